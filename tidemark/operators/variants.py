"""Parameter variants and their replay.

A grid is a table of variants; a replay joins every series with chunks of
variants and advances all lanes of a chunk through the calendar together, one
vector step per day. Series are collected once and copied once per chunk (not
per variant), tasks are (series, chunk) pairs, and only moments leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.fold import FEE, FLOOR, RULES, day_arrays
from tidemark.session import fan_join, spread

SWITCHES = {"use_credit": 1.0, "use_vol": 1.0, "use_ratio": 1.0, "use_liq": 0.0, "credit_hold": 0.0, "cr_lev": 1.0}
DEFAULTS = {**RULES, **SWITCHES}
# Axes of the published six-parameter sweep (17,250 valid combinations).
PUBLISHED_GRID = {
    "z_trigger": [0.8, 1.0, 1.2, 1.5, 1.8, 2.0],
    "z_recover": [-0.5, 0.0, 0.2, 0.5, 0.7],
    "vz_trigger": [0.5, 1.0, 1.5, 1.8, 2.0],
    "vz_recover": [-0.5, 0.0, 0.3, 0.5, 0.8],
    "inf_trigger": [1.5, 2.0, 2.5, 3.0, 3.5],
    "inf_recover": [-0.5, 0.0, 0.3, 0.5, 1.0],
}
SERIES = ["r", "gap", "intra", "rate", "z", "vz", "iz", "nlz", "master"]


class Variants(NamedTuple):
    """Parameter table and the upper bound of its variant ids."""

    table: DataFrame
    size: int


def listed(spark: SparkSession, rows: list[dict]) -> Variants:
    """Variants from explicit overrides; everything else keeps the defaults."""
    full = [{**DEFAULTS, **r} for r in rows]
    schema = "variant_id bigint, " + ", ".join(f"{k} double" for k in DEFAULTS)
    data = [(i, *[float(v[k]) for k in DEFAULTS]) for i, v in enumerate(full)]
    return Variants(spark.createDataFrame(data, schema), len(data))


def grid(spark: SparkSession, axes: dict[str, list[float]]) -> Variants:
    """Cartesian grid with a positional variant_id; each trigger must exceed its recover level."""
    df, stride, vid = spark.range(1), 1, F.lit(0).cast("bigint")
    for name, values in axes.items():
        df = df.select("*", F.posexplode(F.array(*[F.lit(float(v)) for v in values])).alias(f"__{name}", name))
        vid = vid + F.col(f"__{name}") * stride
        stride *= len(values)
    df = df.select(vid.alias("variant_id"), *axes)
    df = df.withColumns({k: F.lit(float(v)) for k, v in DEFAULTS.items() if k not in axes})
    return Variants(df.where("z_trigger > z_recover and vz_trigger > vz_recover and inf_trigger > inf_recover"), stride)


def _fan_out(sig: DataFrame, variants: Variants, by: list[str], chunk: int, period) -> DataFrame:
    """One row per (series, variant chunk) with the day arrays and the chunk's parameters."""
    filled = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("r", "gap", "intra")}
    rate = F.when(F.col("rate").isNull(), F.raise_error(F.lit("rate must not be NULL"))).otherwise(F.col("rate"))
    nan = {c: F.coalesce(F.col(c), F.lit(float("nan"))) for c in ("z", "vz", "iz", "nlz")}
    cols = {**filled, "rate": rate, **nan, "master": F.col("master").cast("double")}
    per = F.lit(None).cast("int") if period is None else period
    d = sig.select(*by, "ts", *[c.alias(n) for n, c in cols.items()], F.coalesce(per, F.lit(-1)).cast("double").alias("period"))
    arr = day_arrays(d, by, [*SERIES, "period"])
    arr = arr.select(*by, *[F.col(f"days.{c}").alias(c) for c in [*SERIES, "period"]])
    v = variants.table.withColumn("chunk", F.floor(F.col("variant_id") / chunk))
    v = v.groupBy("chunk").agg(F.collect_list(F.struct("variant_id", *DEFAULTS)).alias("lanes"))
    n_chunks = (variants.size - 1) // chunk + 1
    fan = arr.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)).cast("array<bigint>")))
    fan = fan_join(fan, v, ["chunk"])
    fan = fan.select(*by, "chunk", *[F.col(f"lanes.{c}").alias(f"v_{c}") for c in ["variant_id", *DEFAULTS]], *SERIES, "period")
    return spread(fan, *by, "chunk")


def _lanes(row: dict) -> tuple[dict, dict, np.ndarray]:
    day = {c: np.asarray(row[c], dtype=float) for c in [*SERIES, "period"]}
    return day, {c: np.asarray(row[f"v_{c}"], dtype=float) for c in DEFAULTS}, np.asarray(row["v_variant_id"], dtype=np.int64)


def _ddl(sig: DataFrame, by: list[str], rest: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sig.select(*by).schema) + ", variant_id bigint, " + rest


def replay(sig: DataFrame, variants: Variants, by: tuple[str, ...] = ("symbol",), chunk: int = 2048, period=None) -> DataFrame:
    """One row per (series, variant, period) with n, final, cagr, mdd, both Sharpes, trades.

    ``period`` is an optional integer column; rows outside any period carry NULL.
    The whole history is reported as period -1.
    """
    by = list(by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                day, params, ids = _lanes(row)
                out, _ = _advance(day, params)
                yield out.assign(**{b: row[b] for b in by}, variant_id=np.tile(ids, len(out) // len(ids)))

    cols = "period int, n int, final double, cagr double, mdd double, sharpe1 double, sharpe0 double, trades int, in_market double"
    return _fan_out(sig, variants, by, chunk, period).mapInPandas(run, _ddl(sig, by, cols))


def equity_paths(sig: DataFrame, variants: Variants, by: tuple[str, ...] = ("symbol",), chunk: int = 16) -> DataFrame:
    """Daily equity and leverage per (series, variant): ``pos`` counts days from 1."""
    by = list(by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                day, params, ids = _lanes(row)
                _, path = _advance(day, params, keep_path=True)
                eq, lev = (np.stack([p[k] for p in path]) for k in (0, 1))
                for j, v in enumerate(ids):
                    one = pd.DataFrame({"pos": np.arange(1, len(path) + 1), "eq": eq[:, j], "lev": lev[:, j]})
                    yield one.assign(**{b: row[b] for b in by}, variant_id=v)

    return _fan_out(sig, variants, by, chunk, None).mapInPandas(run, _ddl(sig, by, "pos bigint, eq double, lev double"))


class _Moments:
    """Running return moments of a slice of the equity paths of all lanes."""

    def __init__(self, lanes: int):
        self.n, self.first, self.last, self.peak = 0, None, None, None
        self.s, self.q, self.mdd = np.zeros(lanes), np.zeros(lanes), np.ones(lanes)

    def add(self, eq, r, rr):
        """``r`` is the day's return and ``rr`` its square; the first day of a slice has none."""
        if self.n == 0:
            self.first = self.peak = eq
        else:
            self.s += r
            self.q += rr
            self.peak = np.maximum(self.peak, eq)
            np.minimum(self.mdd, eq / self.peak, out=self.mdd)
        self.last, self.n = eq, self.n + 1

    def frame(self, period: int) -> dict:
        m = max(self.n - 1, 1)
        mean, ss = self.s / m, np.maximum(self.q - self.s * self.s / m, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            sh = {f"sharpe{d}": np.where(ss > 0, mean / np.sqrt(ss / max(m - d, 1)) * np.sqrt(252.0), 0.0) for d in (1, 0)}
        return {"period": period, "n": self.n, "final": self.last / self.first, "cagr": (self.last / self.first) ** (252.0 / self.n) - 1, "mdd": self.mdd - 1, **sh}


def _advance(day: dict, p: dict, keep_path: bool = False) -> tuple[pd.DataFrame, list]:
    """Step all variant lanes of one series through its days."""
    k = len(p["tc_bps"])
    eq, lev, basis = np.ones(k), np.full(k, 3.0), np.ones(k)
    pend, ret, sq = lev, 0.0, 0.0
    held = np.zeros(k, bool)
    trades, inside = np.zeros(k, int), np.zeros(k)
    guards = [  # (series, latch mask per lane, on-compare, off-compare, leverage once on)
        ("nlz", p["use_liq"] > 0, p["nl_trigger"], p["nl_recover"], p["nl_lev"], -1),
        ("vz", p["use_vol"] > 0, p["vz_trigger"], p["vz_recover"], p["vz_lev"], 1),
        ("iz", p["use_ratio"] > 0, p["inf_trigger"], p["inf_recover"], p["inf_lev"], 1),
        ("z", p["use_credit"] > 0, p["z_trigger"], p["z_recover"], p["cr_lev"], 1),
    ]
    guards = [g for g in guards if g[1].any()]
    on = {g[0]: np.zeros(k, bool) for g in guards}
    keep = p["credit_hold"] > 0
    cost_unit = p["tc_bps"] / 1e4
    total, parts, path = _Moments(k), {}, []
    for i in range(len(day["r"])):
        new = pend
        moved = new != lev
        win = held & (eq > basis)
        target = np.full(k, 3.0)
        if day["master"][i] == 0:
            on = {s: np.zeros(k, bool) for s in on}
            target[:] = 0.0
        else:
            for name, used, hi, lo, tlev, sign in guards:  # later guards outrank earlier ones
                x = sign * day[name][i]
                if x == x:
                    on[name] = used & ((x > sign * hi) | (on[name] & ~(x < sign * lo)))
                loss = np.where(keep, new, 3.0) if name == "z" else new
                target = np.where(on[name], np.where(win, tlev, loss), target)
        grow = (lev > 0) & (new > lev)
        basis = np.where((new > 0) & ~held, eq, np.where(grow, (basis * lev + eq * (new - lev)) / np.where(new > 0, new, 1.0), basis))
        held = new > 0
        trades += moved
        if i > 0:
            r, g, a, f = day["r"][i], day["gap"][i], day["intra"][i], day["rate"][i]
            gross = np.where(moved, (1 + lev * g) * (1 + new * a) - 1, new * r)
            drag = np.where(new > 1, (new - 1) * f + FEE / 252 * np.minimum(new / 3, 1.0), 0.0)
            before = eq
            eq = np.maximum(eq * (1 + gross - drag + np.where(new == 0, f, 0.0) - np.abs(new - lev) * cost_unit), FLOOR)
            ret = eq / before - 1
            sq = ret * ret
        lev, pend = new, target
        inside += lev > 0
        total.add(eq, ret, sq)
        if keep_path:
            path.append((eq, lev))
        if day["period"][i] >= 0:
            parts.setdefault(int(day["period"][i]), _Moments(k)).add(eq, ret, sq)
    extra = {"trades": trades, "in_market": inside / max(total.n, 1)}
    rows = [pd.DataFrame({**m.frame(c), **extra}) for c, m in [(-1, total), *sorted(parts.items())]]
    return pd.concat(rows, ignore_index=True), path
