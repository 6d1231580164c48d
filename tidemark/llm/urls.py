"""URL filter by the ratio of two character language models.

Two smoothed variable-order Markov models over URL bytes, one of accepted and
one of rejected URLs, are counted by Spark over all URLs that a rule decides.
The counts are a table that grows with the corpus; slices of URLs join the
distinct grams they hold to it.
A URL passes when the length-normalised difference of its log-likelihoods
reaches a threshold calibrated on the same URLs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable

#: (host, path, verdict); a rule also fits the subdomains of its host
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = 5
#: Bits of a gram's key; at 64 keys are exact
KEY_BITS = 64
#: Bytes of URLs that ask for their counts together; a longer URL asks alone
SLICE_BYTES = 1 << 16
CALIBRATION_BINS = 4096


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or a URL without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def _grams(urls: list[bytes], order: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of every byte's contexts and of the contexts followed by the byte, for orders 0 to ``order``.

    Returns (row of each byte, valid flags, context keys, gram keys); the
    last three have one line for each order. A context never reaches over the
    start of its URL; the start itself counts as a byte. Order, kind and up to seven bytes fill
    a 64-bit key that is spread one to one; fewer ``bits`` keep its upper part.
    """
    if not 0 <= order <= 6:
        raise ValueError("keys hold contexts of up to 6 bytes")
    lens = np.array([len(u) + 1 for u in urls], dtype=np.int64)
    buf = np.frombuffer(b"\x00" + b"\x00".join(urls) if urls else b"", dtype=np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(urls)), lens)
    at = np.arange(len(buf)) - np.repeat(np.cumsum(lens) - lens, lens)
    spread = lambda h: (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    valid, ctx_keys, gram_keys = [], [], []
    ctx = np.zeros(len(buf), dtype=np.uint64)
    for k in range(order + 1):
        if k:
            back = np.zeros(len(buf), dtype=np.uint64)
            back[k:] = buf[:-k] if k < len(buf) else buf[:0]
            ctx = ctx | (back << np.uint64(8 * (k - 1)))
        valid.append((at >= k) & (at > 0))
        ctx_keys.append(spread(ctx | np.uint64(k << 58)))
        gram_keys.append(spread((ctx << np.uint64(8)) | buf | np.uint64(k << 58 | 1 << 57)))
    return row, np.array(valid), np.array(ctx_keys), np.array(gram_keys)


def _encode(urls: list[str | None]) -> list[bytes]:
    return [(u or "").encode("utf-8", "surrogatepass") for u in urls]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ends = np.array([len(u) for u in _encode(batch.column(0).to_pylist())], dtype=np.int64).cumsum() // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def gram_counts(urls: DataFrame, label: str, order: int = ORDER, bits: int = KEY_BITS) -> DataFrame:
    """key -> (n0, n1), the times it comes in URLs of each class; a row for each context and gram of all URLs.

    Each slice adds up its own URLs and tasks add up their slices, so a host with a third of all rows
    costs no more than any other.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole):
                labels = np.array(b.column(1).to_pylist(), dtype=np.int64)
                row, valid, ctx, gram = _grams(_encode(b.column(0).to_pylist()), order, bits)
                y = np.broadcast_to(labels[row], valid.shape)[valid]
                keys, of = np.unique(np.concatenate([ctx[valid], gram[valid]]), return_inverse=True)
                ones = np.bincount(of, weights=np.concatenate([y, y]), minlength=len(keys)).astype(np.int64)
                both = np.bincount(of, minlength=len(keys))
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(both - ones), pa.array(ones)], names=["key", "n0", "n1"])

    pairs = urls.select("url", F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    return pairs.mapInArrow(count, "key long, n0 long, n1 long").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _log_ratio(urls: list[bytes], order: int, bits: int, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean over the bytes of log P(accepted) - log P(rejected); 0 for an empty URL. ``counts`` has a line for each class."""
    o = np.argsort(keys)
    keys, counts = keys[o], counts[:, o]

    def look(wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros((2, len(wanted)))
        i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return counts[:, i] * (keys[i] == wanted)

    row, valid, ctx, gram = _grams(urls, order, bits)
    p = np.full((2, len(row)), 1 / 256)
    for k in range(order + 1):
        # a context seen often is trusted more than the shorter one below it
        seen, hit = look(ctx[k]), look(gram[k])
        p = np.where(valid[k], (np.minimum(hit, seen) + 4.0 * p) / (seen + 4.0), p)
    log = np.log(p)
    use = valid[0]
    lens = np.bincount(row[use], minlength=len(urls))
    return np.bincount(row[use], weights=(log[1] - log[0])[use], minlength=len(urls)) / np.maximum(lens, 1)


def _wanted(urls: list[bytes], order: int, bits: int) -> np.ndarray:
    _, valid, ctx, gram = _grams(urls, order, bits)
    return np.unique(np.concatenate([ctx[valid], gram[valid]]))


@dataclass
class UrlModel:
    """Counts of both classes, as a table of (key, n0, n1), and the threshold."""

    counts: DataFrame
    order: int
    bits: int
    threshold: float = 0.0

    def score(self, urls: list[bytes]) -> np.ndarray:
        """Scores of a few URLs on the driver."""
        wanted = _wanted(urls, self.order, self.bits).view(np.int64).tolist()
        got = self.counts.where(F.col("key").isin(wanted)).toArrow() if wanted else None
        if got is None:
            return np.zeros(len(urls))
        return _log_ratio(urls, self.order, self.bits, got["key"].to_numpy().view(np.uint64), np.array([got["n0"].to_numpy(), got["n1"].to_numpy()]))

    def scores(self, urls: DataFrame) -> DataFrame:
        """(url, url_score) of the distinct URLs of a column ``url``; null ones are left out.

        A slice of URLs asks for each key once, so a key that is in every URL is asked for once a slice.
        """
        order, bits = self.order, self.bits

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = TaskContext.get().partitionId() << 32
            for whole in batches:
                for b in _slices(whole):
                    yield pa.record_batch([pa.array(np.full(b.num_rows, n)), b.column(0)], names=["slice", "url"])
                    n += 1

        # slices are numbered once
        dealt = durable(urls.select("url").where("url is not null").distinct().mapInArrow(deal, "slice long, url string"))

        def ask(table: pa.Table) -> pa.Table:
            keys = _wanted(_encode(table["url"].to_pylist()), order, bits)
            return pa.table({"slice": pa.array(np.full(len(keys), table["slice"][0].as_py())), "key": pa.array(keys.view(np.int64))})

        def answer(mine: pa.Table, found: pa.Table) -> pa.Table:
            keys = found["key"].to_numpy().view(np.uint64)
            scored = _log_ratio(_encode(mine["url"].to_pylist()), order, bits, keys, np.array([found["n0"].to_numpy(), found["n1"].to_numpy()]))
            return pa.table({"url": mine["url"], "url_score": pa.array(scored)})

        asked = dealt.groupBy("slice").applyInArrow(ask, "slice long, key long")
        found = asked.join(self.counts, "key").select("slice", "key", "n0", "n1")
        return dealt.groupBy("slice").cogroup(found.groupBy("slice")).applyInArrow(answer, "url string, url_score double")


def _threshold(scored: DataFrame, label: str) -> float:
    """The score with the best balanced accuracy over a histogram of all rows; 0 without rows of both classes."""
    step = 8.0 / CALIBRATION_BINS
    bins = scored.groupBy(F.col(label).cast("int").alias("y"), F.floor((F.greatest(F.lit(-4.0), F.least(F.lit(3.999), "url_score")) + 4.0) / step).alias("bin")).count().collect()
    hist = np.zeros((2, CALIBRATION_BINS))
    for r in bins:
        hist[r["y"], r["bin"]] += r["count"]
    if not hist.sum(1).all():
        return 0.0
    below = np.concatenate([[0], hist[0].cumsum()]) / hist[0].sum()
    above = 1 - np.concatenate([[0], hist[1].cumsum()]) / hist[1].sum()
    balanced = below + above
    best = np.flatnonzero(balanced >= balanced.max() - 1e-12)
    return float(best[len(best) // 2] * step - 4.0)


def fit_url_model(urls: DataFrame, label: str = "label", order: int = ORDER, bits: int = KEY_BITS) -> UrlModel:
    """Fit on all rows of (url string, label 0/1).

    The counts stay a table in Spark; only a histogram comes to the driver. The threshold is the score
    with the best balanced accuracy over a histogram of all training scores,
    so repeated URLs count as often as they occur. Without URLs of both classes the
    threshold is 0 and the untrained class stays uniform.
    """
    known = urls.where("url is not null")
    model = UrlModel(durable(gram_counts(known, label, order, bits)), order, bits)
    model.threshold = _threshold(known.join(model.scores(known), "url"), label)
    return model


def filter_urls(pages: DataFrame, rules=RULES, order: int = ORDER, bits: int = KEY_BITS, url_col: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict and url_score to every row; existing columns of these names are replaced.

    The rule with the longest text decides where one fits; all other rows get the verdict of the
    models trained on what the rules decide. Null and empty URLs and those
    without ``://`` score 0 like a URL both models like equally. An empty table
    gives an empty result; with no accepted or no rejected URL to learn from, the
    trained side alone decides against a uniform one.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "url_score")]
    d = pages.select(*keep)
    host, path = split_url(F.col(url_col))
    d = d.withColumn("host", host).withColumn("path", path)
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    d = d.withColumn("rule", text).withColumn("_decided", verdict)
    seen = d.where("_decided is not null").select(F.col(url_col).alias("url"), (F.col("_decided") == "allow").cast("int").alias("label"))
    model = UrlModel(durable(gram_counts(seen.where("url is not null"), "label", order, bits)), order, bits)
    scores = durable(model.scores(d.select(F.col(url_col).alias("url"))).withColumnRenamed("url", "_url"))
    scored = d.join(scores, F.col(url_col) == F.col("_url"), "left").withColumn("url_score", F.coalesce("url_score", F.lit(0.0)))
    model.threshold = _threshold(scored.where(f"_decided is not null and `{url_col}` is not null").withColumn("label", F.col("_decided") == "allow"), "label")
    said = F.when(F.col("url_score") >= F.lit(model.threshold), "allow").otherwise("block")
    return scored.withColumn("verdict", F.coalesce("_decided", said)).select(*keep, "host", "path", "rule", "url_score", "verdict")
