"""Quality classifier learned from trusted positives and unlabelled text.

Rows known to be good and the whole unlabelled corpus are enough: with a class
prior the risk of calling text bad is the corpus's minus the positives' part.
That estimate must not fall under zero, so a step that would push it there is
cut back. The prior is estimated from the same two sets. All sums run over all
documents, one pass of Spark for each step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.capfilters import matrix
from tidemark.llm.common import durable, forget_other_stages
from tidemark.llm.substrings import SLICE_BYTES, Words, _slices

THRESHOLD = 0.7
RIDGE = 1e-4
STEPS = 12
LINE = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01)
PRIOR_BINS = 2000
CLASSES = ("upper", "lower", "digit", "bang", "pipe", "symbol", "point", "wide", "line", "space", "control")


def _byte_classes() -> np.ndarray:
    out = np.full(256, CLASSES.index("control"), dtype=np.int64)
    for name, chars in (("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("wide", range(128, 256)), ("bang", b"!"), ("pipe", b"|"), ("symbol", b"#$%&*@^~<>_=+/\\{}[]`"), ("point", b".,;:?'\"()-"), ("line", b"\n\r"), ("space", b" \t\x0b\x0c")):
        out[list(chars)] = CLASSES.index(name)
    return out


BYTE_CLASS = _byte_classes()
N_FEATURES = 26


def features(texts: pa.Array) -> np.ndarray:
    """Style of each text: shares of characters and word shapes, repetition, length. Zeros, but for the shares' defaults, without words."""
    w = Words(texts)
    n = len(texts)
    size = np.diff(w.offs).astype(np.float64)
    of = np.repeat(np.arange(n), np.diff(w.offs))
    kinds = BYTE_CLASS[w.data]
    count = np.bincount(of * len(CLASSES) + kinds, minlength=n * len(CLASSES)).reshape(n, len(CLASSES)).astype(np.float64)
    c = dict(zip(CLASSES, count.T))
    words = w.counts.astype(np.float64)
    per = lambda flags: np.bincount(w.text[flags], minlength=n) / np.maximum(words, 1)
    h = w.hashes()
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (w.text[1:] == w.text[:-1])
    o = np.lexsort((h, w.text))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[o][1:] != h[o][:-1]) | (w.text[o][1:] != w.text[o][:-1])
    distinct = np.bincount(w.text[o][new], minlength=n).astype(np.float64)
    first, last = (BYTE_CLASS[w.data[w.starts]], BYTE_CLASS[w.data[w.ends - 1]]) if len(h) else (np.zeros(0, int), np.zeros(0, int))
    longer = w.ends - w.starts > 1
    second = BYTE_CLASS[w.data[np.minimum(w.starts + 1, np.maximum(w.ends - 1, 0))]] if len(h) else first
    up = CLASSES.index("upper")
    share = lambda x: x / np.maximum(size, 1)
    base = [
        share(c["upper"]), share(c["digit"]), share(c["bang"]), share(c["pipe"]), share(c["symbol"]), share(c["control"]),
        per(again), per((last == CLASSES.index("bang")) | (last == CLASSES.index("symbol"))), per(longer & (first == up) & (second == up)),
    ]
    rest = [
        np.log1p(words), np.log1p(share(size - c["space"] - c["line"]) * size / np.maximum(words, 1)), share(c["point"]), share(c["wide"]), share(c["line"]),
        distinct / np.maximum(words, 1), np.log1p(distinct) / np.maximum(np.log1p(words), 1), per(first == up), (words == 0).astype(np.float64),
    ]
    x = np.stack([*base, *[np.sqrt(b) for b in base[:8]], *rest], axis=1)
    return x


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))


def document_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns but the text, and ``x``, the style of the whole text."""
    rest = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_other_stages()
        for whole in batches:
            for b in _slices(whole, 0, SLICE_BYTES):
                x = features(b.column(0))
                flat = pa.array(x.astype(np.float32).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * N_FEATURES + 1, N_FEATURES, dtype=np.int32)), flat)
                yield pa.record_batch([*b.columns[1:], lists], names=[*rest, "x"])

    schema = docs.select(*rest).schema.add("x", T.ArrayType(T.FloatType()))
    return docs.select(F.col(text_col).cast("string"), *rest).mapInArrow(run, schema)


def _sums(rows: DataFrame, partial) -> np.ndarray:
    """Sum over all rows of what ``partial(x, known)`` gives for a batch; only the sum reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                s = partial(matrix(b.column("x")).astype(np.float64), b.column("known").to_numpy(zero_copy_only=False))
                total = s if total is None else total + s
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    got = rows.select("x", "known").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(got.num_rows)
    out[got["i"].to_numpy()] = got["v"].to_numpy()
    return out


def _step(z: np.ndarray) -> np.ndarray:
    """log(1 + exp(z)), the loss of calling a margin ``z`` negative."""
    return np.logaddexp(0, z)


def _minimise(rows: DataFrame, model: QualityModel, prior: float, n_u: float, n_p: float) -> None:
    """Newton steps on the non-negative risk; positives weigh ``prior``, the unlabelled corpus 1.

    A prior under which the corpus would hold less than no bad text is lowered to the largest one that keeps
    the estimated risk of the bad at zero.
    """

    def design(x: np.ndarray) -> np.ndarray:
        z = np.clip((x - model.mean) / model.scale, -8, 8)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    d = N_FEATURES + 1
    for _ in range(STEPS):
        w = model.weights.copy()

        def slope(x: np.ndarray, known: np.ndarray) -> np.ndarray:
            z = design(x)
            p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
            return np.concatenate([z.T @ p, z[known].sum(axis=0), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])

        s = _sums(rows, slope)
        # the positives' two losses differ by the margin itself, so their part of the risk is linear
        ridge = (RIDGE + 1.0 / n_p) * np.append(np.ones(d - 1), 0.0)
        gradient = s[:d] / n_u - prior * s[d : 2 * d] / n_p + ridge * w
        hessian = s[2 * d :].reshape(d, d) / n_u + np.diag(ridge + 1e-9)
        move = np.linalg.solve(hessian, gradient)

        def risks(x: np.ndarray, known: np.ndarray) -> np.ndarray:
            out = []
            for t in (0.0, *LINE):
                g = design(x) @ (w - t * move)
                out += [_step(g).sum(), _step(g[known]).sum(), _step(-g[known]).sum()]
            return np.array(out)

        r = _sums(rows, risks).reshape(-1, 3)
        negative = r[:, 0] / n_u - prior * r[:, 1] / n_p
        sizes = np.array([0.0, *LINE])
        value = prior * r[:, 2] / n_p + np.maximum(negative, 0) + np.array([(ridge * (w - t * move) ** 2).sum() / 2 for t in sizes])
        best = int(value.argmin())
        lower = min(prior, (r[best, 0] / n_u) / (r[best, 1] / n_p))
        if (best == 0 or value[0] - value[best] < 1e-7) and prior - lower < 1e-6:
            break
        model.weights, prior = w - sizes[best] * move, lower
    model.prior = prior


def _prior(rows: DataFrame, model: QualityModel, n_u: float, n_p: float) -> float:
    """Least ratio of the corpus's to the positives' share above a margin: where hardly anything bad is above, it is the prior.

    Shares come from a histogram over all rows and are widened by their sampling error, since the least of many
    ratios falls short of the prior where positives are few.
    """

    def histogram(x: np.ndarray, known: np.ndarray) -> np.ndarray:
        i = np.minimum((model.score(x) * PRIOR_BINS).astype(np.int64), PRIOR_BINS - 1)
        return np.concatenate([np.bincount(i, minlength=PRIOR_BINS), np.bincount(i[known], minlength=PRIOR_BINS)]).astype(np.float64)

    h = _sums(rows, histogram).reshape(2, -1)
    u, p = (np.cumsum(x[::-1])[::-1] / n for x, n in zip(h, (n_u, n_p)))
    use = p > 0.5
    ratio = (u[use] + np.sqrt(u[use] * (1 - u[use]) / n_u)) / (p[use] - np.sqrt(p[use] * (1 - p[use]) / n_p))
    return float(np.clip(ratio.min(), 0.05, 0.99))


def fit_quality(rows: DataFrame) -> QualityModel:
    """``rows``: x and boolean ``known`` (a trusted positive) of every document.

    First a plain model of positives against the corpus gives the prior, then the risk is minimised with it. Without
    rows or without positives every score is 0.5.
    """
    moments = _sums(rows, lambda x, known: np.concatenate([[len(x), known.sum()], x.sum(axis=0), (x * x).sum(axis=0)]))
    if not len(moments) or not moments[1]:
        return QualityModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1), 0.5)
    n_u, n_p = moments[:2]
    mean = moments[2 : 2 + N_FEATURES] / n_u
    spread = np.sqrt(np.maximum(moments[2 + N_FEATURES :] / n_u - mean**2, 0))
    model = QualityModel(mean, np.where(spread > 1e-6, spread, 1.0), np.zeros(N_FEATURES + 1), 0.5)
    _minimise(rows, model, 0.5, n_u, n_p)
    _minimise(rows, model, _prior(rows, model, n_u, n_p), n_u, n_p)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep_text: bool = False) -> DataFrame:
    """Adds held_out, score in [0, 1] and predicted (score >= ``threshold``) to every row.

    A row is a trusted positive if all its labels of ``quality`` are 1 and it is not held out by its id. Scores depend on the text alone; null and
    empty texts are scored like any other. Rows with null ids have no label. Existing columns of the result names are replaced.
    The text column is left out unless ``keep_text``, which scores the text in a second pass instead of shuffling it.
    """
    docs = docs.drop("held_out", "score", "predicted", "x")
    good = labels.groupBy(F.col("doc_id").alias("_label_id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("_quality"))
    wanted = [F.col(id_col)] if keep_text else [F.col(c) for c in docs.columns if c != text_col]
    rows = document_features(docs.select(text_col, *wanted), text_col)
    rows = rows.withColumn("held_out", held_out(F.col(id_col))).join(good, F.col(id_col) == F.col("_label_id"), "left")
    rows = durable(rows.withColumn("known", F.coalesce((F.col("_quality") == 1) & ~F.col("held_out"), F.lit(False))).drop("_label_id", "_quality"))
    model = fit_quality(rows)
    if keep_text:
        @F.arrow_udf("double")
        def score(texts: pa.Array) -> pa.Array:
            forget_other_stages()
            t = pa.table({"t": texts}).to_batches()
            parts = [model.score(features(b.column(0)).astype(np.float32).astype(np.float64)) for whole in t for b in _slices(whole, 0, SLICE_BYTES)]
            return pa.array(np.concatenate(parts) if parts else np.zeros(0))

        out = docs.withColumn("held_out", held_out(F.col(id_col))).withColumn("score", score(F.col(text_col).cast("string")))
    else:
        @F.arrow_udf("double")
        def score(x: pa.Array) -> pa.Array:
            return pa.array(model.score(matrix(x).astype(np.float64)) if len(x) else np.zeros(0))

        out = rows.withColumn("score", score("x")).drop("x", "known")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
