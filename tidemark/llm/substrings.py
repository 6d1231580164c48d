"""Repeated passages: rolling hashes of every window of words, counted in Spark.

Every window of ``width`` words has a Rabin-Karp hash. To keep a passage's
windows together and their shuffle small, a window travels under its anchor,
the smallest hash among the half-width windows inside it: equal windows have
equal anchors, and neighbouring windows mostly share one. Windows of anchors that
a first count shows to be hot are dealt by their own hashes. A task first
merges the windows it sees twice, so a passage of a third of all
documents costs one record for each task that meets it. Windows that also start
earlier go back to their documents and merge into maximal removal intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import SEED, forget_other_stages, partitions

WIDTH = 20
#: Bytes of text that a task works on at a time
SLICE_BYTES = 2 << 20
#: Bytes of text behind one part of the shuffled windows, and of the documents
PART_BYTES = 12 << 20
#: Windows under one anchor that may meet in one part
HOT_WINDOWS = 1 << 16
#: Windows counted to find those anchors
SAMPLE_WINDOWS = 1 << 26
NO_ID = -(1 << 63)
BASE, ROLL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_key(text: bytes | np.ndarray) -> int:
    """Tells texts of one id apart."""
    return xxhash.xxh64_intdigest(text, SEED)


class Words:
    """Words of some texts: byte spans, text of each word, and hashes."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offs = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, dtype=np.uint8)[offs[0] : offs[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
        self.offs = offs - offs[0]
        solid = ~SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, dtype=bool)
        edge[self.offs] = True
        before = np.empty(len(self.data), dtype=bool)
        before[:1], before[1:] = True, ~solid[:-1]
        after = np.empty(len(self.data), dtype=bool)
        after[-1:], after[:-1] = True, ~solid[1:]
        self.starts = np.flatnonzero(solid & (before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.solid = solid
        self.text = np.searchsorted(self.offs, self.starts, side="right") - 1
        # texts without bytes share an offset with the next one; the word belongs to the last of them
        self.counts = np.bincount(self.text, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.counts)])[:-1]

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        lens = self.ends - self.starts
        at = np.cumsum(lens) - lens
        steps = np.full(int(lens.max()), BASE, dtype=np.uint64)
        steps[0] = 1
        power = np.multiply.accumulate(steps)
        inside = np.arange(int(lens.sum())) - np.repeat(at, lens)
        values = (self.data[self.solid].astype(np.uint64) + np.uint64(1)) * power[inside]
        return _mix(np.add.reduceat(values, at) + lens.astype(np.uint64))

    def key(self, i: int) -> int:
        return text_key(self.data[self.offs[i] : self.offs[i + 1]])


def _roll(h: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of each run of ``width``: doubled runs are joined by the bits of the width."""
    n, joined, size = max(len(h) - width + 1, 0), None, 0
    power, run, step = ROLL, h, 1
    while width:
        if width & 1:
            # joined covers the words before, run the step words after them
            joined = run.copy() if joined is None else joined[: len(run) - size] * power + run[size : size + len(joined)]
            size += step
        width >>= 1
        if width:
            run = run[: max(len(run) - step, 0)] * power + run[step:]
            power, step = np.uint64(int(power) ** 2 % (1 << 64)), step * 2
    return joined[:n]


def windows_of(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, hash, anchor hash, anchor's word) of every window that lies in one text."""
    h = words.hashes()
    n = len(h) - width + 1
    if n <= 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z.astype(np.uint64), z.astype(np.uint64), z
    half = max(width // 2, 1)
    grams = _mix(_roll(h, half))
    span = width - half + 1
    least = grams[:n].copy()
    where = np.arange(n)
    for k in range(1, span):
        g = grams[k : k + n]
        less = g < least
        least[less] = g[less]
        where[less] = np.flatnonzero(less) + k
    inside = np.flatnonzero(words.text[:n] == words.text[width - 1 :])
    return inside, _mix(_roll(h, width)[inside]), least[inside], where[inside]


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((_mix(h.copy()) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _later(k1, k2, d, t, s) -> np.ndarray:
    """Indices of the entries whose key also comes with a smaller (d, t, s)."""
    both = k1 ^ (k2.astype(np.uint64) * BASE)
    order = np.argsort(both, kind="stable")
    b = both[order]
    same = np.zeros(len(b), dtype=bool)
    same[1:] = b[1:] == b[:-1]
    twice = same.copy()
    twice[:-1] |= same[1:]
    i = order[twice]
    i = i[np.lexsort((s[i], t[i], d[i], k2[i], k1[i]))]
    if not len(i):
        return i
    new = np.ones(len(i), dtype=bool)
    new[1:] = (k1[i][1:] != k1[i][:-1]) | (k2[i][1:] != k2[i][:-1])
    head = i[np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))]
    # a repeated row meets itself: not earlier
    return i[(d[i] != d[head]) | (t[i] != t[head]) | (s[i] != s[head])]


def _doc_part(d: np.ndarray, t: np.ndarray, parts: int) -> np.ndarray:
    return _part(d.view(np.uint64) ^ (t * ROLL), parts)


BLOB = pa.schema([("part", pa.int32()), ("hits", pa.bool_()), *[(c, pa.binary()) for c in ("a", "d", "t", "s", "c", "w")]])
BLOB_DDL = "part int, hits boolean, a binary, d binary, t binary, s binary, c binary, w binary"


def _hit_rows(d: np.ndarray, t: np.ndarray, s: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Window starts to remove, grouped by document part: each document once with its count, then the starts."""
    if not len(d):
        return
    p = _doc_part(d, t, parts)
    o = np.lexsort((s, t, d, p))
    p, d, t, s = p[o], d[o], t[o], s[o]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1])
    docs = np.flatnonzero(new)
    counts = np.diff(np.append(docs, len(d))).astype(np.uint32)
    edges = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    rows = []
    for a, b in zip(edges, np.append(edges[1:], len(p))):
        x, y = np.searchsorted(docs, [a, b])
        rows.append((int(p[a]), True, b"", d[docs[x:y]].tobytes(), t[docs[x:y]].tobytes(), s[a:b].tobytes(), counts[x:y].tobytes(), b""))
    yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*rows), BLOB)], schema=BLOB)


def _slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each; a longer text comes alone."""
    lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(lens):
        if total and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    if at < batch.num_rows:
        yield batch.slice(at)


def hot_anchors(texts: DataFrame, size: int, width: int, parts: int, most: int = HOT_WINDOWS, sample: int = SAMPLE_WINDOWS) -> np.ndarray:
    """Anchors under which more than ``most`` windows come; beyond 2**20 times that many windows, more than a 2**20th of all.

    So there are about a million at most. Counted in texts drawn by hash with about ``sample`` windows, all texts where that many hold
    them. A task counts the anchors it meets and leaves out those with so few windows that all tasks together lose a quarter of
    the limit. What is hot decides where windows meet, not what is found.
    """
    # a window has a word and a space at least
    rate = min(1.0, 2 * sample / max(size, 1))
    most = max(most, size >> 21) * rate
    least = max(int(most / (4 * parts)), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_other_stages()
        found = [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))]
        for whole in batches:
            for batch in _slices(whole, 0, SLICE_BYTES):
                found.append(np.unique(windows_of(Words(batch.column(0)), width)[2], return_counts=True))
        anchors, n = (np.concatenate(x) for x in zip(*found))
        anchors, inverse = np.unique(anchors, return_inverse=True)
        sums = np.bincount(inverse, weights=n, minlength=len(anchors)).astype(np.int64)
        some = np.flatnonzero(sums >= least)
        yield pa.record_batch([pa.array(anchors[some].view(np.int64)), pa.array(sums[some])], names=["anchor", "n"])

    drawn = texts.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1) if rate < 1 else texts
    found = drawn.select("text").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    return np.array(sorted(r["anchor"] for r in found.select("anchor").collect()), dtype=np.int64).view(np.uint64)


def _send(width: int, parts: int, doc_parts: int, hot: np.ndarray | None = None):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_other_stages()
        for whole in batches:
            for batch in _slices(whole, 1, SLICE_BYTES):
                ids = pc.fill_null(batch.column(0), NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
                words = Words(batch.column(1))
                keys = np.array([words.key(i) for i in range(len(ids))], dtype=np.uint64)
                first, w, a, anchor_at = windows_of(words, width)
                if not len(first):
                    continue
                text = words.text[first]
                d, t = ids[text], keys[text]
                s = (first - words.first[text]).astype(np.uint32)
                later = _later(a, w, d, t, s)
                yield from _hit_rows(d[later], t[later], s[later], doc_parts)
                stay = np.ones(len(d), dtype=bool)
                stay[later] = False
                d, t, s, a, w, first, anchor_at = (x[stay] for x in (d, t, s, a, w, first, anchor_at))
                # a record is a run of windows under one anchor
                new = np.ones(len(d), dtype=bool)
                new[1:] = (anchor_at[1:] != anchor_at[:-1]) | (first[1:] != first[:-1] + 1)
                # and a single window under a hot one
                alone = np.isin(a, hot) if hot is not None and len(hot) else np.zeros(len(d), dtype=bool)
                new |= alone
                new[1:] |= alone[:-1]
                head = np.flatnonzero(new)
                count = np.diff(np.append(head, len(d)))
                part = _part(np.where(alone[head], a[head] ^ w[head], a[head]), parts)
                o = np.lexsort((s[head], t[head], d[head], part))
                head, count, part = head[o], count[o], part[o]
                inner = np.repeat(head - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                values, ends = w[inner], np.concatenate([[0], np.cumsum(count)])
                edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                rows = []
                for x, y in zip(edges, np.append(edges[1:], len(part))):
                    h = head[x:y]
                    rows.append((int(part[x]), False, a[h].tobytes(), d[h].tobytes(), t[h].tobytes(), s[h].tobytes(), count[x:y].astype(np.uint8).tobytes(), values[ends[x] : ends[y]].tobytes()))
                yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*rows), BLOB)], schema=BLOB)

    return send


def _count(doc_parts: int):
    """Finds, part by part, the windows that also start earlier."""

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        join = lambda i, kind: np.frombuffer(b"".join(r[i] for r in rows), dtype=kind)
        a, d, t, s, c, w = (join(i, k) for i, k in enumerate((np.uint64, np.int64, np.uint64, np.uint32, np.uint8, np.uint64)))
        c = c.astype(np.int64)
        of = np.repeat(np.arange(len(a)), c)
        s = s[of] + (np.arange(len(of)) - np.repeat(np.cumsum(c) - c, c)).astype(np.uint32)
        later = _later(a[of], w, d[of], t[of], s)
        of = of[later]
        yield from _hit_rows(d[of], t[of], s[later], doc_parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, part = [], None
        for batch in batches:
            for p, hits, *blobs in zip(*(batch.column(n).to_pylist() for n in BLOB.names)):
                if hits:
                    yield pa.record_batch([pa.array([x], type=f.type) for x, f in zip((p, hits, *blobs), BLOB)], schema=BLOB)
                    continue
                if p != part and rows:
                    yield from settle(rows)
                    rows = []
                part = p
                rows.append(blobs)
        if rows:
            yield from settle(rows)

    return count


def _cut(width: int):
    """Marks the words of each document's later windows and cuts them out."""

    def hits_of(rows: list[tuple]) -> dict[tuple[int, int], list[np.ndarray]]:
        out: dict[tuple[int, int], list[np.ndarray]] = {}
        for d, t, s, c in rows:
            d, t, s, c = np.frombuffer(d, np.int64), np.frombuffer(t, np.uint64), np.frombuffer(s, np.uint32), np.frombuffer(c, np.uint32)
            for k, x in zip(zip(d.tolist(), t.tolist()), np.split(s, np.cumsum(c)[:-1])):
                out.setdefault(k, []).append(x)
        return out

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, part, hits = [], None, {}
        for whole in batches:
            # rows come by part, hits before documents
            kinds = np.array(whole.column("part").to_pylist(), dtype=np.int64) * 2 + np.array([not x for x in whole.column("hits").to_pylist()], dtype=np.int64)
            edges = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]])) if len(kinds) else []
            for x, y in zip(edges, np.append(edges[1:], len(kinds)) if len(kinds) else []):
                run = whole.slice(x, y - x)
                if kinds[x] // 2 != part:
                    part, blobs, hits = kinds[x] // 2, [], None
                if kinds[x] % 2 == 0:
                    blobs += zip(*(run.column(n).to_pylist() for n in ("d", "t", "s", "c")))
                    continue
                if hits is None:
                    hits, blobs = hits_of(blobs), []
                docs = pa.record_batch([run.column("id"), run.column("text"), run.column("row")], names=["id", "text", "row"])
                for batch in _slices(docs, 1, SLICE_BYTES):
                    yield one(batch, hits)

    def one(batch: pa.RecordBatch, hits: dict) -> pa.RecordBatch:
        words = Words(batch.column(1))
        ids = pc.fill_null(batch.column(0), NO_ID).to_pylist()
        given = batch.column(1).to_pylist()
        removed, spans, kept = [], [], []
        for i, n in enumerate(words.counts.tolist()):
            found = hits.get((ids[i], words.key(i))) if n else None
            if not found:
                removed.append(0), spans.append([]), kept.append(given[i])
                continue
            s = np.concatenate(found).astype(np.int64)
            depth = np.bincount(s, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(s + width, n), minlength=n + 1)[: n + 1]
            gone = np.concatenate([[False], np.cumsum(depth)[:n] > 0, [False]])
            turn = np.flatnonzero(gone[1:] != gone[:-1])
            spans.append([{"start": int(a), "length": int(b - a)} for a, b in zip(turn[::2], turn[1::2])])
            removed.append(int(gone.sum()))
            stay = np.concatenate([[0], turn, [n]]).reshape(-1, 2)
            f = words.first[i]
            parts = [words.data[words.starts[f + a] : words.ends[f + b - 1]].tobytes() for a, b in stay.tolist() if b > a]
            kept.append(b" ".join(parts).decode("utf-8"))
        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        return pa.record_batch(
            [batch.column(2), pa.array(words.counts, type=pa.int64()), pa.array(removed, type=pa.int64()), pa.array(spans, type=span), pa.array(kept, type=pa.string())],
            names=["row", "n_words", "n_removed", "removed_spans", "text"],
        )

    return cut


RESULTS = ("n_words", "n_removed", "removed_spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Cuts repeats out of the text column and adds n_words, n_removed and removed_spans (first word, length; maximal).

    A word goes if a window of ``width`` words over it also starts earlier: in a smaller id, or in the same
    document; n_words and spans are of the text before. Kept runs keep their own spacing and are joined by
    one space; a text that loses nothing stays as it is, null stays null. A null id counts as the smallest;
    ids are integers. Rows that repeat an id and its text are one document and get equal results; other rows
    of one id are documents ordered by a 64-bit hash of the text. All other columns stay; those with the names of
    the results are replaced. Windows are compared by 64 bits of hashes, besides those of their anchor. Empty tables give empty results.
    """
    spark = docs.sparkSession
    docs = docs.drop(*RESULTS)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    parts = partitions(spark, size, PART_BYTES)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct(*[c for c in docs.columns if c != text_col], *([] if len(docs.columns) > 1 else [F.lit(1).alias("_")])).alias("row"))
    hot = hot_anchors(texts, size, width, parts) if size > 2 * HOT_WINDOWS else None
    sent = texts.select("id", "text").mapInArrow(_send(width, parts, parts, hot), BLOB_DDL)
    met = sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_count(parts), BLOB_DDL)
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("d", "t", "s", "c")]
    with_part = texts.mapInArrow(_with_part(parts), T.StructType([T.StructField("part", T.IntegerType()), *texts.schema.fields]))
    left = met.select("part", F.lit(True).alias("hits"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast(texts.schema["row"].dataType).alias("row"), "d", "t", "s", "c")
    right = with_part.select("part", F.lit(False).alias("hits"), "id", "text", "row", *nothing)
    dealt = left.union(right).repartition(parts, "part").sortWithinPartitions("part", F.col("hits").desc())
    out = T.StructType([T.StructField("row", texts.schema["row"].dataType)]).add("n_words", "long").add("n_removed", "long")
    out = out.add("removed_spans", T.ArrayType(T.StructType().add("start", "long").add("length", "long"))).add("text", "string")
    cut = dealt.mapInArrow(_cut(width), out)
    return cut.select(*[F.col("text" if c == text_col else f"row.`{c}`").alias(c) for c in docs.columns], *RESULTS)


def _with_part(parts: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pc.fill_null(b.column(0), NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = np.array([text_key((x or "").encode()) for x in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.record_batch([pa.array(_doc_part(ids, keys, parts).astype(np.int32)), *b.columns], names=["part", *b.schema.names])

    return add
