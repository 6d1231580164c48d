"""Near-duplicates by 64-bit SimHash fingerprints.

A fingerprint is eight bytes. Two that differ in at most four bits differ in
at most four bytes, so they share at least four positional bytes. The
byte-position index is read by three positions at once: of any four shared
positions, three form one of 20 fixed triples, so every link meets under some
(triple, bytes) key of 24 bits. Pairs that meet are tallied over all eight
positions, kept at the guaranteed minimum of four matches, and verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SEED, durable, forget_other_stages, partitions
from tidemark.llm.components import connected_components

MAX_BITS = 4
MIN_BYTES = 8 - MAX_BITS
#: Members of one index key that meet in one task; larger keys are met block by block.
BLOCK = 4096
CHUNK = 1 << 16


def triples() -> list[tuple[int, int, int]]:
    """20 triples of the positions 0 to 7 of which every four positions contain one.

    Positions form three rings; a triple lies in one ring, or has two in a ring and one in the next.
    """
    ring = [p * 3 // 8 for p in range(8)]
    fits = lambda t: len({ring[p] for p in t}) == 1 or any(sorted(ring[p] for p in t) == sorted([r, r, (r + 1) % 3]) for r in range(3))
    return [t for t in combinations(range(8), 3) if fits(t)]


TRIPLES = triples()


def fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned SimHash of the word shingles of a text; 0 without words.

    Only A-Z are lower-cased; words are split at the six ASCII spaces. Shingles
    count as often as they occur; a text shorter than a shingle is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [hash64(joined, SEED)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        hashes = [hash64(joined[a:b], SEED) for a, b in zip([0, *ends], [e - 1 for e in ends[width - 1 :]])]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        h = np.array(hashes[i : i + CHUNK], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint_column(text, width: int = 4):
    @F.pandas_udf("long")
    def signed(texts: pd.Series) -> pd.Series:
        forget_other_stages()
        return pd.Series(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))

    return signed(text)


def _forest(x: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that join the same fingerprints as all links among ``x`` would: a breadth-first tree of each component."""
    rest, links = x, []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            u = front.pop()
            diff = rest ^ u
            # tally of shared positional bytes, then the bits themselves
            tally = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = tally >= 8 - max_bits
            near[near] = np.bitwise_count(diff[near]) <= max_bits
            if near.any():
                found = rest[near]
                links += [(int(u), int(v)) for v in found]
                front += list(found)
                rest = rest[~near]
    return links


def _verify(max_bits: int):
    names = ["t", "key", "i", "j", "fp"]

    def links_of(arrays: list[np.ndarray]) -> pa.RecordBatch:
        change = np.zeros(len(arrays[0]), dtype=bool)
        change[0] = True
        for a in arrays[:-1]:
            change[1:] |= a[1:] != a[:-1]
        starts = np.flatnonzero(change)
        sizes = np.diff(np.append(starts, len(change)))
        fp = arrays[-1].view(np.uint64)
        two = starts[sizes == 2]
        diff = fp[two] ^ fp[two + 1]
        near = ((diff.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - max_bits) & (np.bitwise_count(diff) <= max_bits)
        pairs = [np.stack([fp[two][near], fp[two + 1][near]], axis=1)]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            if found := _forest(fp[s : s + n], max_bits):
                pairs.append(np.array(found, dtype=np.uint64))
        p = np.concatenate(pairs).view(np.int64)
        return pa.record_batch([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            if not b.num_rows:
                continue
            arrays = [b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]
            if kept is not None:
                arrays = [np.concatenate([k, a]) for k, a in zip(kept, arrays)]
            last = np.ones(len(arrays[0]), dtype=bool)
            for a in arrays[:-1]:
                last &= a == a[-1]
            # the last key may go on in the next batch
            done = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            kept = [a[done:] for a in arrays]
            if done:
                yield links_of([a[:done] for a in arrays])
        if kept is not None:
            yield links_of(kept)

    return verify


def fingerprint_links(prints: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Distinct ``fp`` -> (a, b) links whose components are those of all links of at most ``max_bits`` bits (up to 4)."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the index guarantees links of up to 4 bits")
    spark = prints.sparkSession
    masks = [sum(0xFF << (8 * p) for p in t) for t in TRIPLES]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)]))
    index = prints.select("fp", keys.alias("k")).select("fp", "k.t", "k.key")
    sizes = index.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = index.join(sizes, ["t", "key"])
    blocks = F.ceil(F.col("n") / block)
    own = F.pmod(F.xxhash64("fp"), blocks)
    met = met.select("t", "key", "fp", own.alias("o"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("p"))
    met = met.select("t", "key", F.least("o", "p").alias("i"), F.greatest("o", "p").alias("j"), "fp")
    group = ["t", "key", "i", "j"]
    dealt = met.repartition(partitions(spark), *group).sortWithinPartitions(*group)
    return dealt.mapInArrow(_verify(max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = MAX_BITS, extra: list | None = None) -> DataFrame:
    """(id, fp, component_id and the ``extra`` columns) for every row.

    component_id is the smallest id reachable over links, the row's own
    included. Null and empty texts have fingerprint 0 and link like others;
    rows of one fingerprint are one node, so copies cost nothing beyond their
    own row; null ids are never the smallest, and a component without ids has
    a null one. An empty table gives an empty result.
    """
    extra = extra or []
    f = durable(docs.select(F.col(id_col).alias("id"), *extra, fingerprint_column(F.col(text_col), width).alias("fp")))
    nodes = f.groupBy("fp").agg(F.min("id").alias("least"))
    nodes = durable(nodes)
    found = connected_components(fingerprint_links(nodes.select("fp"), max_bits)).withColumnRenamed("id", "fp")
    named = nodes.join(found, "fp", "left").withColumn("label", F.coalesce("component", "fp"))
    least = named.where("component is not null").groupBy("label").agg(F.min("least").alias("component_id"))
    by_print = named.join(least, "label", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return f.join(by_print, "fp")


def hex_print(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_per_group(docs: DataFrame, width: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents that stay when one row of each group does: the smallest (id, text hash), its first copy.

    Rows come back with their own columns. Rows of a group with null ids stay
    only where the whole group has none.
    """
    columns = docs.columns
    d = docs.withColumn("_h", F.xxhash64("text"))
    g = near_duplicates(d, "doc_id", "text", width, max_bits, ["_h"])
    w = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "_h")).alias("w")
    first = g.withColumn("group", F.coalesce("component_id", F.lit(0))).groupBy(F.col("component_id").isNull().alias("no_id"), "group", F.when(F.col("component_id").isNull(), F.col("fp")).alias("own")).agg(w)
    stay = first.select(F.col("w.id").alias("_id"), F.col("w._h").alias("_k"))
    joined = d.join(stay, d["doc_id"].eqNullSafe(stay["_id"]) & d["_h"].eqNullSafe(stay["_k"]), "left_semi")
    # repeated rows of the one that stays: keep a single one
    return joined.dropDuplicates(["doc_id", "_h"]).select(*columns)
