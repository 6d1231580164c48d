"""The ten operators against brute force, and on odd rows: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from compare import check, connect
from tidemark.llm import ORACLE, QUERIES, ann, capfilters, chat, mixing, packing, quality, sharding, simhash, substrings, urls
from tidemark.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}" for i in range(40_000))
ODD = [
    (1, "one two three four five", "en", "a", 23), (1, "one two three four five", "en", "a", 23), (None, "no id here", "en", "a", 10),
    (2, None, "en", "b", None), (3, "", None, None, 0), (4, " \t\n", "en", None, 3), (5, LONG, "en", "a", len(LONG)), (6, LONG + " tail", "en", "c", 0),
    (7, "Ünï cödé ÇA \x0b va", "fr", "b", 15), (7, "same id, other text", "fr", "b", 19), (8, "ONE two three four five", "en", "", 23),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def components(n, pairs):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("name", list(ORACLE))
def test_sql(spark, sf_dir, name):
    ok, msg, _ = check(spark, connect(sf_dir), name, QUERIES[name], ORACLE[name], sf_dir)
    assert ok, msg


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(500, 560)]
    want = components(600, pairs)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: want[i] for a, b in pairs for i in (a, b) if a != b}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 SimHash


def slow_print(text, width=4):
    words = (text or "").encode()
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in words.decode()).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < width else [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_matches_all_pairs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = {r["doc_id"]: slow_print(r["text"]) for r in rows}
    got = {r["doc_id"]: r for r in QUERIES["op1_simhash_near_dedup"](spark, sf_dir).collect()}
    assert {k: int(v["fingerprint"], 16) for k, v in got.items()} == prints and all(len(v["fingerprint"]) == 16 for v in got.values())
    ids = sorted(prints)
    links = [(i, j) for i in range(len(ids)) for j in range(i) if (prints[ids[i]] ^ prints[ids[j]]).bit_count() <= 4]
    assert [got[i]["component_id"] for i in ids] == [ids[c] for c in components(len(ids), links)]


def test_links_in_blocks_lose_nothing(spark):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 1 << 63))
    prints = {centre}
    for _ in range(300):
        x = centre
        for b in rng.choice(64, size=int(rng.integers(1, 7)), replace=False):
            x ^= 1 << int(b)
        prints.add(x)
    prints = sorted(prints | {int(v) for v in rng.integers(0, 1 << 63, 200)})
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    want = components(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    for block in (16, 4096):
        at = {s: i for i, s in enumerate(signed)}
        got = [(at[r["a"]], at[r["b"]]) for r in simhash.fingerprint_links(df, 4, block).collect()]
        assert components(len(prints), got) == want
        assert all((prints[a] ^ prints[b]).bit_count() <= 4 for a, b in got)


def test_every_four_positions_hold_a_triple():
    from itertools import combinations

    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(q) for t in simhash.TRIPLES) for q in combinations(range(8), 4))


def test_simhash_odd(spark, odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append(r)
    assert by[2][0]["fp"] == by[3][0]["fp"] == by[4][0]["fp"] == 0 and {by[i][0]["component_id"] for i in (2, 3, 4)} == {2}
    assert by[8][0]["component_id"] == by[1][0]["component_id"] == 1
    assert by[None][0]["component_id"] is None
    kept = simhash.one_per_group(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 8 not in ids and ids.count(2) == 1 and 3 not in ids and None in ids and 5 in ids
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_per_group(none).count() == 0
    assert simhash.fingerprint(LONG) == slow_print(LONG)


# 2 sharding


def test_shards_hold_the_mixture(spark, sf_dir):
    rows = QUERIES["op2_sharding"](spark, sf_dir).collect()
    n = len(rows)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted(texts) == sorted(r["doc_id"] for r in rows)
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in rows)
    per = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(16)]
    assert all(p == list(range(len(p))) for p in per) and {len(p) for p in per} <= {n // 16, n // 16 + 1}
    for source in {r["source"] for r in rows}:
        total = sum(r["source"] == source for r in rows)
        for s in range(16):
            assert abs(sum(r["source"] == source and r["shard"] == s for r in rows) - total * len(per[s]) / n) <= 2


@pytest.mark.parametrize("slice_rows", [3, 50_000])
def test_interleaving_equals_one_sort(spark, slice_rows):
    data = [(i, f"s{i * i % 7}" if i % 5 else None) for i in range(200)]
    d = sharding.interleaved(spark.createDataFrame(data, "doc_id long, source string"), "source", ["doc_id"], 1, slice_rows)
    rows = d.collect()
    assert sorted(r["position"] for r in rows) == list(range(200))
    whole = sharding.interleaved(spark.createDataFrame(data, "doc_id long, source string"), "source", ["doc_id"], 1, 10**6).collect()
    assert {r["doc_id"]: r["position"] for r in rows} == {r["doc_id"]: r["position"] for r in whole}


def test_sharding_odd(odd, none):
    d = sharding.shard(odd.withColumn("slot", odd["doc_id"]), 4, "source", ("doc_id", "text"))
    rows = d.collect()
    assert len(rows) == len(ODD) and sorted(r["position"] for r in rows) == list(range(len(ODD))) and d.columns.count("slot") == 1
    assert sharding.shard(none, 4).count() == 0
    assert len({r["shard"] for r in sharding.shard(odd.limit(2), 8).collect()}) == 2


# 3 nearest neighbours


def test_neighbours_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    got = QUERIES["op3_nearest_neighbours"](spark, sf_dir).collect()
    hit, total = 0, 0
    for q in ids[ids % 50 == 0]:
        s = np.array([(v * x[ids == q][0]).sum() / math.sqrt((v * v).sum() * (x[ids == q][0] ** 2).sum()) for v in x])
        s[ids == q] = -2
        want = ids[np.lexsort((ids, -s))[:5]]
        mine = sorted([r for r in got if r["query_id"] == q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(want) + 1))
        assert all(abs(r["score"] - s[ids == r["vec_id"]][0]) < 1e-12 for r in mine)
        hit, total = hit + len(set(want.tolist()) & {r["vec_id"] for r in mine}), total + len(want)
    assert hit / total >= 0.9


def test_neighbours_come_from_the_lists(spark):
    rng = np.random.default_rng(11)
    x = np.repeat(rng.standard_normal((40, 16)), 50, axis=0) + 0.5 * rng.standard_normal((2000, 16))
    u = capfilters.unit(x)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id % 40 = 0")

    def recall_of(got):
        mine = {}
        for r in got.collect():
            mine.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert all(len(mine[q]) == 5 for q in range(0, 2000, 40))
        near = u @ u.T
        np.fill_diagonal(near, -2)
        return sum(len(mine[q] & set(np.argsort(-near[q])[:5].tolist())) for q in range(0, 2000, 40)) / 250

    # one list alone cannot hold all neighbours, though the sample holds all rows
    assert recall_of(ann.nearest(rows, asked, recall=0.01)) < 1
    assert recall_of(ann.nearest(rows, asked, sample_rows=200)) >= 0.9


def test_neighbours_odd(spark):
    v = [1.0, 2.0, 3.0]
    data = [(0, v), (1, v), (2, [2.0, 4.0, 6.0]), (3, v), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 1.0]), (8, [1.0, 0.0, 0.0]), (None, v), (9, [1.0]), (0, v), (10, [])]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = ann.nearest(rows, rows.where("vec_id in (0, 5, 8, 9)")).collect()
    mine = sorted([r for r in got if r["query_id"] == 0], key=lambda r: r["rank"])
    assert [r["vec_id"] for r in mine] == [1, 2, 3, None, 8]
    assert {r["query_id"] for r in got} == {0, 8}
    assert ann.nearest(rows.limit(0), rows).count() == 0 and ann.nearest(rows, rows.limit(0)).count() == 0


def test_scan_keeps_true_neighbours():
    rng = np.random.default_rng(3)
    x = capfilters.unit(rng.standard_normal((2000, 64))).astype(np.float32)
    q = x[:20]
    bound = np.sort(((q[:, None] - x[None]) ** 2).sum(-1), axis=1)[:, 5]
    kept = ann.scan(q, x, bound, 6)
    hit = sum(len(set(np.argsort(((a - x) ** 2).sum(-1))[:6]) & set(k)) for a, k in zip(q, kept))
    assert hit >= 0.97 * 120


# 4 quality


def test_quality_held_out(spark):
    rng = np.random.default_rng(2)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "and", "rivers", "run", "slowly", "down", "to", "sea"]

    def text(bad):
        w = [words[i] for i in rng.integers(0, len(words), int(rng.integers(30, 120)))]
        return " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w) + "."

    rows = [(i, text(i % 6 == 0), "en", "s", 0) for i in range(1500)]
    labels = spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(0, 1500, 2)], "doc_id long, quality int, toxic int")
    got = quality.classify(spark.createDataFrame(rows, DOCS), labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    right = [r["predicted"] == int(r["doc_id"] % 6 != 0) for r in got if r["held_out"]]
    assert sum(right) / len(right) > 0.97


def test_quality_ignores_held_out_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality")
    a, b = ({r["doc_id"]: r["score"] for r in quality.classify(docs, x).collect()} for x in (labels, flipped))
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, None), (5, 1), (None, 1)], "doc_id long, quality int")
    d = quality.classify(odd.withColumn("score", odd["doc_id"]), labels)
    assert d.count() == len(ODD) and d.columns.count("score") == 1
    assert all(r["score"] == 0.5 and r["predicted"] == 0 for r in quality.classify(odd, labels.limit(0)).collect())
    assert quality.classify(none, labels).count() == 0
    kept = quality.classify(odd, labels, keep_text=True)
    assert "text" in kept.columns and kept.count() == len(ODD)
    assert np.isfinite(quality.features(pa.array([None, "", "  ", LONG, "\x00é"]))).all()


# 5 mixing


def slow_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in held]
        level = (total - sum(held.values())) / (sum(w[s] for s in free) or 1)
        over = [s for s in free if w[s] * level > most * sizes[s]]
        if not over:
            return {s: held.get(s, w[s] * level) for s in order}
        held |= {s: most * sizes[s] for s in over}


def test_mix_meets_targets(spark, sf_dir):
    rows = QUERIES["op5_source_mixing"](spark, sf_dir).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sizes = {}
    for r in rows:
        assert r["size"] == len((docs[r["doc_id"]]["text"] or "").encode().split()) and 0 <= r["taken"] <= 3 * r["size"]
        sizes[docs[r["doc_id"]]["source"]] = sizes.get(docs[r["doc_id"]]["source"], 0) + r["size"]
    want = slow_targets(sizes)
    for s in sizes:
        mine = [r for r in rows if docs[r["doc_id"]]["source"] == s]
        assert {r["source_size"] for r in mine} == {sizes[s]} and all(math.isclose(r["target"], want[s], rel_tol=1e-9) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 1


def test_targets_reshare(spark):
    sizes = {"a": 10, "b": 1, "c": 0, "d": 500, "e": 3, None: 40}
    s = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(s).collect()}
    want = slow_targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)


def test_positions_follow_the_schedules(spark):
    rows = [(i, 0, s, 10) for i, s in enumerate(["a", "b", "c"] * 200)]
    d = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, _t long, source string, size long"), ["doc_id", "_t"], (1, 1, 1)).collect()
    mean = {s: np.mean([p["position"] for r in d if r["source"] == s for p in r["passes"]]) for s in "abc"}
    assert mean["a"] < mean["b"] - 0.03 < mean["c"] - 0.06 and all(0 <= p["position"] < 1 for r in d for p in r["passes"])


def test_mixing_odd(spark, odd, none):
    d = mixing.plan_mix(mixing.word_counts(odd), ["doc_id", "_t"])
    assert d.count() == len(ODD) and all(r["taken"] <= 3 * r["size"] for r in d.collect())
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    words = sum(len((r["text"] or "").encode().split()) for r in mixed.collect())
    assert words == sum(r["taken"] for r in d.collect())
    assert mixing.plan_mix(mixing.word_counts(none), ["doc_id", "_t"]).count() == 0 and mixing.mixed_documents(none).count() == 0


# 6 embedding near-duplicates


def test_caps_find_all_links(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((120, 16))
    x = np.concatenate([base, np.repeat(base[:10], 25, axis=0) + 0.25 * rng.standard_normal((250, 16)), np.repeat(base[:1], 120, axis=0) + 0.01 * rng.standard_normal((120, 16)), base[:5]])
    x = x.astype(np.float32)
    rows = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, kept int")
    u = x.astype(np.float64)
    c = (u[:, None] * u[None]).sum(-1) / np.sqrt((u**2).sum(1)[:, None] * (u**2).sum(1)[None])
    link = (c >= 0.9) & ~np.eye(len(x), dtype=bool)
    for block in (32, 2048):
        got = {r["vec_id"]: r for r in capfilters.near_duplicate_vectors(rows, block=block).collect()}
        mine = np.array([got[i]["n_links"] for i in range(len(x))])
        assert (mine <= link.sum(1)).all() and mine.sum() >= 0.99 * link.sum()
        want = components(len(x), list(zip(*np.nonzero(link))))
        assert np.mean([got[i]["component_id"] == want[i] for i in range(len(x))]) > 0.99
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_caps_odd(spark):
    v = [1.0, 2.0, 3.0]
    data = [(5, v), (3, v), (3, v), (4, [2.0, 4.0, 6.0]), (1, None), (2, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [float("inf"), 1.0, 1.0]), (8, [-1.0, 0.0, 0.0]), (None, v), (9, [1.0, 2.0]), (10, [])]
    got = capfilters.near_duplicate_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(data)
    by = {r["vec_id"]: r for r in got}
    assert {by[i]["n_links"] for i in (3, 4, 5, None)} == {4} and {by[i]["component_id"] for i in (3, 4, 5, None)} == {3}
    assert all(by[i]["n_links"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in (1, 2, 6, 7, 8, 9, 10))
    assert capfilters.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


# 7 substrings


def slow_repeats(docs, width):
    seen, out = {}, {}
    for i in sorted(docs):
        words = (docs[i] or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - width + 1):
            w = tuple(words[s : s + width])
            if w in seen:
                gone[s : s + width] = [True] * width
            else:
                seen[w] = i
        out[i] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g))
    return out


@pytest.mark.parametrize("width", [1, 3, 7, 20])
def test_repeats_match_all_windows(spark, width):
    rng = np.random.default_rng(width)
    passage = [f"p{i}" for i in range(30)]
    docs = {}
    for i in range(120):
        words = [f"w{x}" for x in rng.integers(0, 40 if i % 3 else 4000, int(rng.integers(0, 90)))]
        at = int(rng.integers(0, len(words) + 1))
        docs[i] = "  ".join(words[:at] + passage[int(rng.integers(0, 5)) :] + words[at:]) if i % 2 else " ".join(words)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, n_words string").repartition(7)
    want = slow_repeats(docs, width)
    for r in substrings.remove_repeats(df, width=width).collect():
        n, removed, kept = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["text"].encode().split()) == (n, removed, kept.split())
        spans = [(s["start"], s["length"]) for s in r["removed_spans"]]
        assert sum(x for _, x in spans) == removed and all(a + x < b for (a, x), (b, _) in zip(spans, spans[1:]))


def test_repeats_under_one_hot_anchor(spark):
    # a line whose hash is the least of all grams around it
    lines = [" ".join(f"c{i}k{j}" for j in range(10)) for i in range(4000)]
    line = min(lines, key=lambda x: int(substrings._mix(substrings._roll(substrings.Words(pa.array([x])).hashes(), 10))[0]))
    around = lambda side: F.concat_ws(" ", *[F.concat(F.lit(f"{side}{j}"), F.col("id").cast("string")) for j in range(5)])
    rows = spark.range(300_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", around("a"), F.lit(line), around("b")).alias("text"))
    again = rows.where("doc_id = 5").select(F.lit(10**6).cast("long").alias("doc_id"), "text")
    docs = rows.union(again)
    # about ten pairs of these windows share 32 bits of their hashes
    assert {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(docs).where("n_removed > 0").collect()} == {10**6: 20}
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    hot = substrings.hot_anchors(texts, 10**7, 20, 8)
    # a sample of a tenth finds the same one
    assert len(hot) == 1 and substrings.hot_anchors(texts, 10**7, 20, 8, sample=5 * 10**5).tolist() == hot.tolist()
    sent = docs.mapInArrow(substrings._send(20, 8, 8, hot), substrings.BLOB_DDL).where("not hits")
    sizes = [r["n"] for r in sent.groupBy("part").agg(F.sum(F.length("w")).alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < sum(sizes) / 6


def test_texts_of_one_id_stay_apart(spark):
    # two texts whose 16-bit checksums are equal, both without an id
    text = lambda i: " ".join(f"p{i}q{j}" for j in range(25))
    seen = {}
    for i in range(100_000):
        j = seen.setdefault(zlib.crc32(text(i).encode()) & 0xFFFF, i)
        if j != i:
            break
    rows = [(None, text(i)), (None, text(j) + " tail"), (None, text(j)), (3, text(i))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.remove_repeats(docs).collect()
    removed = {(r["doc_id"], r["n_words"]): [] for r in got}
    for r in got:
        removed[r["doc_id"], r["n_words"]].append((r["n_removed"], r["text"]))
    assert removed[3, 25] == [(25, "")]
    # of the text with a tail and the one without, the passage goes from one only; the third text loses nothing
    assert sorted(n for n, _ in removed[None, 25] + removed[None, 26]) == [0, 0, 25] and (0, text(i)) in removed[None, 25]


def test_many_texts_without_id_lose_nothing(spark):
    # of 6,000 texts, about 270 pairs share 16 bits; every second one ends in a passage that starts at a place of its own
    head = lambda i: " ".join(f"h{i}x{j}" for j in range(i % 7 + 1))
    own = lambda i: " ".join(f"o{i}x{j}" for j in range(25))
    passage = " ".join(f"s{j}" for j in range(20))
    rows = [(None, f"{own(i)} {head(i)}" + (f" {passage}" if i % 2 else "")) for i in range(6000)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = [r["text"] for r in got]
    assert sum(r["n_removed"] == 20 for r in got) == 2999 and sum(r["n_removed"] == 0 for r in got) == 3001
    assert sum(passage in t for t in texts) == 1 and all(t.split()[0].startswith("o") for t in texts)
    assert sorted(t.removesuffix(" " + passage) for t in texts) == sorted(f"{own(i)} {head(i)}" for i in range(6000))


def test_repeats_odd(spark, odd, none):
    d = substrings.remove_repeats(odd)
    rows = d.collect()
    assert d.columns == [*odd.columns, "n_words", "n_removed", "removed_spans"] and len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[2][0]["text"] is None and by[2][0]["n_words"] == 0
    assert all(r["n_removed"] == 0 for r in by[1]) and by[5][0]["n_removed"] == 40_000 - 997
    assert by[6][0]["text"] == "tail" or by[6][0]["text"].endswith(" tail")
    assert substrings.remove_repeats(none).count() == 0
    only = substrings.remove_repeats(odd.select("doc_id", "text"))
    assert only.columns[:2] == ["doc_id", "text"]


# 8 chat


def test_layouts(spark):
    schema = "prompt string, completion string, response string, instruction string, input string, output string, system string, messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, data struct<prompt:string,completion:string>"
    blank = dict.fromkeys(["prompt", "completion", "response", "instruction", "input", "output", "system", "messages", "conversations", "data"])
    cases = [
        ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ({"instruction": "i", "output": "o"}, "instruction_output", [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "input": "x", "output": "o"}, "instruction_input_output", [("user", "i"), ("user", "x"), ("assistant", "o")]),
        ({"system": "s", "prompt": "p", "response": "r"}, "system_prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ({"messages": [("user", "q"), ("tool", None)]}, "messages", [("user", "q"), ("tool", "")]),
        ({"conversations": [("human", "h"), ("gpt", "g")]}, "conversations", [("user", "h"), ("assistant", "g")]),
        ({"data": ("p", "c")}, "nested_prompt", [("user", "p"), ("assistant", "c")]),
        ({"messages": []}, "messages", []),
        ({"output": "alone"}, None, None),
        ({}, None, None),
    ]
    rows = [(i, tuple({**blank, **c}.values())) for i, (c, _, _) in enumerate(cases)]
    d = chat.canonical_turns(spark.createDataFrame(rows, f"id int, record struct<{schema}>"))
    for r in d.collect():
        _, layout, turns = cases[r["id"]]
        assert r["layout"] == layout and (turns is None and r["turns"] is None or [tuple(t) for t in r["turns"]] == turns)


def test_format_round_trip(spark):
    texts = ["", "plain", "\\### Assistant: </turn> ok", "a </turn>\n### User: b", "\\\\#<\\", "\n", "é日本 $1 \\1 %25", " </turn>\n", "x" * 50_000 + "#" * 5000]
    roles = ["user", "assistant", "system", "tool: x", "%3A", "", "@user", "### <\\>"]
    turns = [(roles[i % len(roles)], t) for i, t in enumerate(texts * 3)]
    d = spark.createDataFrame([(1, turns), (2, []), (3, None), (4, [("assistant", None), (None, "t")])], "id int, turns array<struct<role:string,text:string>>")
    d = chat.format_turns(d)
    rows = {r["id"]: r for r in d.select("id", "formatted", chat.parse_formatted(d["formatted"]).alias("back"), chat.masked_text(d["formatted"], d["loss_mask"]).alias("loss")).collect()}
    assert [tuple(t) for t in rows[1]["back"]] == turns
    assert rows[1]["loss"] == "".join(t for r, t in turns if r == "assistant")
    assert rows[2]["formatted"] == rows[3]["formatted"] == "" and rows[2]["back"] == []
    assert [tuple(t) for t in rows[4]["back"]] == [("assistant", ""), ("", "t")]


def test_chat_plan_is_native(spark, sf_dir):
    d = QUERIES["op8_chat_formatting"](spark, sf_dir)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
    mine = {r["conv_id"]: r for r in d.collect()}
    odd_text = "\\### Assistant: </turn> ok"
    assert mine[-7]["loss_sha256"] == hashlib.sha256(odd_text.encode()).hexdigest() and mine[-7]["n_turns"] == 2


# 9 packing


def whole_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer()).encode(text or "", add_special_tokens=False).ids + [2]


def check_pieces(rows, docs):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == docs.keys()
    for k, pieces in by_doc.items():
        ids = np.array(whole_ids(docs[k]), dtype="<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    padded = total = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096 and all(p["sequence_tokens"] == at for p in pieces)
        total += at
        padded += 0 if at & (at - 1) == 0 else 4096 - at
    return padded, total


def test_packing(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op9_packing"](spark, sf_dir).collect()
    padded, total = check_pieces(rows, docs)
    assert padded <= 4096 * spark.read.parquet(f"{sf_dir}/documents.parquet").rdd.getNumPartitions() and total > 0


def test_packing_odd(spark, odd, none):
    texts = ["", None, "It's we'LL <|endoftext|> x\x85y \x1cz", "İstanbul ΑΣ Σ é ½ ²", "日本語 テキスト", LONG, "a" * 3000]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    check_pieces(packing.pack(d).collect(), dict(enumerate(texts)))
    assert packing.pack(none).count() == 0
    assert sum(r["length"] for r in packing.pack(odd).collect()) == sum(len(whole_ids(r[1])) for r in ODD)


def test_plain_texts_are_cut_as_a_whole():
    """Words that differ in case or in the mark behind them share their pieces, and ids are the file's own."""
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    one, model = packing.WordTokenizer(path), Tokenizer.from_file(path)
    latin = [chr(i) for i in range(256)]
    texts = ["Then, then. THEN", "", " \t\n", "x1y23, 4.", "a,b.c", "a,.b", "a..", ",", ". .", "\xc9t\xe9s\x0bet\x0c\xdf\xfc\xd1 \xaa\xba\xb5", "don't stop", "a\x85b\xa0c\xadd", "\xb22\xbd"]
    texts += [*latin, *[f"a{c}" for c in latin], *[f"{c}b" for c in latin], *[f"{c}{c}, Q{c}." for c in latin], "e\u0301 \u0130 \u212a \u2028 \ud83d", "<|endoftext|>x"]
    assert one.ids(texts[:1]) and not one.words and set(one.pieces) == {b"then", b",", b"."}
    got = one.ids(texts)
    safe = [t.encode("utf-8", "replace").decode() for t in texts]
    want = [np.array(model.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in safe]
    assert [t for t, g, w in zip(texts, got, want) if g != w] == []


def test_tokenizer_may_forget():
    small = packing.WordTokenizer(packing.default_tokenizer(), memory=40)
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) + " again and again" for i in range(8)]
    for a in range(0, 8, 2):
        got = small.ids(texts[a : a + 2])
        assert [np.frombuffer(g, "<u4").tolist() + [2] for g in got] == [whole_ids(t) for t in texts[a : a + 2]]


def test_step_groups_are_even():
    lengths = [4096] * 37 + [2048] * 11 + [1024] * 90 + [512] * 3
    groups = packing.step_groups(lengths, 1 << 16)
    sums = [sum(n for n, g in zip(lengths, groups) if g == k) for k in set(groups)]
    assert max(sums) - min(sums) <= 4096 and max(sums) <= (1 << 16) + 4096


# 10 URLs


def slow_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def slow_rule(host, path):
    best = None
    for h, p, v in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best


URLS = [None, "", "x", "http://", "HTTP://A.ORG/", "http://a.org", "http://example.org/es/1", "http://www.Example.ORG/en/12?x=/#y", "http://notexample.org/es/", "ftp://é.COM/fr/?a://b", "http://b.com/de/", "http://b.com?/de/", "http://x.com/fr", "a://b://c/d", "http://orga/", "http://h.net/p\nq"]


def test_urls(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    extra = spark.createDataFrame([(10**6 + i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    got = urls.filter_urls(pages.union(extra).union(extra).selectExpr("*", "'mine' as host")).collect()
    assert len(got) == pages.count() + 2 * len(URLS)
    for r in got:
        host, path = slow_split(r["url"])
        rule = slow_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0])
        assert r["verdict"] in ("allow", "block") and (rule is None or r["verdict"] == rule[1])


def slow_scores(seen, target, order, bits):
    from collections import Counter

    seqs = {y: [b"\x00" + u for u, k in seen if k == y] for y in (0, 1)}

    def grams(s):
        return [(i, k) for i in range(1, len(s)) for k in range(order + 1) if i >= k]

    counts = {y: (Counter((k, s[i - k : i]) for s in seqs[y] for i, k in grams(s)), Counter((k, s[i - k : i + 1]) for s in seqs[y] for i, k in grams(s))) for y in (0, 1)}
    s, out = b"\x00" + target, 0.0
    for i in range(1, len(s)):
        for y, sign in ((1, 1), (0, -1)):
            p = 1 / 256
            for k in range(min(order, i) + 1):
                n, hit = counts[y][0][(k, s[i - k : i])], counts[y][1][(k, s[i - k : i + 1])]
                p = (hit + 4 * p) / (n + 4)
            out += sign * math.log(p)
    return out / max(len(target), 1)


def test_url_model_equals_plain_counts(spark):
    good = [f"http://a{i}.org/page/{i}" for i in range(20)]
    bad = [f"http://b{i}.com/de/{i}" for i in range(15)]
    rows = [(u, 1) for u in good] + [(u, 0) for u in bad]
    model = urls.fit_url_model(spark.createDataFrame(rows, "url string, label int"), order=3, bits=22)
    seen = [(u.encode(), y) for u, y in rows]
    for u in [good[0], bad[3], "http://c.net/de/1", "", "é"]:
        assert abs(model.score([u.encode()])[0] - slow_scores(seen, u.encode(), 3, 22)) < 1e-6
    assert all(model.score([u.encode()])[0] >= model.threshold for u in good) and all(model.score([u.encode()])[0] < model.threshold for u in bad)


def test_url_counts_grow_with_the_urls(spark):
    rng = np.random.default_rng(8)
    names = ["".join(chr(97 + c) for c in rng.integers(0, 26, 30)) for _ in range(3000)]
    rows = [(f"http://{u}.org/" if i % 2 else f"http://x.com/{u}", i % 2) for i, u in enumerate(names)]
    model = urls.fit_url_model(spark.createDataFrame(rows, "url string, label int"))
    seen = [(u.encode(), y) for u, y in rows]
    got = {r["url"]: r["url_score"] for r in model.scores(spark.createDataFrame([(rows[0][0],), ("http://new.org/",), ("http://new.org/",), ("",), (None,)], "url string")).collect()}
    assert set(got) == {rows[0][0], "http://new.org/", ""}
    for u, score in got.items():
        # no two grams share a count, whatever their number
        assert abs(score - slow_scores(seen, u.encode(), urls.ORDER, None)) < 1e-9
        assert abs(score - model.score([u.encode()])[0]) < 1e-12


def test_urls_without_training(spark):
    d = urls.filter_urls(spark.createDataFrame([(1, "http://a.net/"), (2, None)], "page_id long, url string"))
    assert [r["verdict"] for r in d.collect()] == ["allow", "allow"] and urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
