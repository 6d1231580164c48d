"""The pipeline's stages against brute force on the smallest tables, and on an empty one."""

import corpus_pipeline as P
from pyspark.sql import functions as F
from test_operators_llm import check_pieces, components, slow_print, slow_repeats, slow_targets
from tidemark.llm import packing, quality
from tidemark.llm.common import written


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = []
    for i, (_, stage) in enumerate(P.STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"test-{i}")
        steps.append((before.collect(), docs.collect()))
        if i < len(P.STAGES) - 1:
            assert docs.dtypes == before.dtypes

    given, kept = steps[0]
    scores = {r["doc_id"]: r["predicted"] for r in quality.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in given if scores[r["doc_id"]] == 1}
    assert {(r["doc_id"], r["text"]) for r in kept} <= {(r["doc_id"], r["text"]) for r in given}

    given, kept = steps[1]
    given = sorted(given, key=lambda r: r["doc_id"])
    prints = [slow_print(r["text"]) for r in given]
    root = components(len(given), [(i, j) for i in range(len(given)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    assert sorted(r["doc_id"] for r in kept) == [given[i]["doc_id"] for i in range(len(given)) if root[i] == i]

    given, kept = steps[2]
    want = slow_repeats({r["doc_id"]: r["text"] for r in given}, 20)
    assert {r["doc_id"]: (r["text"] or "").encode().split() for r in kept} == {k: v[2].split() for k, v in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in kept if want[r["doc_id"]][1])

    given, kept = steps[3]
    count = lambda r: len((r["text"] or "").encode().split())
    sizes = {}
    for r in given:
        sizes[r["source"]] = sizes.get(r["source"], 0) + count(r)
    taken = dict.fromkeys(sizes, 0)
    passes = {}
    for r in kept:
        taken[r["source"]] += count(r)
        passes[r["doc_id"]] = passes.get(r["doc_id"], 0) + 1
    target = slow_targets(sizes)
    assert max(passes.values()) <= 3 and all(abs(taken[s] - target[s]) <= 1 for s in sizes)

    given, pieces = steps[4]
    total = sum(len(x) // 4 + 1 for x in packing.WordTokenizer(packing.default_tokenizer()).ids([r["text"] for r in given]))
    assert sum(p["length"] for p in pieces) == total
    one_pass = [r for r in given if passes[r["doc_id"]] == 1]
    once = {r["doc_id"]: r["text"] for r in one_pass}
    by_seq = {}
    for p in pieces:
        by_seq.setdefault(p["sequence_id"], []).append(p)
    assert all(sum(p["length"] for p in s) <= 4096 for s in by_seq.values()) and once
    check_pieces(packing.pack(spark.createDataFrame([(k, v) for k, v in once.items()], "doc_id long, text string")).collect(), once)


def test_run_and_empty(spark, sf_dir):
    assert P.run(spark, sf_dir).count() > 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for i, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_user_columns_with_the_stages_names_come_through(spark, sf_dir):
    """Names that the operators use inside are the user's own here, and hold the same values after every stage."""
    names = ["x", "passes", "_h", "_t", "_n", "_copy", "n_words", "n_removed", "score", "predicted", "held_out", "component_id", "fp", "taken", "size", "a.b"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 120")
    docs = docs.select("*", *[F.concat(F.lit(n + ":"), F.col("doc_id").cast("string")).alias(n) for n in names])
    for i, (_, stage) in enumerate(P.STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"own-{i}")
        got = docs.collect()
        assert got and docs.columns[-len(names) :] == names
        assert all(r[n] == f"{n}:{r['doc_id']}" for r in got for n in names)
