"""Mixing sources to target weights under a time-varying curriculum.

Each source's weight is a schedule over training time. Its share of the
weights, integrated, says how many tokens of the source the training has
asked for by any moment. Documents of a source stand in a seeded shuffle; the
moment at which the demand reaches a document's tokens is its training
position, and the mix is the documents in order of position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SEED, durable, n_words, ordered_hash, running, slice_of_hash, text_hash

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: Documents that are put in order together
SLICE_ROWS = 8192
#: Weight at the start, the middle and the end of training, times the source's weight; dealt in turn to the ordered sources
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: Equal steps over which schedules are integrated
STEPS = 64


def numbered(sources: DataFrame) -> DataFrame:
    """Adds ``number`` from 0 in code point order, null last; one row of the input for each source.

    Ranges of sources are numbered apart and their counts added up in order.
    """
    s = sources.withColumn("_null", F.col("source").isNull())
    by_range = durable(s.repartitionByRange("_null", "source").sortWithinPartitions("_null", "source").withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    first = by_range.groupBy("_p").agg(F.count("*").alias("_c"), F.min("_m").alias("_first"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.select("_p", "_first", before.alias("_before"))
    return by_range.join(first, "_p").withColumn("number", (F.col("_before") + F.col("_m") - F.col("_first")).cast("long")).drop("_null", "_p", "_m", "_first", "_before")


def targets(sources: DataFrame, weights=WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> adds number, weight, target.

    Targets share the total size by weight and stop at ``max_repeats`` times
    the source's size; what is cut goes to the others by weight until none is
    above. Only sums over all sources reach the driver.
    """
    s = numbered(sources)
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = durable(s.withColumn("weight", F.element_at(w, (F.col("number") % len(weights)).cast("int") + 1)).withColumn("_cap", F.col("source_size") * F.lit(float(max_repeats))))
    total = float(s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, closed = 0.0, -1
    while True:
        full = F.col("_cap") < F.col("weight") * level
        held = s.agg(F.coalesce(F.sum(F.when(full, F.col("_cap")).otherwise(0.0)), F.lit(0.0)), F.coalesce(F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.lit(0.0)), F.count_if(full)).first()
        if held[2] == closed or held[1] == 0.0:
            break
        closed, level = held[2], (total - held[0]) / held[1]
    return s.withColumn("target", F.least("_cap", F.col("weight") * level)).drop("_cap")


def demand_knots(sources: DataFrame, schedules=SCHEDULES, steps: int = STEPS) -> DataFrame:
    """Adds ``knots``: the part of a source's tokens asked for at the ends of equal steps of training.

    At each step a source's rate is its scheduled weight over the sum of all
    scheduled weights; rates are integrated and scaled to reach 1 at the end.
    """
    def weight_at(mid: float) -> Column:
        out = F.lit(None).cast("double")
        for i, knots in enumerate(schedules):
            x = mid * (len(knots) - 1)
            j = min(int(x), len(knots) - 2) if len(knots) > 1 else 0
            v = knots[j] + (knots[j + 1] - knots[j]) * (x - j) if len(knots) > 1 else knots[0]
            out = F.when(F.col("number") % len(schedules) == i, F.lit(float(v))).otherwise(out)
        return out * F.col("weight")

    rates = F.array(*[weight_at((k + 0.5) / steps) for k in range(steps)])
    d = sources.withColumn("_rates", rates)
    sums = d.agg(*[F.sum(F.col("_rates")[k]).alias(f"s{k}") for k in range(steps)]).first()
    share = F.array(*[F.col("_rates")[k] / F.lit(float(sums[k] or 1.0)) for k in range(steps)])
    d = d.withColumn("_share", share)
    summed = F.transform("_share", lambda x, i: F.aggregate(F.slice("_share", 1, i + 1), F.lit(0.0), lambda a, b: a + b))
    d = d.withColumn("_sum", summed)
    return d.withColumn("knots", F.transform("_sum", lambda x: x / F.element_at("_sum", -1))).drop("_rates", "_share", "_sum")


def moment(part: Column, knots: Column, steps: int = STEPS) -> Column:
    """Time in [0, 1] at which the demand reaches ``part`` of a source's tokens: the inverse of the knots."""

    def at(x):
        p, k = x["p"], F.least(x["k"], F.lit(steps - 1))
        low = F.when(k == 0, F.lit(0.0)).otherwise(F.element_at(knots, F.greatest(k, F.lit(1))))
        high = F.element_at(knots, k + 1)
        inside = F.when(high > low, (p - low) / (high - low)).otherwise(0.0)
        return (k + F.least(F.lit(1.0), F.greatest(F.lit(0.0), inside))) / steps

    # arrays of one element bind a value, which would be computed anew wherever it is named
    bound = F.transform(F.array(part.cast("double")), lambda p: F.struct(p.alias("p"), F.aggregate(knots, F.lit(0), lambda n, x: n + F.when(x <= p, 1).otherwise(0)).alias("k")))
    return F.element_at(F.transform(bound, at), 1)


def plan_mix(docs: DataFrame, keys: list[str], weights=WEIGHTS, max_repeats: int = MAX_REPEATS, schedules=SCHEDULES, seed: int = SEED, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row for each document: keys, source, size, source_size, target, taken and its ``passes``.

    ``docs`` has the keys, ``source`` and ``size`` (words). A source is gone
    through in a seeded order as often as its target says; the last pass ends
    inside a document when the target does, so taken words add up to
    the target rounded to whole words. A pass is (number, taken, position), where position in [0, 1) is the
    moment of training. Documents that the mix does not reach, and those without words, have no
    passes and 0 taken. Repeated rows are documents of their own; an empty table gives an empty result.
    """
    d = durable(docs.withColumn("_h", ordered_hash(F.lit(seed), *keys)))
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = durable(demand_knots(targets(sizes, weights, max_repeats), schedules))
    slices = max(1, -(-d.count() // slice_rows))
    d = running(d, ["source"], [F.col("_h"), *map(F.col, keys), F.col("size")], F.col("size"), slice_of_hash(F.col("_h"), slices), "_before").drop("_before_total")
    few = plan.select(F.col("source").alias("_s"), "source_size", "target", "knots", F.floor(F.col("target") + 0.5).cast("long").alias("_goal"))
    d = d.join(few, d["source"].eqNullSafe(few["_s"])).drop("_s", "_h")

    def one_pass(p):
        # pass p takes the words of the source's stream from p * source_size + before on
        start = (p - 1) * F.col("source_size") + F.col("_before")
        taken = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_goal") - start)).cast("long")
        return F.struct(p.alias("number"), taken.alias("taken"), start.alias("start"))

    def placed(x):
        part = (x["start"] + x["taken"] / 2) / F.greatest(F.col("_goal"), F.lit(1))
        return F.struct(x["number"].alias("number"), x["taken"].alias("taken"), moment(part, F.col("knots")).alias("position"))

    passes = F.filter(F.transform(F.sequence(F.lit(1), F.lit(int(max_repeats))), one_pass), lambda x: x["taken"] > 0)
    passes = F.transform(passes, placed)
    d = d.withColumn("passes", passes)
    d = d.withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x["taken"]))
    return d.drop("_before", "_goal", "knots")


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, _t) of documents; ``_t`` tells rows of one id apart by their text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), text_hash(F.col(text_col)).alias("_t"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, schedules=SCHEDULES, seed: int = SEED) -> DataFrame:
    """The mix itself: a row for each pass over a document, in order of position, with the documents' columns.

    The last pass of a source may end inside a document, whose text is then cut
    after the words taken, and n_chars follows. Documents the mix does not reach are left out.
    """
    columns = docs.columns
    d = docs.withColumn("_t", text_hash(F.col("text"))).withColumn("_copy", F.monotonically_increasing_id())
    plan = plan_mix(word_counts(docs), ["doc_id", "_t"], weights, max_repeats, schedules, seed).where("taken > 0")
    plan = plan.select(F.col("doc_id").alias("_id"), F.col("_t").alias("_pt"), F.col("source").alias("_ps"), "passes", F.col("size").alias("_size"))
    # rows that repeat an (id, text, source) are paired off one by one
    plan = plan.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_pt", "_ps").orderBy(F.get("passes", F.lit(0))["position"])))
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "_t", "source").orderBy("_copy")))
    on = d["doc_id"].eqNullSafe(plan["_id"]) & d["_t"].eqNullSafe(plan["_pt"]) & d["source"].eqNullSafe(plan["_ps"]) & (d["_n"] == plan["_n"])
    m = d.join(plan, on).withColumn("_pass", F.explode("passes"))
    for c in ("taken", "position", "number"):
        m = m.withColumn(f"_{c}", F.col("_pass")[c])
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1)), F.lit(1), F.col("_taken").cast("int")), " ")
    part = F.col("_taken") < F.col("_size")
    m = m.withColumn("text", F.when(part, cut).otherwise(F.col("text")))
    if "n_chars" in columns:
        m = m.withColumn("n_chars", F.when(part, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return m.orderBy("_position", "doc_id", "_number").select(*columns)
