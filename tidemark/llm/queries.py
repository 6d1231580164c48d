"""One query for each operator, over its whole table, and the SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, ann, capfilters, chat, mixing, packing, quality, sharding, simhash, substrings, suffixes, urls, whitening
from tidemark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
w AS MATERIALIZED (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM d),
win AS (SELECT doc_id, i, array_to_string(list_slice(l, i, i + 19), ' ') AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) - 18)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
k AS (SELECT w.doc_id, count(*) AS n_words, count(g.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY w.i) FILTER (g.i IS NULL), '') AS kept
  FROM w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

#: The table of the CRC-32 from its polynomial, and the checksum of each text byte by byte
SHARD_SQL = r"""
WITH RECURSIVE t(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS l FROM t WHERE k = 8),
b AS (SELECT doc_id, source, coalesce(text, '') AS text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
d AS (SELECT doc_id, source, CAST(strlen(text) + 1 AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, l[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM b, tab),
h AS (SELECT *, ('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, '~') || '|' || text_crc32), 1, 15))::BIGINT AS h, ('0x' || substr(md5('43|' || coalesce(source, '~')), 1, 15))::BIGINT % 1099511627776 AS phase FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32) - 1 AS rank, count(*) OVER (PARTITION BY source) AS total FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY (rank::HUGEINT * 1099511627776 + phase) // total, h, doc_id, text_crc32) - 1 AS pos, count(*) OVER () AS n FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(pos * 16 // n AS INT) AS shard, pos - (pos * 16 // n * n + 15) // 16 AS slot, CAST(NULL AS INT) AS grown_shard, source FROM p
"""

MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS t FROM documents),
h AS (SELECT *, ('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, '~') || '|' || t), 1, 15))::BIGINT AS h FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS number FROM d GROUP BY source),
w AS (SELECT *, (number % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
-- sources that stop at their cap come first in the order of cap over weight
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held, sum(weight) OVER (ORDER BY cap / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, sum(source_size) OVER () AS total FROM w),
l AS (SELECT (total - held) / open AS level FROM o WHERE cap >= weight * (total - held) / open ORDER BY cap / weight, number LIMIT 1),
g AS (SELECT w.*, least(cap, weight * level) AS target, CAST(floor(least(cap, weight * level) + 0.5) AS BIGINT) AS goal FROM w, l),
r AS (SELECT number, k, weight * CASE number % 3 WHEN 0 THEN 1.5 - (k + 0.5) / 64 WHEN 1 THEN 1.0 ELSE 0.5 + (k + 0.5) / 64 END::DOUBLE AS rate FROM g, range(64) x(k)),
c AS (SELECT number, k, sum(share) OVER (PARTITION BY number ORDER BY k) / sum(share) OVER (PARTITION BY number) AS knot FROM (SELECT number, k, rate / sum(rate) OVER (PARTITION BY k) AS share FROM r)),
n AS (SELECT number, list(knot ORDER BY k) AS knots FROM c GROUP BY number),
b AS (SELECT h.*, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, t, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM h),
j AS (SELECT b.*, source_size, target, goal, knots, greatest(0, least(size, goal - before)) AS t1, greatest(0, least(size, goal - before - source_size)) AS t2, greatest(0, least(size, goal - before - 2 * source_size)) AS t3
  FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source JOIN n ON n.number = g.number),
q AS (SELECT *, (before + t1 / 2.0::DOUBLE) / greatest(goal, 1) AS part FROM j),
k AS (SELECT *, least(63, len(list_filter(knots, lambda x: x <= part))) AS k FROM q),
m AS (SELECT *, CASE WHEN k = 0 THEN 0 ELSE knots[k] END AS low, knots[k + 1] AS high FROM k)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(t1 + t2 + t3 AS BIGINT) AS taken,
  round(CASE WHEN t1 > 0 THEN (k + least(1, greatest(0, (part - low) / (high - low)))) / 64 END::DOUBLE, 6) AS position FROM m
"""

CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
), s AS (
  SELECT *, CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9
    ELSE 1 + length(regexp_replace(replace(replace(role, '%', '%25'), ':', '%3A'), '([\\#<])', '\\\1', 'g')) END AS shown,
    length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) AS body
  FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    CAST(sum(4 + shown + 2 + body + 9) AS BIGINT) AS formatted_chars
  FROM s GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


BYTES_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents),
win AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, n_bytes - 49)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM win) WHERE least < doc_id),
-- runs of hit windows that touch or overlap are maximal spans
runs AS (SELECT doc_id, i, sum(CASE WHEN i <= coalesce(before, -100) + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM later)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run),
gone AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS tail FROM spans GROUP BY doc_id),
kept AS (SELECT s.doc_id, string_agg(substr(x, 2 * coalesce(s.was, 0) + 1, 2 * (s.a - coalesce(s.was, 0))), '' ORDER BY s.a) AS head
  FROM (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY a) AS was FROM spans) s JOIN d ON d.doc_id = s.doc_id GROUP BY s.doc_id)
SELECT d.doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head || substr(x, 2 * tail + 1), x))) AS kept_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


@query()
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = simhash.near_duplicates(docs)
    return d.select(F.col("id").alias("doc_id"), simhash.hex_print("fp").alias("fingerprint"), "component_id")


@query(SHARD_SQL)
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    d = sharding.shard(docs, 16, "source", ("doc_id", "text_crc32"))
    return d.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


@query()
def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 50 = 0"))


@query()
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query(MIX_SQL)
def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.word_counts(table(spark, sf_dir, "documents"))
    d = mixing.plan_mix(docs, ["doc_id", "_t"])
    return d.select("doc_id", "size", "source_size", "target", "taken", F.round(F.get("passes", F.lit(0))["position"], 6).alias("position"))


@query()
def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@query(REPEATS_SQL)
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return d.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


@query(CHAT_SQL)
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    turns = chat.canonical_turns(chat.records_of_rows(rows.union(extra)))
    out = chat.format_turns(turns).select("conv_id", "formatted", "loss_mask")
    out = out.withColumn("back", chat.parse_formatted(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_mask")))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query()
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query()
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "url_score")


@query(BYTES_SQL)
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffixes.remove_shared_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit("").cast("binary")), 256).alias("kept_sha256"))


@query()
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return d.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"), "n_group_links")


@query()
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    d = d.select("vec_id", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "c"), "identity_error")
    return d.select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
