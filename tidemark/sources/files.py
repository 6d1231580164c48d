"""Readers and writers for series files; schemas are explicit, nothing is inferred."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expr import parse_number


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of ``spark.checkpoint.dir``.

    A session whose only machine is the driver's may do without one; on a cluster a
    folder that executors do not share would lose the data, so none is made up.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _stem() -> Column:
    """File name without extension."""
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


def read_series_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """``date,value`` files; the series is named after its file."""
    raw = spark.read.schema("ts STRING, v STRING").option("header", header).csv(path)
    return raw.select(_stem().alias("series_id"), F.col("ts").try_cast("date").alias("ts"), parse_number("v").alias("value"))


def read_values_json(spark: SparkSession, path: str) -> DataFrame:
    """``[[date, value], ...]`` or ``{"values": [[date, value], ...]}``; bad rows are dropped."""
    raw = spark.read.option("wholetext", True).text(path).select(_stem().alias("series_id"), F.trim("value").alias("j"))
    return parse_values_json(raw)


def parse_values_json(raw: DataFrame) -> DataFrame:
    """Same for a table (series_id, j) of JSON texts."""
    pairs = F.coalesce(
        F.from_json(F.when(F.col("j").startswith("["), F.col("j")), "array<array<string>>"),
        F.from_json(F.when(F.col("j").startswith("{"), F.col("j")), "values array<array<string>>")["values"],
    )
    x = raw.select("series_id", F.explode(pairs).alias("p"))
    out = x.select("series_id", F.try_element_at("p", F.lit(1)).try_cast("date").alias("ts"), parse_number(F.try_element_at("p", F.lit(2))).alias("value"))
    return out.where("ts is not null and value is not null")


def parse_observations_json(raw: DataFrame) -> DataFrame:
    """``{"observations": [{"date", "value"}]}`` with '.' for missing, from (series_id, j)."""
    obs = F.from_json("j", "observations array<struct<date:string,value:string>>")["observations"]
    x = raw.select("series_id", F.explode(obs).alias("o"))
    return x.select("series_id", F.col("o.date").try_cast("date").alias("ts"), parse_number("o.value").alias("value"))


def parse_preamble_csv(texts: DataFrame, marker: str, columns: list[str]) -> DataFrame:
    """CSV texts (series_id, j) with free lines before the header that starts with ``marker``.

    Everything up to the header is skipped; rows that do not parse are dropped.
    """
    lines = F.split("j", "\n")
    heads = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).startswith(marker))
    body = F.slice(lines, F.get(heads, F.lit(0)) + 2, F.size(lines))
    x = texts.where(F.size(heads) > 0).select("series_id", F.explode(body).alias("line"))
    cells = F.split("line", ",")
    out = x.select("series_id", F.get(cells, F.lit(0)).try_cast("date").alias("ts"), *[parse_number(F.get(cells, F.lit(i + 1))).alias(c) for i, c in enumerate(columns)])
    return out.na.drop("any")


def wide_to_long(df: DataFrame, keys: list[str], columns: list[str], name: str = "series_id") -> DataFrame:
    return df.unpivot(keys, columns, name, "value")


def upsert(cached: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Newest version per key over the cache and an overlapping re-fetch; aggregates map-side."""
    values = [c for c in cached.columns if c not in keys]
    u = cached.unionByName(new)
    top = u.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(version)).alias("__v"))
    return top.select(*keys, "__v.*")


def freeze(df: DataFrame, path: str, snapshot: str) -> None:
    """Write a dated snapshot; later runs read it by partition."""
    df.withColumn("snapshot", F.lit(snapshot)).write.mode("append").partitionBy("snapshot").parquet(path)


def replay_snapshot(spark: SparkSession, path: str, snapshot: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, snapshot STRING").parquet(path).where(F.col("snapshot") == snapshot).drop("snapshot")


def checksum(df: DataFrame, by: list[str], parts: list[Column]) -> DataFrame:
    """Order-insensitive content checksum per key: 8 hex digits and the row count."""
    text = F.concat_ws("|", *parts)
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    return df.groupBy(*by).agg(F.lpad(F.lower(F.hex(F.bit_xor(h))), 8, "0").alias("checksum"), F.count(F.lit(1)).alias("n"))


def frequency_profile(obs: DataFrame, by: str = "series_id") -> DataFrame:
    """Count, first and last date, last value, mean gap and its D/W/M/Q class."""
    g = obs.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max_by("value", "ts").alias("last_value")
    )
    gap = F.when(F.col("n") > 1, F.datediff("last_ts", "first_ts") / (F.col("n") - 1))
    return g.withColumn("gap", gap).withColumn("freq", F.when(gap < 3, "D").when(gap < 10, "W").when(gap < 60, "M").otherwise("Q"))


def apply_overrides(records: DataFrame, overrides: list[tuple[str, int, float]]) -> DataFrame:
    """Fill a missing rate from a (date, target_year) -> rate table and tag the source."""
    o = records.sparkSession.createDataFrame(overrides, "d string, target_year int, override double").select(F.to_date("d").alias("meeting_date"), "target_year", "override")
    x = records.join(o, ["meeting_date", "target_year"], "left")
    used = F.col("rate").isNull() & F.col("override").isNotNull()
    return x.withColumn("source", F.when(used, "override").otherwise("parsed")).withColumn("rate", F.coalesce("rate", "override")).drop("override")


def labelled_numbers(docs: DataFrame, label: str, skip: str, lookahead: int = 0, most: int = 4, text: str = "text") -> DataFrame:
    """First decimals on a labelled line of each text, as a map 0..most-1 -> value.

    The first line that matches ``label`` (and not ``skip``) and yields decimals
    wins; with ``lookahead`` an empty match also tries the next lines that do not
    match ``skip``. One pass over each row's lines, no shuffle.
    """
    numbers = lambda s: F.regexp_extract_all(s, F.lit(r"(\d+\.\d+)"), F.lit(1))
    # a text without any decimal can yield nothing, so one scan of it is enough
    d = docs.where(F.col(text).rlike(r"\d\.\d")).withColumn("__l", F.split(text, "\n"))
    at = lambda i: F.coalesce(F.get(F.col("__l"), i), F.lit(""))

    def found(line, i):
        own = numbers(line)
        ahead = F.flatten(F.slice(F.filter(F.transform(F.sequence(F.lit(1), F.lit(max(lookahead, 1))), lambda o: F.when(~at(i + o).rlike(skip), numbers(at(i + o))).otherwise(numbers(F.lit("")))), lambda a: F.size(a) > 0), 1, 1))
        value = F.when(F.size(own) > 0, own).otherwise(ahead) if lookahead else own
        return F.when(line.rlike(label) & ~line.rlike(skip), value).otherwise(numbers(F.lit("")))

    hits = F.filter(F.transform("__l", found), lambda a: F.size(a) > 0)
    vals = F.transform(F.slice(F.get(hits, F.lit(0)), 1, most), lambda s: s.cast("double"))
    out = d.withColumn("numbers", vals).where("numbers is not null").drop("__l")
    return out.withColumn("by_offset", F.map_from_arrays(F.sequence(F.lit(0), F.size("numbers") - 1), F.col("numbers")))
