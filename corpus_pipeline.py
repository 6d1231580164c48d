"""Documents to packed training sequences: filter, near-dedup, repeats, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last
return the columns of documents. A user's further columns come through unchanged, whatever their names but ``_document``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, packing, quality, simhash, substrings
from tidemark.llm.common import table, written

#: Scoring, fingerprints, curriculum positions and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


#: The column that carries a document's own columns through a stage, out of reach of the stage's names
WHOLE = "_document"


def whole(docs: DataFrame) -> DataFrame:
    """doc_id, text and source, and apart from them all columns but the text, with its length."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select("doc_id", "text", "source", F.struct(own.alias("own"), F.length("text").alias("length")).alias(WHOLE))


def unwrapped(stage: DataFrame, docs: DataFrame) -> DataFrame:
    """The documents' own columns with the stage's text; where that is another length than it was, n_chars follows."""
    out = {c: F.col(f"{WHOLE}.own.`{c}`") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        cut = ~F.length("text").eqNullSafe(F.col(f"{WHOLE}.length"))
        out["n_chars"] = F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return stage.select(*[out[c].alias(c) for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    scored = quality.classify(whole(docs), table(spark, sf_dir, "labels"), keep_text=True)
    return unwrapped(scored.where("predicted = 1"), docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    return unwrapped(simhash.one_per_group(whole(docs)), docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that start earlier elsewhere; n_chars follows the text."""
    return unwrapped(substrings.remove_repeats(whole(docs)), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass that the mixture takes over a document, in curriculum order; a cut pass has a shorter text and n_chars."""
    return unwrapped(mixing.mixed_documents(whole(docs)), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", one_of_near_copies),
    ("substring dedup", without_repeats),
    ("mixing to target weights", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs
