"""Training-corpus pipeline: language filter, exact and near de-duplication, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that its predecessor
kept; its result is written as Parquet and read again as the next stage's documents. All
stages but the last return the columns of `documents`, whichever they are. Whole texts are
read, however long; rows that repeat another are judged like it; empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import exact_dedup, language_id, near_dedup, packing
from weftgraph.sources.tables import materialise, table


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: null texts and texts without a letter.

    The model learns from the labelled rows of `docs` that are not held out.
    """
    fitted = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    columns = docs.columns
    return language_id.predict(docs, fitted).where("lang_pred <> 'und'").select(*columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space, the row of smallest doc_id stays (see `exact_dedup`: null
    counts as empty, rows of equal doc_id and text stay or go together, texts of one doc_id are judged apart)."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class, the row of smallest doc_id stays (see `near_dedup`: texts without words
    and rows without a doc_id stay, rows of equal doc_id and text stay or go together)."""
    return near_dedup.without_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document's length bucket, batch and place, one row per document, repeated or not; null
    and empty texts have two tokens, and a text longer than the budget has a batch of its own."""
    lengths = packing.counted_tokens(docs)
    return packing.pack(lengths, length=F.col("tokens")).drop("tokens")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: Language models and near-duplicate classes have no SQL form; tests use a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
