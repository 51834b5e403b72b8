"""Exact de-duplication by content-defined chunk recipes, in DataFrame operations only.

Texts are compared after each run of ASCII white space became one space. A text is cut
where its content says so (four letters or digits of fixed classes before a space, a full stop or a
comma, about every hundredth word, after 256 characters at least and 4,096 at most), so that texts
with common passages cut them alike; a chunk's identifier is its 64-bit hash, and
identifiers are verified: if one stood for chunks with two SHA-256 digests, the digests
would serve as identifiers instead. Texts are equal when their ordered lists of identifiers
are. Only these lists, about a fiftieth of the text, are moved.

Null counts as an empty text, and all empty texts form one group. Rows with the same doc_id and
equal texts stay or go together; rows with the same doc_id and other texts are judged apart. A row
without a doc_id stays only if no row of its group has one; keep_id is null then. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.sources.tables import materialise

WHITE = r"[\x20\x09-\x0D]+"
CHUNK = r"(?s).{256,4096}?[a-h0-3][i-p4-6][q-z7-9][a-e0-4][ .,]|.{1,4096}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def recipes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, raw (a hash of the text as it is), SHA-256 of the whole normalised text, identifiers and digests of its chunks in order."""
    chunks = F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0))
    return (
        df.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("raw"), normalised(F.col(text)).alias("norm"))
        .select("id", "raw", F.sha2("norm", 256).alias("text_sha256"), chunks.alias("chunks"))
        .select("id", "raw", "text_sha256", F.transform("chunks", lambda c: F.xxhash64(c)).alias("ids"), F.transform("chunks", lambda c: F.unhex(F.sha2(c, 256))).alias("digests"))
    )


def judged(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per input row: id, raw, keep_id, group_size, kept, text_sha256.

    Groups are found by a hash aggregation that combines before its shuffle; the join back
    is against groups of two or more, written before, so that a hot group's rows are split
    by adaptive execution instead of landing in one task.
    """
    made = materialise(recipes(df, key, text), "recipes")
    pairs = made.select(F.explode(F.arrays_zip("ids", "digests")).alias("c")).select("c.ids", "c.digests")
    doubtful = pairs.groupBy("ids").agg(F.min("digests").alias("a"), F.max("digests").alias("b")).where("a <> b")
    name = "digests" if doubtful.limit(1).count() else "ids"
    rows = made.select("id", "raw", "text_sha256", F.col(name).alias("recipe"))
    groups = materialise(rows.groupBy("recipe").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "groups")
    keep = F.coalesce("keep_id", "id")
    return rows.join(groups, "recipe", "left").select(
        "id", "raw", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256"
    )


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256."""
    return judged(df, key, text).select(F.col("id").alias(key), "keep_id", "group_size", "kept", "text_sha256")


def without_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df` that stay. A row is known by its key and its text's hash, so that another text of the same key stays."""
    gone = materialise(judged(df, key, text).where("NOT kept").select("id", "raw"), "copies")
    named = gone.withColumnsRenamed({"id": "_gone_id", "raw": "_gone_raw"}).distinct()
    same = df[key].eqNullSafe(named["_gone_id"]) & (F.xxhash64(df[text]) == named["_gone_raw"])
    return df.join(named.hint("merge"), same, "left_anti")
