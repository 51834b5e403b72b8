"""Exported git logs as tables of commits and touched files; executors read text, they never call git."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text as T

MAX_COMMITS = 5_000
#: What to export: records begin with the byte 1E, fields end with the byte 00.
EXPORT_FORMAT = "git log --name-only -z --pretty=format:%x1e%H%x00%an%x00%ae%x00%aI%x00%s%x00"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record) of exported logs under a path; Spark splits files at record marks."""
    return spark.read.option("lineSep", "\x1e").text(path).select(F.col("value").alias("record"))


def _flags(df: DataFrame) -> DataFrame:
    s = F.col("subject")
    return df.withColumns({"is_bug_fix": T.is_bug_fix(s), "is_revert": T.is_revert(s), "is_merge": T.is_merge(s)})


def _time(text: Column) -> Column:
    return F.try_to_timestamp(text)


def parse_records(records: DataFrame) -> DataFrame:
    """Commits (hash, author_name, author_email, date, subject, files and flags) of NUL-delimited records; those with a
    malformed hash, author or date are dropped."""
    fields = F.split("record", "\u0000")
    at = lambda i: F.coalesce(F.get(fields, F.lit(i)), F.lit(""))
    names = F.transform(F.slice(fields, 6, F.greatest(F.size(fields) - 5, F.lit(0))), lambda f: F.regexp_replace(f, r"^\r?\n", ""))
    files = F.filter(names, lambda f: (f != "") & ~T.is_ignored_path(f))
    rows = records.select(F.regexp_replace(at(0), r"^[\r\n]+", "").alias("hash"), at(1).alias("author_name"), at(2).alias("author_email"), _time(at(3)).alias("date"), at(4).alias("subject"), files.alias("files"))
    return _flags(rows.where(F.lower("hash").rlike("^[0-9a-f]{40}$") & (F.col("author_name") != "") & (F.col("author_email") != "") & F.col("date").isNotNull()))


HEADER = r"^([^|]{40})\|([^|]+)\|([^|]+)\|([^|]+)\|(.*)$"


def parse_lines(blocks: DataFrame) -> DataFrame:
    """The same of the older form: "hash|name|email|date|subject" and then file names, one per line. `blocks` has block, an
    id, and text; a block holds whole commits."""
    lines = blocks.select("block", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    from pyspark.sql import Window as W

    start = F.when(F.col("line").rlike(HEADER), F.col("i"))
    known = lines.withColumn("commit", F.last(start, ignorenulls=True).over(W.partitionBy("block").orderBy("i"))).where("commit IS NOT NULL")
    head = lambda i: F.max(F.when(F.col("i") == F.col("commit"), F.regexp_extract("line", HEADER, i)))
    name = F.trim("line")
    listed = F.collect_list(F.when((F.col("i") != F.col("commit")) & (name != "") & ~T.is_ignored_path(name), F.struct("i", name.alias("f"))))
    rows = known.groupBy("block", "commit").agg(head(1).alias("hash"), head(2).alias("author_name"), head(3).alias("author_email"), _time(head(4)).alias("date"), head(5).alias("subject"), F.transform(F.array_sort(listed), lambda s: s["f"]).alias("files"))
    return _flags(rows.where("date IS NOT NULL").drop("block", "commit"))


def newest(commits: DataFrame, most: int = MAX_COMMITS) -> DataFrame:
    return commits.orderBy(F.desc("date"), "hash").limit(most)


def touched_symbols(commits: DataFrame, file_symbols: DataFrame) -> DataFrame:
    """(commit_id, symbol_id, at, author, is_bug_fix, is_revert) of commits that are no merges; `file_symbols` has path, symbol_id."""
    files = commits.where("NOT is_merge").select(F.col("hash").alias("commit_id"), F.col("date").alias("at"), F.col("author_email").alias("author"), "is_bug_fix", "is_revert", F.explode("files").alias("path"))
    return files.join(file_symbols, "path").select("commit_id", "symbol_id", "at", "author", "is_bug_fix", "is_revert").distinct()
