"""Repository files as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text as T

MAX_FILE_BYTES = 1_000_000
# Folders that are never read.
SKIP_DIRS = (
    ".git", ".svn", ".hg", "node_modules", "dist", "build", ".next", ".nuxt", ".turbo", ".yarn", ".pnpm-store", "__pycache__", ".venv", "venv", ".mypy_cache", ".pytest_cache",
    ".ruff_cache", ".tox", ".eggs", "egg-info", "target", "vendor", ".gradle", ".mvn", "bin", "obj", "Pods", ".build", "cmake-build-debug", "cmake-build-release", "coverage",
    ".nyc_output", ".idea", ".vscode", ".vs", ".cache", "out", "_build",
)


def all_files(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to root, size, content) of every file under a folder that Spark can read; one row per file, read in parallel."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-z0-9+]+:/*(?=/)", "")
    plain = F.regexp_replace("path", r"^[a-z0-9+]+:/*(?=/)", "")
    relative = F.expr("substr(_plain, length(_base) + 2)")
    return found.withColumns({"_plain": plain, "_base": base}).select(relative.alias("path"), F.col("length").alias("size"), "content")


def walk(spark: SparkSession, root: str, most: int = MAX_FILE_BYTES, known_only: bool = True) -> DataFrame:
    """(path, size, language, content_hash, text) of code files: known languages, one megabyte at most, outside SKIP_DIRS."""
    inside = F.arrays_overlap(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), F.array(*map(F.lit, SKIP_DIRS)))
    rows = all_files(spark, root).where((F.col("size") <= most) & ~inside).withColumn("language", T.language_of(F.col("path")))
    rows = rows.where("language IS NOT NULL") if known_only else rows
    return rows.select("path", "size", "language", F.sha2("content", 256).alias("content_hash"), F.decode("content", "UTF-8").alias("text"))


def discover(files: DataFrame, max_files: int = 20_000) -> DataFrame:
    """(path, size, language, truncated): the first files by path, and whether there are more."""
    n = files.agg(F.count(F.lit(1)).alias("_n"))
    first = files.select("path", "size", "language").orderBy("path").limit(max_files)
    return first.crossJoin(F.broadcast(n)).select("path", "size", "language", (F.col("_n") > max_files).alias("truncated"))
