"""Change-history mining: co-change, risk and ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def co_change_pairs(commits: DataFrame, cap: int = 50, min_count: int = 2) -> DataFrame:
    """Pairs of symbols changed by the same commits, with Jaccard strength.

    `commits` has commit_id, symbol_id, at. As the semantics ask, only the first `cap`
    symbols of a commit (by id) form pairs, while totals count every touched symbol; the
    cap also bounds the pairs of one commit. One shuffle by commit serves the de-duplication,
    the ranking and the self-pairing, which happens inside each commit's array.
    """
    touched = commits.groupBy("commit_id", "symbol_id").agg(F.min("at").alias("at"))
    totals = touched.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("total"))
    first = touched.withColumn("rn", F.row_number().over(W.partitionBy("commit_id").orderBy("symbol_id"))).where(F.col("rn") <= cap)
    left, right = first.alias("a"), first.alias("b")
    pairs = (
        left.join(right, (F.col("a.commit_id") == F.col("b.commit_id")) & (F.col("a.symbol_id") < F.col("b.symbol_id")))
        .groupBy(F.col("a.symbol_id").alias("symbol_a"), F.col("b.symbol_id").alias("symbol_b"))
        .agg(F.count(F.lit(1)).alias("co_change_count"), F.min("a.at").alias("first_co_change"), F.max("a.at").alias("last_co_change"))
        .where(F.col("co_change_count") >= min_count)
    )
    n = F.col("co_change_count")
    return (
        pairs.join(totals.select(F.col("symbol_id").alias("symbol_a"), F.col("total").alias("total_a")), "symbol_a")
        .join(totals.select(F.col("symbol_id").alias("symbol_b"), F.col("total").alias("total_b")), "symbol_b")
        .withColumn("jaccard", F.round(n / (F.col("total_a") + F.col("total_b") - n), 6))
        .select("symbol_a", "symbol_b", "co_change_count", "total_a", "total_b", "jaccard", "first_co_change", "last_co_change")
    )


# Risk weights and windows.
RISK_WEIGHTS = {"change_frequency": 0.25, "bug_fix_count": 0.30, "regression_count": 0.20, "recent_churn_30d": 0.15, "distinct_authors": 0.10}
WINDOW_DAYS, RELATION_JACCARD, MIN_COUNT = 30, 0.25, 2


def co_change_relations(pairs: DataFrame, threshold: float = RELATION_JACCARD) -> DataFrame:
    """(src, dst, confidence) both ways for strong pairs."""
    strong = pairs.where((F.col("jaccard") >= threshold) & (F.col("co_change_count") >= MIN_COUNT)).withColumn("confidence", F.round("jaccard", 3))
    out = strong.select(F.col("symbol_a").alias("src"), F.col("symbol_b").alias("dst"), "confidence")
    return out.union(out.select("dst", "src", "confidence"))


def partners(pairs: DataFrame, symbol, least: float = 0.1, limit: int = 500) -> DataFrame:
    """(partner, co_change_count, jaccard) of one symbol, the strongest first."""
    rows = pairs.where(((F.col("symbol_a") == symbol) | (F.col("symbol_b") == symbol)) & (F.col("jaccard") >= least))
    other = F.when(F.col("symbol_a") == symbol, F.col("symbol_b")).otherwise(F.col("symbol_a"))
    return rows.select(other.alias("partner"), "co_change_count", "jaccard").orderBy(F.desc("jaccard"), "partner").limit(limit)


def risk_scores(commits: DataFrame, now: DataFrame) -> DataFrame:
    """(symbol_id, five features, composite_risk, last_change) of rows commit_id, symbol_id, at, author, is_bug_fix,
    is_revert. `now` is one row with `now`. Features are divided by their maximum, one row that is joined back."""
    touched = commits.groupBy("symbol_id", "commit_id").agg(F.min("at").alias("at"), F.min("author").alias("author"), F.bool_or("is_bug_fix").alias("is_bug_fix"), F.bool_or("is_revert").alias("is_revert"))
    touched = touched.withColumn("at", F.col("at").cast("timestamp")).crossJoin(F.broadcast(now.select(F.col("now").cast("timestamp").alias("now"))))
    previous = F.lag("at").over(W.partitionBy("symbol_id", "is_bug_fix").orderBy("at", "commit_id"))
    close = F.col("is_bug_fix") & (F.unix_micros("at") - F.unix_micros(previous) <= WINDOW_DAYS * 86_400_000_000)
    recent = F.col("at") >= F.col("now") - F.expr(f"INTERVAL {WINDOW_DAYS} DAYS")
    stats = touched.withColumn("close", close).groupBy("symbol_id").agg(
        F.count(F.lit(1)).alias("change_frequency"), F.count_if("is_bug_fix").alias("bug_fix_count"), (F.count_if("close") + F.count_if("is_revert")).alias("regression_count"),
        F.count_if(recent).alias("recent_churn_30d"), F.countDistinct("author").alias("distinct_authors"), F.max("at").alias("last_change"),
    )
    tops = stats.agg(*[F.max(c).alias(f"top_{c}") for c in RISK_WEIGHTS])
    share = lambda c: F.when(F.col(f"top_{c}") == 0, 0.0).otherwise(F.col(c) / F.col(f"top_{c}"))
    total = sum((w * share(c) for c, w in RISK_WEIGHTS.items()), F.lit(0.0))
    return stats.crossJoin(F.broadcast(tops)).select("symbol_id", *RISK_WEIGHTS, F.round(total, 4).alias("composite_risk"), "last_change")


def top_risks(risks: DataFrame, names: DataFrame, limit: int = 50) -> DataFrame:
    """The riskiest symbols with their names (symbol_id, name)."""
    top = risks.orderBy(F.desc("composite_risk"), "symbol_id").limit(limit)
    return top.join(names, "symbol_id", "left").select("symbol_id", "name", "composite_risk")


def ownership(changes: DataFrame) -> DataFrame:
    """(symbol_id, primary_owner, ownership_type, share, authors) of rows symbol_id, author: one owner with 80 % or
    more, or alone, owns solely; symbols without any author are orphaned."""
    counts = changes.groupBy("symbol_id", "author").agg(F.count("author").alias("n"))
    best = counts.groupBy("symbol_id").agg(F.max(F.when(F.col("n") > 0, F.struct("n", F.negative("author").alias("order"), "author"))).alias("m"), F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("authors"))
    share = F.round(F.col("m.n") / F.col("total") * 100, 2)
    kind = F.when(F.col("total") == 0, "orphaned").when((F.col("authors") == 1) | (share >= 80), "sole").otherwise("shared")
    return best.select("symbol_id", F.col("m.author").alias("primary_owner"), kind.alias("ownership_type"), share.alias("share"), "authors")


def file_symbols(files: DataFrame) -> DataFrame:
    """Distinct (path, symbol_id)."""
    return files.select("path", "symbol_id").distinct()
