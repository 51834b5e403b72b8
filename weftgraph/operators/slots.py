"""Gapless numbering of rows in groups that may be far larger than one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parts_for(rows: int, least: int, each: int = 1_000_000) -> int:
    """How many parts give a task about `each` rows at most; never fewer than `least`."""
    return max(least, -(-rows // each))


def gapless_slots(df: DataFrame, group: str, block: Column, order: list[Column], slot: str = "slot") -> DataFrame:
    """Number the rows of each `group` from 0 without gaps, block after block.

    Rows are ranked inside (group, block) only, so one group is spread over as many
    tasks as it has blocks; block starts come from a (groups x blocks) count table, which
    is bounded by the caller's parameters and therefore broadcast. `df` is read twice
    and must be deterministic: pass a materialised table.
    """
    rows = df.withColumn("_block", block)
    counts = rows.groupBy(group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(W.partitionBy(group, "_block").orderBy(*order))
    return (
        rows.withColumn("_rank", rank)
        .join(F.broadcast(starts), [group, "_block"])
        .withColumn(slot, (F.col("_start") + F.col("_rank") - 1).cast("long"))
        .drop("_block", "_rank", "_start")
    )
