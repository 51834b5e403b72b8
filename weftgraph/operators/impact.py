"""Blast radius of changed symbols in five dimensions.

Each dimension gives (symbol, impact_type, confidence, severity); `targets` has column node.
Edges are (src, dst, relation_type, confidence).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import ladders as L
from weftgraph.operators import graph as G

#: Limits of a request by a person: targets, and nodes that a level goes on from. None lifts them.
MAX_TARGETS, FRONTIER = 20, 500


def structural(edges: DataFrame, targets: DataFrame, depth: int = 2, width: int | None = FRONTIER) -> DataFrame:
    """Callers up to `depth` levels away. Also gives depth (from 1), relation_type and action."""
    found = G.levels(edges, targets, "in", depth, width=width).where("depth > 0")
    d = F.col("depth") - 1
    return found.select(
        F.col("node").alias("symbol"), F.lit("structural").alias("impact_type"), F.greatest(F.lit(0.05), F.col("confidence") * (1 - d * 0.2)).alias("confidence"),
        L.structural_severity(d).alias("severity"), "depth", "relation_type", F.when(d == 0, "rerun_test").otherwise("manual_review").alias("action"),
    )


def behavioral(edges: DataFrame, purity: DataFrame, targets: DataFrame) -> DataFrame:
    """Callers that have been pure or read-only so far. `purity` has sv_id, purity_class."""
    calm = purity.where(F.col("purity_class").isin("pure", "read_only")).select(F.col("sv_id").alias("src"))
    callers = edges.where(F.col("relation_type").isin(*G.CALLS)).join(targets.select(F.col("node").alias("dst")), "dst", "left_semi")
    return callers.join(calm, "src", "left_semi").select(F.col("src").alias("symbol")).distinct().select("symbol", F.lit("behavioral").alias("impact_type"), F.lit(0.8).alias("confidence"), F.lit("high").alias("severity"))


def contract(invariants: DataFrame, targets: DataFrame) -> DataFrame:
    """Invariants of the targets; confidence is their strength. Also gives expression."""
    rows = invariants.join(targets.select(F.col("node").alias("sv_id")), "sv_id", "left_semi")
    return rows.select(F.col("sv_id").alias("symbol"), F.lit("contract").alias("impact_type"), F.col("strength").alias("confidence"), L.invariant_severity(F.col("strength")).alias("severity"), "expression")


def _other_ends(inferred: DataFrame, targets: DataFrame, impact: str, severity) -> DataFrame:
    ids = targets.select("node")
    out = inferred.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("symbol"), "confidence")
    back = inferred.join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("symbol"), "confidence")
    best = out.union(back).join(ids.withColumnRenamed("node", "symbol"), "symbol", "left_anti").groupBy("symbol").agg(F.max("confidence").alias("confidence"))
    return best.select("symbol", F.lit(impact).alias("impact_type"), "confidence", severity.alias("severity"))


def homolog(inferred: DataFrame, targets: DataFrame) -> DataFrame:
    """Open, unrejected homologs of confidence 0.6 and more."""
    rows = inferred.where("relation_type <> 'co_changed_with' AND confidence >= 0.6 AND review_state <> 'rejected' AND valid_to IS NULL")
    return _other_ends(rows, targets, "homolog", F.when(F.col("confidence") >= 0.85, "high").otherwise("medium"))


def historical(inferred: DataFrame, targets: DataFrame) -> DataFrame:
    """Open co-change relations of confidence 0.5 and more, whatever their review state."""
    rows = inferred.where("relation_type = 'co_changed_with' AND confidence >= 0.5 AND valid_to IS NULL")
    return _other_ends(rows, targets, "historical", F.when(F.col("confidence") >= 0.8, "medium").otherwise("low"))


def report(dimensions: dict[str, DataFrame]) -> DataFrame:
    """One row: impacts per dimension, distinct symbols, and the validation scope. Severities count in
    the structural, behavioral and contract dimensions only."""
    rows = None
    for df in dimensions.values():
        part = df.select("symbol", "impact_type", "severity")
        rows = part if rows is None else rows.unionByName(part)
    graded = F.col("impact_type").isin("structural", "behavioral", "contract")
    counts = [F.count_if(F.col("impact_type") == name).alias(name) for name in dimensions]
    total = rows.agg(*counts, F.countDistinct("symbol").alias("total"), F.count_if(graded & (F.col("severity") == "critical")).alias("critical"), F.count_if(graded & (F.col("severity") == "high")).alias("high"))
    return total.withColumn("scope", L.validation_scope(F.col("critical"), F.col("high"), F.col("total")))


def blast_radius(edges: DataFrame, purity: DataFrame, invariants: DataFrame, inferred: DataFrame, targets: DataFrame, depth: int = 2, most: int | None = MAX_TARGETS, width: int | None = FRONTIER) -> dict[str, DataFrame]:
    """All five dimensions by name; more than `most` targets are refused."""
    if most is not None and targets.limit(most + 1).count() > most:
        raise ValueError(f"at most {most} targets")
    return {
        "structural": structural(edges, targets, depth, width), "behavioral": behavioral(edges, purity, targets), "contract": contract(invariants, targets),
        "homolog": homolog(inferred, targets), "historical": historical(inferred, targets),
    }
