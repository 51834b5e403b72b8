"""Connected components of an edge table by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.sources.tables import materialise, release


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, label) for all nodes of `edges` (columns a, b) and of `labels` (node, label),
    whose labels count as links too. The label is the component's least node.

    Each round sends labels along edges, combines them before the shuffle, and follows
    pointers once; each round is written, so a lost executor re-reads it, and joins have
    exchanges on both sides that adaptive execution may split when a node is hot.
    """
    links = edges.select("a", "b")
    if labels is not None:
        links = links.union(labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")))
    both = materialise(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    now = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        sent = both.join(now, both.a == now.node).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("seen"))
        heard = now.join(sent, "node", "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("seen", "label")).alias("label"))
        heard = materialise(heard, "labels")
        upper = heard.select(F.col("node").alias("up"), F.col("label").alias("top"))
        jumped = heard.join(upper, heard.label == upper.up, "left").select("node", "was", F.least("label", F.coalesce("top", "label")).alias("label"))
        jumped = materialise(jumped, "labels")
        release(now, heard)
        now = jumped
        if not now.where("was <> label").limit(1).count():
            release(both)
            return now.select("node", "label")
        now = now.select("node", "label")
