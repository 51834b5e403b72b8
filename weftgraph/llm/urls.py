"""URL filter: explicit rules first, then a path-template tree judged by labelled purity.

Each host has a tree of path segments, `depth` levels deep, grown level by level. Below a
node, a segment is a wildcard if it varies (has a digit or over 32 characters) or stands on
fewer than `least` pages there. Siblings are merged into the wildcard when a two-sample test
finds no difference (below `z`) between the bad rate of a sibling's labelled pages and that of
the others'; siblings without labels, or with no labelled sibling to compare with, stay apart. So a node is a host and
a chain of fixed segments and wildcards, and its pages are counted under that chain alone.

Purity is the share of bad pages among a node's labelled ones, smoothed with `weight` pages
towards what is known of it otherwise: the purity of the node above or, if the same template has
labels on any host, the geometric mean of that and its bad rate over all hosts, so that both have to speak
against it. The host's own node is smoothed towards zero, so on hosts without labels nothing is rejected. A template is rejected when
its purity reaches one half. Labels are any 0/1 column; the registered query labels pages by
the rules that fit them.

A null url, or one without "://", has an empty host and an empty path, the root of its tree. Paths of any
length are read whole and judged at their first `depth` segments. Repeated urls
are judged alike; ties can't occur, since all steps are sums. An empty table gives no rows;
input columns named like output columns are replaced. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.sources.tables import materialise

#: (rule, verdict): host, a slash, and the path's start.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (host part and path part together) that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{start}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def lexical_template(path: Column, depth: int = 4) -> Column:
    """The first segments joined by "/", with those that have a digit or over 32 characters as "*"."""
    segments = F.slice(F.filter(F.split(path, "/"), lambda s: s != ""), 1, depth)
    return F.concat_ws("/", F.transform(segments, lambda s: F.when(s.rlike("[0-9]") | (F.length(s) > 32), F.lit("*")).otherwise(s)))


def _names(rows: DataFrame, least: int, z: float) -> DataFrame:
    """For the children of each node (host, branch): seg, fixed (the segment or "*") and name (after merging)."""
    kids = rows.where("seg IS NOT NULL").groupBy("host", "branch", "seg").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    kids = materialise(kids.withColumn("fixed", F.when(F.col("n") >= least, F.col("seg")).otherwise(F.lit("*"))), "kids")
    sums = kids.groupBy("host", "branch", "fixed").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    every = kids.groupBy("host", "branch").agg(F.sum("labelled").alias("every_l"), F.sum("bad").alias("every_b"))
    p, others = F.try_divide("every_b", "every_l"), F.col("every_l") - F.col("l")
    gap = F.abs(F.try_divide("b", "l") - F.try_divide(F.col("every_b") - F.col("b"), others))
    alike = (F.col("l") > 0) & (others > 0) & (gap <= z * F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1), F.col("l")) + F.try_divide(F.lit(1), others))))
    named = sums.join(every, ["host", "branch"]).select("host", "branch", "fixed", F.when(alike, F.lit("*")).otherwise(F.col("fixed")).alias("name"))
    return kids.select("host", "branch", "seg", "fixed").join(named, ["host", "branch", "fixed"])


def templates(pages: DataFrame, depth: int = 4, least: int = 3, z: float = 1.96, weight: float = 4.0) -> DataFrame:
    """`pages` has host, shape (lexical template) and bad (1, 0 or null). One row per host
    and shape: branch (its node), labelled, bad (of the node) and purity.

    All tables are sums per host and shape or smaller, combined before their shuffles; each
    level is written. Where no path goes deeper, the tree ends.
    """
    shapes = pages.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    shapes = materialise(shapes, "shapes")
    roots = shapes.groupBy("host").agg(F.sum("labelled").alias("node_l"), F.sum("bad").alias("node_b"))
    roots = roots.withColumn("purity", F.col("node_b") / (F.col("node_l") + F.lit(weight)))
    rows = materialise(shapes.join(roots, "host").select("*", F.lit("").alias("branch"), F.lit("").alias("general")), "tree-0")
    for level in range(1, depth + 1):
        cut = rows.withColumn("seg", F.nullif(F.split_part("shape", F.lit("/"), F.lit(level)), F.lit("")))
        if not cut.where("seg IS NOT NULL").limit(1).count():
            break
        named = cut.where("seg IS NOT NULL").join(_names(cut, least, z), ["host", "branch", "seg"])
        named = named.withColumns({"branch": F.concat_ws("/", "branch", "name"), "general": F.concat_ws("/", "general", "fixed")}).drop("name", "fixed", "node_l", "node_b")
        named = materialise(named, "named")
        nodes = named.groupBy("host", "branch").agg(F.sum("labelled").alias("node_l"), F.sum("bad").alias("node_b"))
        known = named.groupBy("general").agg(F.try_divide(F.sum("bad"), F.sum("labelled")).alias("rate"))
        # A node's members may have several templates: the mean over its pages that have a known one.
        usual = named.join(known.where("rate IS NOT NULL"), "general").groupBy("host", "branch").agg((F.sum(F.col("n") * F.col("rate")) / F.sum("n")).alias("rate"))
        above = named.groupBy("host", "branch").agg(F.max("purity").alias("above"))
        towards = F.coalesce(F.sqrt(F.col("above") * F.col("rate")), F.col("above"))
        judged = nodes.join(above, ["host", "branch"]).join(usual, ["host", "branch"], "left")
        judged = judged.select("host", "branch", "node_l", "node_b", ((F.col("node_b") + F.lit(weight) * towards) / (F.col("node_l") + F.lit(weight))).alias("purity"))
        deeper = named.drop("purity", "seg").join(judged, ["host", "branch"]).select(*rows.columns)
        rows = materialise(cut.where("seg IS NULL").select(*rows.columns).union(deeper), f"tree-{level}")
    return rows.select("host", "shape", "branch", F.col("node_l").alias("labelled"), F.col("node_b").alias("bad"), "purity")


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """key, host, path, rule, verdict, and the method's branch and purity, for every row.

    The templates are written before the join so that both sides are exchanged and a
    host with a large share of all rows is split by adaptive execution.
    """
    seen = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    seen = seen.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("shape", lexical_template(F.col("path")))
    said = F.lit(None).cast("string")
    for rule, verdict in rules:
        said = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(said)
    seen = seen.withColumn("said", said).withColumn("bad", F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0))
    tree = materialise(templates(seen).select("host", "shape", "branch", "purity"), "templates")
    return seen.join(tree, ["host", "shape"], "left").select(
        key, "host", "path", "rule", F.coalesce("said", F.when(F.round("purity", 6) >= 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "branch", F.round("purity", 6).alias("purity")
    )
