"""Graph operators over edge tables (src, dst, relation_type, confidence).

Loops run on the driver, one step of the graph per round; each round's table is written to the
shared folder, so plans stay short and a lost executor re-reads files.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import relational as R
from weftgraph.sources.tables import extend, materialise

CALLS = ("calls", "references")
MAX_DEPTH, MAX_NODES, MAX_HOPS, MAX_CHAIN = 5, 100, 4, 100
#: Effects that still say something about a caller.
TRANSITIVE_KINDS = ("reads", "writes", "opens", "calls_external", "emits", "requires", "acquires_lock", "throws")


def resolve_relations(found: DataFrame, sources: DataFrame, targets: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """`found` (source_key, target, relation_type) with src, dst, confidence and status. `sources` has
    stable_key, id. The target is looked up in `targets` in turn; what is not found keeps a status that says why."""
    out = R.resolve_cascade(found, "source_key", [(sources, "stable_key", "id")], "src")
    out = R.resolve_cascade(out, "target", targets, "dst")
    status = F.when(F.col("src").isNull(), "unknown_source").when(F.col("dst").isNull(), "unknown_target").otherwise("resolved")
    return out.withColumn("status", status).withColumn("confidence", F.when(status == "resolved", 0.9)).withColumn("strength", F.when(status == "resolved", 1.0))


def relations_of(edges: DataFrame, node, direction: str, types: tuple[str, ...] | None = CALLS, limit: int = 1000) -> DataFrame:
    """Callers ("in"), callees ("out") or all relations ("both") of a node, the surest first."""
    at = {"in": F.col("dst") == node, "out": F.col("src") == node, "both": (F.col("src") == node) | (F.col("dst") == node)}[direction]
    rows = edges.where(at if types is None else at & F.col("relation_type").isin(*types))
    return rows.orderBy(F.desc("confidence"), "src", "dst", "relation_type").limit(limit)


def step(edges: DataFrame, frontier: DataFrame, direction: str) -> DataFrame:
    """(node, via columns) one edge away from `frontier` (node)."""
    rows = []
    if direction in ("out", "both"):
        rows.append(edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node"), "relation_type", "confidence"))
    if direction in ("in", "both"):
        rows.append(edges.join(frontier.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "relation_type", "confidence"))
    return rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])


def levels(edges: DataFrame, starts: DataFrame, direction: str, depth: int, width: int | None = None) -> DataFrame:
    """(node, depth, confidence, relation_type) of nodes within `depth` steps of `starts` (node), each at its
    first depth, by its surest edge. `width` bounds a frontier, by id, where semantics ask for it."""
    depth = min(max(int(depth), 1), MAX_DEPTH)
    seen = materialise(starts.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("relation_type")), "level")
    frontier = seen
    for d in range(1, depth + 1):
        best = F.max(F.struct("confidence", F.col("relation_type").alias("type"))).alias("m")
        met = step(edges, frontier, direction).join(seen.select("node"), "node", "left_anti").groupBy("node").agg(best)
        frontier = materialise(met.select("node", F.lit(d).alias("depth"), "m.confidence", F.col("m.type").alias("relation_type")), "level")
        seen = seen.unionByName(frontier)
        if width is not None:
            frontier = frontier.orderBy("node").limit(width)
        if not frontier.limit(1).count():
            break
    return seen


def neighbourhood(edges: DataFrame, start, direction: str = "both", depth: int = 2, types: tuple[str, ...] | None = None, max_nodes: int = MAX_NODES) -> DataFrame:
    """(node, depth, truncated): the nearest `max_nodes` nodes around a start."""
    rows = edges if types is None else edges.where(F.col("relation_type").isin(*types))
    kind = edges.schema["src"].dataType.simpleString()
    starts = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"))
    found = levels(rows, starts, direction, depth).select("node", "depth")
    total = found.agg(F.count(F.lit(1)).alias("_n"))
    first = found.orderBy("depth", "node").limit(max_nodes)
    return first.crossJoin(F.broadcast(total)).select("node", "depth", (F.col("_n") > max_nodes).alias("truncated"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each connected component of (src, dst), by labels and pointer jumping."""
    links = edges.select("src", "dst")
    both = materialise(links.union(links.select("dst", "src")).distinct(), "links")
    now = materialise(both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("component")), "labels")
    while True:
        sent = both.join(now, both.src == now.node).groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("seen"))
        heard = materialise(now.join(sent, "node", "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("seen", "component")).alias("component")), "labels")
        upper = heard.select(F.col("node").alias("up"), F.col("component").alias("top"))
        jumped = heard.join(upper, heard.component == upper.up, "left").select("node", "was", F.least("component", F.coalesce("top", "component")).alias("component"))
        now = materialise(jumped, "labels")
        if not now.where("was <> component").limit(1).count():
            return now.select("node", "component")
        now = now.select("node", "component")


def peel(nodes: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Layers of a call graph from its leaves: (node, turn) of what can be ordered, and the nodes that call
    into a cycle and never can. `nodes` (node) bounds the graph; `calls` has src, dst. Each layer is appended to one table."""
    calls = materialise(calls.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst").distinct(), "calls")
    left, turn = materialise(nodes.select("node"), "waiting"), 0
    done = None
    while True:
        # A node waits while it calls a node that waits.
        waiting = calls.join(left.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        blocked = materialise(left.join(waiting, "node", "left_semi"), "waiting")
        ready = left.join(blocked, "node", "left_anti").select("node", F.lit(turn).alias("turn"))
        done = materialise(ready, "layers") if done is None else extend(done, ready)
        if blocked.count() == left.count() or not blocked.limit(1).count():
            return done, blocked
        left, turn = blocked, turn + 1


def propagate_levels(profiles: DataFrame, calls: DataFrame) -> DataFrame:
    """(node, level, final): the highest level among a node and all it calls, directly or not. Nodes that
    call into a cycle get the highest level of their weakly connected cluster of such nodes."""
    layers, stuck = peel(profiles, calls)
    known = materialise(profiles.select("node", "level").join(layers, "node", "left"), "levels")
    turns = layers.agg(F.max("turn")).first()[0] or 0
    now = materialise(known.where("turn = 0").select("node", F.col("level").alias("final")), "levels")
    calls = materialise(calls.select("src", "dst").distinct(), "calls")
    for turn in range(1, turns + 1):
        layer = known.where(F.col("turn") == turn).select("node", "level")
        out = calls.join(layer.select(F.col("node").alias("src")), "src", "left_semi")
        heard = out.join(now.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.max("final").alias("heard"))
        now = extend(now, layer.join(heard, "node", "left").select("node", F.greatest("level", F.coalesce("heard", "level")).alias("final")))
    heard = calls.join(now.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.max("final").alias("heard"))
    own = profiles.join(stuck, "node", "left_semi").join(heard, "node", "left").select("node", F.greatest("level", F.coalesce("heard", "level")).alias("own"))
    clusters = _clusters(stuck, calls)
    own = own.join(clusters, "node", "left").withColumn("component", F.coalesce("component", "node"))
    top = own.groupBy("component").agg(F.max("own").alias("final"))
    return profiles.join(now.unionByName(own.join(top, "component").select("node", "final")), "node").select("node", "level", "final")


def _clusters(stuck: DataFrame, calls: DataFrame) -> DataFrame:
    inside = calls.join(stuck.withColumnRenamed("node", "src"), "src", "left_semi").join(stuck.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return components(inside)


def propagate_effects(effects: DataFrame, calls: DataFrame) -> DataFrame:
    """(node, kind, descriptor, provenance, origin, hops): direct effects, and those of callees up to four calls
    away that still say something about a caller; the nearest origin wins, then the least.

    Nodes that call into a cycle do not pass anything on; they share the direct effects of their cluster.
    """
    calls = materialise(calls.select("src", "dst").distinct(), "calls")
    nodes = effects.select("node").distinct()
    done, stuck = peel(nodes, calls)
    direct = effects.select("node", "kind", "descriptor").distinct().select("*", F.lit("direct").alias("provenance"), F.lit(None).cast(effects.schema["node"].dataType).alias("origin"), F.lit(0).alias("hops"))
    seen = materialise(direct, "effects")
    front = seen.where(F.col("kind").isin(*TRANSITIVE_KINDS))
    key = ["node", "kind", "descriptor"]
    for hops in range(1, MAX_HOPS + 1):
        free = front.join(done.select("node"), "node", "left_semi").select(F.col("node").alias("dst"), "kind", "descriptor", F.coalesce("origin", "node").alias("origin"))
        moved = calls.join(free, "dst").select(F.col("src").alias("node"), "kind", "descriptor", "origin").join(nodes, "node", "left_semi")
        fresh = moved.join(seen.select(*key), key, "left_anti").groupBy(*key).agg(F.min("origin").alias("origin"))
        front = materialise(fresh.select(*key, F.lit("transitive").alias("provenance"), "origin", F.lit(hops).alias("hops")), "effects")
        seen = seen.unionByName(front)
    clusters = materialise(_clusters(stuck, calls), "clusters")
    shared = direct.where(F.col("kind").isin(*TRANSITIVE_KINDS)).join(clusters, "node").select("component", "kind", "descriptor").distinct()
    given = clusters.join(shared, "component").select(*key).join(seen.select(*key), key, "left_anti")
    return seen.unionByName(given.select(*key, F.lit("transitive").alias("provenance"), F.col("node").alias("origin"), F.lit(1).alias("hops")))


def c3_merge(lists: list[list]) -> list | None:
    """Merges parents' orders so that each keeps its own; None if they contradict each other."""
    lists, out = [list(x) for x in lists if len(x)], []
    while lists:
        head = next((x[0] for x in lists if not any(x[0] in y[1:] for y in lists)), None)
        if head is None:
            return None
        out.append(head)
        lists = [y for y in ([v for v in x if v != head] if x[0] == head else x for x in lists) if y]
    return out


def linearise(hierarchy: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, mro): C3 order of ancestors, or depth-first order where C3 fails. `hierarchy` has class, parent,
    position; `classes` (class) all classes.

    Classes are taken level by level from the roots; a class's row holds its parents' orders only, so no
    whole hierarchy meets in one task. Classes in or below a cycle get themselves only.
    """
    parents = materialise(hierarchy.select("class", "parent", "position").distinct(), "parents")
    kind = classes.schema["class"].dataType.simpleString()

    def order(batches):
        for pdf in batches:
            rows = []
            for name, pairs in zip(pdf["class"], pdf["parents"], strict=True):
                pairs = sorted(pairs, key=lambda p: p["position"])
                c3, dfs = [list(p["mro"]) for p in pairs], [list(p["dfs"]) for p in pairs]
                merged = c3_merge([*c3, [p["parent"] for p in pairs]])
                deep = list(dict.fromkeys([name, *(v for x in dfs for v in x)]))
                rows.append((name, deep if merged is None else [name, *merged], deep))
            yield pd.DataFrame(rows, columns=["class", "mro", "dfs"])

    known = parents.select("class").union(parents.select("parent")).union(classes.select("class")).distinct()
    self_only = F.array("class").alias("mro"), F.array("class").alias("dfs")
    done = materialise(known.join(parents, "class", "left_anti").select("class", *self_only), "mro")
    left = materialise(known.join(done, "class", "left_anti"), "mro-left")
    while left.limit(1).count():
        ready = parents.join(left.select("class"), "class", "left_semi").join(done.select(F.col("class").alias("parent"), "mro", "dfs"), "parent", "left")
        ready = ready.groupBy("class").agg(F.collect_list(F.struct("parent", "position", "mro", "dfs")).alias("parents"), F.count_if(F.col("mro").isNull()).alias("open")).where("open = 0")
        fresh = materialise(ready.select("class", "parents").mapInPandas(order, f"class {kind}, mro array<{kind}>, dfs array<{kind}>"), "mro")
        if not fresh.limit(1).count():
            break
        done = done.unionByName(fresh)
        left = materialise(left.join(fresh.select("class"), "class", "left_anti"), "mro-left")
    return done.select("class", "mro").unionByName(left.select("class", F.array("class").alias("mro")))


def override_chain(mro: DataFrame, methods: DataFrame) -> DataFrame:
    """(class, method, owners): the classes of the order that define a method. `methods` has class, method."""
    rows = mro.select("class", F.posexplode("mro").alias("position", "owner"))
    owned = rows.join(methods.select(F.col("class").alias("owner"), "method"), "owner")
    listed = F.array_sort(F.collect_list(F.struct("position", "owner")))
    return owned.groupBy("class", "method").agg(F.transform(listed, lambda s: s["owner"]).alias("owners"))


def ancestors(hierarchy: DataFrame) -> DataFrame:
    """(class, parents): direct parents in order."""
    listed = F.array_sort(F.collect_list(F.struct("position", "parent")))
    return hierarchy.groupBy("class").agg(F.transform(listed, lambda s: s["parent"]).alias("parents"))


def lineage_chains(lineage: DataFrame, most: int = MAX_CHAIN) -> DataFrame:
    """(start, id, depth): each lineage and what it came from, `most` at most. `lineage` has id, previous. One step per job, as
    Spark's own recursion ends in an error at a million rows."""
    known = materialise(lineage.select("id", "previous"), "lineage")
    front = materialise(known.select(F.col("id").alias("start"), "id", "previous", F.lit(0).alias("depth")), "chain")
    seen = front
    for depth in range(1, most):
        moved = front.where("previous IS NOT NULL").select("start", F.col("previous").alias("id"))
        front = materialise(moved.join(known, "id").select("start", "id", "previous", F.lit(depth).alias("depth")), "chain")
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen.select("start", "id", "depth")


def member_relations(edges: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """Relations of classes that have none of their own, taken from their members. `classes` has id, key;
    `members` id, key, where a member's key starts with its class's and a dot."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    bare = classes.join(ends, "id", "left_anti").select(F.col("id").alias("class_id"), F.col("key").alias("class_key"))
    owned = R.members_by_prefix(bare, "class_key", members.select("id", "key"), "key").select("class_id", "id")
    rows = R.touching(edges, owned, "id").join(owned.withColumnRenamed("id", "node"), "node")
    return rows.select("class_id", "src", "dst", "relation_type", "confidence").distinct()


def explain_pair(edges: DataFrame, inferred: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, forward, backward, inferred, summary) of pairs (a, b)."""
    count = lambda df, x, y, name: df.groupBy(F.col(x).alias("a"), F.col(y).alias("b")).agg(F.count(F.lit(1)).alias(name))
    both = count(inferred, "src", "dst", "i1"), count(inferred, "dst", "src", "i2")
    out = pairs.join(count(edges, "src", "dst", "forward"), ["a", "b"], "left").join(count(edges, "dst", "src", "backward"), ["a", "b"], "left")
    out = out.join(both[0], ["a", "b"], "left").join(both[1], ["a", "b"], "left").fillna(0)
    total = (F.col("i1") + F.col("i2")).alias("inferred")
    summary = F.when(F.col("forward") + F.col("backward") + F.col("i1") + F.col("i2") == 0, "no relation").otherwise(
        F.concat(F.col("forward") + F.col("backward"), F.lit(" structural, "), F.col("i1") + F.col("i2"), F.lit(" inferred"))
    )
    return out.select("a", "b", "forward", "backward", total, summary.alias("summary"))


def tests_of(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """(symbol, artifact, path): tests that list a symbol, or whose code refers to it; one row each.
    `artifacts` has artifact, test (its symbol), related (array)."""
    listed = artifacts.select(F.explode("related").alias("symbol"), "artifact", F.lit(0).alias("turn"))
    referred = edges.where("relation_type = 'references'").join(artifacts.select(F.col("test").alias("src"), "artifact"), "src").select(F.col("dst").alias("symbol"), "artifact", F.lit(1).alias("turn"))
    merged = listed.union(referred).groupBy("symbol", "artifact").agg(F.min("turn").alias("turn"))
    return merged.select("symbol", "artifact", F.when(F.col("turn") == 0, "related").otherwise("references").alias("path"))


def tests_by_symbol(artifacts: DataFrame) -> DataFrame:
    """(symbol, tests): tests per symbol, sorted."""
    return artifacts.select(F.explode("related").alias("symbol"), "artifact").groupBy("symbol").agg(F.array_sort(F.collect_set("artifact")).alias("tests"))


def is_test_path(path):
    return path.contains(".test.") | path.contains(".spec.") | path.contains("__tests__")


def test_framework(path):
    script = path.rlike(r"[.](test|spec)[.](ts|js)")
    return F.when(script, "jest").when(path.endswith(".py"), "pytest").otherwise("unknown")


def infer_tests(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(test, framework, symbol): other code that a test calls, refers to, imports or names. `symbols` has id,
    name, path, body; of several symbols of one name the greatest id counts."""
    tests, others = symbols.where(is_test_path(F.col("path"))), symbols.where(~is_test_path(F.col("path")))
    rows = edges.where(F.col("relation_type").isin("calls", "references", "imports"))
    called = rows.join(tests.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("test"), F.col("dst").alias("symbol")).join(tests.select(F.col("id").alias("symbol")), "symbol", "left_anti")
    words = tests.select(F.col("id").alias("test"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit("[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)))).alias("name"))
    names = others.where(F.length("name") >= 3).groupBy("name").agg(F.max("id").alias("symbol"))
    found = called.select("test", "symbol").union(words.join(names, "name").select("test", "symbol")).distinct()
    return found.join(tests.select(F.col("id").alias("test"), test_framework(F.col("path")).alias("framework")), "test").select("test", "framework", "symbol")
