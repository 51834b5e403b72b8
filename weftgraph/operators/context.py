"""Context under a token budget: the resolution ladder, greedy context, change plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import ladders as L
from weftgraph.functions import text as T
from weftgraph.operators import relational as R

# Budgets by mode; how many nodes of each category a capsule takes, in its order; what a mode includes.
BUDGETS = {"minimal": 4_000, "standard": 12_000, "strict": 24_000}
LEAST_BUDGET, MOST_BUDGET, MOST_CONTEXT = 100, 100_000, 500
CATEGORIES = {"dependency": 20, "caller": 10, "test": 5, "contract": 1, "homolog": 5, "dispatch": 10, "family": 3, "effect": 1}
MODES = {"minimal": ("dependency",), "standard": ("dependency", "caller", "test", "effect"), "strict": tuple(CATEGORIES)}


def _tokens(text: Column) -> Column:
    return T.token_estimate(F.coalesce(text, F.lit("")))


def ladder_steps(used: Column, node: Column, budget: Column) -> Column:
    """(resolution, tokens) of one node given what is used: the richest form that fits."""
    code, summary, signature, name = node["code"], node["summary"], node["signature"], node["name"]
    step = lambda resolution, tokens: F.struct(F.lit(resolution).alias("resolution"), tokens.cast("long").alias("tokens"))
    fits = lambda tokens: used + tokens <= budget
    return (
        F.when((code == 0) & (summary > 0) & fits(summary), step("contract_summary", summary))
        .when((code > 0) & fits(code + summary), step("full_source", code + summary))
        .when(fits(signature), step("signature_only", signature))
        .when((summary > 0) & fits(summary), step("contract_summary", summary))
        .when(fits(name), step("name_only", name))
        .otherwise(step("omitted", F.lit(0)))
    )


def capsules(targets: DataFrame, nodes: DataFrame, mode: str = "standard", budget: int | None = None) -> DataFrame:
    """(target, target_tokens, used, picks): how each node of a capsule is included.

    `targets` has target, code, signature; `nodes` target, node, category, relevance, name, code, summary, signature. Nodes come
    by category in the order of CATEGORIES, each up to its number, the most relevant first. A capsule's nodes are few, by these
    numbers, so the order-dependent fold runs over one row's array.
    """
    budget = max(LEAST_BUDGET, min(budget if budget is not None else BUDGETS[mode], MOST_BUDGET))
    order = F.create_map(*[F.lit(x) for i, c in enumerate(CATEGORIES) for x in (c, i)])
    cap = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    wanted = nodes.where(F.col("category").isin(*MODES[mode]))
    ranked = R.top_of_each(wanted, ["target", "category"], [F.desc("relevance"), F.col("node")], max(CATEGORIES.values())).where(F.col("rank") <= F.element_at(cap, F.col("category")))
    sized = F.struct(
        F.element_at(order, F.col("category")).alias("turn"), "rank", "node", "category", _tokens(F.col("code")).alias("code"), _tokens(F.col("summary")).alias("summary"),
        _tokens(F.coalesce("signature", F.substring_index("summary", "\n", 1))).alias("signature"), _tokens(F.col("name")).alias("name"),
    )
    lists = ranked.groupBy("target").agg(F.array_sort(F.collect_list(sized)).alias("nodes"))
    signature = F.least(_tokens(F.col("signature")), F.lit(budget))
    own = F.least(_tokens(F.col("code")) + signature, F.lit(budget)).cast("long")
    kind = nodes.schema["node"].dataType.simpleString()
    pick = f"array<struct<node:{kind},category:string,resolution:string,tokens:bigint>>"
    zero = F.struct(F.col("target_tokens").alias("used"), F.array().cast(pick).alias("picks"))

    def fold(state, node):
        got = ladder_steps(state["used"], node, F.lit(budget))
        taken = F.struct(node["node"].alias("node"), node["category"].alias("category"), got["resolution"].alias("resolution"), got["tokens"].alias("tokens"))
        return F.struct((state["used"] + got["tokens"]).alias("used"), F.concat(state["picks"], F.array(taken)).alias("picks"))

    rows = targets.select("target", own.alias("target_tokens")).join(lists, "target", "left")
    none = F.coalesce("nodes", F.array())
    return rows.select("target", "target_tokens", F.aggregate(none, zero, fold).alias("f")).select("target", "target_tokens", "f.used", "f.picks")


def smart_context(targets: DataFrame, impacts: DataFrame, sources: DataFrame, budget: int = 12_000) -> DataFrame:
    """(group, used, taken, n): targets' sources first, then impacts by severity while they fit; those that don't are skipped.

    `targets` has group, symbol; `impacts` group, symbol, severity; `sources` symbol, source.
    """
    strongest = impacts.groupBy("group", "symbol").agg(F.max(L.rank_of(F.col("severity"), L.SEVERITIES)).alias("rank"))
    first = targets.select("group", "symbol", F.lit(99).alias("rank"))
    rows = first.unionByName(strongest.join(targets.select("group", "symbol"), ["group", "symbol"], "left_anti"))
    priced = rows.join(sources, "symbol", "left").select("group", "symbol", (-F.col("rank")).alias("turn"), _tokens(F.col("source")).alias("tokens"))
    return R.greedy_budget(priced, "group", "symbol", "tokens", ["turn", "symbol"], budget)


def change_plan(matches: DataFrame, impacts: DataFrame, confidences: DataFrame) -> DataFrame:
    """(plan, symbols, impacts, capsule_mode, mean_confidence, band) of matches (plan, symbol), impacts (plan, symbol) and
    confidences (symbol, confidence)."""
    sure = matches.join(confidences, "symbol", "left").groupBy("plan").agg(F.count(F.lit(1)).alias("symbols"), F.avg(F.coalesce("confidence", F.lit(1.0))).alias("mean_confidence"))
    hit = impacts.groupBy("plan").agg(F.countDistinct("symbol").alias("impacts"))
    rows = sure.join(hit, "plan", "left").withColumn("impacts", F.coalesce("impacts", F.lit(0)).cast("long"))
    mode = F.when(F.col("impacts") >= 20, "strict").when(F.col("impacts") >= 5, "standard").otherwise("minimal")
    return rows.select("plan", "symbols", "impacts", mode.alias("capsule_mode"), "mean_confidence", L.confidence_band(F.col("mean_confidence")).alias("band"))


def missing_targets(wanted: DataFrame, versions: DataFrame) -> DataFrame:
    """Wanted (txn, symbol) that a snapshot (symbol) does not have."""
    return wanted.join(versions.select("symbol").distinct(), "symbol", "left_anti")


def append_patches(transactions: DataFrame, patches: DataFrame) -> DataFrame:
    """`transactions` (txn, state, patches) with new patches (txn, patch) appended where the state allows it."""
    more = patches.groupBy("txn").agg(F.array_sort(F.collect_list("patch")).alias("_more"))
    allowed = F.col("state").isin("validated", "propagation_pending") & F.col("_more").isNotNull()
    return transactions.join(more, "txn", "left").withColumn("applied", allowed).withColumn("patches", F.when(allowed, F.concat("patches", "_more")).otherwise(F.col("patches"))).drop("_more")
