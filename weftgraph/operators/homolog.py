"""Homolog inference: candidates, seven-dimensional scores, contradictions, relation types, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.operators import relational as R
from weftgraph.operators import vectors as V
from weftgraph.sources.tables import materialise

# Weights and thresholds.
WEIGHTS = {"semantic": 0.20, "logic": 0.20, "signature": 0.15, "behavior": 0.15, "contract": 0.15, "tests": 0.10, "history": 0.05}
FAMILY_FLOOR, MIN_FAMILIES, MIN_TOTAL, SAFE = 0.1, 2, 0.60, 0.85
CAPS = {"body_hash": 50, "ast_hash": 50, "normalized_ast_hash": 50, "name": 30, "behavior": 30, "kind": 20, "semantic": 30}


def _best_others(targets: DataFrame, offers: DataFrame, own: str, order: list[Column], cap: int) -> DataFrame:
    """(target, candidate): the first `cap` of what a target's group `own` is offered, without itself. `targets` has target and
    `own`; `offers` `own`, candidate. A group is cut once, at one more than a target may take, as one of them may be itself."""
    first = R.top_of_each(offers, [own], order, cap + 1, "_turn")
    turn = F.count_if(F.col("candidate") == F.col("target")).over(W.partitionBy("target"))
    met = targets.join(first, own)
    return met.withColumn("_self", F.coalesce(turn, F.lit(0))).where((F.col("_turn") <= cap + F.col("_self")) & (F.col("target") != F.col("candidate"))).select("target", "candidate")


def candidates(targets: DataFrame, symbols: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """Distinct (target, candidate) from the buckets of CAPS and `semantic` pairs.

    Both tables have sv_id, name, kind, purity_class, body_hash, ast_hash, normalized_ast_hash. A bucket
    offers its first rows by id, names the most similar first; symbols are ranked inside their
    bucket before the join, so a bucket of any size costs one sort. Trigrams are those of distinct names.
    """
    found = []
    for bucket, keys in (("body_hash", ["body_hash"]), ("ast_hash", ["ast_hash"]), ("normalized_ast_hash", ["normalized_ast_hash"]), ("behavior", ["kind", "purity_class"]), ("kind", ["kind"])):
        cap = CAPS[bucket]
        known = symbols.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
        offered = R.top_of_each(known.select("sv_id", *keys), keys, [F.col("sv_id")], cap + 1).select(F.col("sv_id").alias("candidate"), "rank", *keys)
        met = targets.select(F.col("sv_id").alias("target"), *keys).join(offered, keys).where("target <> candidate")
        found.append(R.top_of_each(met.drop("rank"), ["target"], [F.col("candidate")], cap).select("target", "candidate"))
    cap = CAPS["name"]
    grams = materialise(symbols.select("name").distinct().withColumn("grams", T.trigrams(F.col("name"))).select("name", F.size("grams").alias("n"), F.explode("grams").alias("gram")), "grams")
    asked = targets.select("name").distinct()
    wanted = grams.join(asked, "name", "left_semi").select(F.col("name").alias("own"), F.col("n").alias("na"), "gram")
    shared = wanted.join(grams.select(F.col("name").alias("other"), F.col("n").alias("nb"), "gram"), "gram").groupBy("own", "other", "na", "nb").agg(F.count(F.lit(1)).alias("both"))
    alike = shared.select("own", "other", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("sim")).where("sim >= 0.3")
    named = R.top_of_each(symbols.select(F.col("name").alias("other"), F.col("sv_id").alias("candidate")), ["other"], [F.col("candidate")], cap + 1).drop("rank")
    found.append(_best_others(targets.select(F.col("sv_id").alias("target"), F.col("name").alias("own")), alike.join(named, "other"), "own", [F.desc("sim"), F.col("candidate")], cap))
    if semantic is not None:
        found.append(semantic.select("target", "candidate"))
    return reduce(DataFrame.union, found).distinct()


def semantic_candidates(targets: DataFrame, members: DataFrame, signatures: DataFrame) -> DataFrame:
    """(target, candidate): for each target (sv_id) the most similar by MinHash of those that share a band with it.

    Symbols with equal token sets form a class: `members` has sv_id, class; `signatures` class, signature. Classes meet, not
    symbols; a class offers as many of its first members as one target may take, and is given as many once for all its targets.
    """
    cap = CAPS["semantic"]
    asked = targets.select(F.col("sv_id").alias("target")).join(members.select(F.col("sv_id").alias("target"), F.col("class").alias("a")), "target")
    keyed = signatures.select("class", V.band_keys(F.col("signature")).alias("band_keys"))
    mine = keyed.withColumnRenamed("class", "a").join(asked.select("a"), "a", "left_semi")
    met = V.band_pairs(mine, keyed.withColumnRenamed("class", "b"), "a", "b")
    alike = met.join(signatures.select(F.col("class").alias("a"), F.col("signature").alias("sa")), "a").join(signatures.select(F.col("class").alias("b"), F.col("signature").alias("sb")), "b")
    alike = alike.select("a", "b", V.estimated_jaccard(F.col("sa"), F.col("sb")).alias("similarity"))
    offered = R.top_of_each(members, ["class"], [F.col("sv_id")], cap + 1).select(F.col("class").alias("b"), F.col("sv_id").alias("candidate"))
    return _best_others(asked, alike.join(offered, "b"), "a", [F.desc("similarity"), F.col("candidate")], cap)


def body_similarity(pairs: DataFrame, members: DataFrame, signatures: DataFrame) -> DataFrame:
    """`pairs` (target, candidate, ...) with body: the estimated Jaccard similarity of their token sets, 0 where one has none.
    `members` and `signatures` as in `semantic_candidates`."""
    for key, own in (("target", "a"), ("candidate", "b")):
        known = members.join(signatures, "class").select(F.col("sv_id").alias(key), F.col("signature").alias(f"_{own}"))
        pairs = pairs.join(known, key, "left")
    return pairs.withColumn("body", F.coalesce(V.estimated_jaccard(F.col("_a"), F.col("_b")), F.lit(0.0))).drop("_a", "_b")


def logic_similarity(a: str, b: str, fallback: Column) -> Column:
    """1 for equal bodies, .9 for equal normalised trees, .85 for equal trees, else the estimate."""
    same = lambda c: F.col(f"{a}.{c}") == F.col(f"{b}.{c}")
    return F.when(same("body_hash"), 1.0).when(same("normalized_ast_hash"), 0.9).when(same("ast_hash"), 0.85).otherwise(F.coalesce(fallback, F.lit(0.0)))


def behavior_overlap(touches_a: Column, touches_b: Column, purity_a: Column, purity_b: Column) -> Column:
    """Jaccard of resources, .2 more for one purity class; without resources .3 for one impure class."""
    none = (F.size(touches_a) == 0) & (F.size(touches_b) == 0)
    bare = F.when((purity_a == purity_b) & (purity_a != "pure"), 0.3).otherwise(0.0)
    full = F.least(F.lit(1.0), T.jaccard(touches_a, touches_b) + F.when(purity_a == purity_b, 0.2).otherwise(0.0))
    known = purity_a.isNotNull() & purity_b.isNotNull()
    return F.when(~known, 0.0).when(none, bare).otherwise(full)


def contract_overlap(pairs: list[tuple[Column, Column]]) -> Column:
    """Share of equal fields among those that both sides have."""
    filled = lambda x: F.coalesce(x, F.lit("")) != ""
    both = reduce(lambda x, y: x + y, [F.when(filled(a) & filled(b), 1).otherwise(0) for a, b in pairs])
    same = reduce(lambda x, y: x + y, [F.when(filled(a) & (a == b), 1).otherwise(0) for a, b in pairs])
    return F.when(both > 0, same / both).otherwise(0.0)


def test_overlap(pairs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """`pairs` (target, candidate) with tests: .3 per test that lists both, 1 at most."""
    listed = artifacts.select("artifact", F.explode("related").alias("symbol")).distinct()
    asked = listed.withColumnRenamed("symbol", "target").join(pairs.select("target").distinct(), "target", "left_semi")
    both = asked.join(listed.withColumnRenamed("symbol", "candidate"), "artifact").groupBy("target", "candidate").agg(F.least(F.lit(1.0), 0.3 * F.count(F.lit(1))).alias("tests"))
    return pairs.join(both, ["target", "candidate"], "left").fillna(0.0, ["tests"])


def history(pairs: DataFrame, inferred: DataFrame) -> DataFrame:
    """`pairs` with history: the surest co-change relation either way."""
    rows = inferred.where("relation_type = 'co_changed_with'").select("src", "dst", "confidence")
    both = rows.union(rows.select("dst", "src", "confidence")).groupBy(F.col("src").alias("target"), F.col("dst").alias("candidate")).agg(F.max("confidence").alias("history"))
    return pairs.join(both, ["target", "candidate"], "left").fillna(0.0, ["history"])


def total_score(df: DataFrame) -> DataFrame:
    """With families (dimensions over .1) and total of the columns in WEIGHTS; equal structure counts as strong evidence."""
    families = reduce(lambda a, b: a + b, [(F.col(c) > FAMILY_FLOOR).cast("int") for c in WEIGHTS])
    total = reduce(lambda a, b: a + b, [w * F.col(c) for c, w in WEIGHTS.items()])
    same = F.col("logic") >= 0.85
    return df.withColumn("families", F.when(same, F.greatest(families, F.lit(3))).otherwise(families)).withColumn(
        "total", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(same, F.greatest(total, F.lit(0.85))).otherwise(total)))
    )


def accepted(scored: DataFrame, threshold: float = MIN_TOTAL) -> DataFrame:
    return scored.where((F.col("families") >= MIN_FAMILIES) & (F.col("total") >= threshold))


def contradictions(a: str, b: str) -> Column:
    """Flags of two behavioural profiles under aliases `a` and `b`."""
    col = lambda t, c: F.coalesce(F.col(f"{t}.{c}"), F.array().cast("array<string>"))
    differ = lambda x, y: F.array_sort(x) != F.array_sort(y)
    io = [F.concat(col(t, "db_reads"), col(t, "db_writes"), col(t, "network_calls")) for t in (a, b)]
    flags = [
        F.when(F.col(f"{a}.purity_class") != F.col(f"{b}.purity_class"), "side_effects_differ"),
        F.when(differ(col(a, "exception_profile"), col(b, "exception_profile")), "exception_semantics_differ"),
        F.when(differ(col(a, "auth_operations"), col(b, "auth_operations")), "security_context_differs"),
        F.when(differ(*io) & (F.size(io[0]) > 0) & (F.size(io[1]) > 0), "io_shape_diverges"),
    ]
    return F.array_compact(F.array(*flags))


def relation_type(logic: Column, behavior: Column, contract: Column, signature: Column, kind_a: Column, kind_b: Column, both_auth: Column, both_throw: Column) -> Column:
    kinds = lambda k: (kind_a == k) & (kind_b == k)
    return (
        F.when(logic >= 0.85, "near_duplicate_logic")
        .when(kinds("validator"), "validator_homolog")
        .when(kinds("serializer"), "serializer_homolog")
        .when(kinds("query_builder"), "query_logic_duplicate")
        .when((behavior >= 0.6) & both_auth, "auth_policy_peer")
        .when((contract >= 0.5) & both_throw, "error_mapping_peer")
        .when((behavior >= 0.7) & (contract >= 0.5), "business_rule_parallel")
        .when(contract >= 0.7, "contract_sibling")
        .when(signature >= 0.8, "normalization_homolog")
        .otherwise("near_duplicate_logic")
    )


def persist(old: DataFrame, new: DataFrame) -> DataFrame:
    """(src, dst, relation_type, confidence, evidence): the surest row wins, with its evidence."""
    return R.upsert_greatest(old, new, ["src", "dst", "relation_type"], "confidence", ("evidence",))


def evidence_bundles(scored: DataFrame) -> DataFrame:
    """One bundle per distinct tuple of scores; the first pair's flags stay."""
    keys = [F.round(c, 6).alias(c) for c in WEIGHTS]
    return scored.select(*keys, "target", "candidate", "flags").groupBy(*WEIGHTS).agg(F.min(F.struct("target", "candidate", "flags")).alias("m"), F.count(F.lit(1)).alias("pairs")).select(*WEIGHTS, "pairs", "m.flags")


def review(inferred: DataFrame, decisions: DataFrame) -> DataFrame:
    """`inferred` with previous_state and the review_state that `decisions` (src, dst, relation_type, new_state) give."""
    keys = ["src", "dst", "relation_type"]
    return inferred.withColumnRenamed("review_state", "previous_state").join(decisions, keys, "left").withColumn("review_state", F.coalesce("new_state", "previous_state")).drop("new_state")


def proposals(inferred: DataFrame, flags: DataFrame) -> DataFrame:
    """(src, dst, confidence, is_safe) of open homologs of .7 and more; safe without contradictions at .85. `flags`
    has src, dst, n."""
    rows = inferred.where("relation_type <> 'co_changed_with' AND confidence >= 0.7 AND review_state <> 'rejected' AND valid_to IS NULL")
    calm = F.coalesce("n", F.lit(0)) == 0
    return rows.join(flags, ["src", "dst"], "left").select("src", "dst", "confidence", (calm & (F.col("confidence") >= SAFE)).alias("is_safe"))
