"""Concept families: clusters of homologs, their types, exemplars, fingerprints, outliers and names.

Member tables are rows (family, member); `links` are undirected (a, b, confidence) inside families.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import graph as G
from weftgraph.operators import relational as R
from weftgraph.sources.tables import materialise

# Thresholds and name suffixes.
EDGE, FALLBACK_EDGE, SPLIT_OVER, DENSITY, OUTLIER, NAMING = 0.40, 0.25, 50, 0.4, 0.5, 0.45
SUFFIXES = ("Engine", "Service", "Handler", "Controller", "Repository", "Factory", "Middleware", "Validator", "Resolver", "Provider", "Manager", "Adapter", "Client", "Worker", "Processor")


def open_edges(inferred: DataFrame, least: float = EDGE) -> DataFrame:
    """Undirected (a, b, confidence), a < b, of open homolog relations."""
    rows = inferred.where((F.col("confidence") >= least) & (F.col("review_state") != "rejected") & F.col("valid_to").isNull() & (F.col("relation_type") != "co_changed_with") & (F.col("src") != F.col("dst")))
    return rows.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("confidence").alias("confidence"))


def clusters(inferred: DataFrame) -> DataFrame:
    """(family, member): connected components of open relations, at .25 where .4 gives none."""
    for least in (EDGE, FALLBACK_EDGE):
        edges = open_edges(inferred, least)
        if edges.limit(1).count():
            break
    found = G.components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return found.select(F.col("component").alias("family"), F.col("node").alias("member"))


def suffix_clusters(symbols: DataFrame) -> DataFrame:
    """(family, member, confidence) by the first of 15 name suffixes, two members at least; `symbols` has sv_id, name, kind."""
    suffix = F.lit(None).cast("string")
    for s in reversed(SUFFIXES):
        suffix = F.when(F.col("name").endswith(s) & (F.length("name") > len(s)), s).otherwise(suffix)
    known = symbols.where(F.col("kind").isin("class", "function", "method")).select("sv_id", "name")
    names = materialise(known.groupBy("name").agg(F.count(F.lit(1)).alias("n")), "names").select("name", "n", F.concat(F.lit("suffix:"), suffix).alias("family")).where("family IS NOT NULL")
    large = names.groupBy("family").agg(F.sum("n").alias("n")).where("n > 1").select("family")
    return known.join(names.join(large, "family").select("name", "family"), "name").select("family", F.col("sv_id").alias("member"), F.lit(NAMING).alias("confidence"))


def bisect(nodes: list, weights: dict) -> list[list]:
    """Greedy modularity bisection: the node of least average weight starts the second half; up to ten passes move nodes
    while modularity gains over .001; halves are split again when over 50 nodes, or over 25 and sparse."""
    nodes = sorted(nodes)
    if len(nodes) <= 4:
        return [nodes]
    inside = set(nodes)
    near = {n: {m: w for m, w in weights.get(n, {}).items() if m in inside} for n in nodes}
    degree = {n: sum(near[n].values()) for n in nodes}
    m = sum(degree.values()) / 2
    if m == 0:
        return [nodes]
    seed = min(nodes, key=lambda n: (degree[n] / max(len(near[n]), 1), n))
    side = {n: n == seed for n in nodes}
    total = {True: degree[seed], False: 2 * m - degree[seed]}
    count = {True: 1, False: len(nodes) - 1}
    for _ in range(10):
        moved = False
        for n in nodes:
            here = side[n]
            if count[here] <= 1:
                continue
            own = sum(w for k, w in near[n].items() if side[k] == here and k != n)
            other = sum(w for k, w in near[n].items() if side[k] != here)
            gain = (other - own) / m + degree[n] * (total[here] - degree[n] - total[not here]) / (2 * m * m)
            if gain > 0.001:
                side[n] = not here
                total[here] -= degree[n]
                total[not here] += degree[n]
                count[here] -= 1
                count[not here] += 1
                moved = True
        if not moved:
            break
    halves = [h for h in ([n for n in nodes if not side[n]], [n for n in nodes if side[n]]) if len(h) >= 2]
    if len(halves) < 2:
        return [nodes]
    out = []
    for half in halves:
        held = set(half)
        links = [w for n in half for k, w in near[n].items() if k in held and n < k]
        sparse = not links or sum(links) / len(links) < DENSITY
        out += bisect(half, near) if len(half) > SPLIT_OVER or (len(half) > SPLIT_OVER / 2 and sparse) else [half]
    return out


def split_large(members: DataFrame, links: DataFrame, most: int = 20_000) -> DataFrame:
    """(family, member) with large or sparse components bisected; each part is named after its least member.

    The local search needs a component in one place: components over `most` nodes are left whole.
    """
    size = members.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    inside = links.join(members.withColumnRenamed("member", "a"), "a")
    mean = inside.groupBy("family").agg(F.avg("confidence").alias("mean"))
    odd = size.join(mean, "family", "left").where(((F.col("n") > SPLIT_OVER) | (F.coalesce("mean", F.lit(0.0)) < DENSITY)) & (F.col("n") <= most)).select("family")
    kind = members.schema["member"].dataType.simpleString()
    fkind = members.schema["family"].dataType.simpleString()

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        weights: dict = {}
        for a, b, w in zip(pdf["a"], pdf["b"], pdf["confidence"], strict=True):
            weights.setdefault(a, {})[b] = w
            weights.setdefault(b, {})[a] = w
        rows = [(part[0], n) for part in bisect(list(weights), weights) for n in part]
        return pd.DataFrame(rows, columns=["family", "member"])

    parts = inside.join(odd, "family", "left_semi").select("family", "a", "b", "confidence").groupBy("family").applyInPandas(split, f"family {fkind}, member {kind}")
    return members.join(odd, "family", "left_anti").select("family", "member").unionByName(parts)


def _sides(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("member"), F.col("b").alias("other"), "confidence").union(links.select("b", "a", "confidence"))


def inner_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """(family, a, b, confidence) of links inside one family."""
    x = links.join(members.select("family", F.col("member").alias("a")), "a")
    return x.join(members.select("family", F.col("member").alias("b")), ["family", "b"]).select("family", "a", "b", "confidence")


def member_similarity(members: DataFrame, links: DataFrame) -> DataFrame:
    """(family, member, similarity, degree): the mean confidence of a member's inner links, 0 without."""
    mean = _sides(inner_links(members, links).drop("family")).groupBy("member").agg(F.avg("confidence").alias("similarity"), F.count(F.lit(1)).alias("degree"))
    return members.join(mean, "member", "left").select("family", "member", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def completeness(profile: str, contract: str) -> Column:
    """Share of 12 fields that a member's profiles fill."""
    arrays = ("resource_touches", "db_reads", "db_writes", "network_calls", "exception_profile", "auth_operations")
    some = lambda c: F.coalesce(F.size(F.col(f"{profile}.{c}")) > 0, F.lit(False)).cast("int")
    filled = lambda c, none: F.coalesce(~F.col(f"{contract}.{c}").isin("", none), F.lit(False)).cast("int")
    strings = (("input_contract", "void"), ("output_contract", "void"), ("error_contract", "never"), ("security_contract", "none"), ("serialization_contract", "none"))
    total = F.col(f"{profile}.purity_class").isNotNull().cast("int")
    for c in arrays:
        total = total + some(c)
    for c, none in strings:
        total = total + filled(c, none)
    return total / 12


def exemplars(similar: DataFrame, complete: DataFrame, links: DataFrame, members: DataFrame) -> DataFrame:
    """(family, exemplar, score): the best of .6 similarity + .4 completeness; where that is an outlier of a family of
    three or more, the most similar member. Ties go to the least member. `complete` has member, completeness."""
    mean = inner_links(members, links).groupBy("family").agg(F.avg("confidence").alias("family_mean"))
    scored = similar.join(complete, "member", "left").withColumn("score", F.round(0.6 * F.col("similarity") + 0.4 * F.coalesce("completeness", F.lit(0.0)), 9))
    best = scored.groupBy("family").agg(
        F.max_by(F.struct("member", "similarity", "score"), F.struct("score", F.negative("member"))).alias("top"), F.max_by("member", F.struct(F.round("similarity", 9), F.negative("member"))).alias("closest"), F.count(F.lit(1)).alias("n")
    )
    odd = (F.col("top.similarity") < OUTLIER * F.coalesce("family_mean", F.lit(0.0))) & (F.col("n") > 2)
    return best.join(mean, "family", "left").select("family", F.when(odd, F.col("closest")).otherwise(F.col("top.member")).alias("exemplar"), F.col("top.score").alias("score"))


def contract_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[\s,()=>{}|:;\]\[]+"), lambda t: t != ""))


def contract_fingerprints(members: DataFrame, contracts: DataFrame, fields: tuple[str, ...] = ("input", "output", "error", "security", "serialization")) -> DataFrame:
    """(family, field, token) of tokens that over half of the profiled members have in a field."""
    known = members.join(contracts.withColumnRenamed("sv_id", "member"), "member")
    n = known.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    each = F.array(*[F.struct(F.lit(f).alias("field"), contract_tokens(F.coalesce(f"{f}_contract", F.lit(""))).alias("tokens")) for f in fields])
    rows = known.select("family", F.inline(each)).select("family", "field", F.explode("tokens").alias("token"))
    return rows.groupBy("family", "field", "token").agg(F.count(F.lit(1)).alias("c")).join(n, "family").where("c > 0.5 * n").select("family", "field", "token")


EFFECT_FIELDS = {"db_reads": "db_read", "db_writes": "db_write", "network_calls": "network", "file_io": "file_io", "cache_ops": "cache", "auth_operations": "auth", "state_mutation_profile": "state_mutation", "transaction_profile": "transaction"}


def effect_fingerprints(members: DataFrame, profiles: DataFrame) -> DataFrame:
    """(family, effects): the sorted set of members' purity classes, resource kinds and effects."""
    known = members.join(profiles.withColumnRenamed("sv_id", "member"), "member")
    kinds = F.transform("resource_touches", lambda r: F.concat(F.lit("effect:"), F.substring_index(r, ":", 1)))
    fields = F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(f"effect:{name}")) for c, name in EFFECT_FIELDS.items()]))
    rows = known.select("family", F.explode(F.concat(F.array(F.concat(F.lit("purity:"), "purity_class")), kinds, fields)).alias("effect"))
    return rows.groupBy("family").agg(F.array_sort(F.collect_set("effect")).alias("effects"))


def deviations(e: str, m: str) -> dict[str, Column]:
    """Contradiction flags, and how contracts and effects of member alias `m` differ from exemplar alias `e`."""
    col = lambda t, c: F.coalesce(F.col(f"{t}.{c}"), F.array().cast("array<string>"))
    effects = lambda t: F.array_compact(F.array(*[F.when(F.size(col(t, c)) > 0, F.lit(n)) for c, n in list(EFFECT_FIELDS.items())[:5]]))
    extra, missing = F.array_except(effects(m), effects(e)), F.array_except(effects(e), effects(m))
    both = F.col(f"{e}.purity_class").isNotNull() & F.col(f"{m}.purity_class").isNotNull()
    text = lambda t, c: F.coalesce(F.col(f"{t}.{c}"), F.lit(""))
    joined = lambda t: F.array_join(F.array_sort(col(t, "exception_profile")), ",")
    known = F.col(f"{e}.error_contract").isNotNull() & F.col(f"{m}.error_contract").isNotNull()
    apart = lambda c, none: known & (text(e, c) != text(m, c)) & (text(e, c) != none) & (text(m, c) != none)
    flags = F.array_compact(
        F.array(
            F.when(both & (F.col(f"{e}.purity_class") != F.col(f"{m}.purity_class")), F.concat(F.lit("purity_diverges:"), F.col(f"{e}.purity_class"), F.lit("->"), F.col(f"{m}.purity_class"))),
            F.when(both & ((F.size(col(e, "auth_operations")) > 0) != (F.size(col(m, "auth_operations")) > 0)), "auth_requirement_differs"),
            F.when(both & (F.size(extra) > 0), "effect_set_diverges"),
            F.when(both & (joined(e) != joined(m)) & (joined(e) != "") & (joined(m) != ""), "exception_semantics_differ"),
            F.when(apart("error_contract", "never"), "error_contract_diverges"),
            F.when(apart("security_contract", "none"), "security_contract_diverges"),
        )
    )
    moved = F.array_compact(F.array(*[F.when(known & (text(e, f"{n}_contract") != text(m, f"{n}_contract")), F.concat(F.lit(f"{n}:"), text(e, f"{n}_contract"), F.lit("->"), text(m, f"{n}_contract"))) for n in ("input", "output", "error")]))
    listed = lambda name, x: F.when(F.size(x) > 0, F.concat(F.lit(f"{name}:["), F.array_join(x, ","), F.lit("]")))
    shifts = F.array_compact(F.array(listed("extra", extra), listed("missing", missing)))
    return {
        "contradiction_flags": flags, "contract_deviation": F.when(F.size(moved) > 0, F.array_join(moved, "; ")), "effect_deviation": F.when(both & (F.size(shifts) > 0), F.array_join(shifts, "; ")),
    }


def outliers(members: DataFrame, links: DataFrame, exemplar: DataFrame) -> DataFrame:
    """(family, member, similarity, is_outlier): to the exemplar by a direct link, else .8 of the member's mean, else 0; an
    outlier is under half of the family's mean."""
    inner = inner_links(members, links)
    mean = inner.groupBy("family").agg(F.avg("confidence").alias("family_mean"))
    own = member_similarity(members, links).withColumnRenamed("similarity", "own")
    direct = _sides(inner.drop("family")).groupBy("member", "other").agg(F.max("confidence").alias("direct"))
    rows = own.join(exemplar.select("family", "exemplar"), "family").join(mean, "family", "left")
    rows = rows.join(direct.withColumnRenamed("other", "exemplar"), ["member", "exemplar"], "left")
    sim = F.when(F.col("member") == F.col("exemplar"), 1.0).otherwise(F.coalesce("direct", F.when(F.col("degree") > 0, F.col("own") * 0.8), F.lit(0.0)))
    odd = (F.col("member") != F.col("exemplar")) & (sim < OUTLIER * F.coalesce("family_mean", F.lit(0.0)))
    return rows.select("family", "member", sim.alias("similarity"), odd.alias("is_outlier"))


def membership_confidence(covered: Column, mean: Column) -> Column:
    return F.least(F.lit(1.0), 0.4 * covered + 0.6 * mean)


# Words that tell a family's type.
FLAGS, BILLING, BILLING_NAMES = "(?i)feature[_-]?flag|feature[_-]?gate|toggle|experiment|flag[_-]?check", "(?i)billing|invoice|payment|charge|subscription|price|cost|credit|debit", "(?i)billing|invoice|payment|charge|subscription|price"
NAME_TYPES = (("validat|check|verify|assert|ensure", "validator"), ("normaliz|sanitiz|clean|trim|format", "normalization"), ("auth|guard|permission|role|policy|security", "auth_policy"), ("serial|marshal|encode|decode|transform|convert", "serializer"))


def family_types(members: DataFrame, symbols: DataFrame, profiles: DataFrame) -> DataFrame:
    """(family, type) by majority: of kinds, then of behaviour, then of names. `symbols` has sv_id, name, kind."""
    rows = members.join(symbols.select(F.col("sv_id").alias("member"), "name", "kind"), "member").join(profiles.withColumnRenamed("sv_id", "member"), "member", "left")
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    touches = F.coalesce("resource_touches", F.array().cast("array<string>"))
    has = lambda p: F.exists(touches, lambda r: r.rlike(p))
    profiled = F.col("purity_class").isNotNull()
    count = {
        "validators": F.col("kind").isin("validator", "schema_object"), "serializers": F.col("kind") == "serializer", "builders": F.col("kind") == "query_builder",
        "auth": some("auth_operations"), "valid": some("validation_operations"), "writes": some("db_writes"), "gates": has(FLAGS), "errors": some("exception_profile"),
        "billing": profiled & (has(BILLING) | F.col("name").rlike(BILLING_NAMES)), "profiled": profiled,
    }
    names = {f"name_{kind}": F.lower("name").rlike(p) for p, kind in NAME_TYPES}
    g = rows.groupBy("family").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(v).alias(k) for k, v in (count | names).items()])
    most = lambda c: F.col(c) > F.col("n") / 2
    kind = (
        F.when(most("validators"), "validator").when(most("serializers"), "serializer").when(most("builders"), "query_builder").when(most("auth"), "auth_policy")
        .when(most("valid") & (F.col("auth") <= 1) & (F.col("writes") <= 1), "normalization").when(most("gates"), "feature_gate").when(most("errors"), "error_handler").when(most("billing"), "billing_rule")
    )
    for _, name in NAME_TYPES:
        kind = kind.when(most(f"name_{name}"), name)
    return g.select("family", kind.when(F.col("profiled") > 0, "business_rule").otherwise("custom").alias("type"))


def family_names(members: DataFrame, symbols: DataFrame, types: DataFrame) -> DataFrame:
    """(family, name): the name tokens over two characters that all members share, sorted, and the type; without any, the
    first member's name."""
    from weftgraph.functions import text as T

    rows = members.join(symbols.select(F.col("sv_id").alias("member"), "name"), "member")
    n = rows.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min_by("name", "member").alias("first"))
    tokens = rows.select("family", "member", F.explode(F.array_distinct(T.tokenize_name(F.col("name")))).alias("token")).where(F.length("token") > 2)
    shared = tokens.groupBy("family", "token").agg(F.count(F.lit(1)).alias("c")).join(n, "family").where("c = n").groupBy("family").agg(F.array_join(F.array_sort(F.collect_list("token")), "_").alias("common"))
    return n.join(shared, "family", "left").join(types, "family").select("family", F.concat(F.coalesce("common", "first"), F.lit("_"), "type").alias("name"))


def families_of(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Families of nodes (node) with all their members."""
    mine = members.join(nodes.select(F.col("node").alias("member")), "member", "left_semi").select("family").distinct()
    return members.join(mine, "family", "left_semi")
