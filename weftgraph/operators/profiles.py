"""Behavioural and contract profiles, invariants, and confidence under uncertainty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import ladders as L

# Where each hint type goes. Profile column to hint types; hint type to resource prefix.
PROFILE = {
    "db_reads": ("db_read",), "db_writes": ("db_write",), "network_calls": ("network_call",), "file_io": ("file_io",),
    "cache_ops": ("cache_op", "cache_write"), "auth_operations": ("auth_check",), "validation_operations": ("validation",),
    "exception_profile": ("throws", "catches"), "state_mutation_profile": ("state_mutation",), "transaction_profile": ("transaction",),
}
RESOURCES = {
    "db_read": "db:read:", "db_write": "db:write:", "network_call": "network:", "file_io": "file:", "cache_op": "cache:", "cache_write": "cache:write:",
    "auth_check": "auth:", "state_mutation": "state:", "transaction": "txn:", "acquires_lock": "lock:", "concurrency": "concurrency:", "serialization": "serialization:",
}


def behavioral_profiles(hints: DataFrame) -> DataFrame:
    """(sv_id, purity_class, resource_touches and ten arrays) of rows sv_id, hint_type, detail; arrays are sorted sets."""
    kind, detail = F.col("hint_type"), F.col("detail")
    prefix = F.element_at(F.create_map(*[F.lit(x) for kv in RESOURCES.items() for x in kv]), kind)
    named = {c: F.when(kind.isin(*ks), F.concat(kind, F.lit(":"), detail) if c == "exception_profile" else detail) for c, ks in PROFILE.items()}
    sets = [F.array_sort(F.collect_set(v)).alias(c) for c, v in ({"resource_touches": F.concat(prefix, detail)} | named).items()]
    return hints.groupBy("sv_id").agg(L.purity_class(F.collect_set("hint_type")).alias("purity_class"), *sets)


EFFECTS = ("network_calls", "db_writes", "file_io", "state_mutation_profile", "auth_operations", "transaction_profile")


def compare_behavior(a: str, b: str) -> dict[str, Column]:
    """From profile `a` to profile `b`: direction of purity, resources that came and went, whether effects changed."""
    col = lambda t, c: F.coalesce(F.col(f"{t}.{c}"), F.array().cast("array<string>"))
    rank = lambda t: L.rank_of(F.col(f"{t}.purity_class"), L.PURITY)
    direction = F.when(rank(b) > rank(a), "escalated").when(rank(b) < rank(a), "deescalated").otherwise("unchanged")
    changed = reduce(lambda x, y: x | y, [F.array_sort(col(a, c)) != F.array_sort(col(b, c)) for c in EFFECTS])
    return {
        "purity_direction": direction,
        "new_resources": F.array_sort(F.array_except(col(b, "resource_touches"), col(a, "resource_touches"))),
        "removed_resources": F.array_sort(F.array_except(col(a, "resource_touches"), col(b, "resource_touches"))),
        "side_effects_changed": changed,
    }


def contract_profile(input_types: Column, output_type: Column, thrown_types: Column, decorators: Column) -> dict[str, Column]:
    """Contract strings of a function's types and decorators."""
    picked = lambda pattern: F.filter(decorators, lambda d: F.lower(d).rlike(pattern))
    joined = lambda values: F.when(F.size(values) == 0, "none").otherwise(F.array_join(values, "; "))
    return {
        "input_contract": F.when(F.size(input_types) == 0, "void").otherwise(F.concat(F.lit("("), F.array_join(input_types, ", "), F.lit(")"))),
        "output_contract": F.when(F.coalesce(output_type, F.lit("")) == "", "void").otherwise(output_type),
        "error_contract": F.when(F.size(thrown_types) == 0, "never").otherwise(F.array_join(thrown_types, " | ")),
        "schema_refs": picked("schema|validate|is|matches|min|max|length"),
        "api_contract_refs": picked("get|post|put|delete|patch|route|api|endpoint|controller"),
        "security_contract": joined(picked("auth|guard|role|permission|security|token|session")),
        "serialization_contract": joined(picked("serialize|transform|expose|exclude|json|xml|proto")),
    }


def contract_changes(a: str, b: str) -> dict[str, Column]:
    """Five flags: which contract strings differ."""
    return {f"{n}_changed": ~F.col(f"{a}.{n}_contract").eqNullSafe(F.col(f"{b}.{n}_contract")) for n in ("input", "output", "error", "security", "serialization")}


# Strength of an invariant by where it comes from.
STRENGTHS = {"test": 0.9, "schema": 0.95, "validation": 0.75, "error_contract": 0.7, "security": 0.85, "exception": 0.8, "resource_access": 0.65}


def derived_invariants(symbols: DataFrame) -> DataFrame:
    """(sv_id, scope, expression, source_type, strength) by seven rules. `symbols` has sv_id, name, kind, file_path, the
    behavioural arrays with purity_class, error_contract and security_contract; missing profiles are null.

    All rules are read off a row at once; the strongest of equal expressions stays.
    """
    c, name = F.col, F.col("name")
    code = c("kind").isin("function", "method")
    test = (c("kind") == "test_case") | c("file_path").contains(".test.") | c("file_path").contains(".spec.") | c("file_path").contains("__tests__")
    filled = lambda column, empty: F.coalesce(~c(column).isin(empty, ""), F.lit(False))
    listed = lambda column: F.array_join(c(column), ", ")
    some = lambda column: F.coalesce(F.size(column), F.lit(0)) > 0
    thrown = F.transform(F.filter("exception_profile", lambda e: e.startswith("throws:")), lambda e: F.substr(e, F.lit(8)))

    def rule(when: Column, key: str, scope: str, source: str, *text: Column) -> Column:
        made = F.struct(F.lit(scope).alias("scope"), F.concat(F.lit(f"{key}:"), name, *text).alias("expression"), F.lit(source).alias("source_type"), F.lit(STRENGTHS[key]).alias("strength"))
        return F.when(when, made)

    found = F.array(
        rule(test, "test", "symbol", "explicit_test", F.lit(" asserts behavior of target symbol")),
        rule(c("kind").isin("validator", "schema_object"), "schema", "module", "schema", F.lit(" enforces data shape constraints")),
        rule(code & some("validation_operations"), "validation", "symbol", "derived", F.lit(" performs input validation ("), listed("validation_operations"), F.lit(")")),
        rule(code & filled("error_contract", "never"), "error_contract", "symbol", "derived", F.lit(" may throw "), c("error_contract")),
        rule(code & filled("security_contract", "none"), "security", "symbol", "derived", F.lit(" requires "), c("security_contract")),
        rule(code & F.coalesce(F.size(thrown) > 0, F.lit(False)), "exception", "symbol", "derived", F.lit(" raises "), F.array_join(thrown, ", ")),
        rule(code & F.coalesce(c("purity_class") != "pure", F.lit(False)) & some("resource_touches"), "resource_access", "symbol", "derived", F.lit(" ("), c("purity_class"), F.lit(") touches "), F.array_join(F.slice("resource_touches", 1, 5), ", ")),
    )
    return upsert_invariants(symbols.select("sv_id", F.explode(F.array_compact(found)).alias("r")).select("sv_id", "r.*"))


def upsert_invariants(rows: DataFrame) -> DataFrame:
    """One row per (sv_id, expression), a null sv_id being one scope: the greatest strength with its source."""
    return rows.groupBy("sv_id", "expression").agg(F.max(F.struct("strength", "scope", "source_type")).alias("m")).select("sv_id", "m.scope", "expression", "m.source_type", "m.strength")


# What each kind of uncertainty costs.
IMPACTS = {
    "parse_error": 0.30, "type_inference_failure": 0.15, "dynamic_dispatch": 0.20, "reflection_usage": 0.25, "eval_usage": 0.35, "external_dependency": 0.10,
    "incomplete_type_info": 0.12, "ambiguous_override": 0.18, "circular_reference": 0.15, "untested_path": 0.08, "config_dependent": 0.10, "runtime_only_behavior": 0.22,
}
UNKNOWN_IMPACT, FLOOR, REPEAT = 0.05, 0.1, 0.3


def impact_of(flag: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in IMPACTS.items() for x in kv]), flag), F.lit(UNKNOWN_IMPACT))


def symbol_confidence(flags: Column) -> Column:
    """Product over distinct flags of 1 minus impact, .1 at least."""
    product = F.aggregate(F.array_distinct(F.coalesce(flags, F.array().cast("array<string>"))), F.lit(1.0), lambda p, f: p * (1 - impact_of(f)))
    return F.greatest(F.lit(FLOOR), product)


def snapshot_confidence(annotations: DataFrame, group: str) -> DataFrame:
    """(group, confidence) of rows group, source, impact: a source's first (greatest) annotation counts in full and its
    repeats at .3; the product of what is left, .1 at least.

    Counts and sums per source replace a ranking, so a group of any size is combined before its shuffle.
    """
    i = F.least(F.lit(0.95), F.greatest(F.lit(0.0), F.col("impact")))
    by_source = annotations.withColumn("i", i).groupBy(group, "source").agg(F.max("i").alias("top"), F.sum(F.log(1 - REPEAT * F.col("i"))).alias("repeats"))
    left = F.sum(F.col("repeats") - F.log(1 - REPEAT * F.col("top")) + F.log(1 - F.col("top")))
    return by_source.groupBy(group).agg(F.greatest(F.lit(FLOOR), F.exp(left)).alias("confidence"))


def uncertainty_report(symbols: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Flags by (group, source): annotations and symbols; and the 20 least certain symbols of each group. `symbols` has
    group, sv_id, uncertainty_flags."""
    rows = symbols.select(group, "sv_id", F.explode("uncertainty_flags").alias("source"))
    counts = rows.groupBy(group, "source").agg(F.count(F.lit(1)).alias("annotations"), F.countDistinct("sv_id").alias("symbols"))
    from weftgraph.operators.relational import top_of_each

    scored = symbols.where(F.size("uncertainty_flags") > 0).select(group, "sv_id", F.round(symbol_confidence(F.col("uncertainty_flags")), 9).alias("confidence"))
    return counts, top_of_each(scored, [group], [F.col("confidence"), F.col("sv_id")], 20)
