"""Typed effects of symbols: from profiles, contracts, hints and framework patterns; classes, merging and differences.

Effects are rows (sv_id, kind, descriptor); a symbol's class and confidence follow from its set.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import ladders as L
from weftgraph.rules.effect_patterns import EFFECT_PATTERNS
from weftgraph.rules.hint_patterns import HINT_PATTERNS, SCRIPT_HINT_PATTERNS
from weftgraph.sources.tables import by_text, materialise

CACHE_WRITE = "(?i)write|set|put|del|expire|incr|decr|invalidate"
SCRIPTS = ("typescript", "javascript")

# Profile column to effects, as (kind, descriptor prefix).
FROM_PROFILE = {
    "db_reads": (("reads", "db."),), "db_writes": (("writes", "db."),), "network_calls": (("calls_external", "network."),), "file_io": (("opens", "file."),),
    "auth_operations": (("requires", "auth."),), "state_mutation_profile": (("mutates", "state."),), "validation_operations": (("normalizes", "validation."),),
    "transaction_profile": (("writes", "db.transaction."), ("acquires_lock", "db.transaction_lock.")),
}
# Hint type to effects.
FROM_HINT = {
    "db_read": (("reads", "db."),), "db_write": (("writes", "db."),), "network_call": (("calls_external", "network."),), "file_io": (("opens", "file."),),
    "auth_check": (("requires", "auth."),), "validation": (("normalizes", "validation."),), "throws": (("throws", "error."),), "state_mutation": (("mutates", "state."),),
    "transaction": (("writes", "db.transaction."), ("acquires_lock", "db.transaction_lock.")), "logging": (("logs", "log."),), "acquires_lock": (("acquires_lock", "lock."),),
    "concurrency": (("calls_external", "concurrency."),), "serialization": (("normalizes", "serialization."),), "cache_write": (("writes", "cache."),),
}


def _effect(kind, descriptor) -> Column:
    return F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), descriptor.alias("descriptor"))


def _cache(detail: Column) -> Column:
    return _effect(F.when(detail.rlike(CACHE_WRITE), "writes").otherwise("reads"), F.concat(F.lit("cache."), detail))


def normal_descriptor(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), r"\s+", "_"), "[^a-z0-9_.-]", "")


def _rows(df: DataFrame, found: Column) -> DataFrame:
    return df.select("sv_id", F.inline(found)).distinct()


def from_profiles(profiles: DataFrame) -> DataFrame:
    """Of behavioural profiles."""
    named = lambda kind, prefix: lambda d: _effect(kind, F.concat(F.lit(prefix), d))
    lists = [F.transform(c, named(kind, prefix)) for c, made in FROM_PROFILE.items() for kind, prefix in made]
    thrown = F.transform(F.filter("exception_profile", lambda e: e.startswith("throws:")), lambda e: _effect("throws", F.concat(F.lit("error."), F.trim(F.substr(e, F.lit(8))))))
    return _rows(profiles, F.concat(*lists, F.transform("cache_ops", _cache), thrown))


def from_contracts(contracts: DataFrame) -> DataFrame:
    """Of contract profiles: sv_id, security_contract, error_contract, api_contract_refs."""

    def parts(column: str, separator: str, none: str, kind: str, prefix: str) -> Column:
        values = F.filter(F.transform(F.split(column, separator), lambda x: F.trim(x)), lambda p: p != "")
        made = F.transform(values, lambda p: _effect(kind, F.concat(F.lit(prefix), normal_descriptor(p))))
        return F.when(F.coalesce(F.col(column), F.lit(none)) == none, F.array()).otherwise(made)

    api = F.transform("api_contract_refs", lambda p: _effect("reads", F.concat(F.lit("api."), normal_descriptor(p))))
    return _rows(contracts, F.concat(parts("security_contract", ";", "none", "requires", "auth."), parts("error_contract", "[|]", "never", "throws", "error."), F.coalesce(api, F.array())))


def from_hints(hints: DataFrame) -> DataFrame:
    """Of rows sv_id, hint_type, detail."""
    made = F.when(F.col("hint_type") == "cache_op", F.array(_cache(F.col("detail"))))
    for kind, effects in FROM_HINT.items():
        made = made.when(F.col("hint_type") == kind, F.array(*[_effect(k, F.concat(F.lit(p), "detail")) for k, p in effects]))
    return _rows(hints, F.coalesce(made, F.array()))


def blank_literals(code: Column, language: Column) -> Column:
    """Code without the insides of strings and without comments."""
    hashes = F.coalesce(F.lower(language).isin("python", "ruby", "bash"), F.lit(False))
    plain = F.when(hashes, F.regexp_replace(F.regexp_replace(code, r"(?s)\"\"\".*?\"\"\"|'''.*?'''", '""'), r"(?m)#[^\n]*$", "")).otherwise(code)
    for quote in ("'", '"', "`"):
        plain = F.regexp_replace(plain, rf"{quote}[^{quote}\\]*+(?:\\.[^{quote}\\]*+)*+{quote}", quote * 2)
    return F.when(hashes, plain).otherwise(F.regexp_replace(plain, r"//[^\n]*|(?s:/\*.*?\*/)", " "))


def from_patterns(symbols: DataFrame) -> DataFrame:
    """Of code by framework patterns: sv_id, body, language, kind. Types and interfaces are left out;
    patterns for all languages don't apply to TypeScript and JavaScript, whose hints are resolved by type."""
    language = F.lower(F.coalesce("language", F.lit("")))
    keyed, texts = by_text(symbols.where(~F.col("kind").isin("class", "interface", "type_alias")).select("sv_id", language.alias("language"), "body"), "language", "body")
    code = texts.select("_text", "language", blank_literals(F.col("body"), F.col("language")).alias("code"))
    found = []
    for pattern, languages, effects in EFFECT_PATTERNS:
        fits = F.col("language").isin(*languages) if languages else ~F.col("language").isin(*SCRIPTS)
        found.append(F.when(fits & F.col("code").rlike(pattern), F.array(*[_effect(k, F.lit(d)) for k, d in effects])).otherwise(F.array()))
    each = materialise(code.select("_text", F.inline(F.concat(*found))).distinct(), "effects")
    return keyed.select("sv_id", "_text").join(each, "_text").select("sv_id", "kind", "descriptor").distinct()


def scan_hints(symbols: DataFrame) -> DataFrame:
    """(sv_id, hint_type, detail, line) of each line of code that a hint pattern fits: sv_id, body, language, start_line."""
    language = F.lower(F.coalesce("language", F.lit("")))
    keyed, texts = by_text(symbols.select("sv_id", language.alias("language"), F.coalesce("start_line", F.lit(1)).alias("start"), "body"), "language", "body")
    lines = texts.select("_text", "language", F.posexplode(F.split(blank_literals(F.col("body"), F.col("language")), "\n")).alias("i", "text"))
    found = []
    for script, table in ((False, HINT_PATTERNS), (True, SCRIPT_HINT_PATTERNS)):
        for pattern, kind, detail, languages in table:
            fits = F.col("language").isin(*languages) if languages else (F.col("language").isin(*SCRIPTS) if script else ~F.col("language").isin(*SCRIPTS))
            found.append(F.when(fits & F.col("text").rlike(pattern), F.struct(F.lit(kind).alias("hint_type"), F.lit(detail).alias("detail"))))
    hits = materialise(lines.select("_text", "i", F.inline(F.array_compact(F.array(*found)))), "hits")
    return keyed.select("sv_id", "start", "_text").join(hits, "_text").select("sv_id", "hint_type", "detail", (F.col("start") + F.col("i")).alias("line"))


def merge(*sources: DataFrame) -> DataFrame:
    """One row per effect; a direct one beats a transitive one, then the nearest."""
    rows = reduce(DataFrame.unionByName, [s if "provenance" in s.columns else s.withColumn("provenance", F.lit("direct")) for s in sources])
    return rows.groupBy("sv_id", "kind", "descriptor").agg(F.min("provenance").alias("provenance"))


def signatures(effects: DataFrame) -> DataFrame:
    """(sv_id, effect_class, n_effects and seven sorted descriptor arrays)."""
    kinds = {"reads_resources": "reads", "writes_resources": "writes", "emits_events": "emits", "calls_external": "calls_external", "mutates_state": "mutates", "requires_auth": "requires", "throws_errors": "throws"}
    arrays = [F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("descriptor")))).alias(c) for c, k in kinds.items()]
    transactional = F.bool_or((F.col("kind") == "writes") & F.col("descriptor").contains("transaction"))
    return effects.groupBy("sv_id").agg(L.effect_class(F.collect_set("kind"), transactional).alias("effect_class"), F.count(F.lit(1)).alias("n_effects"), *arrays)


def confidence(behavioral: Column, contract: Column, body: Column) -> Column:
    """From which sources effects were read."""
    add = lambda c, w: F.when(c, w).otherwise(0.0)
    return F.least(F.lit(0.95), 0.5 + add(behavioral, 0.2) + add(contract, 0.15) + add(body, 0.1))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(sv_id, added, removed, class_before, class_after, class_direction, new_resources, removed_resources, summary) of two effect
    tables; a symbol without effects is pure."""
    key = F.concat("kind", F.lit(":"), "descriptor")
    touching = F.col("kind").isin("reads", "writes", "calls_external")
    transactional = F.bool_or((F.col("kind") == "writes") & F.col("descriptor").contains("transaction"))

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("sv_id").agg(
            F.collect_set(key).alias(f"{tag}_keys"), F.collect_set(F.when(touching, F.col("descriptor"))).alias(f"{tag}_resources"), L.effect_class(F.collect_set("kind"), transactional).alias(f"{tag}_class")
        )

    none = F.array().cast("array<string>")
    both = side(before, "a").join(side(after, "b"), "sv_id", "full")
    col = lambda c: F.coalesce(c, none)
    minus = lambda x, y: F.array_sort(F.array_except(col(x), col(y)))
    rows = both.select(
        "sv_id", minus("b_keys", "a_keys").alias("added"), minus("a_keys", "b_keys").alias("removed"), F.coalesce("a_class", F.lit("pure")).alias("class_before"), F.coalesce("b_class", F.lit("pure")).alias("class_after"),
        minus("b_resources", "a_resources").alias("new_resources"), minus("a_resources", "b_resources").alias("removed_resources"),
    )
    ranks = [L.rank_of(F.col(c), L.EFFECT_CLASSES) for c in ("class_before", "class_after")]
    rows = rows.withColumn("class_direction", F.when(ranks[1] > ranks[0], "escalated").when(ranks[1] < ranks[0], "deescalated").otherwise("unchanged"))
    some = lambda c, sign, text: F.when(F.size(c) > 0, F.concat(F.lit(sign), F.size(c), F.lit(text)))
    moved = F.when(F.col("class_direction") != "unchanged", F.concat(F.lit("class "), "class_direction", F.lit(": "), "class_before", F.lit(" -> "), "class_after"))
    parts = F.array_compact(F.array(some("added", "+", " effect(s) added"), some("removed", "-", " effect(s) removed"), moved, some("new_resources", "+", " new resource(s)"), some("removed_resources", "-", " resource(s) dropped")))
    return rows.withColumn("summary", F.when(F.size(parts) == 0, "No effect changes detected").otherwise(F.array_join(parts, "; ")))
