"""Semantic and contract differences between symbol versions, with severities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import ladders as L

LEVELS = ("none", "minor", "major", "breaking")


def _array(t: str, *columns: str) -> Column:
    parts = [F.coalesce(F.col(f"{t}.{c}"), F.array().cast("array<string>")) for c in columns]
    return F.concat(*parts)


def _text(t: str, c: str, none: str) -> Column:
    return F.coalesce(F.col(f"{t}.{c}"), F.lit(none))


def return_type(signature: Column) -> Column:
    colon, arrow = F.regexp_extract(signature, r"\)\s*:\s*(.+)$", 1), F.regexp_extract(signature, r"\)\s*->\s*(.+)$", 1)
    return F.when(colon != "", F.trim(colon)).when(arrow != "", F.trim(arrow)).otherwise(signature)


def _row(name: str, changed: Column, severity: Column, key: str) -> Column:
    level = F.when(changed, severity).otherwise("none")
    return F.struct(F.lit(name).alias(key), F.coalesce(changed, F.lit(False)).alias("changed"), F.coalesce(level, F.lit("none")).alias("severity"))


def semantic_changes(a: str, b: str) -> Column:
    """Nine structs dimension, changed, severity, from alias `a` to alias `b`; missing profiles count as pure and empty."""
    moved = lambda *c: F.array_sort(_array(a, *c)) != F.array_sort(_array(b, *c))
    came = lambda *c: F.size(F.array_except(_array(b, *c), _array(a, *c))) > 0
    went = lambda *c: F.size(F.array_except(_array(a, *c), _array(b, *c))) > 0
    grade = lambda worse, name: F.when(worse, name).otherwise("minor")
    effects, resources = ("network_calls", "db_writes", "file_io", "state_mutation_profile"), ("resource_touches", "network_calls", "file_io")
    pa, pb = _text(a, "purity_class", "pure"), _text(b, "purity_class", "pure")
    row = lambda name, changed, severity: _row(name, changed, severity, "dimension")
    return F.array(
        row("purity", pa != pb, grade(L.rank_of(pb, L.PURITY) > L.rank_of(pa, L.PURITY), "breaking")),
        row("side_effects", moved(*effects), grade(came(*effects), "major")),
        row("return_type", return_type(_text(a, "signature", "")) != return_type(_text(b, "signature", "")), F.lit("breaking")),
        row("exception_behavior", moved("exception_profile"), grade(came("exception_profile"), "major")),
        row("auth_behavior", moved("auth_operations"), grade(went("auth_operations"), "breaking")),
        row("serialization", _text(a, "serialization_contract", "none") != _text(b, "serialization_contract", "none"), F.lit("major")),
        row("persistence", moved("db_reads") | moved("db_writes"), grade(came("db_writes"), "major")),
        row("validation", moved("validation_operations"), grade(went("validation_operations"), "major")),
        row("resource_access", moved(*resources), grade(came(*resources), "major")),
    )


def contract_changes(a: str, b: str) -> Column:
    """Six structs field, changed, severity."""
    text = lambda t, n: _text(t, f"{n}_contract", "")
    row = lambda name, severity: _row(f"{name}_contract", text(a, name) != text(b, name), severity, "field")
    refs = F.array_sort(_array(a, "schema_refs")) != F.array_sort(_array(b, "schema_refs"))
    return F.array(
        row("input", F.when(F.length(text(b, "input")) < F.length(text(a, "input")), "major").otherwise("minor")), row("output", F.lit("breaking")), row("error", F.lit("major")),
        row("security", F.lit("breaking")), row("serialization", F.lit("major")), _row("schema_refs", refs, F.lit("minor"), "field"),
    )


def overall(changes: Column) -> Column:
    """The worst severity."""
    return L.by_rank(F.array_max(F.transform(changes, lambda c: L.rank_of(c["severity"], LEVELS))), LEVELS)


def summary(changes: Column, key: str) -> Column:
    named = lambda level: F.array_join(F.transform(F.filter(changes, lambda c: c["severity"] == level), lambda c: c[key]), ", ")
    n = F.size(F.filter(changes, lambda c: c["changed"]))
    parts = F.array_compact(
        F.array(F.concat(n, F.lit(" dimension(s) changed")), F.when(named("breaking") != "", F.concat(F.lit("BREAKING in: "), named("breaking"))), F.when(named("major") != "", F.concat(F.lit("major in: "), named("major"))))
    )
    return F.when(n == 0, "No semantic changes detected between the two symbol versions.").otherwise(F.concat(F.array_join(parts, "; "), F.lit(".")))


def version_pairs(versions: DataFrame, pairs: DataFrame, key: str = "sv_id") -> DataFrame:
    """`pairs` (before, after) joined with the versions of both, under aliases a and b."""
    left = pairs.alias("p").join(versions.alias("a"), F.col("a." + key) == F.col("p.before"))
    return left.join(versions.alias("b"), F.col("b." + key) == F.col("p.after"))
