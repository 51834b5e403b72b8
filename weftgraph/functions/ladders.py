"""Ladders from numbers and sets to categories, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PURITY = ("pure", "read_only", "read_write", "side_effecting")
EFFECT_CLASSES = ("pure", "reader", "writer", "io", "full_side_effect")
SEVERITIES = ("low", "medium", "high", "critical")


def rank_of(value: Column, order: tuple[str, ...]) -> Column:
    """Position in `order`, from 0; null if it isn't there."""
    return F.nullif(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0)) - 1


def by_rank(rank: Column, order: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, order)), rank.cast("int"))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def structural_severity(level: Column) -> Column:
    return F.when(level == 0, "high").when(level == 1, "medium").otherwise("low")


def invariant_severity(strength: Column) -> Column:
    return F.when(strength >= 0.9, "critical").when(strength >= 0.7, "high").otherwise("medium")


def validation_scope(critical: Column, high: Column, total: Column) -> Column:
    return F.when((critical > 0) | (high >= 5) | (total >= 20), "strict").when((high >= 2) | (total >= 8), "standard").otherwise("quick")


def purity_class(hints: Column) -> Column:
    """Of an array of hint types."""
    has = lambda *kinds: F.arrays_overlap(hints, F.array(*map(F.lit, kinds)))
    return (
        F.when(has("network_call", "transaction", "acquires_lock", "concurrency"), "side_effecting")
        .when(has("db_write", "state_mutation", "file_io", "cache_write"), "read_write")
        .when(has("db_read", "cache_op", "auth_check"), "read_only")
        .otherwise("pure")
    )


def effect_class(kinds: Column, transactional: Column) -> Column:
    """Of an array of effect kinds; `transactional`: whether a write concerns a transaction."""
    has = lambda *names: F.arrays_overlap(kinds, F.array(*map(F.lit, names)))
    return (
        F.when(has("emits", "acquires_lock") | F.coalesce(transactional, F.lit(False)), "full_side_effect")
        .when(has("calls_external"), "io")
        .when(has("writes", "mutates", "opens"), "writer")
        .when(has("reads", "requires", "throws", "normalizes", "logs"), "reader")
        .otherwise("pure")
    )
