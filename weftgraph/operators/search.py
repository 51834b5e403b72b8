"""Symbol and code search: trigram lookup, score ladder, regex lines, concepts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.sources.tables import materialise

TRIGRAM_THRESHOLD = 0.3


def trigram_match(name: Column, query: str) -> tuple[Column, Column]:
    """Similarity, and whether the name matches by trigrams or as a substring."""
    sim = T.trigram_similarity(name, F.lit(query))
    return sim, (sim >= TRIGRAM_THRESHOLD) | F.contains(F.lower(name), F.lit(query.lower()))


def distinct_matches(rows: DataFrame, name: str, query: str, out: str) -> DataFrame:
    """(name, out): the distinct names that match, with their similarity; each name is compared once. Names are written, as
    the optimiser would test each row before it looks for distinct ones."""
    sim, fits = trigram_match(F.col(name), query)
    return materialise(rows.select(name).distinct(), "names").where(fits).select(name, sim.alias(out))


def resolve_symbol(symbols: DataFrame, query: str, key: str, limit: int = 10) -> DataFrame:
    """key, name and name_sim of the best matches."""
    found = distinct_matches(symbols, "name", query, "name_sim")
    return symbols.select(key, "name").join(found, "name").select(key, "name", "name_sim").orderBy(F.desc("name_sim"), key).limit(limit)


def ladder_score(query: str, name: Column, stable_key: Column, path: Column, public: Column) -> Column:
    """100 for the exact name, 92 for a prefix, 84 inside, 76 inside the key, 56 inside the path, 40 and 12 per
    word found anywhere; 3 more if public."""
    wanted = query.strip().lower()
    low, key, where = F.lower(name), F.lower(stable_key), F.lower(path)
    by_name = F.when(low == wanted, 100).when(low.startswith(wanted), 92).when(low.contains(wanted), 84).otherwise(0)
    words = [w for w in "".join(c if c.isascii() and (c.isalnum() or c == "_") else " " for c in wanted).split()]
    hits = reduce(lambda a, b: a + b, [(low.contains(w) | key.contains(w) | where.contains(w)).cast("int") for w in words], F.lit(0))
    score = F.greatest(
        by_name, F.when(key.contains(wanted), 76).otherwise(0), F.when(where.contains(wanted), 56).otherwise(0), F.when(hits > 0, 40 + hits * 12).otherwise(0)
    )
    return score + F.when(public, 3).otherwise(0)


def search_symbols(symbols: DataFrame, query: str, key: str, limit: int = 20) -> DataFrame:
    """`symbols` has key, name, stable_key, file_path and public."""
    score = ladder_score(query, F.col("name"), F.col("stable_key"), F.col("file_path"), F.col("public"))
    return symbols.select(key, "name", "file_path", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "file_path", "name", key).limit(limit)


def search_lines(df: DataFrame, key: str, text: str, pattern: str, context: int = 2, limit: int | None = 100) -> DataFrame:
    """key, line (from 1), match and context of lines that match, case-insensitively. Context lines are
    numbered, the matching one marked with ">"."""
    split = df.select(key, F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r", ""), "\n").alias("_lines"))
    rows = split.select(key, "_lines", F.posexplode("_lines").alias("_i", "_line")).where(T.search_predicate(F.col("_line"), pattern))
    low = F.greatest(F.lit(0), F.col("_i") - context)
    shown = F.transform(
        F.sequence(low, F.least(F.size("_lines") - 1, F.col("_i") + context)),
        lambda i: F.concat(F.when(i == F.col("_i"), "> ").otherwise("  "), (i + 1).cast("string"), F.lit(": "), F.get(F.col("_lines"), i)),
    )
    out = rows.select(key, (F.col("_i") + 1).alias("line"), F.trim("_line").alias("match"), F.array_join(shown, "\n").alias("context"))
    return out if limit is None else out.orderBy(key, "line").limit(limit)


def find_concept(names: DataFrame, families: DataFrame, contracts: DataFrame, concept: str, key: str, limit: int = 20) -> DataFrame:
    """key, relevance and match_source. `names` has key, name; `families` key, family_name; `contracts` key, text.

    A name's trigram similarity comes first, then 0.9 of the family name's, then 0.7 for a contract
    that has the concept; the first source that knows a symbol wins.
    """
    named = names.select(key, "name").join(distinct_matches(names, "name", concept, "relevance"), "name")
    belongs = families.select(key, "family_name").join(distinct_matches(families, "family_name", concept, "sim"), "family_name")
    best = lambda df: df.orderBy(F.desc("relevance"), key).limit(limit)
    found = [
        best(named.select(key, "relevance", F.lit("name").alias("match_source"), F.lit(0).alias("turn"))),
        best(belongs.groupBy(key).agg(F.max(F.col("sim") * 0.9).alias("relevance")).select(key, "relevance", F.lit("concept_family").alias("match_source"), F.lit(1).alias("turn"))),
        best(contracts.where(F.contains(F.lower("text"), F.lit(concept.lower()))).select(key, F.lit(0.7).alias("relevance"), F.lit("contract").alias("match_source"), F.lit(2).alias("turn"))),
    ]
    merged = found[0].union(found[1]).union(found[2]).groupBy(key).agg(F.min_by(F.struct("relevance", "match_source"), "turn").alias("m"))
    return merged.select(key, "m.relevance", "m.match_source").orderBy(F.desc("relevance"), key).limit(limit)
