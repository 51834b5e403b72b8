"""Sparse text vectors, MinHash signatures, band keys and similarity search.

Vectors are in long form, one row per (id, view, token), so that they join and aggregate
without wide maps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.sources.ship import ship

# Hash family, bands, view weights.
PRIME, EMPTY, PERMUTATIONS, MAX_PERMUTATIONS, ROWS_PER_BAND = 4294967291, 4294967295, 128, 256, 8
GOLDEN = 0x9E3779B1
VIEW_WEIGHTS = {"name": 0.25, "body": 0.30, "signature": 0.20, "behavior": 0.15, "contract": 0.10}
VOCABULARY_CAP = 50_000


def coefficients(n: int = MAX_PERMUTATIONS) -> list[tuple[int, int]]:
    """(a, b) of each permutation, from a linear congruential generator seeded with 42."""
    state, out = 42, []

    def draw() -> int:
        nonlocal state
        state = (state * 1664525 + 1013904223) % 2**32
        return state

    for _ in range(n):
        a = draw() % (PRIME - 1) or 1
        out.append((a, draw() % PRIME))
    return out


def term_frequencies(tokens: DataFrame, *key: str) -> DataFrame:
    """(key, token, tf) of rows (key, token): 1 + ln of the count."""
    return tokens.groupBy(*key, "token").agg((1 + F.log(F.count(F.lit(1)))).alias("tf"))


def inverse_frequencies(tf: DataFrame, n: DataFrame, cap: int | None = None) -> DataFrame:
    """(token, df, idf): ln(1 + n / (1 + df)); `n` is one row with the number of documents."""
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    if cap is not None:
        df = df.orderBy(F.desc("df"), "token").limit(cap)
    return df.crossJoin(F.broadcast(n)).select("token", "df", F.log(1 + F.col("n") / (1 + F.col("df"))).alias("idf"))


def unit_vectors(tf: DataFrame, idf: DataFrame, *key: str) -> DataFrame:
    """(key, token, weight): tf times idf (1 for unknown tokens), scaled to unit length."""
    raw = tf.join(idf.select("token", "idf"), "token", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(1.0)))
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(*key)))
    return raw.withColumn("size", size).select(*key, "token", F.when(F.col("size") < 1e-10, F.col("w")).otherwise(F.col("w") / F.col("size")).alias("weight"))


def matching_vectors(tf: DataFrame, idf: DataFrame, tokens: DataFrame, *key: str) -> DataFrame:
    """The rows of `unit_vectors` for these tokens (token) alone. Lengths are summed before they are shuffled and the other
    rows of the corpus are read, not moved by key; `tf` and `idf` are best written tables."""
    known = idf.select("token", "idf")
    weighted = lambda rows: rows.join(known, "token", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(1.0)))
    size = weighted(tf).groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    few = weighted(tf.join(tokens.select("token").distinct(), "token", "left_semi")).join(size, list(key))
    return few.select(*key, "token", F.when(F.col("size") < 1e-10, F.col("w")).otherwise(F.col("w") / F.col("size")).alias("weight"))


def cosine_pairs(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """(a_key, b_key, cosine) of all pairs that share a token."""
    right = b.select(b_key, "token", F.col("weight").alias("_w"))
    dot = a.join(right, "token").groupBy(a_key, b_key).agg(F.sum(F.col("weight") * F.col("_w")).alias("cosine"))
    return dot.withColumn("cosine", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("cosine"))))


def _fnv(tokens: list[str]) -> np.ndarray:
    """FNV-1a over UTF-16 units, all tokens in step."""
    raw = [t.encode("utf-16-le") for t in tokens]
    sizes = np.array([len(r) // 2 for r in raw], dtype=np.int64)
    units = np.frombuffer(b"".join(raw), dtype=np.uint16).astype(np.uint64)
    starts, out = np.cumsum(sizes) - sizes, np.full(len(raw), T.FNV_OFFSET, dtype=np.uint64)
    live, step = np.flatnonzero(sizes > 0), 0
    while len(live):
        out[live] = ((out[live] ^ units[starts[live] + step]) * np.uint64(T.FNV_PRIME)) & np.uint64(0xFFFFFFFF)
        step += 1
        live = live[sizes[live] > step]
    return out


def min_hash(df: DataFrame, key: str, tokens: str, permutations: int = PERMUTATIONS) -> DataFrame:
    """(key, signature) of arrays of tokens taken as sets; empty sets get the largest value everywhere.

    The arithmetic needs 64-bit products modulo a prime, which numpy does in two halves; rows stay
    where they are read.
    """
    ship(df.sparkSession)
    n = max(1, min(int(permutations), MAX_PERMUTATIONS))
    pairs = coefficients(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens").to_pylist()
            distinct = {t: i for i, t in enumerate(dict.fromkeys(t for row in lists for t in row or ()))}
            hashes = _fnv(list(distinct))
            high, low = hashes >> np.uint64(16), hashes & np.uint64(0xFFFF)
            sets = [np.fromiter({distinct[t] for t in row or ()}, dtype=np.int64) for row in lists]
            some = [i for i, s in enumerate(sets) if len(s)]
            out = np.full((len(lists), n), EMPTY, dtype=np.int64)
            if some:
                flat = np.concatenate([sets[i] for i in some])
                starts = np.cumsum([0] + [len(sets[i]) for i in some[:-1]])
                prime = np.uint64(PRIME)
                for j, (a, b) in enumerate(pairs):
                    value = (((np.uint64(a) * high) % prime << np.uint64(16)) + np.uint64(a) * low + np.uint64(b)) % prime
                    out[some, j] = np.minimum.reduceat(value[flat], starts).astype(np.int64)
            signatures = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * n), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), signatures], ["key", "signature"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(tokens).alias("tokens")).mapInArrow(run, f"key {kind}, signature array<bigint>").withColumnRenamed("key", key)


def _is_empty(signature: Column) -> Column:
    return F.forall(signature, lambda v: v == EMPTY)


def estimated_jaccard(a: Column, b: Column) -> Column:
    """Share of equal positions; 0 if a side is an empty set's signature."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | _is_empty(a) | _is_empty(b), F.lit(0.0)).otherwise(same / F.least(F.size(a), F.size(b)))


def _signed(x: Column) -> Column:
    return F.when(x >= 2**31, x - 2**32).otherwise(x).cast("int")


def band_keys(signature: Column, rows: int = ROWS_PER_BAND) -> Column:
    """Signed 32-bit keys: FNV-1a over each band's little-endian bytes, mixed with the band's position."""
    mask = F.lit(0xFFFFFFFF)

    def one(i: Column) -> Column:
        values = F.slice(signature, i * rows + 1, rows)
        octets = F.flatten(F.transform(values, lambda v: F.transform(F.array(*map(F.lit, (0, 8, 16, 24))), lambda s: F.call_function("shiftright", v, s).bitwiseAND(F.lit(255)))))
        h = F.aggregate(octets, F.lit(T.FNV_OFFSET).cast("long"), lambda h, o: (h.bitwiseXOR(o) * F.lit(T.FNV_PRIME)).bitwiseAND(mask))
        return _signed(h.bitwiseXOR(((i + 1).cast("long") * F.lit(GOLDEN)).bitwiseAND(mask)))

    bands = F.floor(F.size(signature) / rows).cast("int")
    return F.when(F.size(signature) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), bands - 1), one))


def band_pairs(a: DataFrame, b: DataFrame, a_key: str, b_key: str, keys: str = "band_keys") -> DataFrame:
    """Distinct pairs that share a band key. Buckets are joined by key, and equal pairs are combined before
    they are shuffled; join against signatures of distinct texts, so that copies do not multiply."""
    left = a.select(F.col(a_key), F.explode(F.array_distinct(keys)).alias("_band"))
    right = b.select(F.col(b_key), F.explode(F.array_distinct(keys)).alias("_band"))
    return left.join(right, "_band").select(a_key, b_key).distinct()


def multi_view(similarities: DataFrame, *key: str, over_total: bool = False) -> DataFrame:
    """(key, similarity) of rows (key, view, similarity): the mean weighted by view, over the views
    present on both sides, or over all views' weight with `over_total`."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in VIEW_WEIGHTS.items() for x in kv]), F.col("view"))
    total = F.lit(sum(VIEW_WEIGHTS.values())) if over_total else F.sum("_w")
    mean = F.sum(F.col("_w") * F.col("similarity")) / total
    return similarities.withColumn("_w", weight).where("_w IS NOT NULL").groupBy(*key).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)).alias("similarity"))


def kind_boost(kind: Column, line_span: Column) -> Column:
    return (
        F.when(kind.isin("function", "method", "class"), 1.15)
        .when(kind == "interface", 0.9)
        .when(kind.isin("variable", "constant") & (line_span <= 2), 0.2)
        .otherwise(1.0)
    )


def display_boost(kind: Column, line_span: Column, body_length: Column) -> Column:
    up = F.when(kind.isin("function", "method", "class"), 1.15).otherwise(1.0)
    return up * F.when(kind.isin("variable", "constant") & (line_span <= 2) & (body_length < 120), 0.3).otherwise(1.0)


def semantic_search(vectors: DataFrame, idf: DataFrame, query_tokens: DataFrame, symbols: DataFrame, key: str, limit: int = 100) -> DataFrame:
    """(key, similarity, rank) of the vectors nearest to a query given as rows (token).

    `symbols` has key, kind, line_span and body_length. Only vectors that share a token with the
    query can score above 0, so the join on tokens is the whole search.
    """
    one = query_tokens.select(F.lit(1).alias("query"), "token")
    wanted = unit_vectors(term_frequencies(one, "query"), idf, "query")
    scored = cosine_pairs(vectors, wanted, key, "query").join(symbols, key)
    first = F.least(F.lit(1.0), F.col("cosine") * kind_boost(F.col("kind"), F.col("line_span")))
    best = scored.withColumn("first", first).where("first > 0.01").orderBy(F.desc("first"), key).limit(limit)
    shown = F.round(F.least(F.lit(1.0), F.col("first") * display_boost(F.col("kind"), F.col("line_span"), F.col("body_length"))), 4)
    ranked = best.select(key, shown.alias("similarity"))
    return ranked.withColumn("rank", F.row_number().over(W.orderBy(F.desc("similarity"), key)))
