"""Packing into length buckets whose boundaries minimise padding, with token-budget batches.

A length is operator 1's token count and the end-of-text token (`counted_tokens`). A global
histogram with one bin per length, over all rows, feeds a dynamic programme that places at
most `buckets` upper boundaries so that the padding, the sum of boundary minus length, is
least. Inside a bucket, rows in a random order form batches of as many rows as the token
budget holds at the bucket's boundary, at least one.

Distinct lengths number at most the square root of twice the corpus' tokens, so the driver
holds the histogram. Null or empty texts have the initial mark and the end-of-text token;
rows longer than the budget get batches of their own; an empty table gives no rows. Ties in
order are broken by key. Columns of the input named like an output column are replaced.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import token_counts
from weftgraph.operators.slots import gapless_slots, parts_for
from weftgraph.sources.tables import materialise


def counted_tokens(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and tokens: operator 1's count plus the end-of-text token, for every row."""
    return token_counts.count_tokens(df, key, text).select(key, (F.col("n_tokens") + 1).alias("tokens"))


def estimated_tokens(text: str = "text") -> Column:
    """A guess without a model, far too low for many texts: a quarter of the UTF-8 bytes, rounded up, plus the end-of-text token."""
    return F.ceil(F.octet_length(F.coalesce(F.col(text), F.lit(""))) / 4).cast("long") + 1


def optimal_boundaries(bins: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """`bins` are (largest length, rows, sum of lengths) in ascending order. The returned
    upper boundaries are largest lengths of bins and end with the last one.

    With a last bucket that begins at bin i, the padding up to bin j is a line in j's length
    whose slope falls with i, so a lower hull of lines gives each step in linear time.
    """
    if not bins:
        return []
    n, top = len(bins), [b[0] for b in bins]
    rows = list(accumulate((b[1] for b in bins), initial=0))
    total = list(accumulate((b[2] for b in bins), initial=0))
    best = [top[j] * rows[j + 1] - total[j + 1] for j in range(n)]
    cuts = [[0] * n]
    for k in range(1, min(buckets, n)):
        now, cut, hull, head = [0] * n, [0] * n, [], 0
        for j in range(k, n):
            m, c = rows[j], best[j - 1] + total[j]
            while len(hull) - head > 1:
                (m1, c1, _), (m2, c2, _) = hull[-2:]
                if (c - c1) * (m2 - m1) > (c2 - c1) * (m - m1):
                    break
                hull.pop()
            hull.append((m, c, j))
            while head + 1 < len(hull) and hull[head + 1][1] - top[j] * hull[head + 1][0] < hull[head][1] - top[j] * hull[head][0]:
                head += 1
            m, c, cut[j] = hull[head]
            now[j] = c - top[j] * m + top[j] * rows[j + 1] - total[j + 1]
        best = now
        cuts.append(cut)
    out, j = [], n - 1
    for cut in reversed(cuts):
        out.append(top[j])
        j = cut[j] - 1
        if j < 0:
            break
    return out[::-1]


def pack(df: DataFrame, length: Column, key: str = "doc_id", buckets: int = 16, budget: int = 65536, blocks: int | None = None, seed: int = 7) -> DataFrame:
    """`df` with n_tokens, bucket, boundary, batch (gapless inside its bucket), place
    (inside the batch) and padding. Keep only the columns you need in `df`: it is
    written once in between. A bucket is ordered in `blocks`, by default one per million rows, 64 at
    least."""
    inner = [c for c in df.columns if c in ("_rank", "_block", "_start", "_n", "slot")]
    df = df.withColumn("n_tokens", length).drop("bucket", "boundary", "batch", "place", "padding").withColumnsRenamed({c: f"{c} of the input" for c in inner})
    rows = materialise(df, "lengths")
    histogram = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toArrow()
    bins = sorted((t, n, t * n) for t, n in zip(*(c.to_pylist() for c in histogram.columns), strict=True))
    bounds = optimal_boundaries(bins, buckets) or [1]
    blocks = blocks or parts_for(sum(b[1] for b in bins), 64)
    bucket = sum((F.when(F.col("n_tokens") > b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0))
    placed = gapless_slots(
        rows.withColumn("bucket", bucket.cast("int")), "bucket", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(blocks)), [F.xxhash64(F.col(key), F.lit(seed + 1)), F.col(key)]
    )
    boundary = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket") + 1)
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("boundary"))).cast("long")
    return (
        placed.withColumn("boundary", boundary)
        .withColumn("batch", F.floor(F.col("slot") / fits).cast("long"))
        .withColumn("place", (F.col("slot") - F.col("batch") * fits).cast("int"))
        .withColumn("padding", F.col("boundary") - F.col("n_tokens"))
        .drop("slot")
        .withColumnsRenamed({f"{c} of the input": c for c in inner})
    )
