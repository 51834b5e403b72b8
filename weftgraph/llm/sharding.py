"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Source partitions are hash buckets of the key, so a task that is run again deals the same
rows. The number of rows each partition sends to each shard is drawn exactly: going down
the partitions, the counts follow a multivariate hypergeometric law over the places left, at any size.
Each partition is permuted locally, cut by its row of the matrix, exchanged, and each
shard is permuted again, in blocks whose order is random too.

Nulls: a null key is hashed like any other. Rows with equal keys are ordered by the other
`tie` columns; fully equal rows are interchangeable. An empty table gives an empty result.
Columns of the input named like an output column are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.operators.slots import gapless_slots, parts_for
from weftgraph.sources.tables import materialise


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of `n` places drawn from `good` + `bad` are good, for numbers of any size.

    The law's ratios of neighbours are simple fractions; they are multiplied outwards from the mode over twelve standard
    deviations and more, beyond which less is left than a double can tell, and the law is inverted there.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    every = good + bad
    mode = min(max((n + 1) * (good + 1) // (every + 2), low), high)
    reach = 40 + int(12 * (n * (good / every) * (bad / every) * ((every - n) / max(1, every - 1))) ** 0.5)
    first, last = max(low, mode - reach), min(high, mode + reach)
    x = np.arange(last - first, dtype=np.float64)
    steps = np.log((good - first) - x) + np.log((n - first) - x) - np.log((first + 1) + x) - np.log((bad - n + first + 1) + x)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    sums = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Counts of rows from each partition to each shard: row sums are `rows`, and the
    column sums differ by one at most."""
    rng, out = np.random.default_rng(seed), np.zeros((len(rows), shards), dtype=np.int64)
    total = sum(rows)
    left = [total // shards] * shards
    turn = int(rng.integers(shards))
    for i in range(total % shards):
        left[(turn + i) % shards] += 1
    for p, n in enumerate(rows):
        rest = total
        for s in range(shards):
            rest -= left[s]
            out[p, s] = took = hypergeometric(rng, left[s], rest, n)
            left[s] -= took
            n -= took
        total -= rows[p]
    return out


def hypergeometric_shards(df: DataFrame, key: str = "doc_id", shards: int = 40, parts: int | None = None, blocks: int | None = None, seed: int = 20240501, tie: tuple[str, ...] = ()) -> DataFrame:
    """`df` with `shard` (0 to shards-1, sizes one apart at most) and `slot` (gapless from 0).

    `parts` and `blocks` default to one per million rows (256 and 64 at least), so that a block
    fits a task; the driver and broadcasts hold parts x shards and shards x blocks counts.
    """
    inner = [c for c in df.columns if c in ("_part", "_rank", "_ends", "_block", "_start", "_n")]
    df = df.drop("shard", "slot").withColumnsRenamed({c: f"{c} of the input" for c in inner})
    n = df.count() if parts is None or blocks is None else 0
    parts = parts or parts_for(n, 256)
    blocks = blocks or parts_for(n // shards, 64)
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(parts)).cast("int")
    counts = {r["_part"]: r["n"] for r in df.select(bucket.alias("_part")).groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], shards, seed)
    ends = [(p, row.tolist()) for p, row in enumerate(np.cumsum(matrix, axis=1))]
    cuts = df.sparkSession.createDataFrame(ends, "_part int, _ends array<bigint>")
    local = [F.xxhash64(F.col(key), F.lit(seed + 1)), F.col(key), *map(F.col, tie)]
    dealt = (
        df.withColumn("_part", bucket)
        .withColumn("_rank", F.row_number().over(W.partitionBy("_part").orderBy(*local)))
        .join(F.broadcast(cuts), "_part")
        .withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))))
        .drop("_part", "_rank", "_ends")
    )
    again = F.xxhash64(F.col(key), F.lit(seed + 2))
    placed = gapless_slots(materialise(dealt, "shards"), "shard", F.pmod(again, F.lit(blocks)), [F.xxhash64(F.col(key), F.lit(seed + 3)), F.col(key), *map(F.col, tie)])
    return placed.withColumnsRenamed({f"{c} of the input": c for c in inner})
