"""Structured Streaming: trace queues, sliding windows, rate limits and sessions.

All take a streaming DataFrame and work on a batch one too, so the results can be compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftgraph.operators import runtime as R


def windowed_churn(changes: DataFrame, key: str = "symbol_id", at: str = "at", window: str = "30 days", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(window_start, window_end, key, changes) per window; rows later than `late` are dropped."""
    frame = F.window(at, window, slide) if slide else F.window(at, window)
    counted = changes.withWatermark(at, late).groupBy(frame.alias("w"), key).agg(F.count(F.lit(1)).alias("changes"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "changes")


def sessions(events: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """(session_start, session_end, key, n) of events closer than a gap."""
    counted = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def unique_traces(traces: DataFrame, key: str = "trace_id", at: str = "at", late: str = "1 hour") -> DataFrame:
    """Each trace once, though its source may send it again within `late`."""
    return traces.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def trace_sink(symbols: DataFrame, path: str, key: str = "trace") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch's observed edges as one folder per batch id, so that a batch that is run again
    replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        R.observed_edges(batch, key, symbols).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def rate_limited(requests: DataFrame, key: str = "user_id", at: str = "ts", capacity: int = 10, refill_seconds: float = 60.0) -> DataFrame:
    """(key, at, allowed) of requests under a token bucket per key: `capacity` tokens, whole ones refilled per interval."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        for pdf in batches:
            rows = []
            for now in sorted(pdf["at"]):
                seconds = now.timestamp()
                last = seconds if last is None else last
                more = int((seconds - last) // refill_seconds)
                if more > 0:
                    tokens, last = min(capacity, tokens + more), last + more * refill_seconds
                rows.append((name[0], now, tokens > 0))
                tokens -= tokens > 0
            yield pd.DataFrame(rows, columns=["key", "at", "allowed"])
        state.update((int(tokens), last))

    kind = requests.schema[key].dataType.simpleString()
    renamed = requests.select(F.col(key).alias("key"), F.col(at).alias("at"))
    return renamed.groupBy("key").applyInPandasWithState(step, f"key {kind}, at timestamp, allowed boolean", "tokens int, last double", "append", GroupStateTimeout.NoTimeout)
