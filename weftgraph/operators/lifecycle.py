"""Snapshots, transactions, retention, overviews and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# States, moves and limits.
TRANSITIONS = {
    "planned": ("prepared", "failed", "rolled_back"), "prepared": ("patched", "failed", "rolled_back"), "patched": ("reindexed", "failed", "rolled_back"), "reindexed": ("validated", "failed", "rolled_back"),
    "validated": ("propagation_pending", "committed", "failed", "rolled_back"), "propagation_pending": ("committed", "failed", "rolled_back"), "committed": (), "rolled_back": (), "failed": ("rolled_back",),
}
TERMINAL = ("committed", "rolled_back", "failed")
MAX_AGE_DAYS, MAX_PER_REPO, STUCK_MINUTES, STALE_MINUTES = 90, 50, 180, 60
RISK = {"transaction": 6, "acquires_lock": 5, "network_call": 4, "concurrency": 4, "db_write": 3, "file_io": 3, "auth_check": 2, "throws": 1}


def is_legal_move(source: Column, target: Column) -> Column:
    allowed = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)).cast("array<string>") for kv in TRANSITIONS.items() for x in kv])
    return F.coalesce(F.array_contains(F.element_at(allowed, source), target), F.lit(False))


def illegal_moves(history: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, from_state, to_state, n) of moves between consecutive states that are not allowed."""
    previous = F.lag("state").over(W.partitionBy(key).orderBy(*order))
    moves = history.withColumn("from_state", previous).where(F.col("from_state").isNotNull() & ~is_legal_move(F.col("from_state"), F.col("state")))
    return moves.groupBy(key, "from_state", F.col("state").alias("to_state")).agg(F.count(F.lit(1)).alias("n"))


def _newest(snapshots: DataFrame) -> DataFrame:
    last = snapshots.groupBy("repo").agg(F.max(F.struct("created_at", "snapshot")).alias("m"))
    return last.select(F.col("m.snapshot").alias("snapshot"))


def expired(snapshots: DataFrame, now: DataFrame, days: int = MAX_AGE_DAYS) -> DataFrame:
    """Snapshots (repo, snapshot, created_at, retained_until) past their time, but for each repo's newest."""
    until = F.coalesce("retained_until", F.col("created_at") + F.expr(f"INTERVAL {days} DAYS"))
    old = snapshots.crossJoin(F.broadcast(now)).where(until < F.col("now"))
    return old.join(_newest(snapshots), "snapshot", "left_anti").select("repo", "snapshot")


def over_cap(snapshots: DataFrame, cap: int = MAX_PER_REPO) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("repo").orderBy(F.desc("created_at"), F.desc("snapshot")))
    return snapshots.withColumn("rank", rank).where(F.col("rank") > cap).select("repo", "snapshot", "rank")


def age_minutes(at: str) -> Column:
    return F.floor((F.unix_timestamp("now") - F.unix_timestamp(at)) / 60)


def stuck(snapshots: DataFrame, now: DataFrame, minutes: int = STUCK_MINUTES) -> DataFrame:
    """`snapshots` with index_status failed where indexing has gone on for too long."""
    late = (F.col("index_status") == "indexing") & (F.col("created_at") < F.col("now") - F.expr(f"INTERVAL {minutes} MINUTES"))
    return snapshots.crossJoin(F.broadcast(now)).withColumn("index_status", F.when(late, "failed").otherwise(F.col("index_status"))).drop("now")


def stale(transactions: DataFrame, now: DataFrame, minutes: int = STALE_MINUTES, limit: int | None = None) -> DataFrame:
    """(txn, state, updated_at, age_minutes) of unfinished transactions without news for too long, the oldest first."""
    rows = transactions.crossJoin(F.broadcast(now)).where(~F.col("state").isin(*TERMINAL) & (F.col("updated_at") < F.col("now") - F.expr(f"INTERVAL {minutes} MINUTES")))
    rows = rows.select("txn", "state", "updated_at", age_minutes("updated_at").alias("age_minutes"))
    return rows if limit is None else rows.orderBy("updated_at", "txn").limit(limit)


def fail_stale(transactions: DataFrame, now: DataFrame, minutes: int = STALE_MINUTES) -> DataFrame:
    """(state, n): transactions set to failed, by their new state."""
    return stale(transactions, now, minutes).select(F.lit("failed").alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def orphan_evidence(bundles: DataFrame, inferred: DataFrame, now: DataFrame) -> DataFrame:
    """Bundles (bundle, generated_at) older than an hour that no relation (bundle) refers to."""
    old = bundles.crossJoin(F.broadcast(now)).where(F.col("generated_at") < F.col("now") - F.expr("INTERVAL 1 HOUR"))
    return old.join(inferred.where("bundle IS NOT NULL").select("bundle").distinct(), "bundle", "left_anti").select("bundle")


def orphan_backups(backups: DataFrame, transactions: DataFrame, now: DataFrame) -> DataFrame:
    """Backups (txn, path) of transactions finished for a day."""
    done = transactions.crossJoin(F.broadcast(now)).where(F.col("state").isin(*TERMINAL) & (F.col("updated_at") < F.col("now") - F.expr("INTERVAL 24 HOURS")))
    return backups.join(done.select("txn"), "txn", "left_semi")


def run_policy(steps: dict) -> list[tuple[str, int, str]]:
    """Runs retention steps in order (name to a function that gives a DataFrame); (name, rows, error) each. A step that fails does
    not stop the others; its error is reported."""
    out = []
    for name, step in steps.items():
        try:
            out.append((name, step().count(), ""))
        except Exception as e:  # reported to the caller, step by step
            out.append((name, 0, str(e).splitlines()[0]))
    return out


def retention_stats(snapshots: DataFrame, transactions: DataFrame, now: DataFrame) -> DataFrame:
    """One row: total, expired, oldest, stale."""
    with_now = snapshots.crossJoin(F.broadcast(now))
    s = with_now.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("retained_until") < F.col("now")).alias("expired"), F.min("created_at").alias("oldest"))
    return s.crossJoin(F.broadcast(stale(transactions, now).agg(F.count(F.lit(1)).alias("stale"))))


def recovery_scan(transactions: DataFrame, backups: DataFrame, now: DataFrame) -> DataFrame:
    """Stale transactions with their number of backups."""
    n = backups.groupBy("txn").agg(F.count(F.lit(1)).alias("backups"))
    return stale(transactions, now).join(n, "txn", "left").select("txn", "state", "age_minutes", F.coalesce("backups", F.lit(0)).cast("long").alias("backups"))


def invariant_check(targets: DataFrame, invariants: DataFrame) -> DataFrame:
    """(target, checked, violated, passed): invariants of .8 and more are checked, from .9 on a change fails them. `targets` has target, changed."""
    rows = targets.join(invariants.where("strength >= 0.8").withColumnRenamed("sv_id", "target"), "target", "left")
    broken = F.count_if(F.col("changed") & (F.col("strength") >= 0.9))
    return rows.groupBy("target").agg(F.count("strength").alias("checked"), broken.alias("violated")).withColumn("passed", F.col("violated") == 0)


def validation_levels(levels: DataFrame, mode: str) -> DataFrame:
    """(txn, overall_passed, levels_run) of rows txn, level (1 to 6), passed. A level runs while all before it passed, or always if
    strict; only the first two run if quick. A failed invariant check (5) blocks in strict mode only."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("level", "passed"))), lambda s: s)
    zero = F.struct(F.lit(True).alias("ok"), F.lit(0).cast("long").alias("run"))

    def step(state, row):
        runs = (state["ok"] | F.lit(mode == "strict") | (row["level"] == 1)) & (F.lit(mode != "quick") | (row["level"] <= 2))
        blocks = (row["level"] != 5) | F.lit(mode == "strict")
        return F.when(runs, F.struct((state["ok"] & (row["passed"] | ~blocks)).alias("ok"), (state["run"] + 1).alias("run"))).otherwise(state)

    return levels.groupBy("txn").agg(F.aggregate(listed, zero, step).alias("f")).select("txn", F.col("f.ok").alias("overall_passed"), F.col("f.run").alias("levels_run"))


def overview(symbols: DataFrame) -> DataFrame:
    """(metric, value, n): symbols by language, kind, purity and directory (the 20 largest); `symbols` has these columns."""
    rows = None
    for metric in ("language", "kind", "purity"):
        part = symbols.groupBy(F.col(metric).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(metric).alias("metric"), "value", "n")
        rows = part if rows is None else rows.unionByName(part)
    dirs = symbols.groupBy(F.col("directory").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(20)
    return rows.unionByName(dirs.select(F.lit("directory").alias("metric"), "value", "n"))


def snapshot_stats(files: DataFrame, versions: DataFrame, relations: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(snapshot, files, versions, relations, orphaned): complete snapshots without anything are orphaned."""
    out = snapshots.select("snapshot", "index_status")
    for name, df in (("files", files), ("versions", versions), ("relations", relations)):
        out = out.join(df.groupBy("snapshot").agg(F.count(F.lit(1)).alias(name)), "snapshot", "left")
    out = out.fillna(0, ["files", "versions", "relations"])
    empty = F.col("files") + F.col("versions") + F.col("relations") == 0
    return out.select("snapshot", "files", "versions", "relations", (empty & (F.col("index_status") == "complete")).alias("orphaned"))


def risk_hints(hints: DataFrame, limit: int = 10) -> DataFrame:
    """(sv_id, hints): a symbol's dangerous hints as hint:detail, once each, the worst first."""
    severity = F.element_at(F.create_map(*[F.lit(x) for kv in RISK.items() for x in kv]), F.col("hint_type"))
    rows = hints.withColumn("severity", severity).where("severity IS NOT NULL").select("sv_id", F.struct((-F.col("severity")).alias("order"), F.concat("hint_type", F.lit(":"), "detail").alias("hint")).alias("h"))
    return rows.groupBy("sv_id").agg(F.slice(F.transform(F.array_sort(F.collect_set("h")), lambda h: h["hint"]), 1, limit).alias("hints"))


def precision_recall(rows: DataFrame) -> DataFrame:
    """(category, tp, fp, fn, precision, recall, f1) of rows category, expected, predicted, and a total; empty denominators give 1."""
    counts = [F.count_if(F.col("expected") & F.col("predicted")).alias("tp"), F.count_if(~F.col("expected") & F.col("predicted")).alias("fp"), F.count_if(F.col("expected") & ~F.col("predicted")).alias("fn")]
    both = rows.groupBy("category").agg(*counts).unionByName(rows.agg(*counts).select(F.lit("total").alias("category"), "tp", "fp", "fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = F.when(tp + fp == 0, 1.0).otherwise(tp / (tp + fp)), F.when(tp + fn == 0, 1.0).otherwise(tp / (tp + fn))
    return both.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))
