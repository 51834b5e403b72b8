"""Runtime evidence: traces to observed edges, merging into static relations, less uncertainty, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.operators import dispatch as D

# Confidences, caps, and flags that evidence settles.
BOTH, ONE, BOOST, NEW_EDGE, FILE_LINE = 0.9, 0.6, 0.15, 0.85, 0.85
CAPS = {"call_edges": 50_000, "dynamic_routes": 5_000, "observed_types": 10_000, "framework_events": 10_000}
RESOLVABLE = ("dynamic_dispatch", "runtime_only_behavior", "type_inference_failure", "ambiguous_override")
TRACE = """struct<source:string,timestamp:timestamp,call_edges:array<struct<caller_key:string,callee_key:string,receiver_type:string,call_count:bigint>>,
  dynamic_routes:array<struct<route:string,handler_key:string,method:string>>,observed_types:array<struct<expression:string,observed_type:string,location:string>>,
  framework_events:array<struct<event_type:string,detail:string>>>"""


def parse_traces(raw: DataFrame, key: str, json: str) -> DataFrame:
    """(key, source, timestamp, four arrays) of JSON traces; malformed ones are dropped, long arrays cut at their caps."""
    parsed = raw.select(key, F.from_json(json, TRACE).alias("t")).where("t IS NOT NULL AND t.source IS NOT NULL")
    none = lambda c: F.coalesce(F.col(f"t.{c}"), F.array())
    return parsed.select(key, "t.source", "t.timestamp", *[F.slice(none(c), 1, n).alias(c) for c, n in CAPS.items()])


def observed_confidence(both: Column, calls: Column) -> Column:
    return F.least(F.lit(1.0), F.when(both, BOTH).otherwise(ONE) + F.least(F.lit(0.1), F.log10(F.greatest(F.lit(1), calls)) * 0.03))


def resolve_keys(rows: DataFrame, key: str, symbols: DataFrame, out: str) -> DataFrame:
    """`rows` with the symbol of a runtime key: by stable key, else canonical name, else demangled or simple name. `symbols` has id,
    stable_key, name; of several the least id counts."""
    from weftgraph.operators.relational import resolve_cascade

    ready = rows.withColumn("_plain", T.demangle(F.col(key))).withColumn("_simple", T.simple_name(F.col(key)))
    found = resolve_cascade(ready, key, [(symbols, "stable_key", "id"), (symbols, "name", "id")], "_exact")
    found = resolve_cascade(found, "_plain", [(symbols, "name", "id")], "_demangled")
    found = resolve_cascade(found, "_simple", [(symbols, "name", "id")], "_short")
    return found.withColumn(out, F.coalesce("_exact", "_demangled", "_short")).drop("_plain", "_simple", "_exact", "_demangled", "_short")


def observed_edges(traces: DataFrame, key: str, symbols: DataFrame) -> DataFrame:
    """(trace, caller, callee, receiver_type, calls, confidence): call counts add up; edges with no known end are skipped."""
    rows = traces.select(F.col(key).alias("trace"), F.inline("call_edges"))
    named = resolve_keys(resolve_keys(rows, "caller_key", symbols, "caller"), "callee_key", symbols, "callee")
    known = named.where("caller IS NOT NULL OR callee IS NOT NULL")
    total = known.groupBy("trace", "caller", "callee").agg(F.max("receiver_type").alias("receiver_type"), F.sum(F.coalesce("call_count", F.lit(1))).alias("calls"))
    both = F.col("caller").isNotNull() & F.col("callee").isNotNull()
    return total.withColumn("confidence", observed_confidence(both, F.col("calls")))


def merge_edges(static: DataFrame, observed: DataFrame) -> DataFrame:
    """(src, dst, confidence, provenance): calls seen at run time gain .15, new ones get .85 + .05 log10 of their number; the rest
    stays."""
    seen = observed.where("caller IS NOT NULL AND callee IS NOT NULL").groupBy(F.col("caller").alias("src"), F.col("callee").alias("dst")).agg(F.sum("calls").alias("calls"))
    both = static.select("src", "dst", "confidence").join(seen, ["src", "dst"], "full")
    fresh = F.least(F.lit(1.0), NEW_EDGE + F.log10(F.greatest(F.lit(1), F.col("calls"))) * 0.05)
    sure = F.when(F.col("calls").isNull(), F.col("confidence")).when(F.col("confidence").isNull(), fresh).otherwise(F.least(F.lit(1.0), F.col("confidence") + BOOST))
    return both.select("src", "dst", sure.alias("confidence"), F.when(F.col("calls").isNull(), "static_inferred").otherwise("runtime_observed").alias("provenance"))


def settle_flags(symbols: DataFrame, observed: DataFrame) -> DataFrame:
    """`symbols` (sv_id, uncertainty_flags) of which evidence settled flags, with those left."""
    seen = observed.select(F.col("caller").alias("sv_id")).union(observed.select("callee")).where("sv_id IS NOT NULL").distinct()
    settled = F.array_except("uncertainty_flags", F.array(*map(F.lit, RESOLVABLE)))
    rows = symbols.join(seen, "sv_id", "left_semi").withColumn("left", settled)
    return rows.where(F.arrays_overlap("uncertainty_flags", F.array(*map(F.lit, RESOLVABLE)))).select("sv_id", F.col("left").alias("uncertainty_flags"))


def settle_dispatch(edges: DataFrame, observed: DataFrame) -> DataFrame:
    """`edges` (caller, expression, resolved, method, confidence, is_polymorphic): unresolved ones take a caller's five most called
    targets, those that a call confirms gain .15."""
    top = D.best_targets(observed.where("callee IS NOT NULL")).withColumnRenamed("resolved", "seen")
    called = observed.where("caller IS NOT NULL AND callee IS NOT NULL").groupBy("caller").agg(F.collect_set("callee").alias("callees"))
    rows = edges.join(top, "caller", "left").join(called, "caller", "left")
    fill = (F.col("method") == "unresolved") & F.col("seen").isNotNull()
    sure = F.least(F.lit(1.0), NEW_EDGE + F.log10(F.greatest(F.lit(1), F.col("calls"))) * 0.05)
    confirmed = ~F.col("method").isin("unresolved", "runtime_observed") & F.coalesce(F.arrays_overlap("resolved", "callees"), F.lit(False))
    return rows.select(
        "caller", "expression", F.when(fill, F.col("seen")).otherwise(F.col("resolved")).alias("resolved"), F.when(fill, "runtime_observed").otherwise(F.col("method")).alias("method"),
        F.when(fill, sure).when(confirmed, F.least(F.lit(1.0), F.col("confidence") + BOOST)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(fill, F.size("seen") > 1).otherwise(F.col("is_polymorphic")).alias("is_polymorphic"),
    )


def _add_to_sets(rows: DataFrame, key: str, column: str, additions: DataFrame) -> DataFrame:
    """`rows` with values (key, value) added to an array column as a sorted set."""
    more = additions.groupBy(key).agg(F.collect_set("value").alias("_more"))
    none = F.array().cast("array<string>")
    grown = F.array_sort(F.array_distinct(F.concat(F.coalesce(column, none), F.col("_more"))))
    return rows.join(more, key, "left").withColumn(column, F.when(F.col("_more").isNull(), F.col(column)).otherwise(grown)).drop("_more")


def apply_routes(profiles: DataFrame, traces: DataFrame, symbols: DataFrame) -> DataFrame:
    """`profiles` (sv_id, api_contract_refs) with the routes bound to their symbols at run time."""
    routes = traces.select(F.inline("dynamic_routes")).where("handler_key IS NOT NULL AND route IS NOT NULL")
    bound = resolve_keys(routes, "handler_key", symbols, "sv_id").where("sv_id IS NOT NULL")
    return _add_to_sets(profiles, "sv_id", "api_contract_refs", bound.select("sv_id", F.concat(F.coalesce(F.nullif("method", F.lit("")), F.lit("ANY")), F.lit(" "), "route").alias("value")))


def apply_types(edges: DataFrame, traces: DataFrame) -> DataFrame:
    """`edges` (expression, types, confidence) with types observed for their expression, sure to .85 at least."""
    seen = traces.select(F.inline("observed_types")).where("expression IS NOT NULL AND observed_type IS NOT NULL").select("expression", F.col("observed_type").alias("value"))
    known = seen.select("expression").distinct().withColumn("_seen", F.lit(True))
    grown = _add_to_sets(edges, "expression", "types", seen).join(known, "expression", "left")
    return grown.withColumn("confidence", F.when(F.col("_seen"), F.greatest("confidence", F.lit(FILE_LINE))).otherwise(F.col("confidence"))).drop("_seen")


# Framework events: fields, and what they make.
EVENTS = {
    "route_bind": ("handler_key", "route"), "orm_register": ("model_key", "table_name"), "decorator_expand": ("target_key", "expanded_key"), "event_handler": ("emitter_key", "handler_key"), "middleware_mount": ("app_key", "middleware_key"),
}


def framework_events(traces: DataFrame, symbols: DataFrame) -> DataFrame:
    """(event_type, first, second, first_id, second_id, method, strength, provenance) of five kinds of events whose keys are known."""
    rows = traces.select(F.inline("framework_events")).where("event_type IS NOT NULL AND detail IS NOT NULL")
    field = lambda i: F.coalesce(*[F.when(F.col("event_type") == kind, F.get_json_object("detail", f"$.{fields[i]}")) for kind, fields in EVENTS.items()])
    read = rows.select("event_type", field(0).alias("first"), field(1).alias("second"), F.get_json_object("detail", "$.method").alias("method")).where("first IS NOT NULL AND second IS NOT NULL")
    named = resolve_keys(resolve_keys(read, "first", symbols, "first_id"), "second", symbols, "second_id")
    single = F.col("event_type").isin("route_bind", "orm_register")
    known = named.where(F.col("first_id").isNotNull() & (single | F.col("second_id").isNotNull()))
    strength = F.when(F.col("event_type") == "event_handler", 0.8).when(~single, 1.0)
    provenance = F.when(F.col("event_type") == "event_handler", "runtime_observed").when(~single, "framework_declared")
    return known.select("event_type", "first", "second", "first_id", F.when(~single, F.col("second_id")).alias("second_id"), "method", strength.alias("strength"), provenance.alias("provenance"))


def evidence_report(observed: DataFrame) -> DataFrame:
    """(sv_id, as_caller, as_callee, observations, sources, first_observed, last_observed, confidence_boost) of rows caller, callee, source, at."""
    rows = observed.select(F.col("caller").alias("sv_id"), F.lit(1).alias("out"), "source", "at").union(observed.select("callee", F.lit(0), "source", "at")).where("sv_id IS NOT NULL")
    g = rows.groupBy("sv_id").agg(
        F.sum("out").alias("as_caller"), F.sum(1 - F.col("out")).alias("as_callee"), F.count(F.lit(1)).alias("observations"), F.countDistinct("source").alias("sources"), F.min("at").alias("first_observed"), F.max("at").alias("last_observed")
    )
    return g.withColumn("confidence_boost", F.least(F.lit(0.3), BOOST * F.least("sources", F.lit(3))))
