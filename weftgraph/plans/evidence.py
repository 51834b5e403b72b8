"""Dispatch and runtime evidence."""

from pyspark.sql import functions as F

from weftgraph.operators import dispatch as D
from weftgraph.operators import graph as G
from weftgraph.operators import runtime as R
from weftgraph.plans import bindings as B
from weftgraph.plans.registry import query
from weftgraph.plans.scalars import q
from weftgraph.sources.tables import table

_DISPATCH = f"""(SELECT src AS caller, 'self.f' || (dst % 40) AS expression, list(DISTINCT dst) AS resolved, CASE src % 4 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'inheritance_mro' ELSE 'type_annotation' END AS method, max(confidence) AS confidence, count(DISTINCT dst) > 1 AS is_polymorphic FROM {B.EDGES} GROUP BY 1, 2, 4)"""


def _edges(spark, sf_dir):
    kind = F.when(F.col("src") % 4 == 0, "unresolved").when(F.col("src") % 4 == 1, "inheritance_mro").otherwise("type_annotation")
    rows = B.edges(spark, sf_dir).select(F.col("src").alias("caller"), F.concat(F.lit("self.f"), F.col("dst") % 40).alias("expression"), kind.alias("method"), "dst", "confidence")
    return rows.groupBy("caller", "expression", "method").agg(F.array_sort(F.collect_set("dst")).alias("resolved"), F.max("confidence").alias("confidence"), (F.countDistinct("dst") > 1).alias("is_polymorphic"))


@query("D4a_edges_of_caller", f"SELECT expression, method, confidence FROM {_DISPATCH} WHERE caller = 9 ORDER BY confidence DESC, expression")
def edges_of_caller(spark, sf_dir):
    return D.edges_of_caller(_edges(spark, sf_dir), 9).select("expression", "method", "confidence")


@query("D4b_dispatchers", f"SELECT caller, expression, confidence FROM {_DISPATCH} WHERE list_contains(resolved, 17)")
def dispatchers(spark, sf_dir):
    return D.dispatchers_of(_edges(spark, sf_dir), 17).select("caller", "expression", "confidence")


@query("D4c_unresolved", f"SELECT caller, expression FROM {_DISPATCH} WHERE method = 'unresolved'")
def unresolved(spark, sf_dir):
    return D.unresolved(_edges(spark, sf_dir)).select("caller", "expression")


_STAT = "count(*) AS edges, count(*) FILTER (WHERE len(resolved) > 0) AS resolved, count(*) FILTER (WHERE method = 'unresolved') AS unresolved, count(*) FILTER (WHERE is_polymorphic) AS polymorphic, round(coalesce(avg(confidence), 0), 6) AS mean_confidence"


@query("D4d_dispatch_stats", f"WITH d AS {_DISPATCH} SELECT 'all' AS method, {_STAT} FROM d UNION ALL SELECT method, {_STAT} FROM d GROUP BY method")
def dispatch_stats(spark, sf_dir):
    return D.statistics(_edges(spark, sf_dir)).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("D4e_hierarchy", "SELECT s_suppkey AS class, string_agg(n_name, '>' ORDER BY pos) AS ancestors FROM (SELECT s_suppkey, n_name, 0 AS pos FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT s_suppkey, r_name, 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY s_suppkey")
def hierarchy(spark, sf_dir):
    homes = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = homes.select(F.col("s_suppkey").alias("class"), F.posexplode(F.array("n_name", "r_name")).alias("position", "parent"))
    return D.hierarchy_lists(rows).withColumn("ancestors", F.array_join("ancestors", ">"))


_TYPES = "list_filter(list_transform(string_split({0}, '|'), lambda p: trim(regexp_replace(trim(p), '<[^>]*>|\\[.*\\]', '', 'g'))), lambda t: t <> '' AND t NOT IN (" + ", ".join(map(q, D.PRIMITIVES)) + "))"
_SIMPLE = [(i, *r) for i, r in enumerate(D.FACT_RULES)]


def _facts_sql() -> str:
    whens = []
    for _, p, f, t, source, sure, languages in _SIMPLE:
        plain = p.replace(r"(?!(?:int|long|float|double|boolean|byte|char|short|void|var|string|String|return)\b)", "")
        skip = "" if plain == p else r" AND NOT regexp_matches(text, '^(?:(?:private|protected|public|internal|readonly|final|static)\s+){0,2}(?:int|long|float|double|boolean|byte|char|short|void|var|string|String|return)\b')"
        lang = f" AND language IN ({', '.join(map(q, languages))})" if languages else ""
        whens.append(f"WHEN regexp_matches(text, {q(plain)}){lang}{skip} THEN {{'field': regexp_extract(text, {q(plain)}, {f}), 'types': {_TYPES.format(f'trim(regexp_extract(text, {q(plain)}, {t}))')}, 'source': '{source}', 'confidence': {sure}::DOUBLE}}")
    return "CASE " + " ".join(whens) + " END"


FACTS = f"ls AS (SELECT sv_id AS owner, language, trim(unnest(string_split(body, chr(10)))) AS text FROM {B.BODIES}), fr AS (SELECT owner, {_facts_sql()} AS f FROM ls), ft AS (SELECT owner, f.field AS field, f.types AS types, f.source AS source, f.confidence AS confidence FROM fr WHERE f IS NOT NULL AND len(f.types) > 0)"


@query("D1_points_to", f"WITH {FACTS}, t AS (SELECT owner, field, string_agg(DISTINCT x, ',' ORDER BY x) AS types FROM (SELECT owner, field, unnest(types) AS x FROM ft) GROUP BY 1, 2) SELECT t.owner, t.field, t.types, max(confidence) AS confidence FROM t JOIN ft ON ft.owner = t.owner AND ft.field = t.field GROUP BY 1, 2, 3")
def points_to(spark, sf_dir):
    code = B.bodies(spark, sf_dir).withColumnRenamed("sv_id", "owner")
    return D.points_to(code).select("owner", "field", F.array_join("types", ",").alias("types"), "confidence")


@query("D2_member_calls", f"WITH l AS (SELECT sv_id, start_line, unnest(string_split(body, chr(10))) AS text, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS i FROM {B.BODIES} WHERE kind IN ('method', 'function')), c AS (SELECT sv_id AS caller, (start_line + i)::INT AS line, regexp_replace(unnest(regexp_extract_all(text, {q(D.CHAIN)}, 1)), '\\s+', '', 'g') AS part FROM l) SELECT caller, 'self' || part AS chain, list_extract(string_split(part, '.'), -1) AS method, line FROM c")
def member_calls(spark, sf_dir):
    return D.member_calls(B.bodies(spark, sf_dir))


def _world(spark, sf_dir):
    """A class is a dozen of parts, with their fields and calls and, if one is a method, "find"; classes of one gross inherit from
    its first. Outside the parts stands a class Repository that inherits "find" from a class Store."""
    first = F.col("sv_id") - F.col("sv_id") % 12
    code = B.bodies(spark, sf_dir).withColumn("owner", first.cast("string"))
    classes = code.select(F.col("owner").alias("class"), first.alias("first")).distinct()
    parents = classes.where("first % 144 > 0").select("class", (F.col("first") - F.col("first") % 144).cast("string").alias("parent"), F.lit(0).alias("position"))
    parents = parents.unionByName(spark.sql("SELECT 'Repository' AS class, 'Store' AS parent, 0 AS position"))
    methods = code.where("kind = 'method'").groupBy(F.col("owner").alias("class")).agg(F.lit("find").alias("method"), F.min("sv_id").alias("id"))
    methods = methods.unionByName(spark.sql("SELECT 'Store' AS class, 'find' AS method, 0L AS id"))
    return code, methods, G.linearise(parents, classes.select("class").unionByName(spark.sql("SELECT explode(array('Repository', 'Store')) AS class")))


@query("D3_chain_resolution")
def chain_resolution(spark, sf_dir):
    """Position by position; tests walk every chain of the table plainly."""
    code, methods, mro = _world(spark, sf_dir)
    calls = D.member_calls(code).join(code.select(F.col("sv_id").alias("caller"), "owner"), "caller").select("caller", "owner", "chain")
    return D.resolve_chains(calls, D.points_to(code), methods, mro).withColumn("types", F.array_join("types", ",")).withColumn("targets", F.array_join("targets", ","))


@query("D4f_dispatch_build")
def dispatch_build(spark, sf_dir):
    code, methods, mro = _world(spark, sf_dir)
    owners = code.select(F.col("sv_id").alias("caller"), "owner")
    built = D.build(code, owners, methods, mro)
    return built.withColumns({c: F.array_join(c, ",") for c in ("types", "resolved", "override_chain")})


# Runtime. A user's consecutive events are calls between their types; a trace is a user.

TRACES = """(WITH e AS (SELECT user_id, event_type AS caller_key, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS callee_key, value, ts FROM events)
SELECT user_id AS trace, caller_key, callee_key, 1 + CAST(floor(value) AS BIGINT) % 7 AS n, ts FROM e WHERE callee_key IS NOT NULL)"""
KEYS = "(SELECT 'view' AS name, 1 AS id UNION ALL SELECT 'click', 2 UNION ALL SELECT 'purchase', 3 UNION ALL SELECT 'error', 4)"


def _calls(spark, sf_dir):
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events")
    nxt = F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = e.select(F.col("user_id").alias("trace"), F.col("event_type").alias("caller_key"), nxt.alias("callee_key"), (1 + F.expr("CAST(floor(value) AS BIGINT)") % 7).alias("call_count"), "ts")
    return rows.where("callee_key IS NOT NULL")


def _keys(spark):
    return spark.createDataFrame([("view", 1), ("click", 2), ("purchase", 3), ("error", 4)], "name string, id int").withColumn("stable_key", F.concat(F.lit("app#"), "name"))


def _traces(spark, sf_dir):
    calls = _calls(spark, sf_dir).select("trace", F.struct("caller_key", "callee_key", F.lit(None).cast("string").alias("receiver_type"), "call_count").alias("c"))
    return calls.groupBy("trace").agg(F.collect_list("c").alias("call_edges"))


@query("R1_trace_ingest", "SELECT event_id, event_type AS source, 1 AS n_calls, 0 AS n_routes FROM events WHERE event_id % 10 < 9")
def trace_ingest(spark, sf_dir):
    text = F.when(F.col("event_id") % 10 == 9, "not json").otherwise(F.concat(F.lit('{"source": "'), "event_type", F.lit('", "call_edges": [{"caller_key": "a", "callee_key": "b", "call_count": 3}]}')))
    raw = table(spark, sf_dir, "events").select("event_id", text.alias("json"))
    return R.parse_traces(raw, "event_id", "json").select("event_id", "source", F.size("call_edges").alias("n_calls"), F.size("dynamic_routes").alias("n_routes"))


OBSERVED = f"""oe AS (SELECT trace, a.id AS caller, b.id AS callee, sum(n)::BIGINT AS calls FROM {TRACES} t LEFT JOIN {KEYS} a ON a.name = caller_key LEFT JOIN {KEYS} b ON b.name = callee_key WHERE a.id IS NOT NULL OR b.id IS NOT NULL GROUP BY 1, 2, 3)"""


def _observed(spark, sf_dir):
    return R.observed_edges(_traces(spark, sf_dir), "trace", _keys(spark))


@query("R2_observed_edges", f"WITH {OBSERVED} SELECT trace, caller, callee, calls, round(least(1.0, CASE WHEN caller IS NOT NULL AND callee IS NOT NULL THEN 0.9 ELSE 0.6 END + least(0.1, 0.03 * log10(calls)))::DOUBLE, 6) AS confidence FROM oe")
def observed_edges(spark, sf_dir):
    return _observed(spark, sf_dir).select("trace", "caller", "callee", "calls", F.round("confidence", 6).alias("confidence"))


_STATIC = "(SELECT a.id AS src, b.id AS dst, 0.5::DOUBLE + a.id / 20::DOUBLE AS confidence FROM {0} a, {0} b WHERE a.id <> b.id AND (a.id + b.id) % 2 = 1)".format(KEYS)


@query("R3_merged_edges", f"WITH {OBSERVED}, s AS (SELECT caller AS src, callee AS dst, sum(calls) AS calls FROM oe WHERE caller IS NOT NULL AND callee IS NOT NULL GROUP BY 1, 2) SELECT coalesce(s.src, t.src) AS src, coalesce(s.dst, t.dst) AS dst, round(CASE WHEN s.src IS NULL THEN t.confidence WHEN t.src IS NULL THEN least(1.0, 0.85 + 0.05 * log10(calls)) ELSE least(1.0, t.confidence + 0.15) END::DOUBLE, 6) AS confidence, CASE WHEN s.src IS NULL THEN 'static_inferred' ELSE 'runtime_observed' END AS provenance FROM s FULL JOIN {_STATIC} t ON t.src = s.src AND t.dst = s.dst")
def merged_edges(spark, sf_dir):
    k = _keys(spark).select("id")
    a, b = k.withColumnRenamed("id", "src"), k.withColumnRenamed("id", "dst")
    static = a.join(b, (F.col("src") != F.col("dst")) & ((F.col("src") + F.col("dst")) % 2 == 1)).withColumn("confidence", 0.5 + F.col("src") / 20)
    return R.merge_edges(static, _observed(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


def _pairs(spark, sf_dir):
    """Observed calls between parts, one to nine along each static edge."""
    rows = B.edges(spark, sf_dir)
    return rows.select(F.col("src").alias("caller"), F.col("dst").alias("callee"), (1 + F.col("dst") % 9).alias("calls"), (F.col("src") % 3).cast("string").alias("source"), (F.col("dst") % 28).alias("at"))


_PAIRS = f"(SELECT src AS caller, dst AS callee, 1 + dst % 9 AS calls, CAST(src % 3 AS VARCHAR) AS source, dst % 28 AS \"at\" FROM {B.EDGES})"


@query("R4_settled_flags", f"WITH o AS {_PAIRS}, s AS (SELECT DISTINCT unnest([caller, callee]) AS sv_id FROM o) SELECT p_partkey AS sv_id, CASE WHEN p_size % 2 = 0 THEN 'parse_error' ELSE '' END AS left_flags FROM part JOIN s ON s.sv_id = p_partkey WHERE p_size % 3 = 0")
def settled_flags(spark, sf_dir):
    s = F.col("p_size")
    flags = F.array_compact(F.array(F.when(s % 3 == 0, "dynamic_dispatch"), F.when(s % 2 == 0, "parse_error")))
    symbols = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sv_id"), flags.alias("uncertainty_flags"))
    return R.settle_flags(symbols, _pairs(spark, sf_dir)).select("sv_id", F.array_join("uncertainty_flags", ",").alias("left_flags"))


@query(
    "R4_settled_dispatch",
    f"""WITH o AS {_PAIRS}, d AS {_DISPATCH}, g AS (SELECT caller, callee, sum(calls) AS calls, row_number() OVER (PARTITION BY caller ORDER BY sum(calls) DESC, callee) AS rn FROM o GROUP BY 1, 2), t AS (SELECT caller, count(*) AS n, sum(calls) AS calls, string_agg(callee, ',' ORDER BY rn) AS seen FROM g WHERE rn <= 5 GROUP BY caller)
SELECT d.caller, expression, CASE WHEN method = 'unresolved' AND seen IS NOT NULL THEN seen ELSE array_to_string(list_sort(resolved), ',') END AS resolved, CASE WHEN method = 'unresolved' AND seen IS NOT NULL THEN 'runtime_observed' ELSE method END AS method,
 round(CASE WHEN method = 'unresolved' AND seen IS NOT NULL THEN least(1.0, 0.85 + 0.05 * log10(t.calls)) WHEN method <> 'unresolved' AND EXISTS (SELECT 1 FROM o WHERE o.caller = d.caller AND list_contains(d.resolved, o.callee)) THEN least(1.0, confidence + 0.15) ELSE confidence END::DOUBLE, 6) AS confidence,
 CASE WHEN method = 'unresolved' AND seen IS NOT NULL THEN n > 1 ELSE is_polymorphic END AS is_polymorphic FROM d LEFT JOIN t ON t.caller = d.caller""",
)
def settled_dispatch(spark, sf_dir):
    out = R.settle_dispatch(_edges(spark, sf_dir), _pairs(spark, sf_dir))
    return out.withColumn("resolved", F.array_join("resolved", ",")).withColumn("confidence", F.round("confidence", 6))


def _detailed(spark, sf_dir):
    """Traces with routes, types and framework events, from pages and parts."""
    s = B.symbols(spark, sf_dir)
    route = F.struct(F.concat(F.lit("/"), "kind").alias("route"), F.col("stable_key").alias("handler_key"), F.when(F.col("line_span") % 2 == 0, "GET").otherwise("").alias("method"))
    seen = F.struct(F.concat(F.lit("self.f"), F.col("sv_id") % 40).alias("expression"), F.col("kind").alias("observed_type"), F.lit("x").alias("location"))
    detail = F.to_json(F.struct(F.col("stable_key").alias("app_key"), F.col("stable_key").alias("middleware_key"), F.col("stable_key").alias("handler_key"), F.lit("/x").alias("route")))
    event = F.struct(F.when(F.col("sv_id") % 2 == 0, "middleware_mount").otherwise("route_bind").alias("event_type"), detail.alias("detail"))
    return s.select(F.col("sv_id").alias("trace"), F.array(route).alias("dynamic_routes"), F.array(seen).alias("observed_types"), F.array(event).alias("framework_events")), B.symbols(spark, sf_dir).select(F.col("sv_id").alias("id"), "stable_key", "name")


_OWNER = f"ow AS (SELECT stable_key, min(sv_id) AS id FROM {B.SYMBOLS} GROUP BY stable_key)"


@query("R5a_dynamic_routes", f"WITH {_OWNER}, r AS (SELECT DISTINCT id, CASE WHEN line_span % 2 = 0 THEN 'GET' ELSE 'ANY' END || ' /' || kind AS v FROM {B.SYMBOLS} s JOIN ow USING (stable_key) UNION SELECT sv_id, api_ref FROM {B.CONTRACTS} WHERE sv_id IN (SELECT id FROM ow)) SELECT c.sv_id, coalesce((SELECT string_agg(DISTINCT v, ',' ORDER BY v) FROM r WHERE r.id = c.sv_id), api_ref) AS refs FROM {B.CONTRACTS} c")
def dynamic_routes(spark, sf_dir):
    traces, symbols = _detailed(spark, sf_dir)
    profiles = B.contracts(spark, sf_dir).select("sv_id", F.array("api_ref").alias("api_contract_refs"))
    return R.apply_routes(profiles, traces, symbols).select("sv_id", F.array_join("api_contract_refs", ",").alias("refs"))


@query("R5b_observed_types", f"WITH d AS {_DISPATCH}, o AS (SELECT DISTINCT 'self.f' || (sv_id % 40) AS expression, kind AS t FROM {B.SYMBOLS}) SELECT caller, expression, coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT t FROM o WHERE o.expression = d.expression UNION SELECT d.method)), d.method) AS types, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.expression = d.expression) THEN greatest(0.85::DOUBLE, confidence) ELSE confidence END AS confidence FROM d")
def observed_types(spark, sf_dir):
    edges = _edges(spark, sf_dir).select("caller", "expression", F.array("method").alias("types"), "confidence")
    return R.apply_types(edges, _detailed(spark, sf_dir)[0]).select("caller", "expression", F.array_join("types", ",").alias("types"), "confidence")


@query("R5c_framework_events", f"WITH {_OWNER} SELECT CASE WHEN sv_id % 2 = 0 THEN 'middleware_mount' ELSE 'route_bind' END AS event_type, ow.id AS first_id, CASE WHEN sv_id % 2 = 0 THEN ow.id END AS second_id, CASE WHEN sv_id % 2 = 0 THEN 1.0::DOUBLE END AS strength FROM {B.SYMBOLS} s JOIN ow ON ow.stable_key = s.stable_key")
def framework_events(spark, sf_dir):
    traces, symbols = _detailed(spark, sf_dir)
    return R.framework_events(traces, symbols).select("event_type", "first_id", "second_id", "strength")


@query("R6_evidence_report", f"WITH o AS {_PAIRS}, r AS (SELECT caller AS sv_id, 1 AS o, source, \"at\" FROM o UNION ALL SELECT callee, 0, source, \"at\" FROM o) SELECT sv_id, sum(o)::BIGINT AS as_caller, sum(1 - o)::BIGINT AS as_callee, count(*) AS observations, count(DISTINCT source) AS sources, min(\"at\") AS first_observed, max(\"at\") AS last_observed, round(least(0.3, 0.15 * least(3, count(DISTINCT source)))::DOUBLE, 6) AS confidence_boost FROM r GROUP BY sv_id")
def evidence_report(spark, sf_dir):
    return R.evidence_report(_pairs(spark, sf_dir)).withColumn("confidence_boost", F.round("confidence_boost", 6))
