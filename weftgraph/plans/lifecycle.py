"""Context assembly, differences, plans, transactions, retention and overviews."""

from pyspark.sql import functions as F

from weftgraph.operators import context as C
from weftgraph.operators import diff as X
from weftgraph.operators import impact as I
from weftgraph.operators import lifecycle as L
from weftgraph.operators import search as S
from weftgraph.plans import bindings as B
from weftgraph.plans.graph import _purities
from weftgraph.plans.profiles import PROFILES, _profiles
from weftgraph.plans.registry import query
from weftgraph.plans.scalars import trgm_sql
from weftgraph.sources.tables import table

# Capsules: a target is a source, its nodes its documents.

_CATEGORY = "CASE doc_id % 4 WHEN 0 THEN 'dependency' WHEN 1 THEN 'caller' WHEN 2 THEN 'test' ELSE 'effect' END"
_SIZES = "ceil(length(code) / 4.0)::BIGINT AS c, ceil(length(summary) / 4.0)::BIGINT AS s, ceil(length(summary) / 4.0)::BIGINT AS g, ceil(length(name) / 4.0)::BIGINT AS nm"


def _nodes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    code = F.when(F.col("doc_id") % 4 == 2, "").otherwise(F.col("text"))
    return d.select(
        F.col("source").alias("target"), F.col("doc_id").alias("node"), F.expr(_CATEGORY).alias("category"), (-F.col("doc_id")).alias("relevance"), F.concat(F.lit("doc"), "doc_id").alias("name"),
        code.alias("code"), F.substring_index(F.substring("text", 1, 60), "\n", 1).alias("summary"), F.lit(None).cast("string").alias("signature"),
    )


@query(
    "Z1_capsules",
    f"""WITH RECURSIVE n AS (SELECT source AS target, doc_id AS node, {_CATEGORY} AS category, CASE WHEN doc_id % 4 = 2 THEN '' ELSE text END AS code, split_part(substr(text, 1, 60), chr(10), 1) AS summary, 'doc' || doc_id AS name FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY target, category ORDER BY node) AS rk, CASE category WHEN 'dependency' THEN 0 WHEN 'caller' THEN 1 WHEN 'test' THEN 2 ELSE 7 END AS turn FROM n),
k AS (SELECT target, node, category, {_SIZES}, row_number() OVER (PARTITION BY target ORDER BY turn, rk) AS i FROM r WHERE rk <= CASE category WHEN 'dependency' THEN 20 WHEN 'caller' THEN 10 WHEN 'test' THEN 5 ELSE 1 END),
f AS (SELECT DISTINCT target, 0::BIGINT AS i, 25::BIGINT AS used, NULL::BIGINT AS node, NULL::VARCHAR AS resolution, 0::BIGINT AS tokens FROM n UNION ALL
 SELECT k.target, k.i, used + t, k.node, rs, t FROM (SELECT k.*, f.used, CASE WHEN c = 0 AND s > 0 AND f.used + s <= 12000 THEN 'contract_summary' WHEN c > 0 AND f.used + c + s <= 12000 THEN 'full_source' WHEN f.used + g <= 12000 THEN 'signature_only' WHEN s > 0 AND f.used + s <= 12000 THEN 'contract_summary' WHEN f.used + nm <= 12000 THEN 'name_only' ELSE 'omitted' END AS rs,
  CASE WHEN c = 0 AND s > 0 AND f.used + s <= 12000 THEN s WHEN c > 0 AND f.used + c + s <= 12000 THEN c + s WHEN f.used + g <= 12000 THEN g WHEN s > 0 AND f.used + s <= 12000 THEN s WHEN f.used + nm <= 12000 THEN nm ELSE 0 END AS t FROM f JOIN k ON k.target = f.target AND k.i = f.i + 1) k)
SELECT target, node, resolution, tokens FROM f WHERE i > 0""",
)
def capsules(spark, sf_dir):
    """Budgets never overflow: each node takes the richest form that still fits."""
    nodes = _nodes(spark, sf_dir)
    targets = nodes.select("target").distinct().select("target", F.repeat(F.lit("x"), F.lit(80)).alias("code"), F.repeat(F.lit("y"), F.lit(20)).alias("signature"))
    picked = C.capsules(targets, nodes, "standard")
    return picked.select("target", F.inline("picks")).select("target", "node", "resolution", "tokens")


@query(
    "Z2_smart_context",
    """WITH RECURSIVE t AS (SELECT source AS g, min(doc_id) AS symbol FROM documents GROUP BY source), d AS (SELECT source AS g, doc_id AS symbol, ceil(length(text) / 4.0)::BIGINT AS cost, CASE WHEN doc_id IN (SELECT symbol FROM t) THEN 99 ELSE doc_id % 4 END AS rank FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY rank DESC, symbol) AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
f AS (SELECT DISTINCT g, 0::BIGINT AS i, 0::BIGINT AS used, '' AS taken FROM k UNION ALL SELECT k.g, k.i, CASE WHEN used + cost <= 12000 THEN used + cost ELSE used END, CASE WHEN used + cost <= 12000 THEN taken || ',' || symbol ELSE taken END FROM f JOIN k ON k.g = f.g AND k.i = f.i + 1)
SELECT k.g AS "group", used, substr(taken, 2) AS taken, k.n FROM f JOIN k ON k.g = f.g AND k.i = f.i WHERE k.i = k.n""",
)
def smart_context(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("group"), F.col("doc_id").alias("symbol"), "text")
    targets = d.groupBy("group").agg(F.min("symbol").alias("symbol"))
    severity = F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), (F.col("symbol") % 4 + 1).cast("int"))
    out = C.smart_context(targets, d.select("group", "symbol", severity.alias("severity")), d.select("symbol", F.col("text").alias("source")))
    return out.withColumn("taken", F.array_join("taken", ","))


# Differences


def _versions(spark, sf_dir):
    full = _profiles(spark, sf_dir).join(B.contracts(spark, sf_dir), "sv_id").join(B.symbols(spark, sf_dir).select("sv_id", "signature"), "sv_id").withColumn("schema_refs", F.array("schema_ref"))
    return full.alias("a").join(full.alias("b"), F.col("b.sv_id") == F.col("a.sv_id") + 1)


def _cat(t, *cs):
    return "list_sort(list_concat(" + ", ".join(f"{t}.{c}" for c in cs) + "))" if len(cs) > 1 else f"{t}.{cs[0]}"


def _came(x, y):
    return f"len(list_filter({y}, lambda v: NOT list_contains({x}, v))) > 0"


_SE, _RA = ("network_calls", "db_writes", "file_io", "state_mutation_profile"), ("resource_touches", "network_calls", "file_io")
_PR = "CASE {0} WHEN 'pure' THEN 0 WHEN 'read_only' THEN 1 WHEN 'read_write' THEN 2 ELSE 3 END"
_RET = "CASE WHEN regexp_matches({0}.signature, '\\)\\s*:\\s*(.+)$') THEN trim(regexp_extract({0}.signature, '\\)\\s*:\\s*(.+)$', 1)) ELSE {0}.signature END"
_DIMENSIONS = [
    ("purity", "a.purity_class <> b.purity_class", f"CASE WHEN {_PR.format('b.purity_class')} > {_PR.format('a.purity_class')} THEN 'breaking' ELSE 'minor' END"),
    ("side_effects", f"{_cat('a', *_SE)} <> {_cat('b', *_SE)}", f"CASE WHEN {_came(_cat('a', *_SE), _cat('b', *_SE))} THEN 'major' ELSE 'minor' END"),
    ("return_type", f"{_RET.format('a')} <> {_RET.format('b')}", "'breaking'"),
    ("exception_behavior", "a.exception_profile <> b.exception_profile", f"CASE WHEN {_came('a.exception_profile', 'b.exception_profile')} THEN 'major' ELSE 'minor' END"),
    ("auth_behavior", "a.auth_operations <> b.auth_operations", f"CASE WHEN {_came('b.auth_operations', 'a.auth_operations')} THEN 'breaking' ELSE 'minor' END"),
    ("serialization", "a.serialization_contract <> b.serialization_contract", "'major'"),
    ("persistence", "a.db_reads <> b.db_reads OR a.db_writes <> b.db_writes", f"CASE WHEN {_came('a.db_writes', 'b.db_writes')} THEN 'major' ELSE 'minor' END"),
    ("validation", "a.validation_operations <> b.validation_operations", f"CASE WHEN {_came('b.validation_operations', 'a.validation_operations')} THEN 'major' ELSE 'minor' END"),
    ("resource_access", f"{_cat('a', *_RA)} <> {_cat('b', *_RA)}", f"CASE WHEN {_came(_cat('a', *_RA), _cat('b', *_RA))} THEN 'major' ELSE 'minor' END"),
]
_FULL = f"vv AS (SELECT p.*, c.* EXCLUDE (sv_id), signature FROM {PROFILES} p JOIN {B.CONTRACTS} c ON c.sv_id = p.sv_id JOIN {B.SYMBOLS} s ON s.sv_id = p.sv_id)"
_SEMANTIC = " UNION ALL ".join(f"SELECT a.sv_id, '{n}' AS dimension, {c} AS changed, CASE WHEN {c} THEN {v} ELSE 'none' END AS severity FROM vv a JOIN vv b ON b.sv_id = a.sv_id + 1" for n, c, v in _DIMENSIONS)


@query("Z3_semantic_diff", f"WITH {_FULL} {_SEMANTIC}")
def semantic_diff(spark, sf_dir):
    return _versions(spark, sf_dir).select(F.col("a.sv_id").alias("sv_id"), F.inline(X.semantic_changes("a", "b")))


@query("Z3_overall_severity", f"WITH {_FULL}, x AS ({_SEMANTIC}) SELECT sv_id, list_extract(['none', 'minor', 'major', 'breaking'], 1 + max(CASE severity WHEN 'none' THEN 0 WHEN 'minor' THEN 1 WHEN 'major' THEN 2 ELSE 3 END)) AS severity FROM x GROUP BY sv_id")
def overall_severity(spark, sf_dir):
    return _versions(spark, sf_dir).select(F.col("a.sv_id").alias("sv_id"), X.overall(X.semantic_changes("a", "b")).alias("severity"))


_CHANGES = [("input_contract", "CASE WHEN length(b.input_contract) < length(a.input_contract) THEN 'major' ELSE 'minor' END"), ("output_contract", "'breaking'"), ("error_contract", "'major'"), ("security_contract", "'breaking'"), ("serialization_contract", "'major'"), ("schema_ref", "'minor'")]


@query("Z4_contract_diff", f"WITH {_FULL} " + " UNION ALL ".join(f"SELECT a.sv_id, '{'schema_refs' if c == 'schema_ref' else c}' AS field, a.{c} <> b.{c} AS changed, CASE WHEN a.{c} <> b.{c} THEN {s} ELSE 'none' END AS severity FROM vv a JOIN vv b ON b.sv_id = a.sv_id + 1" for c, s in _CHANGES))
def contract_diff(spark, sf_dir):
    return _versions(spark, sf_dir).select(F.col("a.sv_id").alias("sv_id"), F.inline(X.contract_changes("a", "b")))


# Plans and transactions

_STATES = "list_extract(list_value('planned', 'prepared', 'patched', 'reindexed', 'validated', 'propagation_pending', 'committed', 'rolled_back', 'failed'), 1 + {0} % 9)"
_TXN = f"(SELECT o_orderkey AS txn, {_STATES.format('(o_orderkey * 7 + o_custkey)')} AS state, o_orderdate AS updated_at FROM orders)"
_NOW = "(SELECT max(o_orderdate) FROM orders)"


def _state(e):
    return F.element_at(F.array(*map(F.lit, L.TRANSITIONS)), (1 + e % 9).cast("int"))


def _transactions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("txn"), _state(F.col("o_orderkey") * 7 + F.col("o_custkey")).alias("state"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))


def _now(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.max("o_orderdate").cast("timestamp").alias("now"))


@query("Z5a_change_plan", f"WITH m AS (SELECT sv_id AS symbol FROM {B.SYMBOLS} WHERE {trgm_sql('name', "'redWidget'")} >= 0.3 OR name ILIKE '%redWidget%' ORDER BY {trgm_sql('name', "'redWidget'")} DESC, sv_id LIMIT 5), i AS (SELECT DISTINCT src FROM {B.EDGES} WHERE dst IN (SELECT symbol FROM m) AND src NOT IN (SELECT symbol FROM m)), c AS (SELECT count(*) AS symbols, avg(1 - (symbol % 5) / 10.0::DOUBLE) AS mean FROM m), n AS (SELECT count(*) AS impacts FROM i) SELECT 'redWidget' AS plan, symbols, impacts, CASE WHEN impacts >= 20 THEN 'strict' WHEN impacts >= 5 THEN 'standard' ELSE 'minimal' END AS capsule_mode, round(mean, 6) AS mean_confidence, CASE WHEN mean >= 0.8 THEN 'high' WHEN mean >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM c, n")
def change_plan(spark, sf_dir):
    matches = S.resolve_symbol(B.symbols(spark, sf_dir), "redWidget", "sv_id", 5).select(F.lit("redWidget").alias("plan"), F.col("sv_id").alias("symbol"))
    near = I.structural(B.edges(spark, sf_dir), matches.select(F.col("symbol").alias("node")), 1).select(F.lit("redWidget").alias("plan"), "symbol")
    sure = matches.select("symbol", (1 - (F.col("symbol") % 5) / 10).alias("confidence"))
    return C.change_plan(matches, near, sure).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("Z5b_missing_targets", "SELECT o_orderkey AS txn, o_custkey * 3 AS symbol FROM orders WHERE o_custkey * 3 NOT IN (SELECT p_partkey FROM part)")
def missing_targets(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("txn"), (F.col("o_custkey") * 3).alias("symbol"))
    return C.missing_targets(wanted, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"))).select("txn", "symbol")


@query("Z5c_append_patches", f"SELECT t.txn, state IN ('validated', 'propagation_pending') AND p.patches IS NOT NULL AS applied, CASE WHEN state IN ('validated', 'propagation_pending') AND p.patches IS NOT NULL THEN 'base,' || p.patches ELSE 'base' END AS patches FROM {_TXN} t LEFT JOIN (SELECT l_orderkey, string_agg(lpad(CAST(l_partkey AS VARCHAR), 9, '0'), ',' ORDER BY lpad(CAST(l_partkey AS VARCHAR), 9, '0')) AS patches FROM lineitem WHERE l_linenumber < 3 GROUP BY 1) p ON p.l_orderkey = t.txn")
def append_patches(spark, sf_dir):
    t = _transactions(spark, sf_dir).select("txn", "state", F.array(F.lit("base")).alias("patches"))
    patches = table(spark, sf_dir, "lineitem").where("l_linenumber < 3").select(F.col("l_orderkey").alias("txn"), F.lpad(F.col("l_partkey").cast("string"), 9, "0").alias("patch"))
    return C.append_patches(t, patches).select("txn", "applied", F.array_join("patches", ",").alias("patches"))


_HISTORY = f"(SELECT user_id, ts, event_id, {_STATES.format('event_id')} AS state FROM events)"
_LEGAL = "CASE p " + " ".join(f"WHEN '{k}' THEN state IN ({', '.join(repr(x) for x in v) or 'NULL'})" for k, v in L.TRANSITIONS.items()) + " END"


@query("Z6_illegal_moves", f"WITH h AS (SELECT user_id, state, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM {_HISTORY}) SELECT user_id, p AS from_state, state AS to_state, count(*) AS n FROM h WHERE p IS NOT NULL AND NOT coalesce({_LEGAL}, false) GROUP BY 1, 2, 3")
def illegal_moves(spark, sf_dir):
    h = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", _state(F.col("event_id")).alias("state"))
    return L.illegal_moves(h, "user_id", ["ts", "event_id"])


@query("Z7_invariant_check", f"SELECT p_partkey AS target, count(strength) AS checked, count(*) FILTER (WHERE p_size % 2 = 0 AND strength >= 0.9) AS violated, count(*) FILTER (WHERE p_size % 2 = 0 AND strength >= 0.9) = 0 AS passed FROM part LEFT JOIN (SELECT * FROM {B.INVARIANTS} WHERE strength >= 0.8) ON sv_id = p_partkey GROUP BY p_partkey")
def invariant_check(spark, sf_dir):
    targets = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target"), (F.col("p_size") % 2 == 0).alias("changed"))
    return L.invariant_check(targets, B.invariants(spark, sf_dir).select("sv_id", "strength"))


_LEVELS = "(SELECT o_orderkey AS txn, l AS level, (o_orderkey * 7 + l * 3) % 5 > 0 AS passed FROM orders, (SELECT unnest(range(1, 7)) AS l))"


@query("Z7_validation_levels", f"WITH v AS {_LEVELS}, b AS (SELECT txn, min(level) FILTER (WHERE NOT passed AND level <> 5) AS stop FROM v GROUP BY txn) SELECT txn, stop IS NULL AS overall_passed, coalesce(stop, 6)::BIGINT AS levels_run FROM b")
def validation_levels(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("txn"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("level"))
    return L.validation_levels(rows.withColumn("passed", (F.col("txn") * 7 + F.col("level") * 3) % 5 > 0), "standard")


# Retention: snapshots are a customer's orders.

_SNAPS = "(SELECT o_custkey AS repo, o_orderkey AS snapshot, o_orderdate AS created_at, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 400 DAY END AS retained_until, CASE WHEN o_orderstatus = 'P' THEN 'indexing' ELSE 'complete' END AS index_status FROM orders)"


def _snapshots(spark, sf_dir):
    at = F.col("o_orderdate").cast("timestamp")
    until = F.when(F.col("o_orderkey") % 4 == 0, at + F.expr("INTERVAL 400 DAYS"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("snapshot"), at.alias("created_at"), until.alias("retained_until"), F.when(F.col("o_orderstatus") == "P", "indexing").otherwise("complete").alias("index_status"))


@query("Z9a_expired", f"SELECT repo, snapshot FROM {_SNAPS} s WHERE coalesce(retained_until, created_at + INTERVAL 90 DAY) < {_NOW} AND snapshot <> (SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) FROM orders WHERE o_custkey = s.repo)")
def expired(spark, sf_dir):
    return L.expired(_snapshots(spark, sf_dir), _now(spark, sf_dir))


@query("Z9b_over_cap", f"SELECT repo, snapshot, rn::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY created_at DESC, snapshot DESC) AS rn FROM {_SNAPS}) WHERE rn > 8")
def over_cap(spark, sf_dir):
    return L.over_cap(_snapshots(spark, sf_dir), 8)


@query("Z9c_stuck", f"SELECT snapshot, CASE WHEN index_status = 'indexing' AND created_at < {_NOW} - INTERVAL 180 MINUTE THEN 'failed' ELSE index_status END AS index_status FROM {_SNAPS}")
def stuck(spark, sf_dir):
    return L.stuck(_snapshots(spark, sf_dir), _now(spark, sf_dir)).select("snapshot", "index_status")


_STALE = f"SELECT txn, state, updated_at, date_diff('second', updated_at, {_NOW})::BIGINT // 60 AS age_minutes FROM {_TXN} WHERE state NOT IN ('committed', 'rolled_back', 'failed') AND updated_at < {_NOW} - INTERVAL 60 MINUTE"


@query("Z9d_fail_stale", f"SELECT 'failed' AS state, count(*) AS n FROM ({_STALE})")
def fail_stale(spark, sf_dir):
    return L.fail_stale(_transactions(spark, sf_dir), _now(spark, sf_dir))


@query("Z9e_orphan_evidence", f"SELECT snapshot AS bundle FROM {_SNAPS} WHERE created_at < {_NOW} - INTERVAL 1 HOUR AND snapshot NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)")
def orphan_evidence(spark, sf_dir):
    bundles = _snapshots(spark, sf_dir).select(F.col("snapshot").alias("bundle"), F.col("created_at").alias("generated_at"))
    return L.orphan_evidence(bundles, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bundle")), _now(spark, sf_dir))


@query("Z9e_orphan_backups", f"SELECT l_orderkey AS txn, l_linenumber AS path FROM lineitem WHERE l_orderkey IN (SELECT txn FROM {_TXN} WHERE state IN ('committed', 'rolled_back', 'failed') AND updated_at < {_NOW} - INTERVAL 24 HOUR)")
def orphan_backups(spark, sf_dir):
    backups = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("txn"), F.col("l_linenumber").alias("path"))
    return L.orphan_backups(backups, _transactions(spark, sf_dir), _now(spark, sf_dir))


@query("Z9f_policy_run")
def policy_run(spark, sf_dir):
    """The five steps in their order, each with its own error."""
    snaps, txns, now = _snapshots(spark, sf_dir), _transactions(spark, sf_dir), _now(spark, sf_dir)
    steps = {
        "stuck": lambda: L.stuck(snaps, now).where("index_status = 'failed'"), "stale": lambda: L.stale(txns, now), "expiry": lambda: L.expired(snaps, now),
        "cap": lambda: L.over_cap(snaps), "orphans": lambda: L.orphan_backups(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("txn")), txns, now),
    }
    return spark.createDataFrame(L.run_policy(steps), "step string, rows long, error string")


@query("Z9g_retention_stats", f"SELECT (SELECT count(*) FROM {_SNAPS}) AS total, (SELECT count(*) FROM {_SNAPS} WHERE retained_until < {_NOW}) AS expired, (SELECT min(created_at) FROM {_SNAPS}) AS oldest, (SELECT count(*) FROM ({_STALE})) AS stale")
def retention_stats(spark, sf_dir):
    return L.retention_stats(_snapshots(spark, sf_dir), _transactions(spark, sf_dir), _now(spark, sf_dir)).withColumn("oldest", F.col("oldest").cast("timestamp_ntz"))


@query("Z9h_stale_list", f"SELECT txn, state, age_minutes FROM ({_STALE}) ORDER BY updated_at, txn LIMIT 20")
def stale_list(spark, sf_dir):
    return L.stale(_transactions(spark, sf_dir), _now(spark, sf_dir), limit=20).select("txn", "state", "age_minutes")


@query("Z9i_recovery_scan", f"SELECT s.txn, state, age_minutes, coalesce(n, 0) AS backups FROM ({_STALE}) s LEFT JOIN (SELECT l_orderkey AS txn, count(*) AS n FROM lineitem GROUP BY 1) b ON b.txn = s.txn")
def recovery_scan(spark, sf_dir):
    return L.recovery_scan(_transactions(spark, sf_dir), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("txn")), _now(spark, sf_dir))


_OVER = f"(SELECT s.*, coalesce(purity_class, 'pure') AS purity, regexp_replace(file_path, '/[^/]*$', '') AS directory, 'typescript' AS language FROM {B.SYMBOLS} s LEFT JOIN {PROFILES} p ON p.sv_id = s.sv_id)"


@query("Z10_overview", f"WITH o AS {_OVER} SELECT 'language' AS metric, language AS value, count(*) AS n FROM o GROUP BY 2 UNION ALL SELECT 'kind', kind, count(*) FROM o GROUP BY 2 UNION ALL SELECT 'purity', purity, count(*) FROM o GROUP BY 2 UNION ALL (SELECT 'directory', directory, count(*) AS n FROM o GROUP BY 2 ORDER BY n DESC, directory LIMIT 20)")
def overview(spark, sf_dir):
    from weftgraph.functions import text as T

    s = B.symbols(spark, sf_dir).join(_purities(spark, sf_dir), "sv_id", "left")
    return L.overview(s.select("kind", F.coalesce("purity_class", F.lit("pure")).alias("purity"), T.dirname(F.col("file_path")).alias("directory"), F.lit("typescript").alias("language")))


@query("Z11_snapshot_stats", f"SELECT c_custkey AS snapshot, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS files, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND o_totalprice > 400000) AS versions, (SELECT count(*) FROM supplier WHERE s_suppkey = c_custkey) AS relations, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') + (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND o_totalprice > 400000) + (SELECT count(*) FROM supplier WHERE s_suppkey = c_custkey) = 0 AND c_nationkey > 3 AS orphaned FROM customer")
def snapshot_stats(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("snapshot", F.col("o_custkey"))
    snaps = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("snapshot"), F.when(F.col("c_nationkey") > 3, "complete").otherwise("failed").alias("index_status"))
    return L.snapshot_stats(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O' AND o_totalprice > 400000"), table(spark, sf_dir, "supplier").withColumn("snapshot", F.col("s_suppkey")), snaps)


_RISK = "CASE hint_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.RISK.items()) + " END"


@query("Z12_risk_hints", f"SELECT sv_id, string_agg(hint, ',' ORDER BY r DESC, hint) AS hints FROM (SELECT *, row_number() OVER (PARTITION BY sv_id ORDER BY r DESC, hint) AS rn FROM (SELECT DISTINCT sv_id, hint_type || ':' || detail AS hint, {_RISK} AS r FROM {B.HINTS}) WHERE r IS NOT NULL) WHERE rn <= 10 GROUP BY sv_id")
def risk_hints(spark, sf_dir):
    return L.risk_hints(B.hints(spark, sf_dir)).withColumn("hints", F.array_join("hints", ","))


_EVAL = "(SELECT lang AS category, toxic = 1 AS expected, length(text) % 3 = 0 AS predicted FROM labels JOIN documents USING (doc_id))"
_CONF = "count(*) FILTER (WHERE expected AND predicted) AS tp, count(*) FILTER (WHERE NOT expected AND predicted) AS fp, count(*) FILTER (WHERE expected AND NOT predicted) AS fn"


@query("Z13_precision_recall", f"WITH e AS {_EVAL}, c AS (SELECT category, {_CONF} FROM e GROUP BY 1 UNION ALL SELECT 'total', {_CONF} FROM e), p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END::DOUBLE AS p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END::DOUBLE AS r FROM c) SELECT category, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM p")
def precision_recall(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.col("lang").alias("category"), (F.col("toxic") == 1).alias("expected"), (F.length("text") % 3 == 0).alias("predicted"))
    return L.precision_recall(rows).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})
