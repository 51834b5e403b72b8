"""Graph operators and blast radius."""

from pyspark.sql import functions as F

from weftgraph.operators import graph as G
from weftgraph.operators import impact as I
from weftgraph.operators import profiles as P
from weftgraph.functions import ladders as L
from weftgraph.plans import bindings as B
from weftgraph.plans.registry import query
from weftgraph.sources.tables import table

E = B.EDGES


@query(
    "G1_relation_resolution",
    """WITH f AS (SELECT c_name AS source_key, CASE c_custkey % 3 WHEN 0 THEN 'Brand#' || (c_custkey % 30) WHEN 1 THEN 'Supplier#' || lpad(CAST(c_custkey % 120 AS VARCHAR), 9, '0') ELSE 'nothing' END AS target FROM customer),
r AS (SELECT *, (SELECT min(c_custkey) FROM customer WHERE c_name = source_key AND c_custkey % 10 <> 0) AS src, coalesce((SELECT min(p_partkey) FROM part WHERE p_brand = target), (SELECT min(s_suppkey) FROM supplier WHERE s_name = target)) AS dst FROM f)
SELECT source_key, target, src, dst, CASE WHEN src IS NULL THEN 'unknown_source' WHEN dst IS NULL THEN 'unknown_target' ELSE 'resolved' END AS status, CASE WHEN src IS NOT NULL AND dst IS NOT NULL THEN 0.9::DOUBLE END AS confidence, CASE WHEN src IS NOT NULL AND dst IS NOT NULL THEN 1.0::DOUBLE END AS strength FROM r""",
)
def relation_resolution(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    target = F.when(k % 3 == 0, F.concat(F.lit("Brand#"), k % 30)).when(k % 3 == 1, F.concat(F.lit("Supplier#"), F.lpad((k % 120).cast("string"), 9, "0"))).otherwise("nothing")
    found = customer.select(F.col("c_name").alias("source_key"), target.alias("target"))
    sources = customer.where("c_custkey % 10 <> 0").select(F.col("c_name").alias("stable_key"), F.col("c_custkey").alias("id"))
    return G.resolve_relations(found, sources, [(table(spark, sf_dir, "part"), "p_brand", "p_partkey"), (table(spark, sf_dir, "supplier"), "s_name", "s_suppkey")])


@query("G2_callers", f"SELECT src, dst, relation_type, confidence FROM {E} WHERE dst = 17 AND relation_type IN ('calls', 'references') ORDER BY confidence DESC, src, dst, relation_type LIMIT 1000")
def callers(spark, sf_dir):
    return G.relations_of(B.edges(spark, sf_dir), 17, "in")


BFS = f"""WITH RECURSIVE e AS {E}, b AS (SELECT {{0}} AS node, 0 AS depth UNION SELECT CASE WHEN e.src = b.node THEN e.dst ELSE e.src END, depth + 1 FROM b JOIN e ON {{1}} WHERE depth < {{2}}),
n AS (SELECT node, min(depth) AS depth FROM b GROUP BY node)"""


@query("G3_neighbourhood", f"{BFS.format('5::BIGINT', 'e.src = b.node OR e.dst = b.node', 2)} SELECT node, depth::INT AS depth, (SELECT count(*) FROM n) > 100 AS truncated FROM n ORDER BY depth, node LIMIT 100")
def neighbourhood(spark, sf_dir):
    return G.neighbourhood(B.edges(spark, sf_dir), 5, "both", 2)


@query("G3_neighbourhood_out", f"{BFS.format('5::BIGINT', 'e.src = b.node', 5)} SELECT node, depth::INT AS depth, false AS truncated FROM n ORDER BY depth, node LIMIT 5000")
def neighbourhood_out(spark, sf_dir):
    return G.neighbourhood(B.edges(spark, sf_dir), 5, "out", 9, max_nodes=5000)


def _tree(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    level = F.when(F.col("p_size") % 10 == 0, 3).when(F.col("p_size") % 10 == 1, 2).when(F.col("p_size") % 10 == 2, 1).otherwise(0)
    profiles = part.select(F.col("p_partkey").alias("node"), level.alias("level"))
    calls = part.where("p_partkey > 0").select(F.col("p_partkey").alias("dst"), F.expr("p_partkey DIV 2").alias("src"))
    return profiles, calls


_TREE = """n AS (SELECT p_partkey AS node, CASE p_size % 10 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS level FROM part)"""


@query(
    "G5_purity_propagation",
    f"""WITH RECURSIVE {_TREE}, r AS (SELECT node AS top, node, level FROM n UNION ALL SELECT r.top // 2, r.node, r.level FROM r WHERE top > 1)
SELECT n.node, n.level::INT AS level, (CASE WHEN n.node = 0 THEN (SELECT max(level) FROM n) ELSE m END)::INT AS final FROM n LEFT JOIN (SELECT top, max(level) AS m FROM r GROUP BY top) ON top = n.node""",
)
def purity_propagation(spark, sf_dir):
    """Part k calls parts 2k and 2k + 1; part 0 calls itself and part 1, so it is a cycle's caller."""
    profiles, calls = _tree(spark, sf_dir)
    loop = spark.range(1).select(F.lit(0).cast("long").alias("dst"), F.lit(0).cast("long").alias("src"))
    return G.propagate_levels(profiles, calls.unionByName(loop))


@query(
    "G6_effect_propagation",
    """WITH RECURSIVE f AS (SELECT p_partkey AS node, 'reads' AS kind, p_brand AS descriptor FROM part WHERE p_size % 3 = 0 UNION SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'logs' ELSE 'writes' END, p_type FROM part),
t AS (SELECT node, node AS origin, kind, descriptor, 0 AS hops FROM f UNION ALL SELECT t.node // 2, origin, kind, descriptor, hops + 1 FROM t WHERE t.node > 1 AND hops < 4 AND kind <> 'logs'),
b AS (SELECT node, kind, descriptor, min(hops) AS hops FROM t GROUP BY 1, 2, 3)
SELECT b.node, b.kind, b.descriptor, CASE WHEN b.hops = 0 THEN 'direct' ELSE 'transitive' END AS provenance, CASE WHEN b.hops > 0 THEN min(origin) END AS origin, b.hops::INT AS hops
FROM b JOIN t ON t.node = b.node AND t.kind = b.kind AND t.descriptor = b.descriptor AND t.hops = b.hops WHERE b.node > 0 GROUP BY b.node, b.kind, b.descriptor, b.hops""",
)
def effect_propagation(spark, sf_dir):
    part = table(spark, sf_dir, "part").where("p_partkey > 0")
    reads = part.where("p_size % 3 = 0").select(F.col("p_partkey").alias("node"), F.lit("reads").alias("kind"), F.col("p_brand").alias("descriptor"))
    rest = part.select(F.col("p_partkey").alias("node"), F.when(F.col("p_size") % 2 == 0, "logs").otherwise("writes").alias("kind"), F.col("p_type").alias("descriptor"))
    return G.propagate_effects(reads.union(rest), _tree(spark, sf_dir)[1].where("src > 0"))


OPEN = f"SELECT src, dst FROM {B.INFERRED} WHERE confidence >= 0.4 AND review_state <> 'rejected' AND valid_to IS NULL AND relation_type <> 'co_changed_with'"


@query("G7_components", f"WITH RECURSIVE e AS ({OPEN}), u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r AS (SELECT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node) SELECT node, min(root) AS component FROM r GROUP BY node")
def components(spark, sf_dir):
    return G.components(B.inferred(spark, sf_dir).where("confidence >= 0.4 AND review_state <> 'rejected' AND valid_to IS NULL AND relation_type <> 'co_changed_with'"))


def _hierarchy(spark, sf_dir):
    part = table(spark, sf_dir, "part").where("p_partkey > 0")
    return part.select(F.col("p_partkey").alias("class"), F.expr("p_partkey DIV 3").alias("parent"), F.lit(0).alias("position"))


@query("G9_linearisation", "WITH RECURSIVE r AS (SELECT p_partkey AS class, p_partkey AS a, 0 AS d FROM part UNION ALL SELECT class, a // 3, d + 1 FROM r WHERE a > 0) SELECT class, string_agg(CAST(a AS VARCHAR), '>' ORDER BY d) AS mro FROM r GROUP BY class")
def linearisation(spark, sf_dir):
    """Single inheritance here, which SQL can follow; tests cover diamonds and cycles."""
    hierarchy = _hierarchy(spark, sf_dir)
    return G.linearise(hierarchy, hierarchy.select("class")).select("class", F.array_join(F.transform("mro", lambda c: c.cast("string")), ">").alias("mro"))


@query(
    "G10_override_chain",
    "WITH RECURSIVE r AS (SELECT p_partkey AS class, p_partkey AS a, 0 AS d FROM part UNION ALL SELECT class, a // 3, d + 1 FROM r WHERE a > 0) SELECT class, p_type AS method, string_agg(CAST(a AS VARCHAR), '>' ORDER BY d) AS owners FROM r JOIN part ON a = p_partkey GROUP BY class, p_type",
)
def override_chain(spark, sf_dir):
    hierarchy = _hierarchy(spark, sf_dir)
    methods = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("class"), F.col("p_type").alias("method"))
    chain = G.override_chain(G.linearise(hierarchy, hierarchy.select("class")), methods)
    return chain.withColumn("owners", F.array_join(F.transform("owners", lambda c: c.cast("string")), ">"))


_LINEAGE = "SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS previous FROM conversations"


@query("G11_lineage_chain", f"WITH RECURSIVE t AS ({_LINEAGE}), c AS (SELECT id AS start, id, previous, 0 AS depth FROM t UNION ALL SELECT c.start, t.id, t.previous, depth + 1 FROM c JOIN t ON c.previous = t.id WHERE depth < 99) SELECT start, id, depth FROM c")
def lineage_chain(spark, sf_dir):
    lineage = table(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn AS id", "CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS previous")
    return G.lineage_chains(lineage)


@query(
    "G12_member_relations",
    f"""WITH c AS (SELECT 100000 + n_nationkey AS class_id, 'Brand' || n_nationkey AS key FROM nation), m AS (SELECT p_partkey AS id, replace(p_brand, '#', '') || '.' || p_name AS key FROM part),
o AS (SELECT class_id, id FROM c JOIN m ON starts_with(m.key, c.key || '.')), t AS (SELECT DISTINCT class_id, src, dst, relation_type, confidence FROM o JOIN {E} e ON e.src = o.id OR e.dst = o.id)
SELECT class_id, src, dst, relation_type, confidence FROM t""",
)
def member_relations(spark, sf_dir):
    """Classes are no parts, whatever the parts' number: they are numbered below zero until they are shown."""
    classes = table(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("id"), F.concat(F.lit("Brand"), F.col("n_nationkey")).alias("key"))
    members = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("."), "p_name").alias("key"))
    return G.member_relations(B.edges(spark, sf_dir), classes, members).withColumn("class_id", 99999 - F.col("class_id"))


@query(
    "G13_explain_pair",
    f"""WITH p AS (SELECT DISTINCT src AS a, dst AS b FROM {E}), x AS (SELECT a, b, (SELECT count(*) FROM {E} e WHERE e.src = a AND e.dst = b) AS forward, (SELECT count(*) FROM {E} e WHERE e.src = b AND e.dst = a) AS backward,
 (SELECT count(*) FROM {B.INFERRED} i WHERE (i.src = a AND i.dst = b) OR (i.src = b AND i.dst = a)) AS inferred FROM p)
SELECT *, CASE WHEN forward + backward + inferred = 0 THEN 'no relation' ELSE (forward + backward) || ' structural, ' || inferred || ' inferred' END AS summary FROM x""",
)
def explain_pair(spark, sf_dir):
    edges = B.edges(spark, sf_dir)
    return G.explain_pair(edges, B.inferred(spark, sf_dir), edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())


@query(
    "G14_tests_of_symbol",
    f"""WITH a AS {B.ARTIFACTS}, x AS (SELECT unnest(related) AS symbol, artifact, 0 AS turn FROM a UNION ALL SELECT dst, artifact, 1 FROM {E} e JOIN a ON e.src = a.test WHERE relation_type = 'references')
SELECT symbol, artifact, CASE WHEN min(turn) = 0 THEN 'related' ELSE 'references' END AS path FROM x GROUP BY symbol, artifact""",
)
def tests_of_symbol(spark, sf_dir):
    return G.tests_of(B.artifacts(spark, sf_dir), B.edges(spark, sf_dir))


@query("G15_tests_by_symbol", f"SELECT symbol, string_agg(CAST(artifact AS VARCHAR), ',' ORDER BY artifact) AS tests FROM (SELECT DISTINCT unnest(related) AS symbol, artifact FROM {B.ARTIFACTS}) GROUP BY symbol")
def tests_by_symbol(spark, sf_dir):
    return G.tests_by_symbol(B.artifacts(spark, sf_dir)).withColumn("tests", F.array_join(F.transform("tests", lambda t: t.cast("string")), ","))


_TEST_SYMBOLS = "SELECT p_partkey AS id, replace(p_name, ' ', '_') AS name, CASE p_size % 10 WHEN 0 THEN 'a.test.ts' WHEN 1 THEN '__tests__/b.py' ELSE 'src/c.ts' END AS path, 'expect(' || replace(p_name, ' ', '_') || ', of)' AS body FROM part"


@query(
    "G16_inferred_tests",
    f"""WITH s AS ({_TEST_SYMBOLS}), t AS (SELECT * FROM s WHERE path <> 'src/c.ts'), n AS (SELECT name, max(id) AS symbol FROM s WHERE path = 'src/c.ts' GROUP BY name),
f AS (SELECT e.src AS test, e.dst AS symbol FROM {E} e WHERE e.src IN (SELECT id FROM t) AND e.dst NOT IN (SELECT id FROM t) UNION SELECT t.id, n.symbol FROM t JOIN n ON n.name = t.name)
SELECT test, CASE path WHEN 'a.test.ts' THEN 'jest' ELSE 'pytest' END AS framework, symbol FROM f JOIN t ON t.id = f.test""",
)
def inferred_tests(spark, sf_dir):
    symbols = spark.sql(_TEST_SYMBOLS.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    return G.infer_tests(symbols, B.edges(spark, sf_dir))


# Blast radius. A search: targets are all parts whose key is divisible by 50.

TARGETS = "(SELECT p_partkey AS node FROM part WHERE p_partkey % 50 = 0)"
PURITY = """CASE WHEN list_has_any(h, ['network_call', 'transaction', 'acquires_lock', 'concurrency']) THEN 'side_effecting' WHEN list_has_any(h, ['db_write', 'state_mutation', 'file_io', 'cache_write']) THEN 'read_write'
  WHEN list_has_any(h, ['db_read', 'cache_op', 'auth_check']) THEN 'read_only' ELSE 'pure' END"""
PURITIES = f"(SELECT sv_id, {PURITY} AS purity_class FROM (SELECT sv_id, list(DISTINCT hint_type) AS h FROM {B.HINTS} GROUP BY sv_id))"


def _targets(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("node"))


def _purities(spark, sf_dir):
    return B.hints(spark, sf_dir).groupBy("sv_id").agg(L.purity_class(F.collect_set("hint_type")).alias("purity_class"))


STRUCTURAL = f"""e AS {E}, r AS (SELECT node, 0 AS depth FROM {TARGETS} UNION SELECT e.src, depth + 1 FROM r JOIN e ON e.dst = r.node WHERE depth < 3), n AS (SELECT node, min(depth) AS depth FROM r GROUP BY node),
m AS (SELECT n.node, n.depth, max((e.confidence, e.relation_type)) AS best FROM n JOIN e ON e.src = n.node JOIN n p ON p.node = e.dst AND p.depth = n.depth - 1 WHERE n.depth > 0 GROUP BY 1, 2)"""


@query(
    "B1_structural",
    f"""WITH RECURSIVE {STRUCTURAL} SELECT node AS symbol, 'structural' AS impact_type, round(greatest(0.05::DOUBLE, best[1] * (1 - (depth - 1) * 0.2::DOUBLE)), 6) AS confidence, CASE depth WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
  depth::INT AS depth, best[2] AS relation_type, CASE depth WHEN 1 THEN 'rerun_test' ELSE 'manual_review' END AS action FROM m""",
)
def structural(spark, sf_dir):
    return I.structural(B.edges(spark, sf_dir), _targets(spark, sf_dir), 3, width=None).withColumn("confidence", F.round("confidence", 6))


BEHAVIORAL = f"SELECT DISTINCT src AS symbol, 'behavioral' AS impact_type, 0.8::DOUBLE AS confidence, 'high' AS severity FROM {E} WHERE relation_type IN ('calls', 'references') AND dst IN (SELECT node FROM {TARGETS}) AND src IN (SELECT sv_id FROM {PURITIES} WHERE purity_class IN ('pure', 'read_only'))"


@query("B2_behavioral", BEHAVIORAL)
def behavioral(spark, sf_dir):
    return I.behavioral(B.edges(spark, sf_dir), _purities(spark, sf_dir), _targets(spark, sf_dir))


CONTRACT = f"SELECT sv_id AS symbol, 'contract' AS impact_type, strength AS confidence, CASE WHEN strength >= 0.9 THEN 'critical' WHEN strength >= 0.7 THEN 'high' ELSE 'medium' END AS severity, expression FROM {B.INVARIANTS} WHERE sv_id IN (SELECT node FROM {TARGETS})"


@query("B3_contract", CONTRACT)
def contract(spark, sf_dir):
    return I.contract(B.invariants(spark, sf_dir), _targets(spark, sf_dir))


def ends_sql(where: str, impact: str, severity: str) -> str:
    return f"""SELECT symbol, '{impact}' AS impact_type, max(confidence) AS confidence, {severity.replace('confidence', 'max(confidence)')} AS severity FROM (
  SELECT dst AS symbol, confidence FROM {B.INFERRED} WHERE src IN (SELECT node FROM {TARGETS}) AND {where} UNION ALL SELECT src, confidence FROM {B.INFERRED} WHERE dst IN (SELECT node FROM {TARGETS}) AND {where})
WHERE symbol NOT IN (SELECT node FROM {TARGETS}) GROUP BY symbol"""


HOMOLOG = ends_sql("relation_type <> 'co_changed_with' AND confidence >= 0.6 AND review_state <> 'rejected' AND valid_to IS NULL", "homolog", "CASE WHEN confidence >= 0.85 THEN 'high' ELSE 'medium' END")
HISTORICAL = ends_sql("relation_type = 'co_changed_with' AND confidence >= 0.5 AND valid_to IS NULL", "historical", "CASE WHEN confidence >= 0.8 THEN 'medium' ELSE 'low' END")


@query("B4_homolog", HOMOLOG)
def homolog(spark, sf_dir):
    return I.homolog(B.inferred(spark, sf_dir), _targets(spark, sf_dir))


@query("B5_historical", HISTORICAL)
def historical(spark, sf_dir):
    return I.historical(B.inferred(spark, sf_dir), _targets(spark, sf_dir))


@query(
    "B6_report",
    f"""WITH RECURSIVE {STRUCTURAL}, u AS (SELECT node AS symbol, 'structural' AS t, CASE depth WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity FROM m WHERE depth <= 2 UNION ALL SELECT symbol, impact_type, severity FROM ({BEHAVIORAL})
  UNION ALL SELECT symbol, impact_type, severity FROM ({CONTRACT}) UNION ALL SELECT symbol, impact_type, severity FROM ({HOMOLOG}) UNION ALL SELECT symbol, impact_type, severity FROM ({HISTORICAL})),
a AS (SELECT count(*) FILTER (WHERE t = 'structural') AS structural, count(*) FILTER (WHERE t = 'behavioral') AS behavioral, count(*) FILTER (WHERE t = 'contract') AS contract, count(*) FILTER (WHERE t = 'homolog') AS homolog, count(*) FILTER (WHERE t = 'historical') AS historical,
  count(DISTINCT symbol) AS total, count(*) FILTER (WHERE severity = 'critical' AND t IN ('structural', 'behavioral', 'contract')) AS critical, count(*) FILTER (WHERE severity = 'high' AND t IN ('structural', 'behavioral', 'contract')) AS high FROM u)
SELECT *, CASE WHEN critical > 0 OR high >= 5 OR total >= 20 THEN 'strict' WHEN high >= 2 OR total >= 8 THEN 'standard' ELSE 'quick' END AS scope FROM a""",
)
def report(spark, sf_dir):
    parts = I.blast_radius(B.edges(spark, sf_dir), _purities(spark, sf_dir), B.invariants(spark, sf_dir), B.inferred(spark, sf_dir), _targets(spark, sf_dir), 2, most=None, width=None)
    return I.report(parts)
