"""Homologs, lineage and families."""

from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.operators import families as K
from weftgraph.operators import homolog as H
from weftgraph.operators import lineage as N
from weftgraph.operators import profiles as P
from weftgraph.operators import vectors as V
from weftgraph.plans import bindings as B
from weftgraph.plans.graph import OPEN, PURITIES
from weftgraph.plans.profiles import PROFILES, _profiles
from weftgraph.plans.registry import query
from weftgraph.plans.scalars import body_sql, jaccard_sql, name_sim_sql, sig_sim_sql, split_sql, tokens_sql, trigrams_sql
from weftgraph.plans.vectors import ESTIMATE, signature_sql
from weftgraph.sources.tables import materialise, table

HASHED = f"""(SELECT s.*, coalesce(p.purity_class, 'pure') AS purity_class, md5(name || kind) AS body_hash, md5(name) AS ast_hash, md5(regexp_replace(name, '[0-9]+$', '') || CAST(line_span % 3 AS VARCHAR)) AS normalized_ast_hash
  FROM {B.SYMBOLS} s LEFT JOIN {PURITIES} p ON p.sv_id = s.sv_id)"""


def hashed(spark, sf_dir, profiles=None):
    """Symbols with hashes and purity, written, as every bucket reads them."""
    purity = (_profiles(spark, sf_dir) if profiles is None else profiles).select("sv_id", "purity_class")
    return materialise(_hashes(spark, sf_dir).join(purity, "sv_id", "left").withColumn("purity_class", F.coalesce("purity_class", F.lit("pure"))), "symbols")


def _hashes(spark, sf_dir):
    return B.symbols(spark, sf_dir).withColumns({
        "body_hash": F.md5(F.concat("name", "kind")), "ast_hash": F.md5("name"),
        "normalized_ast_hash": F.md5(F.concat(F.regexp_replace("name", "[0-9]+$", ""), (F.col("line_span") % 3).cast("string"))),
    })


def _bucket(keys: str, cap: int) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split())
    return f"SELECT target, candidate FROM (SELECT a.sv_id AS target, b.sv_id AS candidate, row_number() OVER (PARTITION BY a.sv_id ORDER BY b.sv_id) AS rn FROM h a JOIN h b ON {on} AND a.sv_id <> b.sv_id WHERE a.sv_id % 50 = 0) WHERE rn <= {cap}"


_GRAM = f"""SELECT target, candidate FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY sim DESC, candidate) AS rn FROM (SELECT a.sv_id AS target, b.sv_id AS candidate, {jaccard_sql('a.g', 'b.g')} AS sim FROM (SELECT sv_id, {trigrams_sql('name')} AS g FROM h WHERE sv_id % 50 = 0) a JOIN (SELECT sv_id, {trigrams_sql('name')} AS g FROM h) b ON a.sv_id <> b.sv_id) WHERE sim >= 0.3) WHERE rn <= 30"""
_BODY_ESTIMATE = ESTIMATE.replace("a.sig", "ba.sig").replace("b.sig", "bb.sig")
_SEMANTIC = "SELECT target, candidate FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY sim DESC, candidate) AS rn FROM bs) WHERE rn <= 30"
_BANDS = f"""{signature_sql(B.BODIES, "sv_id", body_sql("body"), "bsig")}, bk AS (SELECT sv_id, i, signature[i * 8 + 1:i * 8 + 8] AS band FROM bsig, range(16) r(i)),
bc AS (SELECT DISTINCT a.sv_id AS target, b.sv_id AS candidate FROM bk a JOIN bk b ON a.i = b.i AND a.band = b.band AND a.sv_id <> b.sv_id WHERE a.sv_id % 50 = 0),
bs AS (SELECT target, candidate, {ESTIMATE} AS sim FROM bc JOIN bsig a ON a.sv_id = target JOIN bsig b ON b.sv_id = candidate)"""
CANDIDATES = f"h AS {HASHED}, {_BANDS}, c AS ({' UNION '.join(_bucket(k, n) for k, n in (('body_hash', 50), ('ast_hash', 50), ('normalized_ast_hash', 50), ('kind purity_class', 30), ('kind', 20)))} UNION {_GRAM} UNION {_SEMANTIC})"


def _bodies(spark, sf_dir):
    """Classes of symbols whose bodies have one token set, and a MinHash signature per class."""
    rows = B.bodies(spark, sf_dir).select("sv_id", "body", F.sha2("body", 256).alias("text"))
    texts = materialise(rows.groupBy("text").agg(F.first("body").alias("body")), "texts").select("text", F.array_sort(F.array_distinct(T.tokenize_body(F.col("body")))).alias("tokens"))
    keyed = materialise(texts.withColumn("class", F.sha2(F.to_json("tokens"), 256)), "bodies").where("size(tokens) > 0")
    members = materialise(rows.select("sv_id", "text").join(keyed.select("text", "class"), "text").select("sv_id", "class"), "members")
    return members, materialise(V.min_hash(keyed.groupBy("class").agg(F.min("tokens").alias("tokens")), "class", "tokens"), "signatures")


def _candidates(spark, sf_dir, s, bodies):
    asked = s.where("sv_id % 50 = 0")
    return H.candidates(asked, s, H.semantic_candidates(asked, *bodies))


@query("H1_candidates", f"WITH {CANDIDATES} SELECT target, candidate FROM c")
def candidates(spark, sf_dir):
    return _candidates(spark, sf_dir, hashed(spark, sf_dir), _bodies(spark, sf_dir))


_OVERLAP = f"""coalesce(CASE WHEN pa.sv_id IS NULL OR pb.sv_id IS NULL THEN 0.0 WHEN len(pa.resource_touches) = 0 AND len(pb.resource_touches) = 0 THEN CASE WHEN pa.purity_class = pb.purity_class AND pa.purity_class <> 'pure' THEN 0.3 ELSE 0.0 END ELSE least(1.0, {jaccard_sql('pa.resource_touches', 'pb.resource_touches')} + CASE WHEN pa.purity_class = pb.purity_class THEN 0.2 ELSE 0 END) END, 0.0)::DOUBLE"""
_FIELDS = ("input", "output", "error", "security")
_CONTRACT = "(" + " + ".join(f"(ca.{n}_contract = cb.{n}_contract)::INT" for n in _FIELDS) + ")::DOUBLE / 4"
_TESTS = f"least(1.0, 0.3 * (SELECT count(*) FROM a WHERE list_contains(related, x.target) AND list_contains(related, x.candidate)))::DOUBLE"
_HISTORY = "coalesce((SELECT max(confidence) FROM i WHERE relation_type = 'co_changed_with' AND ((i.src = x.target AND i.dst = x.candidate) OR (i.dst = x.target AND i.src = x.candidate))), 0.0)::DOUBLE"
DIMS = f"""{CANDIDATES}, p AS {PROFILES}, k AS {B.CONTRACTS}, a AS (SELECT artifact, related FROM {B.ARTIFACTS}), i AS {B.INFERRED},
d AS (SELECT x.target, x.candidate, {name_sim_sql('ha.name', 'hb.name')} AS semantic, CASE WHEN ha.body_hash = hb.body_hash THEN 1.0 WHEN ha.normalized_ast_hash = hb.normalized_ast_hash THEN 0.9 WHEN ha.ast_hash = hb.ast_hash THEN 0.85 ELSE coalesce({_BODY_ESTIMATE}, 0.0) END::DOUBLE AS logic,
  {sig_sim_sql('ha.signature', 'hb.signature')} AS signature, {_OVERLAP} AS behavior, {_CONTRACT} AS contract, {_TESTS} AS tests, {_HISTORY} AS history, ha.kind AS kind_a, hb.kind AS kind_b
 FROM c x JOIN h ha ON ha.sv_id = x.target JOIN h hb ON hb.sv_id = x.candidate LEFT JOIN p pa ON pa.sv_id = x.target LEFT JOIN p pb ON pb.sv_id = x.candidate JOIN k ca ON ca.sv_id = x.target JOIN k cb ON cb.sv_id = x.candidate LEFT JOIN bsig ba ON ba.sv_id = x.target LEFT JOIN bsig bb ON bb.sv_id = x.candidate),
t AS (SELECT *, CASE WHEN logic >= 0.85 THEN greatest(3, f) ELSE f END AS families, least(1.0, CASE WHEN logic >= 0.85 THEN greatest(w, 0.85) ELSE w END)::DOUBLE AS total FROM (SELECT *, {' + '.join(f'({c} > 0.1)::INT' for c in H.WEIGHTS)} AS f, {' + '.join(f'{w} * {c}' for c, w in H.WEIGHTS.items())} AS w FROM d))"""


def scored(spark, sf_dir):
    prof = materialise(_profiles(spark, sf_dir), "profiles")
    s, bodies, cont = hashed(spark, sf_dir, prof), _bodies(spark, sf_dir), B.contracts(spark, sf_dir)
    pairs = H.body_similarity(materialise(_candidates(spark, sf_dir, s, bodies), "candidates"), *bodies)
    pairs = H.history(H.test_overlap(pairs, B.artifacts(spark, sf_dir)), B.inferred(spark, sf_dir))
    known = s.select("sv_id", F.struct("name", "kind", "signature", "body_hash", "ast_hash", "normalized_ast_hash").alias("s"))
    known = known.join(prof.select("sv_id", F.struct(*prof.columns).alias("p")), "sv_id", "left").join(cont.select("sv_id", F.struct(*cont.columns).alias("c")), "sv_id")
    known = materialise(known, "known")
    for t, key in (("a", "target"), ("b", "candidate")):
        pairs = pairs.join(known.select(F.col("sv_id").alias(key), *[F.col(x).alias(x + t) for x in "spc"]), key)
    c = F.col
    return pairs.withColumns({
        "semantic": T.name_similarity(c("sa.name"), c("sb.name")), "logic": H.logic_similarity("sa", "sb", c("body")), "signature": T.signature_similarity(c("sa.signature"), c("sb.signature")),
        "behavior": H.behavior_overlap(c("pa.resource_touches"), c("pb.resource_touches"), c("pa.purity_class"), c("pb.purity_class")),
        "contract": H.contract_overlap([(c(f"ca.{n}_contract"), c(f"cb.{n}_contract")) for n in _FIELDS]),
    })


# Estimates are whole 128ths, so that totals may stand halfway between two numbers of six digits.
_ROUNDED = ", ".join(f"round({c}, {9 if c == 'total' else 6}) AS {c}" for c in (*H.WEIGHTS, "total"))


def _rounded(df, *columns):
    return df.select(*columns, *[F.round(c, 9 if c == "total" else 6).alias(c) for c in (*H.WEIGHTS, "total")])


@query("H2_score", f"WITH {DIMS} SELECT target, candidate, families, {_ROUNDED} FROM t")
def score(spark, sf_dir):
    return _rounded(H.total_score(scored(spark, sf_dir)), "target", "candidate", "families")


@query("H3_behavior_overlap", f"WITH {DIMS} SELECT target, candidate, round(behavior, 6) AS behavior FROM d")
def behavior_overlap(spark, sf_dir):
    return scored(spark, sf_dir).select("target", "candidate", F.round("behavior", 6).alias("behavior"))


@query("H4_contract_overlap", f"SELECT ca.sv_id AS a, cb.sv_id AS b, {_CONTRACT} AS overlap FROM {B.CONTRACTS} ca JOIN {B.CONTRACTS} cb ON cb.sv_id = ca.sv_id + 1")
def contract_overlap(spark, sf_dir):
    k = B.contracts(spark, sf_dir)
    both = k.alias("a").join(k.alias("b"), F.col("b.sv_id") == F.col("a.sv_id") + 1)
    return both.select(F.col("a.sv_id").alias("a"), F.col("b.sv_id").alias("b"), H.contract_overlap([(F.col(f"a.{n}_contract"), F.col(f"b.{n}_contract")) for n in _FIELDS]).alias("overlap"))


@query("H5_test_overlap", f"WITH a AS (SELECT artifact, unnest(related) AS s FROM {B.ARTIFACTS}), c AS (SELECT src AS target, dst AS candidate FROM {B.INFERRED}) SELECT target, candidate, round(least(1.0, 0.3 * (SELECT count(*) FROM a x JOIN a y ON x.artifact = y.artifact WHERE x.s = target AND y.s = candidate))::DOUBLE, 6) AS tests FROM c")
def test_overlap(spark, sf_dir):
    pairs = B.inferred(spark, sf_dir).select(F.col("src").alias("target"), F.col("dst").alias("candidate"))
    return H.test_overlap(pairs, B.artifacts(spark, sf_dir)).select("target", "candidate", F.round("tests", 6).alias("tests"))


@query("H6_history", f"WITH i AS {B.INFERRED}, x AS (SELECT dst AS target, src AS candidate FROM i) SELECT target, candidate, {_HISTORY} AS history FROM x")
def history(spark, sf_dir):
    i = B.inferred(spark, sf_dir)
    return H.history(i.select(F.col("dst").alias("target"), F.col("src").alias("candidate")), i)


@query("H7_accepted", f"WITH {DIMS} SELECT target, candidate, round(total, 9) AS total FROM t WHERE families >= 2 AND total >= 0.6")
def accepted(spark, sf_dir):
    return H.accepted(H.total_score(scored(spark, sf_dir))).select("target", "candidate", F.round("total", 9).alias("total"))


_IO = "list_sort(list_concat({0}.db_reads, {0}.db_writes, {0}.network_calls))"
FLAGS = f"""array_to_string(list_filter([CASE WHEN a.purity_class <> b.purity_class THEN 'side_effects_differ' END, CASE WHEN a.exception_profile <> b.exception_profile THEN 'exception_semantics_differ' END, CASE WHEN a.auth_operations <> b.auth_operations THEN 'security_context_differs' END,
  CASE WHEN {_IO.format('a')} <> {_IO.format('b')} AND len({_IO.format('a')}) > 0 AND len({_IO.format('b')}) > 0 THEN 'io_shape_diverges' END], lambda x: x IS NOT NULL), ',')"""


def _flagged(spark, sf_dir):
    """Flags of the inferred pairs."""
    p, i = _profiles(spark, sf_dir), B.inferred(spark, sf_dir).alias("i")
    both = i.join(p.alias("a"), F.col("a.sv_id") == F.col("i.src")).join(p.alias("b"), F.col("b.sv_id") == F.col("i.dst"))
    return both.select(F.col("a.sv_id").alias("src"), F.col("b.sv_id").alias("dst"), H.contradictions("a", "b").alias("flags"))


@query("H8_contradictions", f"SELECT a.sv_id AS src, b.sv_id AS dst, {FLAGS} AS flags FROM {B.INFERRED} i JOIN {PROFILES} a ON a.sv_id = i.src JOIN {PROFILES} b ON b.sv_id = i.dst")
def contradictions(spark, sf_dir):
    return _flagged(spark, sf_dir).withColumn("flags", F.array_join("flags", ","))


@query(
    "H9_relation_type",
    f"""WITH {DIMS} SELECT d.target, d.candidate, CASE WHEN logic >= 0.85 THEN 'near_duplicate_logic' WHEN behavior >= 0.6 AND len(pa.auth_operations) > 0 AND len(pb.auth_operations) > 0 THEN 'auth_policy_peer'
  WHEN contract >= 0.5 AND len(list_filter(pa.exception_profile, lambda e: starts_with(e, 'throws:'))) > 0 AND len(list_filter(pb.exception_profile, lambda e: starts_with(e, 'throws:'))) > 0 THEN 'error_mapping_peer'
  WHEN behavior >= 0.7 AND contract >= 0.5 THEN 'business_rule_parallel' WHEN contract >= 0.7 THEN 'contract_sibling' WHEN signature >= 0.8 THEN 'normalization_homolog' ELSE 'near_duplicate_logic' END AS relation_type
FROM d LEFT JOIN p pa ON pa.sv_id = d.target LEFT JOIN p pb ON pb.sv_id = d.candidate""",
)
def relation_type(spark, sf_dir):
    c = F.col
    both = lambda test: F.coalesce(test("pa") & test("pb"), F.lit(False))
    auth = both(lambda t: F.size(c(f"{t}.auth_operations")) > 0)
    throw = both(lambda t: F.exists(c(f"{t}.exception_profile"), lambda e: e.startswith("throws:")))
    kind = H.relation_type(c("logic"), c("behavior"), c("contract"), c("signature"), c("sa.kind"), c("sb.kind"), auth, throw)
    return scored(spark, sf_dir).select("target", "candidate", kind.alias("relation_type"))


@query("H10_persist", f"WITH o AS (SELECT src, dst, relation_type, confidence, 'old' AS evidence FROM {B.INFERRED} WHERE src % 3 > 0 UNION ALL SELECT src, dst, relation_type, round(0.4::DOUBLE + (dst % 50) / 100::DOUBLE, 2), 'new' FROM {B.INFERRED} WHERE src % 2 = 0) SELECT src, dst, relation_type, max((confidence, evidence))[1] AS confidence, max((confidence, evidence))[2] AS evidence FROM o GROUP BY ALL")
def persist(spark, sf_dir):
    i = B.inferred(spark, sf_dir)
    old = i.where("src % 3 > 0").select("src", "dst", "relation_type", "confidence", F.lit("old").alias("evidence"))
    new = i.where("src % 2 = 0").select("src", "dst", "relation_type", F.round(0.4 + (F.col("dst") % 50) / 100, 2).alias("confidence"), F.lit("new").alias("evidence"))
    return H.persist(old, new)


@query("H11_review", f"SELECT src, dst, relation_type, review_state AS previous_state, CASE WHEN (src + dst) % 4 = 0 THEN 'confirmed' ELSE review_state END AS review_state FROM {B.INFERRED}")
def review(spark, sf_dir):
    i = B.inferred(spark, sf_dir)
    decisions = i.where("(src + dst) % 4 = 0").select("src", "dst", "relation_type", F.lit("confirmed").alias("new_state"))
    return H.review(i, decisions).select("src", "dst", "relation_type", "previous_state", "review_state")


@query("H12_proposals", f"WITH f AS (SELECT a.sv_id AS src, b.sv_id AS dst, {FLAGS} AS flags FROM {B.INFERRED} x JOIN {PROFILES} a ON a.sv_id = x.src JOIN {PROFILES} b ON b.sv_id = x.dst) SELECT i.src, i.dst, confidence, coalesce(flags, '') = '' AND confidence >= 0.85 AS is_safe FROM {B.INFERRED} i LEFT JOIN f ON f.src = i.src AND f.dst = i.dst WHERE relation_type <> 'co_changed_with' AND confidence >= 0.7 AND review_state <> 'rejected' AND valid_to IS NULL")
def proposals(spark, sf_dir):
    return H.proposals(B.inferred(spark, sf_dir), _flagged(spark, sf_dir).select("src", "dst", F.size("flags").alias("n")))


# Lineage. The new snapshot has every other part, some renamed.

_NEW = f"(SELECT * REPLACE (CASE WHEN sv_id % 4 = 0 THEN name || 'V' ELSE name END AS name) FROM {HASHED} WHERE sv_id % 2 = 0)"
_OLD = f"(SELECT * FROM {HASHED} WHERE sv_id % 3 > 0)"


def _snapshots(spark, sf_dir):
    s = _hashes(spark, sf_dir).withColumn("language", F.split_part("file_path", F.lit("/"), F.lit(2)))
    new = s.where("sv_id % 2 = 0").withColumn("name", F.when(F.col("sv_id") % 4 == 0, F.concat("name", F.lit("V"))).otherwise(F.col("name")))
    return s.where("sv_id % 3 > 0"), new


_SEED = "md5(name || kind || file_path)"


def _seeded(df):
    return df.withColumn("seed", F.md5(F.concat("name", "kind", "file_path")))


@query("L1_exact_lineage", f"SELECT o.sv_id AS lineage_id, n.sv_id FROM (SELECT sv_id, {_SEED} AS seed FROM {_OLD} WHERE sv_id % 5 > 0) o JOIN (SELECT sv_id, {_SEED} AS seed FROM {_NEW}) n ON o.seed = n.seed")
def exact_lineage(spark, sf_dir):
    old, new = (_seeded(s) for s in _snapshots(spark, sf_dir))
    return N.exact_matches(old.select(F.col("sv_id").alias("lineage_id"), "seed", (F.col("sv_id") % 5 > 0).alias("is_alive")), new)


NEAR = f"""e AS (SELECT src, dst FROM {B.EDGES} WHERE src IN (SELECT p_partkey FROM part) AND dst IN (SELECT p_partkey FROM part)), nb AS (SELECT node, list_sort(list_filter(list(DISTINCT c), lambda x: x IS NOT NULL)) AS callers, list_sort(list_filter(list(DISTINCT d), lambda x: x IS NOT NULL)) AS callees FROM (
  SELECT src AS node, NULL AS c, p_name AS d FROM e JOIN part ON p_partkey = dst UNION ALL SELECT dst, p_name, NULL FROM e JOIN part ON p_partkey = src) GROUP BY node)"""


def _near(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"))
    return N.neighbourhoods(B.edges(spark, sf_dir), names)


_AROUND = f"0.4 * {jaccard_sql('coalesce(x.callers, [])', 'coalesce(y.callers, [])')} + 0.6 * {jaccard_sql('coalesce(x.callees, [])', 'coalesce(y.callees, [])')}"
RENAMES = f"""{NEAR}, o AS (SELECT * FROM {_OLD}), n AS (SELECT * FROM {_NEW}), w AS (SELECT n.sv_id AS new_id, o.sv_id AS old_id,
  CASE WHEN o.normalized_ast_hash = n.normalized_ast_hash THEN 1.0 WHEN o.ast_hash = n.ast_hash THEN 0.85 ELSE 0.0 END::DOUBLE AS normalized_ast, CASE WHEN o.body_hash = n.body_hash THEN 1.0 WHEN o.ast_hash = n.ast_hash THEN 0.7 WHEN o.normalized_ast_hash = n.normalized_ast_hash THEN 0.6 ELSE 0.0 END::DOUBLE AS body_hash,
  {sig_sim_sql('o.signature', 'n.signature', (0.4, 0.3, 0.3))} AS signature, {name_sim_sql('o.name', 'n.name')} AS name FROM o JOIN n ON o.kind = n.kind AND split_part(o.file_path, '/', 2) = split_part(n.file_path, '/', 2) WHERE NOT (o.name = n.name AND o.file_path = n.file_path)),
s AS (SELECT r.*, round(least(1.0, 0.30 * normalized_ast + 0.25 * body_hash + 0.15 * ({_AROUND}) + 0.15 * signature + 0.15 * name)::DOUBLE, 9) AS score FROM w r LEFT JOIN nb x ON x.node = r.old_id LEFT JOIN nb y ON y.node = r.new_id),
b AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY score DESC, old_id) AS best FROM s WHERE score >= 0.45)"""


def _renames(spark, sf_dir):
    near = materialise(_near(spark, sf_dir).withColumnRenamed("node", "sv_id"), "neighbourhoods")
    old, new = (s.join(near, "sv_id", "left") for s in _snapshots(spark, sf_dir))
    return N.rename_candidates(old, new, ["kind", "language"])


@query("L2_rename_match", f"WITH {RENAMES} SELECT new_id, old_id, round(score, 6) AS score FROM b WHERE best = 1")
def rename_match(spark, sf_dir):
    return _renames(spark, sf_dir).select("new_id", "old_id", F.round("score", 6).alias("score"))


@query("L2_greedy_assignment")
def greedy_assignment(spark, sf_dir):
    """One to one by descending score; sequential, so tests compare it with a plain walk."""
    return N.assign_greedily(_renames(spark, sf_dir))


@query("L3_neighbourhood_similarity", f"WITH {NEAR} SELECT a.node AS a, b.node AS b, round(0.4 * {jaccard_sql('a.callers', 'b.callers')} + 0.6 * {jaccard_sql('a.callees', 'b.callees')}, 6) AS similarity FROM nb a JOIN nb b ON b.node = a.node + 1")
def neighbourhood_similarity(spark, sf_dir):
    near = _near(spark, sf_dir)
    both = near.alias("a").join(near.alias("b"), F.col("b.node") == F.col("a.node") + 1)
    value = N.neighbourhood_similarity(F.col("a.callers"), F.col("a.callees"), F.col("b.callers"), F.col("b.callees"))
    return both.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.round(value, 6).alias("similarity"))


@query("L4_hash_ladders", f"WITH o AS {HASHED} SELECT a.sv_id AS a, b.sv_id AS b, CASE WHEN a.normalized_ast_hash = b.normalized_ast_hash THEN 1.0 WHEN a.ast_hash = b.ast_hash THEN 0.85 ELSE 0.0 END::DOUBLE AS ast, CASE WHEN a.body_hash = b.body_hash THEN 1.0 WHEN a.ast_hash = b.ast_hash THEN 0.7 WHEN a.normalized_ast_hash = b.normalized_ast_hash THEN 0.6 ELSE 0.0 END::DOUBLE AS body FROM o a JOIN o b ON a.ast_hash = b.ast_hash AND a.sv_id < b.sv_id")
def hash_ladders(spark, sf_dir):
    """All pairs of equal trees, quadratic in a tree's copies. Hashes are compared between a tree's distinct triples; symbols are
    only joined to the results, by triple, so that no task holds a tree's whole block."""
    s = _hashes(spark, sf_dir).select("sv_id", *N.HASHES, F.sha2(F.to_json(F.struct(*N.HASHES)), 256).alias("triple"))
    of = s.groupBy("triple").agg(*[F.first(c).alias(c) for c in N.HASHES])
    pairs = of.alias("a").join(of.alias("b"), F.col("a.ast_hash") == F.col("b.ast_hash"))
    pairs = materialise(pairs.select(F.col("a.triple").alias("x"), F.col("b.triple").alias("y"), N.ast_similarity("a", "b").alias("ast"), N.body_similarity("a", "b").alias("body")), "triples")
    members = materialise(s.select("sv_id", "triple"), "members")
    left = members.select(F.col("sv_id").alias("a"), F.col("triple").alias("x")).join(pairs, "x")
    right = members.select(F.col("sv_id").alias("b"), F.col("triple").alias("y")).hint("merge")
    return left.join(right, "y").where("a < b").select("a", "b", "ast", "body")


@query("L5_births_deaths", "WITH o AS (SELECT o_custkey AS seed, bool_or(o_orderstatus <> 'P') AS is_alive FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1), n AS (SELECT DISTINCT o_custkey AS seed FROM orders WHERE year(o_orderdate) = 1997) SELECT coalesce(o.seed, n.seed) AS seed, CASE WHEN o.seed IS NULL THEN 'birth' WHEN n.seed IS NOT NULL AND is_alive THEN 'carried' WHEN n.seed IS NOT NULL THEN 'resurrected' ELSE 'death' END AS status FROM o FULL JOIN n ON o.seed = n.seed WHERE o.seed IS NULL OR n.seed IS NOT NULL OR is_alive")
def births_deaths(spark, sf_dir):
    """Customers of one year against those of the next."""
    orders = table(spark, sf_dir, "orders").withColumn("seed", F.col("o_custkey"))
    old = orders.where("year(o_orderdate) = 1996").groupBy("seed").agg(F.bool_or(F.col("o_orderstatus") != "P").alias("is_alive"))
    return N.life_events(old, orders.where("year(o_orderdate) = 1997").select("seed"))


_LINEAGES = "(SELECT p_partkey AS lineage_id, p_name AS name, p_type AS kind, p_brand AS language, p_size > 5 AS is_alive, CASE WHEN p_size % 9 = 0 THEN p_partkey - 1 END AS previous FROM part)"


def _lineages(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("lineage_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("language"), (s > 5).alias("is_alive"), F.when(s % 9 == 0, F.col("p_partkey") - 1).alias("previous"))


_LSTAT = "count(*) AS total, count(*) FILTER (WHERE is_alive) AS alive, count(*) FILTER (WHERE NOT is_alive) AS dead, count(previous) AS renamed"


@query("L6_lineage_stats", f"WITH l AS {_LINEAGES} SELECT 'all' AS scope, 'all' AS value, {_LSTAT} FROM l UNION ALL SELECT 'kind', kind, {_LSTAT} FROM l GROUP BY kind UNION ALL SELECT 'language', language, {_LSTAT} FROM l GROUP BY language")
def lineage_stats(spark, sf_dir):
    return N.statistics(_lineages(spark, sf_dir))


@query("L7_alive_lineages", f"SELECT lineage_id, name FROM {_LINEAGES} WHERE is_alive")
def alive_lineages(spark, sf_dir):
    return N.alive(_lineages(spark, sf_dir)).select("lineage_id", "name")


# Families: components of open homolog relations between parts.

LINKS = f"ln AS (SELECT src AS a, dst AS b, max(confidence) AS confidence FROM {B.INFERRED} WHERE confidence >= 0.4 AND review_state <> 'rejected' AND valid_to IS NULL AND relation_type <> 'co_changed_with' GROUP BY 1, 2)"
MEMBERS = f"ux AS (SELECT a, b FROM ln UNION SELECT b, a FROM ln), rx AS (SELECT a AS node, a AS root FROM ux UNION SELECT ux.b, rx.root FROM rx JOIN ux ON ux.a = rx.node), mb AS (SELECT node AS member, min(root) AS family FROM rx GROUP BY node)"
FAM = f"WITH RECURSIVE {LINKS}, {MEMBERS}"
SIDES = "sd AS (SELECT a AS member, b AS other, confidence FROM ln UNION ALL SELECT b, a, confidence FROM ln), sm AS (SELECT family, mb.member, avg(confidence) AS similarity, count(*) AS degree FROM mb JOIN sd ON sd.member = mb.member GROUP BY 1, 2), fm AS (SELECT family, avg(confidence) AS family_mean FROM mb JOIN ln ON ln.a = mb.member GROUP BY family)"


def _families(spark, sf_dir):
    i = B.inferred(spark, sf_dir)
    return materialise(K.clusters(i), "families"), K.open_edges(i)


@query("K1_clusters", f"{FAM} SELECT family, member FROM mb")
def clusters(spark, sf_dir):
    return _families(spark, sf_dir)[0]


@query("K1_suffix_clusters", f"WITH s AS (SELECT sv_id AS member, CASE WHEN name LIKE '%Handler' THEN 'suffix:Handler' END AS family FROM {B.SYMBOLS}) SELECT family, member, 0.45::DOUBLE AS confidence FROM s WHERE family IS NOT NULL")
def suffix_clusters(spark, sf_dir):
    return K.suffix_clusters(B.symbols(spark, sf_dir).withColumn("kind", F.lit("function")))


@query("G8_bisection")
def bisection(spark, sf_dir):
    """Order-dependent local search; tests pin its results on small graphs."""
    members, links = _families(spark, sf_dir)
    return K.split_large(members, links)


_NAMES_SYM = f"(SELECT sv_id, name, CASE sv_id % 7 WHEN 0 THEN 'validator' WHEN 1 THEN 'serializer' ELSE 'function' END AS kind FROM {B.SYMBOLS})"


def _symbols(spark, sf_dir):
    k = F.col("sv_id") % 7
    return B.symbols(spark, sf_dir).select("sv_id", "name", F.when(k == 0, "validator").when(k == 1, "serializer").otherwise("function").alias("kind"))


_MOST = "count(*) FILTER (WHERE {0}) > count(*) / 2.0"
TYPES = f"""ft AS (SELECT family, CASE WHEN {_MOST.format("kind IN ('validator', 'schema_object')")} THEN 'validator' WHEN {_MOST.format("kind = 'serializer'")} THEN 'serializer' WHEN {_MOST.format("len(auth_operations) > 0")} THEN 'auth_policy'
  WHEN {_MOST.format("len(validation_operations) > 0")} AND count(*) FILTER (WHERE len(auth_operations) > 0) <= 1 AND count(*) FILTER (WHERE len(db_writes) > 0) <= 1 THEN 'normalization' WHEN {_MOST.format("len(exception_profile) > 0")} THEN 'error_handler'
  WHEN count(purity_class) > 0 THEN 'business_rule' ELSE 'custom' END AS type FROM mb JOIN {_NAMES_SYM} s ON s.sv_id = mb.member LEFT JOIN {PROFILES} p ON p.sv_id = mb.member GROUP BY family)"""


@query("K2_family_type", f"{FAM}, {TYPES} SELECT family, type FROM ft")
def family_type(spark, sf_dir):
    return K.family_types(_families(spark, sf_dir)[0], _symbols(spark, sf_dir), _profiles(spark, sf_dir))


_ARR = ("resource_touches", "db_reads", "db_writes", "network_calls", "exception_profile", "auth_operations")
COMPLETE = f"""cm AS (SELECT c.sv_id AS member, ((purity_class IS NOT NULL)::INT + {' + '.join(f'coalesce((len({x}) > 0)::INT, 0)' for x in _ARR)} + (input_contract <> 'void')::INT + (output_contract <> 'void')::INT + (error_contract <> 'never')::INT + (security_contract <> 'none')::INT + (serialization_contract <> 'none')::INT) / 12::DOUBLE AS completeness
  FROM {B.CONTRACTS} c LEFT JOIN {PROFILES} p ON p.sv_id = c.sv_id)"""
EXEMPLAR = f"""{SIDES}, {COMPLETE}, sc AS (SELECT sm.*, round(0.6 * similarity + 0.4 * completeness, 9) AS score FROM sm JOIN cm ON cm.member = sm.member), bx AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY score DESC, member) AS rs, row_number() OVER (PARTITION BY family ORDER BY round(similarity, 9) DESC, member) AS rc, count(*) OVER (PARTITION BY family) AS n FROM sc),
ex AS (SELECT t.family, CASE WHEN t.similarity < 0.5 * family_mean AND t.n > 2 THEN c.member ELSE t.member END AS exemplar, t.score FROM bx t JOIN bx c ON c.family = t.family AND c.rc = 1 JOIN fm ON fm.family = t.family WHERE t.rs = 1)"""


def _exemplars(spark, sf_dir, members, links):
    p, c = _profiles(spark, sf_dir), B.contracts(spark, sf_dir)
    complete = c.alias("c").join(p.alias("p"), F.col("c.sv_id") == F.col("p.sv_id"), "left").select(F.col("c.sv_id").alias("member"), K.completeness("p", "c").alias("completeness"))
    return K.exemplars(K.member_similarity(members, links), complete, links, members)


@query("K3_exemplar", f"{FAM}, {EXEMPLAR} SELECT family, exemplar, round(score, 6) AS score FROM ex")
def exemplar(spark, sf_dir):
    members, links = _families(spark, sf_dir)
    return _exemplars(spark, sf_dir, members, links).withColumn("score", F.round("score", 6))


_FIELD_ROWS = " UNION ALL ".join(f"SELECT family, '{f}' AS field, unnest(list_distinct(list_filter(regexp_split_to_array(lower({f}_contract), '[\\s,()=>{{}}|:;\\]\\[]+'), lambda t: t <> ''))) AS token FROM mb JOIN {B.CONTRACTS} c ON c.sv_id = mb.member" for f in ("input", "output", "error", "security", "serialization"))


@query("K4_contract_fingerprint", f"{FAM}, n AS (SELECT family, count(*) AS n FROM mb JOIN {B.CONTRACTS} c ON c.sv_id = mb.member GROUP BY family), t AS ({_FIELD_ROWS}) SELECT family, field, token FROM t JOIN n USING (family) GROUP BY family, field, token, n HAVING count(*) > 0.5 * n")
def contract_fingerprint(spark, sf_dir):
    return K.contract_fingerprints(_families(spark, sf_dir)[0], B.contracts(spark, sf_dir))


_EFF = " UNION ALL ".join(f"SELECT family, 'effect:{n}' AS e FROM x WHERE len({c}) > 0" for c, n in K.EFFECT_FIELDS.items())


@query("K4_effect_fingerprint", f"{FAM}, x AS (SELECT mb.family, p.* FROM mb JOIN {PROFILES} p ON p.sv_id = mb.member), y AS (SELECT family, 'purity:' || purity_class AS e FROM x UNION ALL SELECT family, 'effect:' || split_part(unnest(resource_touches), ':', 1) FROM x UNION ALL {_EFF}) SELECT family, string_agg(DISTINCT e, ',' ORDER BY e) AS effects FROM y GROUP BY family")
def effect_fingerprint(spark, sf_dir):
    return K.effect_fingerprints(_families(spark, sf_dir)[0], _profiles(spark, sf_dir)).withColumn("effects", F.array_join("effects", ","))


@query(
    "K5_outliers",
    f"""{FAM}, {EXEMPLAR}, q AS (SELECT sm.family, sm.member, CASE WHEN sm.member = exemplar THEN 1.0 ELSE coalesce((SELECT max(confidence) FROM sd WHERE sd.member = sm.member AND sd.other = exemplar), sm.similarity * 0.8) END AS similarity, family_mean, exemplar FROM sm JOIN ex ON ex.family = sm.family JOIN fm ON fm.family = sm.family)
SELECT family, member, round(similarity, 6) AS similarity, member <> exemplar AND similarity < 0.5 * family_mean AS is_outlier FROM q""",
)
def outliers(spark, sf_dir):
    members, links = _families(spark, sf_dir)
    return K.outliers(members, links, _exemplars(spark, sf_dir, members, links)).withColumn("similarity", F.round("similarity", 6))


@query("K5_contradictions", f"{FAM}, {EXEMPLAR} SELECT a.sv_id AS exemplar, b.sv_id AS member, array_to_string(list_filter([CASE WHEN a.purity_class <> b.purity_class THEN 'purity_diverges:' || a.purity_class || '->' || b.purity_class END, CASE WHEN (len(a.auth_operations) > 0) <> (len(b.auth_operations) > 0) THEN 'auth_requirement_differs' END, CASE WHEN {' OR '.join(f'(len(b.{c}) > 0 AND len(a.{c}) = 0)' for c in list(K.EFFECT_FIELDS)[:5])} THEN 'effect_set_diverges' END, CASE WHEN a.exception_profile <> b.exception_profile AND len(a.exception_profile) > 0 AND len(b.exception_profile) > 0 THEN 'exception_semantics_differ' END, CASE WHEN ca.error_contract <> cb.error_contract AND ca.error_contract <> 'never' AND cb.error_contract <> 'never' THEN 'error_contract_diverges' END, CASE WHEN ca.security_contract <> cb.security_contract AND ca.security_contract <> 'none' AND cb.security_contract <> 'none' THEN 'security_contract_diverges' END], lambda x: x IS NOT NULL), ',') AS flags FROM mb JOIN ex ON ex.family = mb.family AND mb.member <> ex.exemplar JOIN {PROFILES} a ON a.sv_id = ex.exemplar JOIN {PROFILES} b ON b.sv_id = mb.member JOIN {B.CONTRACTS} ca ON ca.sv_id = a.sv_id JOIN {B.CONTRACTS} cb ON cb.sv_id = b.sv_id")
def family_contradictions(spark, sf_dir):
    members, links = _families(spark, sf_dir)
    full = _profiles(spark, sf_dir).join(B.contracts(spark, sf_dir), "sv_id")
    pairs = members.join(_exemplars(spark, sf_dir, members, links).select("family", "exemplar"), "family").where("member <> exemplar").alias("x")
    both = pairs.join(full.alias("e"), F.col("e.sv_id") == F.col("x.exemplar")).join(full.alias("m"), F.col("m.sv_id") == F.col("x.member"))
    return both.select(F.col("e.sv_id").alias("exemplar"), F.col("m.sv_id").alias("member"), F.array_join(K.deviations("e", "m")["contradiction_flags"], ",").alias("flags"))


@query("K6_membership", f"{FAM}, {SIDES}, n AS (SELECT family, count(*) AS n FROM mb GROUP BY family) SELECT sm.family, member, round(least(1.0, 0.4 * degree / greatest(1, n - 1) + 0.6 * similarity), 6) AS confidence FROM sm JOIN n ON n.family = sm.family")
def membership(spark, sf_dir):
    members, links = _families(spark, sf_dir)
    n = members.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    sim = K.member_similarity(members, links).join(n, "family")
    value = K.membership_confidence(F.col("degree") / F.greatest(F.lit(1), F.col("n") - 1), F.col("similarity"))
    return sim.select("family", "member", F.round(value, 6).alias("confidence"))


@query("K7_family_name", f"{FAM}, {TYPES}, s AS (SELECT family, member, name FROM mb JOIN {B.SYMBOLS} s ON s.sv_id = mb.member), n AS (SELECT family, count(*) AS n, arg_min(name, member) AS first FROM s GROUP BY family), t AS (SELECT DISTINCT family, member, unnest({tokens_sql(split_sql('name'), False)}) AS token FROM s), c AS (SELECT family, token FROM t JOIN n USING (family) WHERE length(token) > 2 GROUP BY family, token, n HAVING count(*) = n), g AS (SELECT family, string_agg(token, '_' ORDER BY token) AS common FROM c GROUP BY family) SELECT n.family, coalesce(common, first) || '_' || type AS name FROM n LEFT JOIN g ON g.family = n.family JOIN ft ON ft.family = n.family")
def family_name(spark, sf_dir):
    members = _families(spark, sf_dir)[0]
    return K.family_names(members, B.symbols(spark, sf_dir), K.family_types(members, _symbols(spark, sf_dir), _profiles(spark, sf_dir)))


@query("K8_family_reads", f"{FAM} SELECT family, member FROM mb WHERE family IN (SELECT family FROM mb WHERE member % 50 = 0)")
def family_reads(spark, sf_dir):
    members = _families(spark, sf_dir)[0]
    return K.families_of(members, members.where("member % 50 = 0").select(F.col("member").alias("node"))).select("family", "member")
