"""Profiles, invariants, mined contracts, effects and uncertainty."""

import re

from pyspark.sql import functions as F

from weftgraph.functions import ladders as L
from weftgraph.operators import contracts as C
from weftgraph.operators import effects as E
from weftgraph.operators import profiles as P
from weftgraph.plans import bindings as B
from weftgraph.plans.graph import PURITY
from weftgraph.plans.registry import query
from weftgraph.plans.scalars import q
from weftgraph.rules.contract_rules import BODY_RULES, DECORATOR_RULES, REGEX_DOMAINS
from weftgraph.rules.effect_patterns import EFFECT_PATTERNS
from weftgraph.rules.hint_patterns import HINT_PATTERNS, SCRIPT_HINT_PATTERNS
from weftgraph.sources.tables import table

PREFIX = "CASE hint_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.RESOURCES.items()) + " END || detail"
_ARRAYS = {"resource_touches": PREFIX} | {
    c: f"CASE WHEN hint_type IN ({', '.join(map(q, ks))}) THEN {'hint_type || chr(58) || detail' if c == 'exception_profile' else 'detail'} END" for c, ks in P.PROFILE.items()
}
PROFILES = f"""(SELECT sv_id, {PURITY} AS purity_class, {', '.join(_ARRAYS)} FROM (SELECT sv_id, list(DISTINCT hint_type) AS h,
  {', '.join(f"list_sort(list_filter(list(DISTINCT {v}), lambda x: x IS NOT NULL)) AS {c}" for c, v in _ARRAYS.items())} FROM {B.HINTS} GROUP BY sv_id))"""
_JOINED = ", ".join(f"array_to_string({c}, ',') AS {c}" for c in _ARRAYS)


def _profiles(spark, sf_dir):
    return P.behavioral_profiles(B.hints(spark, sf_dir))


def _joined(df):
    return df.select("sv_id", *[c for c in df.columns if c not in _ARRAYS and c != "sv_id"], *[F.array_join(c, ",").alias(c) for c in _ARRAYS])


@query("P1_behavioral_profile", f"SELECT sv_id, purity_class, {_JOINED} FROM {PROFILES}")
def behavioral_profile(spark, sf_dir):
    return _joined(_profiles(spark, sf_dir))


@query("P2_purity", f"SELECT purity_class, count(*) AS n FROM {PROFILES} GROUP BY purity_class")
def purity(spark, sf_dir):
    return _profiles(spark, sf_dir).groupBy("purity_class").agg(F.count(F.lit(1)).alias("n"))


_RANK = "CASE {0} WHEN 'pure' THEN 0 WHEN 'read_only' THEN 1 WHEN 'read_write' THEN 2 ELSE 3 END"
_MINUS = "array_to_string(list_sort(list_filter({0}, lambda x: NOT list_contains({1}, x))), ',')"


@query(
    "P3_behavior_compare",
    f"""SELECT a.sv_id, CASE WHEN {_RANK.format('b.purity_class')} > {_RANK.format('a.purity_class')} THEN 'escalated' WHEN {_RANK.format('b.purity_class')} < {_RANK.format('a.purity_class')} THEN 'deescalated' ELSE 'unchanged' END AS purity_direction,
  {_MINUS.format('b.resource_touches', 'a.resource_touches')} AS new_resources, {_MINUS.format('a.resource_touches', 'b.resource_touches')} AS removed_resources,
  {' OR '.join(f'a.{c} <> b.{c}' for c in P.EFFECTS)} AS side_effects_changed FROM {PROFILES} a JOIN {PROFILES} b ON b.sv_id = a.sv_id + 1""",
)
def behavior_compare(spark, sf_dir):
    p = _profiles(spark, sf_dir)
    both = p.alias("a").join(p.alias("b"), F.col("b.sv_id") == F.col("a.sv_id") + 1)
    made = P.compare_behavior("a", "b")
    return both.select(F.col("a.sv_id").alias("sv_id"), *[(F.array_join(v, ",") if "resources" in k else v).alias(k) for k, v in made.items()])


@query(
    "P4_contract_profile",
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'void' ELSE '(' || p_type || ', ' || p_brand || ')' END AS input_contract, CASE WHEN p_size % 3 = 0 THEN 'void' ELSE p_type END AS output_contract,
  CASE WHEN p_size % 2 = 0 THEN 'never' ELSE 'TypeError | RangeError' END AS error_contract, CASE WHEN p_size % 5 = 0 THEN '@UseGuards(Auth)' ELSE 'none' END AS security_contract, 'none' AS serialization_contract,
  '@MinLength(3)' AS schema_refs, '@Get(x)' AS api_contract_refs FROM part""",
)
def contract_profile(spark, sf_dir):
    none, size = F.array().cast("array<string>"), F.col("p_size")
    inputs = F.when(size % 4 == 0, none).otherwise(F.array("p_type", "p_brand"))
    thrown = F.when(size % 2 == 0, none).otherwise(F.array(F.lit("TypeError"), F.lit("RangeError")))
    decorators = F.concat(F.array(F.lit("@MinLength(3)"), F.lit("@Get(x)")), F.when(size % 5 == 0, F.array(F.lit("@UseGuards(Auth)"))).otherwise(none))
    made = P.contract_profile(inputs, F.when(size % 3 == 0, "").otherwise(F.col("p_type")), thrown, decorators)
    return table(spark, sf_dir, "part").select("p_partkey", *[(F.array_join(v, ",") if k.endswith("refs") else v).alias(k) for k, v in made.items()])


_SYMBOLS = f"(SELECT s.sv_id, name, CASE s.sv_id % 10 WHEN 0 THEN 'validator' WHEN 1 THEN 'test_case' WHEN 2 THEN 'class' ELSE 'function' END AS kind, file_path FROM {B.SYMBOLS} s)"


def _rule(name, when, text, scope="symbol", source="derived"):
    return f"SELECT sv_id, '{scope}' AS scope, '{name}:' || name || {text} AS expression, '{source}' AS source_type, {P.STRENGTHS[name]}::DOUBLE AS strength FROM x WHERE {when}"


@query(
    "P5_invariants",
    f"""WITH x AS (SELECT s.*, p.* EXCLUDE (sv_id), error_contract, security_contract FROM {_SYMBOLS} s LEFT JOIN {PROFILES} p ON p.sv_id = s.sv_id JOIN {B.CONTRACTS} c ON c.sv_id = s.sv_id) """
    + " UNION ALL ".join(
        [
            _rule("test", "kind = 'test_case'", "' asserts behavior of target symbol'", source="explicit_test"),
            _rule("schema", "kind = 'validator'", "' enforces data shape constraints'", "module", "schema"),
            _rule("validation", "kind = 'function' AND len(validation_operations) > 0", "' performs input validation (' || array_to_string(validation_operations, ', ') || ')'"),
            _rule("error_contract", "kind = 'function' AND error_contract <> 'never'", "' may throw ' || error_contract"),
            _rule("security", "kind = 'function' AND security_contract <> 'none'", "' requires ' || security_contract"),
            _rule("exception", "kind = 'function' AND len(list_filter(exception_profile, lambda e: starts_with(e, 'throws:'))) > 0", "' raises ' || array_to_string(list_transform(list_filter(exception_profile, lambda e: starts_with(e, 'throws:')), lambda e: substr(e, 8)), ', ')"),
            _rule("resource_access", "kind = 'function' AND purity_class <> 'pure' AND len(resource_touches) > 0", "' (' || purity_class || ') touches ' || array_to_string(resource_touches[1:5], ', ')"),
        ]
    ),
)
def invariants(spark, sf_dir):
    s = B.symbols(spark, sf_dir).select("sv_id", "name", F.when(F.col("sv_id") % 10 == 0, "validator").when(F.col("sv_id") % 10 == 1, "test_case").when(F.col("sv_id") % 10 == 2, "class").otherwise("function").alias("kind"), "file_path")
    joined = s.join(_profiles(spark, sf_dir), "sv_id", "left").join(B.contracts(spark, sf_dir).select("sv_id", "error_contract", "security_contract"), "sv_id")
    return P.derived_invariants(joined)


@query("P5b_invariant_upsert", f"SELECT sv_id % 50 AS sv_id, expression, max(strength) AS strength FROM {B.INVARIANTS} GROUP BY 1, 2")
def invariant_upsert(spark, sf_dir):
    rows = B.invariants(spark, sf_dir).select((F.col("sv_id") % 50).alias("sv_id"), "expression", "strength", F.lit("symbol").alias("scope"), F.lit("derived").alias("source_type"))
    return P.upsert_invariants(rows).select("sv_id", "expression", "strength")


@query("P5c_contract_compare", f"SELECT a.sv_id, {', '.join(f'a.{n}_contract IS DISTINCT FROM b.{n}_contract AS {n}_changed' for n in ('input', 'output', 'error', 'security', 'serialization'))} FROM {B.CONTRACTS} a JOIN {B.CONTRACTS} b ON b.sv_id = a.sv_id + 1")
def contract_compare(spark, sf_dir):
    c = B.contracts(spark, sf_dir)
    both = c.alias("a").join(c.alias("b"), F.col("b.sv_id") == F.col("a.sv_id") + 1)
    return both.select(F.col("a.sv_id").alias("sv_id"), *[v.alias(k) for k, v in P.contract_changes("a", "b").items()])


# Mined contracts: SQL made from the same rules


def squeezed_sql(x: str, most: int) -> str:
    t = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({t}) <= {most} THEN {t} ELSE substr({t}, 1, {most - 3}) || '...' END"


def filled_sql(template: str, shift: dict[int, int] | None = None) -> str:
    parts, at = [], 0
    for m in re.finditer(r"\{(\d)(?::(\d+))?\}", template):
        parts.append(q(template[at : m.start()]))
        g = f"m{(shift or {}).get(int(m[1]), int(m[1]))}"
        parts.append(f"({squeezed_sql(g, int(m[2]))})" if m[2] else g)
        at = m.end()
    return " || ".join([*parts, q(template[at:])])


def rules_sql(group: str) -> str:
    out = []
    for name, gate, pattern, template, strength, source in BODY_RULES:
        if name != group:
            continue
        if gate.startswith("library:"):
            where = "(" + " OR ".join(f"contains(body, {q(s)})" for s in gate[8:].split("|")) + ")"
        else:
            where = f"language = {q(gate)}" if gate else "true"
        plain, shift = pattern.replace("++", "+").replace("*+", "*"), None
        if "\\1" in plain:
            plain, shift = plain.replace("\\1", r"([\w.]+)"), {4: 5, 5: 6}
        plain = re.sub(r"\(\?[=!][^)]*\)", "", plain)
        n = re.compile(plain).groups if "{1" in template or "{2" in template else 0
        if n == 0:
            out.append(f"SELECT sv_id, {q(template)} AS expression, {strength}::DOUBLE AS strength, {q(source)} AS source_type FROM b WHERE {where} AND regexp_matches(body, {q(plain)})")
            continue
        groups = ", ".join(f"unnest(regexp_extract_all(body, {q(plain)}, {i})) AS m{i}" for i in range(1, n + 1))
        same = "WHERE m1 = m4" if shift else ""
        out.append(f"SELECT sv_id, {filled_sql(template, shift)} AS expression, {strength}::DOUBLE AS strength, {q(source)} AS source_type FROM (SELECT sv_id, {groups} FROM b WHERE {where}) {same}")
    return " UNION ALL ".join(out)


MAXED = "SELECT sv_id, expression, max((strength, source_type))[1] AS strength, max((strength, source_type))[2] AS source_type FROM r GROUP BY sv_id, expression"
def domain_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {q(p)}) THEN '{n}'" for p, n in REGEX_DOMAINS) + " ELSE 'custom_pattern' END"


_RX = r"(\/(?:[^/\\]|\\.)+\/[gimsuy]*)"


def _validators_sql() -> str:
    rows = (("test", _RX + r"\s*\.\s*test\s*\(\s*([\w.]+)\s*\)", "m1", "m2", "must match", 0.75, 0.85), ("match", r"([\w.]+)\s*\.\s*match\s*\(\s*" + _RX + r"\s*\)", "m2", "m1", "matched against", 0.72, 0.82))
    return " UNION ALL ".join(
        f"SELECT sv_id, 'regex_validation:' || {v} || ' {verb} ' || {domain_sql(p)} || ' pattern ' || {squeezed_sql(p, 80)} AS expression, CASE WHEN {domain_sql(p)} = 'custom_pattern' THEN {a} ELSE {b} END::DOUBLE AS strength, 'assertion' AS source_type FROM (SELECT sv_id, unnest(regexp_extract_all(body, {q(rx)}, 1)) AS m1, unnest(regexp_extract_all(body, {q(rx)}, 2)) AS m2 FROM b)"
        for _, rx, p, v, verb, a, b in rows
    )


_CLOSURES = r"""SELECT sv_id, 'closure:contains ' || (a + n) || ' nested function(s) (' || a || ' arrow, ' || n || ' named)', 0.65::DOUBLE, 'derived' FROM (SELECT sv_id, len(regexp_extract_all(body, '(?:const|let|var)\s+\w+\s*=\s*(?:\([^)]*\)|[\w]+)\s*=>')) AS a, len(regexp_extract_all(body, 'function\s+\w+\s*\(')) AS n FROM b) WHERE a + n > 0
UNION ALL SELECT sv_id, 'return_shape:returns ' || s || ' (observed from ' || n || ' return path(s))', 0.70::DOUBLE, 'derived' FROM (SELECT sv_id, len(v) AS n, array_to_string(list_filter([CASE WHEN list_has_any(v, ['null', 'undefined', 'void 0']) THEN 'null' END, CASE WHEN len(list_filter(v, lambda x: regexp_matches(x, '^(?:new\s+)?Promise|await\s'))) > 0 THEN 'Promise' END, CASE WHEN len(list_filter(v, lambda x: starts_with(x, '{'))) > 0 THEN 'object' END,
  CASE WHEN len(list_filter(v, lambda x: starts_with(x, '['))) > 0 THEN 'array' END, CASE WHEN list_has_any(v, ['true', 'false']) THEN 'boolean' END, CASE WHEN len(list_filter(v, lambda x: regexp_matches(x, '^-?\d+(\.\d+)?$'))) > 0 THEN 'number' END], lambda x: x IS NOT NULL), ' | ') AS s FROM v) WHERE s <> ''
UNION ALL SELECT sv_id, 'return_nullable:function may return null/undefined on some paths', 0.78::DOUBLE, 'derived' FROM v WHERE list_has_any(v, ['null', 'undefined', 'void 0']) AND len(list_filter(v, lambda x: x NOT IN ('null', 'undefined', 'void 0'))) > 0"""
_RETURNS = r", v AS (SELECT sv_id, list_transform(regexp_extract_all(body, 'return\s+([^;]+)', 1), lambda x: trim(x)) AS v FROM b)"
_COUNTED = r"""SELECT sv_id, 'rust_error_propagation:' || n || ' ? operators — function returns Result/Option', 0.8::DOUBLE, 'type_constraint' FROM (SELECT sv_id, len(regexp_extract_all(body, '\w[\w.]*\s*\?')) AS n FROM b WHERE language = 'rust') WHERE n > 0
UNION ALL SELECT sv_id, 'ruby_guard_clauses:' || n || ' guard clause(s) — early return on invalid state', 0.8::DOUBLE, 'guard_clause' FROM (SELECT sv_id, len(regexp_extract_all(body, 'return\s+(?:nil|false)?\s+(?:if|unless)\s+')) AS n FROM b WHERE language = 'ruby') WHERE n > 0"""
_PRISMA = r"""SELECT sv_id, 'schema_prisma:' || m1 || ' type=' || m2 || m3 || CASE WHEN trim(m4) = '' THEN '' ELSE ' ' || trim(m4) END, 0.9::DOUBLE, 'schema' FROM (SELECT sv_id, unnest(regexp_extract_all(body, '(\w+)\s+(String|Int|Float|Boolean|DateTime|BigInt|Decimal|Json|Bytes)\s*(\?)?\s*(.*)', 1)) AS m1, unnest(regexp_extract_all(body, '(\w+)\s+(String|Int|Float|Boolean|DateTime|BigInt|Decimal|Json|Bytes)\s*(\?)?\s*(.*)', 2)) AS m2,
 unnest(regexp_extract_all(body, '(\w+)\s+(String|Int|Float|Boolean|DateTime|BigInt|Decimal|Json|Bytes)\s*(\?)?\s*(.*)', 3)) AS m3, unnest(regexp_extract_all(body, '(\w+)\s+(String|Int|Float|Boolean|DateTime|BigInt|Decimal|Json|Bytes)\s*(\?)?\s*(.*)', 4)) AS m4 FROM b)"""


def group_sql(group: str) -> str:
    extra = {"P6f": _validators_sql(), "P6i": _PRISMA, "P6k": _CLOSURES, "P6l": _COUNTED}.get(group)
    parts = " UNION ALL ".join(x for x in (rules_sql(group), extra) if x)
    return f"WITH b AS {B.BODIES}{_RETURNS if group == 'P6k' else ''}, r(sv_id, expression, strength, source_type) AS ({parts}) {MAXED}"


def _register(name: str, group: str):
    @query(name, group_sql(group))
    def mined(spark, sf_dir):
        body = B.bodies(spark, sf_dir)
        return C.findings(body, C.body_findings(F.col("body"), F.col("language"), (group,)), ("body", "language"))

    return mined


for _name in ("P6a_assertions", "P6b_guards", "P6c_type_guards", "P6d_null_checks", "P6e_ranges", "P6f_regex_validators", "P6g_enums", "P6h_normalisation", "P6i_orm_schemas", "P6j_validators", "P6k_closures", "P6l_languages"):
    _register(_name, _name.split("_")[0])


ALL_BODY = " UNION ALL ".join(f"({rules_sql(g)})" for g in C.GROUPS if rules_sql(g))
MINED = f"r0(sv_id, expression, strength, source_type) AS ({ALL_BODY} UNION ALL {_validators_sql()} UNION ALL {_PRISMA} UNION ALL {_CLOSURES} UNION ALL {_COUNTED})"


@query("P6m_mine_all", f"WITH b AS {B.BODIES}{_RETURNS}, {MINED}, r AS (SELECT * FROM r0) {MAXED}")
def mine_all(spark, sf_dir):
    none = F.lit(None).cast("array<string>")
    return C.mine(B.bodies(spark, sf_dir).withColumn("signature", F.lit("")).withColumn("decorators", none))


PARAMETERS = r"""prm AS (SELECT sv_id, signature, unnest(list_transform(regexp_extract_all(regexp_extract(signature, '(?s)^[^(]*\((.*)\)', 1), '(?:=>|[^,<(\[{]|[<(\[{][^<>()\[\]{}]*[>)\]}])+'), lambda p: trim(p))) AS p FROM s),
par AS (SELECT sv_id, regexp_extract(p, '(\w+)\s*(\?)?:\s*([^\n]+)', 1) AS n, regexp_extract(p, '(\w+)\s*(\?)?:\s*([^\n]+)', 2) = '?' AS o, trim(regexp_extract(p, '(\w+)\s*(\?)?:\s*([^\n]+)', 3)) AS t, p FROM prm WHERE regexp_matches(p, '(\w+)\s*(\?)?:\s*([^\n]+)'))"""
_MUST = "CASE WHEN t IN ('string', 'String') THEN 'string' WHEN t IN ('number', 'Number') THEN 'number' WHEN t IN ('boolean', 'Boolean') THEN 'boolean' WHEN regexp_matches(t, '\\[\\]$|^Array<') THEN 'array' WHEN regexp_matches(t, '^Promise<') THEN 'Promise' END"


@query(
    "P7a_parameter_types",
    f"""WITH s AS {B.SIGNED}, {PARAMETERS}, r(sv_id, expression, strength, source_type) AS (SELECT sv_id, 'input_type:' || n || ': ' || t || CASE WHEN o THEN ' (optional)' ELSE '' END, 0.85::DOUBLE, 'derived' FROM par
  UNION ALL SELECT sv_id, 'input_contract:' || n || ' must be ' || {_MUST}, CASE WHEN {_MUST} IN ('array', 'Promise') THEN 0.88 ELSE 0.90 END::DOUBLE, 'derived' FROM par WHERE {_MUST} IS NOT NULL
  UNION ALL SELECT sv_id, 'nullability:' || n || ' may be null/undefined', 0.85::DOUBLE, 'derived' FROM par WHERE o OR regexp_matches(t, '\\|\\s*(?:null|undefined)')) {MAXED}""",
)
def parameter_types(spark, sf_dir):
    return C.findings(B.signed(spark, sf_dir), C.parameter_findings(F.col("signature")))


RETURN = r"trim(regexp_extract(signature, '\)\s*:\s*([^\n]+?)(?:\s*\{|=>|$)', 1))"


@query(
    "P7b_return_type",
    rf"""WITH s AS {B.SIGNED}, k AS (SELECT sv_id, {RETURN} AS k FROM s), r(sv_id, expression, strength, source_type) AS (SELECT sv_id, 'output_guarantee:returns ' || k, 0.85::DOUBLE, 'derived' FROM k WHERE k NOT IN ('', 'void', 'any')
  UNION ALL SELECT sv_id, 'output_guarantee:async, resolves to ' || regexp_extract(k, '^Promise<(.+)>$', 1), 0.85::DOUBLE, 'derived' FROM k WHERE regexp_matches(k, '^Promise<(.+)>$')
  UNION ALL SELECT sv_id, 'output_nullable:return type includes null/undefined', 0.85::DOUBLE, 'derived' FROM k WHERE regexp_matches(k, '\|\s*(?:null|undefined)')
  UNION ALL SELECT sv_id, 'output_guarantee:function always throws (return type: never)', 0.95::DOUBLE, 'derived' FROM k WHERE k = 'never') {MAXED}""",
)
def return_type(spark, sf_dir):
    return C.findings(B.signed(spark, sf_dir), C.return_findings(F.col("signature")))


@query("P7c_generics", rf"WITH s AS {B.SIGNED} SELECT sv_id, 'type_bound:' || m1 || ' extends ' || trim(m2) AS expression, 0.82::DOUBLE AS strength, 'derived' AS source_type FROM (SELECT sv_id, unnest(regexp_extract_all(signature, '<\s*(\w+)\s+extends\s+([^>,]+)', 1)) AS m1, unnest(regexp_extract_all(signature, '<\s*(\w+)\s+extends\s+([^>,]+)', 2)) AS m2 FROM s)")
def generics(spark, sf_dir):
    return C.findings(B.signed(spark, sf_dir), C.generic_findings(F.col("signature")))


@query("P7d_unions", rf"WITH s AS {B.SIGNED}, u AS (SELECT sv_id, regexp_extract({RETURN}, '(\w+(?:\s*\|\s*\w+)+)', 1) AS u FROM s) SELECT sv_id, 'union_type:return is one of {{' || array_to_string(list_transform(string_split(u, '|'), lambda x: trim(x)), ', ') || '}}' AS expression, 0.80::DOUBLE AS strength, 'derived' AS source_type FROM u WHERE u <> ''")
def unions(spark, sf_dir):
    return C.findings(B.signed(spark, sf_dir), C.union_findings(F.col("signature")))


@query(
    "P7e_optional_parameters",
    rf"""WITH s AS {B.SIGNED}, prm AS (SELECT sv_id, list_transform(regexp_extract_all(regexp_extract(signature, '(?s)^[^(]*\((.*)\)', 1), '(?:=>|[^,<(\[{{]|[<(\[{{][^<>()\[\]{{}}]*[>)\]}}])+'), lambda p: trim(p)) AS ps FROM s),
par AS (SELECT sv_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM prm), k AS (SELECT sv_id, i, regexp_extract(p, '(\w+)\s*(\?)?:\s*([^\n]+)', 1) AS n, regexp_extract(p, '(\w+)\s*(\?)?:\s*([^\n]+)', 2) = '?' OR regexp_matches(p, '=\s*.+') AS o FROM par WHERE regexp_matches(p, '(\w+)\s*(\?)?:\s*([^\n]+)'))
SELECT sv_id, 'param_ordering:required param ''' || n || ''' follows optional params' AS expression, 0.60::DOUBLE AS strength, 'derived' AS source_type FROM k WHERE NOT o AND EXISTS (SELECT 1 FROM k x WHERE x.sv_id = k.sv_id AND x.o AND x.i < k.i)
UNION ALL SELECT sv_id, 'optional_params:' || string_agg(n, ', ' ORDER BY i) || ' are optional', 0.80::DOUBLE, 'derived' FROM k WHERE o GROUP BY sv_id""",
)
def optional_parameters(spark, sf_dir):
    return C.findings(B.signed(spark, sf_dir), C.optional_findings(F.col("signature")))


def _decorators_sql() -> str:
    out = []
    for pattern, template, strength, source in DECORATOR_RULES:
        extra = " AND NOT regexp_matches(d, 'length\\s*:\\s*\\d')" if "(?!" in pattern else ""
        plain = "(?i)" + pattern.replace(r"(?![^}]*length\s*:\s*\d)", "")
        n = re.compile(plain).groups if "{1" in template else 0
        groups = "".join(f", regexp_extract(d, {q(plain)}, {i}) AS m{i}" for i in range(1, n + 1))
        out.append(f"SELECT sv_id, {filled_sql(template)} AS expression, {strength}::DOUBLE AS strength, {q(source)} AS source_type FROM (SELECT sv_id{groups} FROM d WHERE regexp_matches(d, {q(plain)}){extra})")
    return " UNION ALL ".join(out)


DECORATED = f"d AS (SELECT sv_id, unnest(decorators) AS d FROM {B.DECORATED}), r AS ({_decorators_sql()})"


@query("P8_decorators", f"WITH {DECORATED} {MAXED}")
def decorators(spark, sf_dir):
    return C.findings(B.decorated(spark, sf_dir), C.decorator_findings(F.col("decorators")))


def _named(x: str) -> str:
    return rf"regexp_replace({x}, '(?i)\b[a-z_]\w*\b', '_VAR', 'g')"


PREDICATE = rf"""trim(regexp_replace(CASE WHEN category = 'guard_clause' THEN regexp_replace({_named('p')}, '_VAR\s*\.\s*_VAR', '_VAR._VAR', 'g') WHEN category = 'type_guard' THEN regexp_replace(regexp_replace(p, 'typeof\s+\w+', 'typeof _VAR', 'g'), '\w+\s+instanceof\s+', '_VAR instanceof ', 'g')
  WHEN category IN ('null_check', 'null_safety', 'range_check', 'length_check', 'assert', 'precondition') THEN {_named('p')} ELSE p END, '\s+', ' ', 'g'))"""


@query(
    "P9_cross_symbol",
    f"""WITH b AS {B.BODIES}{_RETURNS}, {MINED}, a AS (SELECT DISTINCT sv_id, expression, strength, split_part(expression, ':', 1) AS category, trim(substr(expression, instr(expression, ':') + 1)) AS p FROM r0 WHERE source_type = 'assertion'),
g AS (SELECT category, {PREDICATE} AS pattern, count(DISTINCT sv_id) AS symbols, max(strength) AS top FROM a GROUP BY 1, 2 HAVING count(DISTINCT sv_id) >= 3), w AS (SELECT *, least(0.95::DOUBLE, top + 0.05 * log2(symbols)) AS boosted FROM g)
SELECT symbols, 'family_pattern:' || category || ':' || pattern || ' (observed in ' || symbols || ' symbols)' AS expression, 'module' AS scope, round(boosted, 6) AS strength FROM w
UNION ALL SELECT symbols, 'global_invariant:' || category || ':' || pattern || ' (universal pattern across ' || symbols || ' symbols)', 'global', round(least(0.98::DOUBLE, boosted + 0.05), 6) FROM w WHERE symbols >= 10""",
)
def cross_symbol(spark, sf_dir):
    none = F.lit(None).cast("array<string>")
    mined = C.mine(B.bodies(spark, sf_dir).withColumn("signature", F.lit("")).withColumn("decorators", none))
    return C.cross_symbol_patterns(mined).withColumn("strength", F.round("strength", 6))


@query(
    "P10_global_auth",
    f"""WITH {DECORATED}, g AS (SELECT DISTINCT sv_id FROM r WHERE starts_with(expression, 'decorator_auth:')), h AS (SELECT DISTINCT sv_id FROM g UNION SELECT p_partkey FROM part WHERE p_partkey % 9 = 0),
t AS (SELECT count(*) AS handlers, count(g.sv_id) AS authenticated FROM h LEFT JOIN g ON g.sv_id = h.sv_id)
SELECT handlers, authenticated, round(authenticated / handlers, 6) AS ratio, 'global_auth:' || round(authenticated / handlers * 100)::INT || '% of route handlers require authentication (' || authenticated || '/' || handlers || ')' AS expression, round(least(0.95::DOUBLE, 0.8 + authenticated / handlers * 0.15), 6) AS strength FROM t WHERE handlers >= 3 AND authenticated / handlers >= 0.7""",
)
def global_auth(spark, sf_dir):
    found = C.findings(B.decorated(spark, sf_dir), C.decorator_findings(F.col("decorators")))
    handlers = found.where("startswith(expression, 'decorator_auth:')").select("sv_id").union(table(spark, sf_dir, "part").where("p_partkey % 9 = 0").select("p_partkey")).distinct()
    return C.global_auth(handlers, found).withColumn("ratio", F.round("ratio", 6)).withColumn("strength", F.round("strength", 6))


# Hints and effects


def _hint_sql() -> str:
    out = []
    for script, rows in ((False, HINT_PATTERNS), (True, SCRIPT_HINT_PATTERNS)):
        for p, kind, detail, languages in rows:
            where = f"language IN ({', '.join(map(q, languages))})" if languages else ("language IN ('typescript', 'javascript')" if script else "language NOT IN ('typescript', 'javascript')")
            out.append(f"SELECT sv_id, '{kind}' AS hint_type, '{detail}' AS detail, line FROM l WHERE {where} AND regexp_matches(text, {q(p)})")
    return " UNION ALL ".join(out)


BLANK = r"""regexp_replace(regexp_replace(CASE WHEN language IN ('python', 'ruby', 'bash') THEN regexp_replace(body, '(?m)#[^\n]*$', '', 'g') ELSE body END, '"[^"\\]*(?:\\.[^"\\]*)*"', '""', 'g'), CASE WHEN language IN ('python', 'ruby', 'bash') THEN '\bno such text\b' ELSE '//[^\n]*' END, ' ', 'g')"""


@query("S20_behaviour_hints", f"WITH b AS (SELECT sv_id, language, start_line, {BLANK} AS body FROM {B.BODIES}), l AS (SELECT sv_id, language, unnest(string_split(body, chr(10))) AS text, (start_line + generate_subscripts(string_split(body, chr(10)), 1) - 1)::INT AS line FROM b) {_hint_sql()}")
def behaviour_hints(spark, sf_dir):
    return E.scan_hints(B.bodies(spark, sf_dir))


def _list_effects(column: str, kind: str, prefix: str) -> str:
    return f"SELECT sv_id, '{kind}' AS kind, '{prefix}' || unnest({column}) AS descriptor FROM p"


FROM_PROFILE = f"""p AS {PROFILES}, e1 AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(_list_effects(c, k, x) for c, made in E.FROM_PROFILE.items() for k, x in made)}
  UNION ALL SELECT sv_id, CASE WHEN regexp_matches(o, '{E.CACHE_WRITE}') THEN 'writes' ELSE 'reads' END, 'cache.' || o FROM (SELECT sv_id, unnest(cache_ops) AS o FROM p)
  UNION ALL SELECT sv_id, 'throws', 'error.' || substr(x, 8) FROM (SELECT sv_id, unnest(exception_profile) AS x FROM p) WHERE starts_with(x, 'throws:')))"""


@query("E1a_profile_effects", f"WITH {FROM_PROFILE} SELECT * FROM e1")
def profile_effects(spark, sf_dir):
    return E.from_profiles(_profiles(spark, sf_dir))


NORMAL = "regexp_replace(regexp_replace(lower(trim({0})), '\\s+', '_', 'g'), '[^a-z0-9_.-]', '', 'g')"
FROM_CONTRACT = f"""e2 AS (SELECT DISTINCT sv_id, 'requires' AS kind, 'auth.' || {NORMAL.format('x')} AS descriptor FROM (SELECT sv_id, unnest(string_split(security_contract, ';')) AS x FROM {B.CONTRACTS} WHERE security_contract <> 'none') WHERE trim(x) <> ''
  UNION SELECT sv_id, 'throws', 'error.' || {NORMAL.format('x')} FROM (SELECT sv_id, unnest(string_split(error_contract, '|')) AS x FROM {B.CONTRACTS} WHERE error_contract <> 'never') WHERE trim(x) <> ''
  UNION SELECT sv_id, 'reads', 'api.' || {NORMAL.format('api_ref')} FROM {B.CONTRACTS})"""


def _contract_effects(spark, sf_dir):
    return E.from_contracts(B.contracts(spark, sf_dir).withColumn("api_contract_refs", F.array("api_ref")))


@query("E1b_contract_effects", f"WITH {FROM_CONTRACT} SELECT * FROM e2")
def contract_effects(spark, sf_dir):
    return _contract_effects(spark, sf_dir)


FROM_HINT = f"""e3 AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(f"SELECT sv_id, '{k}' AS kind, '{x}' || detail AS descriptor FROM {B.HINTS} WHERE hint_type = '{h}'" for h, made in E.FROM_HINT.items() for k, x in made)}
  UNION ALL SELECT sv_id, CASE WHEN regexp_matches(detail, '{E.CACHE_WRITE}') THEN 'writes' ELSE 'reads' END, 'cache.' || detail FROM {B.HINTS} WHERE hint_type = 'cache_op'))"""


@query("E1c_hint_effects", f"WITH {FROM_HINT} SELECT * FROM e3")
def hint_effects(spark, sf_dir):
    return E.from_hints(B.hints(spark, sf_dir))


def _patterns_sql() -> str:
    out = []
    for p, languages, effects in EFFECT_PATTERNS:
        where = f"language IN ({', '.join(map(q, languages))})" if languages else "language NOT IN ('typescript', 'javascript')"
        out += [f"SELECT sv_id, '{k}' AS kind, '{d}' AS descriptor FROM b WHERE {where} AND regexp_matches(body, {q(p)})" for k, d in effects]
    return " UNION ".join(out)


FROM_PATTERN = f"b AS (SELECT sv_id, language, {BLANK} AS body FROM {B.BODIES} WHERE kind <> 'class'), e4 AS ({_patterns_sql()})"


@query("E1d_pattern_effects", f"WITH {FROM_PATTERN} SELECT * FROM e4")
def pattern_effects(spark, sf_dir):
    return E.from_patterns(B.bodies(spark, sf_dir))


EFFECTS = f"{FROM_PROFILE}, {FROM_CONTRACT}, {FROM_HINT}, {FROM_PATTERN}, eff AS (SELECT * FROM e1 UNION SELECT * FROM e2 UNION SELECT * FROM e3 UNION SELECT * FROM e4)"
CLASS = """CASE WHEN bool_or(kind IN ('emits', 'acquires_lock') OR (kind = 'writes' AND contains(descriptor, 'transaction'))) THEN 'full_side_effect' WHEN bool_or(kind = 'calls_external') THEN 'io' WHEN bool_or(kind IN ('writes', 'mutates', 'opens')) THEN 'writer'
  WHEN bool_or(kind IN ('reads', 'requires', 'throws', 'normalizes', 'logs')) THEN 'reader' ELSE 'pure' END"""
_SIG = {"reads_resources": "reads", "writes_resources": "writes", "emits_events": "emits", "calls_external": "calls_external", "mutates_state": "mutates", "requires_auth": "requires", "throws_errors": "throws"}


def _effects(spark, sf_dir):
    return E.merge(E.from_profiles(_profiles(spark, sf_dir)), _contract_effects(spark, sf_dir), E.from_hints(B.hints(spark, sf_dir)), E.from_patterns(B.bodies(spark, sf_dir)))


@query("E1e_signatures", f"WITH {EFFECTS} SELECT sv_id, {CLASS} AS effect_class, count(*) AS n_effects, {', '.join(f'''coalesce(string_agg(CASE WHEN kind = '{k}' THEN descriptor END, ',' ORDER BY descriptor), '') AS {c}''' for c, k in _SIG.items())} FROM eff GROUP BY sv_id")
def effect_signatures(spark, sf_dir):
    made = E.signatures(_effects(spark, sf_dir))
    return made.select("sv_id", "effect_class", "n_effects", *[F.array_join(c, ",").alias(c) for c in _SIG])


@query("E1f_merged_effects", f"WITH {EFFECTS}, x AS (SELECT sv_id, kind, descriptor, 'direct' AS provenance FROM eff UNION ALL SELECT sv_id + 1, kind, descriptor, 'transitive' FROM eff) SELECT sv_id, kind, descriptor, min(provenance) AS provenance FROM x GROUP BY 1, 2, 3")
def merged_effects(spark, sf_dir):
    own = _effects(spark, sf_dir)
    return E.merge(own, own.withColumn("sv_id", F.col("sv_id") + 1).withColumn("provenance", F.lit("transitive")))


@query("E1g_normal_descriptor", f"SELECT p_partkey, {NORMAL.format(chr(39) + '  ' + chr(39) + ' || p_brand || ' + chr(39) + ' / ' + chr(39) + ' || p_name')} AS descriptor FROM part")
def normal_descriptor(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", E.normal_descriptor(F.concat(F.lit("  "), "p_brand", F.lit(" / "), "p_name")).alias("descriptor"))


@query("E2_effect_class", f"WITH {EFFECTS} SELECT effect_class, count(*) AS n FROM (SELECT sv_id, {CLASS} AS effect_class FROM eff GROUP BY sv_id) GROUP BY effect_class")
def effect_class(spark, sf_dir):
    return E.signatures(_effects(spark, sf_dir)).groupBy("effect_class").agg(F.count(F.lit(1)).alias("n"))


@query("E3_effect_confidence", "SELECT p_partkey, round(least(0.95, 0.5 + CASE WHEN p_size % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 0.15 ELSE 0 END + CASE WHEN p_size % 5 > 0 THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS confidence FROM part")
def effect_confidence(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(E.confidence(s % 2 == 0, s % 3 == 0, s % 5 > 0), 6).alias("confidence"))


_EC_RANK = "CASE {0} WHEN 'pure' THEN 0 WHEN 'reader' THEN 1 WHEN 'writer' THEN 2 WHEN 'io' THEN 3 ELSE 4 END"


@query(
    "E4_effect_diff",
    f"""WITH {FROM_PROFILE}, {FROM_HINT}, k AS (SELECT coalesce(a.sv_id, b.sv_id) AS sv_id, coalesce(a.kind, b.kind) AS kind, coalesce(a.descriptor, b.descriptor) AS descriptor, a.sv_id IS NULL AS added, b.sv_id IS NULL AS removed FROM e1 a FULL JOIN (SELECT sv_id + 1 AS sv_id, kind, descriptor FROM e3) b ON a.sv_id = b.sv_id AND a.kind = b.kind AND a.descriptor = b.descriptor),
s AS (SELECT sv_id, count(*) FILTER (WHERE added) AS n_added, count(*) FILTER (WHERE removed) AS n_removed FROM k GROUP BY sv_id),
ca AS (SELECT sv_id, {CLASS} AS c FROM e1 GROUP BY sv_id), cb AS (SELECT sv_id + 1 AS sv_id, {CLASS} AS c FROM e3 GROUP BY sv_id)
SELECT s.sv_id, n_added::INT AS n_added, n_removed::INT AS n_removed, coalesce(ca.c, 'pure') AS class_before, coalesce(cb.c, 'pure') AS class_after, CASE WHEN {_EC_RANK.format("coalesce(cb.c, 'pure')")} > {_EC_RANK.format("coalesce(ca.c, 'pure')")} THEN 'escalated' WHEN {_EC_RANK.format("coalesce(cb.c, 'pure')")} < {_EC_RANK.format("coalesce(ca.c, 'pure')")} THEN 'deescalated' ELSE 'unchanged' END AS class_direction
FROM s LEFT JOIN ca ON ca.sv_id = s.sv_id LEFT JOIN cb ON cb.sv_id = s.sv_id""",
)
def effect_diff(spark, sf_dir):
    before = E.from_profiles(_profiles(spark, sf_dir))
    after = E.from_hints(B.hints(spark, sf_dir)).withColumn("sv_id", F.col("sv_id") + 1)
    return E.difference(before, after).select("sv_id", F.size("added").alias("n_added"), F.size("removed").alias("n_removed"), "class_before", "class_after", "class_direction")


# Uncertainty

_IMPACT = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in P.IMPACTS.items()) + f" ELSE {P.UNKNOWN_IMPACT}::DOUBLE END"
_SOURCES = (*P.IMPACTS, "unknown_flag")
_FLAG_LIST = ", ".join(map(q, _SOURCES))
_FLAGS = f"(SELECT p_partkey AS sv_id, p_brand AS snapshot, list_value({_FLAG_LIST})[1 + (p_partkey * 7 + p_size) % 13] AS f1, list_value({_FLAG_LIST})[1 + (p_partkey * 3) % 13] AS f2, p_size % 3 AS n FROM part)"


def _flagged(spark, sf_dir):
    pick = lambda e: F.element_at(F.array(*map(F.lit, _SOURCES)), (1 + e % 13).cast("int"))
    k, s = F.col("p_partkey"), F.col("p_size")
    f1, f2 = pick(k * 7 + s), pick(k * 3)
    flags = F.when(s % 3 == 0, F.array().cast("array<string>")).when(s % 3 == 1, F.array(f1)).otherwise(F.array(f1, f2, f1))
    return table(spark, sf_dir, "part").select(k.alias("sv_id"), F.col("p_brand").alias("snapshot"), flags.alias("uncertainty_flags"))


_LONG = f"SELECT sv_id, snapshot, f1 AS source FROM {_FLAGS} WHERE n > 0 UNION ALL SELECT sv_id, snapshot, f2 FROM {_FLAGS} WHERE n = 2 UNION ALL SELECT sv_id, snapshot, f1 FROM {_FLAGS} WHERE n = 2"
SYMBOL_CONFIDENCE = f"(SELECT p.sv_id, p.snapshot, greatest(0.1::DOUBLE, coalesce(c, 1.0::DOUBLE)) AS confidence, n FROM {_FLAGS} p LEFT JOIN (SELECT sv_id, product(1 - {_IMPACT}) AS c FROM (SELECT DISTINCT sv_id, source FROM ({_LONG})) GROUP BY sv_id) x ON x.sv_id = p.sv_id)"


@query("U1_snapshot_confidence", f"WITH l AS ({_LONG}), i AS (SELECT snapshot, source, {_IMPACT} AS i, row_number() OVER (PARTITION BY snapshot, source ORDER BY sv_id) AS rn FROM l) SELECT snapshot, round(greatest(0.1::DOUBLE, product(CASE WHEN rn = 1 THEN 1 - i ELSE 1 - 0.3 * i END)), 6) AS confidence FROM i GROUP BY snapshot")
def snapshot_confidence(spark, sf_dir):
    rows = _flagged(spark, sf_dir).select("snapshot", F.explode("uncertainty_flags").alias("source"))
    return P.snapshot_confidence(rows.withColumn("impact", P.impact_of(F.col("source"))), "snapshot").withColumn("confidence", F.round("confidence", 6))


@query("U2_symbol_confidence", f"SELECT sv_id, round(confidence, 6) AS confidence FROM {SYMBOL_CONFIDENCE}")
def symbol_confidence(spark, sf_dir):
    return _flagged(spark, sf_dir).select("sv_id", F.round(P.symbol_confidence(F.col("uncertainty_flags")), 6).alias("confidence"))


@query("U3_uncertainty_by_source", f"SELECT snapshot, source, count(*) AS annotations, count(DISTINCT sv_id) AS symbols FROM ({_LONG}) GROUP BY 1, 2")
def uncertainty_by_source(spark, sf_dir):
    return P.uncertainty_report(_flagged(spark, sf_dir), "snapshot")[0]


@query("U3_least_certain", f"SELECT snapshot, sv_id, round(confidence, 6) AS confidence, rn::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY round(confidence, 9), sv_id) AS rn FROM {SYMBOL_CONFIDENCE} WHERE n > 0) WHERE rn <= 20")
def least_certain(spark, sf_dir):
    return P.uncertainty_report(_flagged(spark, sf_dir), "snapshot")[1].withColumn("confidence", F.round("confidence", 6))
