"""Logical inputs of the analyses, bound to the standard tables; each has a SQL twin for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.sources.tables import table

_FIRST, _SECOND = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
_NAME = f"""concat({_FIRST}, upper(substr({_SECOND}, 1, 1)), substr({_SECOND}, 2),
  CASE p_size % 4 WHEN 0 THEN 'Handler' WHEN 1 THEN '_service' WHEN 2 THEN 'XMLParser' ELSE '' END,
  CASE WHEN p_size % 5 = 0 THEN cast(p_size AS STRING) ELSE '' END)"""
_SYMBOLS = f"""SELECT p_partkey AS sv_id, {_NAME} AS name, lower(p_type) AS kind, p_size AS line_span,
  concat('src/', lower(replace(p_brand, '#', '')), '/', {_SECOND}, '.ts') AS file_path,
  concat({_FIRST}, '(item: ', {_SECOND}, CASE WHEN p_size % 2 = 0 THEN ', size: number' ELSE '' END, '): ',
    CASE p_size % 3 WHEN 0 THEN 'Result' WHEN 1 THEN 'void' ELSE {_SECOND} END) AS signature,
  concat('src/', lower(replace(p_brand, '#', '')), '.ts', CASE p_size % 3 WHEN 0 THEN '#' ELSE '::' END,
    CASE WHEN p_size % 2 = 0 THEN concat(upper(substr({_SECOND}, 1, 1)), substr({_SECOND}, 2), '.') ELSE '' END, {_FIRST}) AS stable_key
FROM part"""

#: Named SQL views, for oracles: every text uses functions that both engines share.
SYMBOLS = f"({_SYMBOLS.replace('STRING', 'VARCHAR')})"


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol versions from `part`: sv_id, name, kind, line_span, file_path, signature, stable_key."""
    return spark.sql(_SYMBOLS.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))


_COMMITS = """SELECT DISTINCT l_orderkey AS commit_id, l_partkey AS symbol_id, o_orderdate AS at, o_custkey AS author,
  l_returnflag = 'R' AS is_bug_fix, l_returnflag = 'A' AND l_linestatus = 'F' AS is_revert
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
COMMITS = f"""(SELECT commit_id, symbol_id, "at", author, bool_or(is_bug_fix) AS is_bug_fix, bool_or(is_revert) AS is_revert
  FROM ({_COMMITS.replace('AS at', 'AS "at"')}) GROUP BY commit_id, symbol_id, "at", author)"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touched symbols of commits from lineitem and orders: commit_id, symbol_id, at, author, is_bug_fix, is_revert."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return rows.groupBy(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("symbol_id"), F.col("o_orderdate").alias("at"), F.col("o_custkey").alias("author")).agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("is_bug_fix"),
        F.bool_or((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")).alias("is_revert"),
    )


_EDGES = """SELECT a AS src, b AS dst, CASE (a + b) % 4 WHEN 0 THEN 'calls' WHEN 1 THEN 'references' WHEN 2 THEN 'imports' ELSE 'calls' END AS relation_type,
  round(0.5 + ((a * 7 + b) % 50) / 100.0, 2) AS confidence
FROM (SELECT DISTINCT l_partkey AS a, (l_partkey * 3 + l_suppkey % 4) % 499 AS b FROM lineitem) WHERE a <> b"""
EDGES = f"({_EDGES.replace('100.0', '100.0::DOUBLE').replace('round(0.5 +', 'round(0.5::DOUBLE +')})"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed relations between parts, one to four of each, from all of lineitem: src, dst, relation_type, confidence."""
    text = _EDGES.replace("FROM lineitem", "FROM {lineitem}").replace("100.0", "100D").replace("0.5 +", "0.5D +")
    return spark.sql(text, lineitem=table(spark, sf_dir, "lineitem"))


#: All hint types occur; a part has few, so that all purities occur too.
HINT_TYPES = ("db_read", "db_write", "network_call", "file_io", "cache_op", "cache_write", "auth_check", "validation", "throws", "catches", "state_mutation", "transaction", "acquires_lock", "concurrency", "serialization", "logging")
_HINTS = f"""SELECT l_partkey AS sv_id, concat('r', l_suppkey % 5) AS detail,
  element_at(array({", ".join(f"'{h}'" for h in HINT_TYPES)}), cast(1 + (l_partkey * 5 + l_partkey % 3 * (l_suppkey % 4)) % 16 AS INT)) AS hint_type
FROM lineitem"""
HINTS = "(" + _HINTS.replace("element_at(array(", "list_extract(list_value(").replace("AS INT", "AS BIGINT") + ")"


def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behaviour hints of parts from all of lineitem, of one to four types each: sv_id, hint_type, detail."""
    return spark.sql(_HINTS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


_CONTRACTS = """SELECT p_partkey AS sv_id, concat('(', split_part(p_name, ' ', 1), ', ', split_part(p_name, ' ', 2), ')') AS input_contract,
  CASE p_size % 3 WHEN 0 THEN 'Result' WHEN 1 THEN 'void' ELSE split_part(p_name, ' ', 2) END AS output_contract,
  CASE p_size % 4 WHEN 0 THEN 'never' WHEN 1 THEN 'TypeError' ELSE 'Error | RangeError' END AS error_contract,
  CASE p_size % 5 WHEN 0 THEN 'auth:admin' WHEN 1 THEN 'role(user)' ELSE 'none' END AS security_contract,
  CASE p_size % 2 WHEN 0 THEN 'none' ELSE 'json' END AS serialization_contract, p_brand AS schema_ref, p_type AS api_ref FROM part"""
CONTRACTS = f"({_CONTRACTS})"


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract profiles of parts: sv_id, five contract strings, schema_ref, api_ref."""
    return spark.sql(_CONTRACTS.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))


_INFERRED = """SELECT src, dst, relation_type, confidence, review_state, valid_to FROM (SELECT a AS src, b AS dst, round(0.25D + ((a * 7 + b * 3) % 70) / 100D, 2) AS confidence,
  CASE (a + b) % 5 WHEN 0 THEN 'co_changed_with' WHEN 1 THEN 'contract_sibling' ELSE 'near_duplicate_logic' END AS relation_type,
  CASE (a * b) % 7 WHEN 0 THEN 'rejected' ELSE 'unreviewed' END AS review_state, CASE (a + b) % 11 WHEN 0 THEN 9 END AS valid_to
FROM (SELECT DISTINCT least(l_partkey, o) AS a, greatest(l_partkey, o) AS b FROM (SELECT l_partkey, l_partkey - l_partkey % 12 + l_suppkey % 12 AS o FROM lineitem) WHERE l_partkey <> o))"""
INFERRED = "(" + _INFERRED.replace("0.25D", "0.25::DOUBLE").replace("100D", "100::DOUBLE") + ")"


def inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inferred relations between parts of one dozen: src < dst, relation_type, confidence, review_state, valid_to."""
    return spark.sql(_INFERRED.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


_INVARIANTS = """SELECT l_partkey AS sv_id, concat('quantity <= ', cast(l_quantity AS INT)) AS expression, max(round(0.6 + l_discount * 4, 2)) AS strength FROM lineitem GROUP BY 1, 2"""
INVARIANTS = f"({_INVARIANTS})"


def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of parts: sv_id, expression, strength."""
    return spark.sql(_INVARIANTS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


_ARTIFACTS = "SELECT o_orderkey AS artifact, min(o_custkey) AS test, array_sort(collect_set(l_partkey)) AS related FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"
ARTIFACTS = "(" + _ARTIFACTS.replace("array_sort(collect_set(l_partkey))", "list_sort(list(DISTINCT l_partkey))") + ")"


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests from all orders: artifact, test (its symbol), related (symbols)."""
    return spark.sql(_ARTIFACTS.replace("FROM orders JOIN lineitem", "FROM {orders} JOIN {lineitem}"), orders=table(spark, sf_dir, "orders"), lineitem=table(spark, sf_dir, "lineitem"))


#: Lines of code of which bodies are made; no line has a quote of the SQL kind.
CODE_LINES = (
    "if (!input) { throw new Error(x) }", "if (user === null) return", "assert(count > check(total))", "console.assert(items.length)", "invariant(state)", "precondition(ready(a))",
    'if (typeof value === "string") {}', "if (err instanceof TypeError) {}", "Array.isArray(rows)", "Number.isNaN(score)", "isFinite(ratio)", "const a = name ?? fallback", "user?.profile",
    "if (node !== undefined) {}", "if (head != null) {}", "Math.max(0, Math.min(10, size))", "if (age < 18) {}", "if (list.length >= 3) {}", "Math.max(1, width)", "Math.min(9, height)",
    "/^[a-z]+$/.test(name)", "code.match(/^[0-9]{4}$/)", '["a", "b"].includes(kind)', "name.trim()", "key.toLowerCase()", "tag.toUpperCase()", 'path.replace("/", sep)', "parseInt(raw, 10)",
    "parseFloat(raw)", "Number(raw)", "JSON.parse(text)", "id: { type: String, required: true }", "z.string().min(3).email()", "z.number().int().positive()", "yup.string().required().max(20)",
    "Joi.number().min(1).valid(1, 2)", "const f = (a) => a", "function inner(a) {", "return null;", "return [a, b];", "return function () {};", "this.total = 1", "self.cache.get(key)",
    "db.findOne(id)", "repo.saveAll(rows)", "axios.get(url)", "fs.readFile(path)", "logger.info(x)", "verifyToken(t)", "mutex.lock()", "events.emit(x)", "this.repo.find(id)",
    "private repo: Repository;", "this.client = new Client()",
)
LANGUAGES = ("typescript", "python", "java", "rust", "ruby", "go")


def _braced(text: str) -> str:
    """Braces doubled, as parametrised SQL wants them."""
    return text.replace("{", "{{").replace("}", "}}")


def _pick(step: int) -> str:
    lines = ", ".join(f"'{x}'" for x in CODE_LINES)
    return f"element_at(array({lines}), cast(1 + (p_partkey * {step} + p_size) % {len(CODE_LINES)} AS INT))"


_BODIES = f"""SELECT p_partkey AS sv_id, element_at(array({", ".join(f"'{x}'" for x in LANGUAGES)}), cast(1 + p_size % {len(LANGUAGES)} AS INT)) AS language, {_NAME} AS name,
  CASE p_size % 7 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'method' END AS kind, p_size AS start_line, concat_ws(chr(10), {", ".join(_pick(s) for s in (1, 5, 7, 11, 13))}) AS body FROM part"""
BODIES = "(" + _BODIES.replace("element_at(array(", "list_extract(list_value(").replace("AS INT", "AS BIGINT").replace("AS STRING", "AS VARCHAR") + ")"


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code of parts: sv_id, language, name, kind, start_line, body."""
    return spark.sql(_braced(_BODIES).replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))


_SIGNATURES = (
    "get(id: string, depth?: number): Promise<User>", "run(): void", "find(keys: string[], limit: number = 5): User | null", "wrap<T extends Base>(value: T): T", "fail(reason: Error): never",
    "map(items: Map<string, number>, each: (a: string) => void): boolean", "load(flag: boolean | undefined, last?: Date, path: String)", "kind(): string | number | boolean", "all(rows: Array<Row>, done: Promise<void>): Row[]",
)
_SIGNED = f"SELECT p_partkey AS sv_id, element_at(array({', '.join(repr(s) for s in _SIGNATURES)}), cast(1 + p_partkey % {len(_SIGNATURES)} AS INT)) AS signature FROM part"
SIGNED = "(" + _SIGNED.replace("element_at(array(", "list_extract(list_value(").replace("AS INT", "AS BIGINT") + ")"


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of parts: sv_id, signature."""
    return spark.sql(_braced(_SIGNED).replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))


_DECORATORS = ("@IsEmail()", "@Min(3)", "@Max(9.5)", "@MinLength(2)", "@Length(1, 30)", "@Length(4)", '@Roles("admin")', "@Authenticated()", '@Column({ type: "varchar", length: 255 })', '@Column({ type: "int" })', '@RateLimit(100, "1m")', "@Validate(x)", "@IsOptional()")
_DECORATED = f"""SELECT p_partkey AS sv_id, array({", ".join(f"element_at(array({', '.join(repr(d) for d in _DECORATORS)}), cast(1 + (p_partkey * {s}) % {len(_DECORATORS)} AS INT))" for s in (1, 2, 4))}) AS decorators FROM part"""
DECORATED = "(" + _DECORATED.replace("element_at(array(", "list_extract(list_value(").replace("AS INT", "AS BIGINT").replace("sv_id, array(", "sv_id, list_value(") + ")"


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decorators of parts: sv_id, decorators."""
    return spark.sql(_braced(_DECORATED).replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
