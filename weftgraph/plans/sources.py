"""Sources, extraction and streams as queries."""

from pyspark.sql import functions as F

from weftgraph.functions import code as K
from weftgraph.plans import bindings as B
from weftgraph.plans.registry import query
from weftgraph.sources import extract as X
from weftgraph.sources import files as D
from weftgraph.sources import gitlog as G
from weftgraph.sources.ship import ship
from weftgraph.sources.tables import table
from weftgraph.streaming import queries as Q


@query("S1_file_walk")
def file_walk(spark, sf_dir):
    """Small files of the data folder itself, by name and size; names differ between file systems, so there is no SQL twin."""
    return D.all_files(spark, sf_dir).where(F.col("size") <= D.MAX_FILE_BYTES).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "size", F.sha2("content", 256).alias("content_hash"))


@query("S2_workspace", f"SELECT 'src/' || lpad(CAST(sv_id AS VARCHAR), 9, '0') AS path, length(body)::INT AS size, language, (SELECT count(*) FROM part) > 20000 AS truncated FROM {B.BODIES} ORDER BY path LIMIT 20000")
def workspace(spark, sf_dir):
    """The listing's own limit is 20,000 files."""
    files = B.bodies(spark, sf_dir).select(F.concat(F.lit("src/"), F.lpad(F.col("sv_id").cast("string"), 9, "0")).alias("path"), F.length("body").alias("size"), "language")
    return D.discover(files)


_RECORD = "concat(md5(cast(o_orderkey AS STRING)), '00000000', chr(1), 'A', o_custkey, chr(1), CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE concat('a', o_custkey, '@x') END, chr(1), CASE WHEN o_orderkey % 40 = 0 THEN 'never' ELSE '2024-01-02T03:04:05Z' END, chr(1), CASE o_orderkey % 4 WHEN 0 THEN 'Fix it' WHEN 1 THEN 'Merge branch x' ELSE 'Add' END, chr(1), 'src/a', o_orderkey % 9, '.ts', chr(1), 'dist/b.js')"


@query(
    "S5_git_log",
    "SELECT md5(CAST(o_orderkey AS VARCHAR)) || '00000000' AS hash, 'a' || o_custkey || '@x' AS author_email, 'src/a' || (o_orderkey % 9) || '.ts' AS files, o_orderkey % 4 = 0 AS is_bug_fix, o_orderkey % 4 = 1 AS is_merge FROM orders WHERE o_orderkey % 50 > 0 AND o_orderkey % 40 > 0",
)
def git_log(spark, sf_dir):
    """Records made from orders: some lack an author, some have no date, all name a build file that is left out."""
    records = table(spark, sf_dir, "orders").select(F.replace(F.expr(_RECORD), F.lit("\u0001"), F.lit("\u0000")).alias("record"))
    return G.parse_records(records).select("hash", "author_email", F.array_join("files", ",").alias("files"), "is_bug_fix", "is_merge")


def _code(spark, sf_dir):
    name = F.concat(F.lit("f"), "p_partkey")
    python = F.concat(F.lit("import os\nclass C:\n    def "), name, F.lit("(self, a: int) -> str:\n        if a:\n            raise ValueError(a)\n        return os.getcwd()\n"))
    script = F.concat(F.lit('import fs from "fs";\nexport function '), name, F.lit("(path: string): Buffer {\n  if (!path) { throw new TypeError(path) }\n  return fs.readFileSync(path);\n}\n"))
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k, F.concat(F.lit("f"), k, F.when(k % 2 == 0, ".py").otherwise(".ts")).alias("path"), F.when(k % 2 == 0, "python").otherwise("typescript").alias("language"), F.when(k % 2 == 0, python).otherwise(script).alias("text"))


@query("S6_script_symbols", "SELECT 'f' || p_partkey || '.ts' AS path, 'f' || p_partkey AS name, 'function' AS kind, 2 AS start_line, 5 AS end_line FROM part WHERE p_partkey % 2 = 1")
def script_symbols(spark, sf_dir):
    return X.symbols(X.extract(_code(spark, sf_dir).where("language = 'typescript'"))).select("path", "name", "kind", "start_line", "end_line")


@query("S7_resolved_hints", "SELECT 'f' || p_partkey || '.ts' AS path, 'file_io' AS hint_type, 'read_file' AS detail, 4 AS line FROM part WHERE p_partkey % 2 = 1")
def resolved_hints(spark, sf_dir):
    return X.resolved_hints(_code(spark, sf_dir).where("language = 'typescript'"))


@query("S8_python_symbols", "SELECT 'f' || p_partkey || '.py' AS path, unnest(['C', 'C.f' || p_partkey]) AS name, unnest(['class', 'method']) AS kind FROM part WHERE p_partkey % 2 = 0")
def python_symbols(spark, sf_dir):
    return X.symbols(X.extract(_code(spark, sf_dir).where("language = 'python'"))).select("path", "name", "kind")


@query("S9_all_languages", "SELECT CASE p_partkey % 2 WHEN 0 THEN 'python' ELSE 'typescript' END AS language, sum(CASE p_partkey % 2 WHEN 0 THEN 2 ELSE 1 END)::BIGINT AS symbols FROM part GROUP BY 1")
def all_languages(spark, sf_dir):
    return X.symbols(X.extract(_code(spark, sf_dir))).groupBy("language").agg(F.count(F.lit(1)).alias("symbols"))


@query("S21_contract_hints", "SELECT p_partkey % 2 = 0 AS is_python, count(*) AS n, min(CASE WHEN p_partkey % 2 = 0 THEN 'int' ELSE 'string' END) AS input, min(CASE WHEN p_partkey % 2 = 0 THEN 'str' ELSE 'Buffer' END) AS output, min(CASE WHEN p_partkey % 2 = 0 THEN 'ValueError' ELSE 'TypeError' END) AS thrown FROM part GROUP BY 1")
def contract_hints(spark, sf_dir):
    rows = X.contracts(X.extract(_code(spark, sf_dir)))
    return rows.groupBy(F.col("key").contains(".py#").alias("is_python")).agg(F.count(F.lit(1)).alias("n"), F.min(F.array_join("input_types", ",")).alias("input"), F.min("output_type").alias("output"), F.min(F.array_join("thrown_types", ",")).alias("thrown"))


@query("S22_relations", "SELECT relation_type, target, count(*) AS n FROM (SELECT p_partkey, unnest(CASE p_partkey % 2 WHEN 0 THEN ['imports', 'calls', 'calls'] ELSE ['imports', 'calls', 'calls'] END) AS relation_type, unnest(CASE p_partkey % 2 WHEN 0 THEN ['os', 'ValueError', 'os.getcwd'] ELSE ['fs', 'TypeError', 'fs.readFileSync'] END) AS target FROM part) GROUP BY 1, 2")
def relations(spark, sf_dir):
    return X.relations(X.extract(_code(spark, sf_dir))).groupBy("relation_type", "target").agg(F.count(F.lit(1)).alias("n"))


@query("stream_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, user_id, count(*) AS changes FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = Q.windowed_churn(events, "user_id", "ts", "1 day")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "user_id", "changes")


@query("stream_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, s.s")
def stream_sessions(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return Q.sessions(events).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("C8_blanked_literals")
def blanked_literals(spark, sf_dir):
    """A scan with memory, so there is no SQL twin; tests pin its cases."""
    ship(spark)
    return B.bodies(spark, sf_dir).select("sv_id", K.blank_code(F.col("body"), F.col("language")).alias("code"))


@query("C9_shape_hash")
def shape_hash(spark, sf_dir):
    """Hashes that renaming does not change; tests pin its cases."""
    ship(spark)
    return B.bodies(spark, sf_dir).select("sv_id", K.shape_hash(F.col("body")).alias("shape_hash"))
