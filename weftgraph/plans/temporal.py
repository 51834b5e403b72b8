"""Queries on change histories."""

from pyspark.sql import functions as F

from weftgraph.operators import temporal as T
from weftgraph.plans import bindings as B
from weftgraph.plans.registry import query
from weftgraph.sources.tables import table

COMMITS = """(SELECT DISTINCT l_orderkey AS commit_id, l_partkey AS symbol_id, o_orderdate AS at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def pairs_sql(commits: str, cap: int = 50) -> str:
    return f"""WITH c AS {commits},
n AS (SELECT symbol_id, count(*) AS total FROM c GROUP BY symbol_id),
r AS (SELECT *, row_number() OVER (PARTITION BY commit_id ORDER BY symbol_id) AS rn FROM c),
p AS (SELECT a.symbol_id AS symbol_a, b.symbol_id AS symbol_b, count(*) AS co_change_count,
        min(a.at) AS first_co_change, max(a.at) AS last_co_change
      FROM r a JOIN r b ON a.commit_id = b.commit_id AND a.symbol_id < b.symbol_id
      WHERE a.rn <= {cap} AND b.rn <= {cap} GROUP BY 1, 2 HAVING count(*) >= 2),
j AS (SELECT symbol_a, symbol_b, co_change_count, na.total AS total_a, nb.total AS total_b,
        round(co_change_count / (na.total + nb.total - co_change_count), 6) AS jaccard,
        first_co_change, last_co_change
      FROM p JOIN n na ON na.symbol_id = symbol_a JOIN n nb ON nb.symbol_id = symbol_b)"""


PAIRS = pairs_sql(COMMITS)


def commits(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).selectExpr(
        "l_orderkey AS commit_id", "l_partkey AS symbol_id", "o_orderdate AS at"
    )


@query("M1_co_change_pairs", f"{PAIRS} SELECT * FROM j")
def co_change_pairs(spark, sf_dir):
    return T.co_change_pairs(commits(spark, sf_dir))


DAYS = "(SELECT DISTINCT date_trunc('hour', ts) AS commit_id, user_id AS symbol_id, date_trunc('hour', ts) AS at FROM events)"


def _hours(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("commit_id"), F.col("user_id").alias("symbol_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("at"))


@query("M1_co_change_capped", f"{pairs_sql(DAYS, 5)} SELECT * FROM j")
def co_change_capped(spark, sf_dir):
    """Commits are hours and symbols users, so that the cap (5 here) cuts in."""
    return T.co_change_pairs(_hours(spark, sf_dir), cap=5)


@query("M2_co_change_relations", f"{PAIRS}, s AS (SELECT symbol_a AS src, symbol_b AS dst, round(jaccard, 3) AS confidence FROM j WHERE jaccard >= 0.05) SELECT * FROM s UNION ALL SELECT dst, src, confidence FROM s")
def co_change_relations(spark, sf_dir):
    """At a threshold of .05; at the usual .25 these data have few pairs."""
    return T.co_change_relations(T.co_change_pairs(commits(spark, sf_dir)), 0.05)


@query("M4_partners", f"{PAIRS} SELECT CASE WHEN symbol_a = 7 THEN symbol_b ELSE symbol_a END AS partner, co_change_count, jaccard FROM j WHERE (symbol_a = 7 OR symbol_b = 7) AND jaccard >= 0.01 ORDER BY jaccard DESC, partner LIMIT 500")
def partners(spark, sf_dir):
    return T.partners(T.co_change_pairs(commits(spark, sf_dir)), 7, 0.01)


RISK = f"""WITH c AS {B.COMMITS}, k AS (SELECT symbol_id, commit_id, min("at") AS "at", min(author) AS author, bool_or(is_bug_fix) AS fix, bool_or(is_revert) AS rev FROM c GROUP BY 1, 2),
g AS (SELECT *, fix AND date_diff('day', lag("at") OVER (PARTITION BY symbol_id, fix ORDER BY "at", commit_id), "at") <= 30 AS close FROM k),
s AS (SELECT symbol_id, count(*) AS change_frequency, count(*) FILTER (WHERE fix) AS bug_fix_count, count(*) FILTER (WHERE close) + count(*) FILTER (WHERE rev) AS regression_count,
  count(*) FILTER (WHERE "at" >= (SELECT max("at") FROM c) - INTERVAL 30 DAY) AS recent_churn_30d, count(DISTINCT author) AS distinct_authors, max("at") AS last_change FROM g GROUP BY symbol_id),
t AS (SELECT symbol_id, change_frequency, bug_fix_count, regression_count, recent_churn_30d, distinct_authors, round(0.25::DOUBLE * change_frequency / (SELECT max(change_frequency) FROM s) + 0.30::DOUBLE * bug_fix_count / (SELECT max(bug_fix_count) FROM s) + 0.20::DOUBLE * regression_count / (SELECT max(regression_count) FROM s)
  + 0.15::DOUBLE * recent_churn_30d / (SELECT max(recent_churn_30d) FROM s) + 0.10::DOUBLE * distinct_authors / (SELECT max(distinct_authors) FROM s), 4) AS composite_risk, last_change FROM s)"""


def _risks(spark, sf_dir):
    rows = B.commits(spark, sf_dir)
    now = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(table(spark, sf_dir, "orders"), "o_orderkey").agg(F.max("o_orderdate").alias("now"))
    return T.risk_scores(rows, now)


@query("M3_risk_scores", f"{RISK} SELECT * FROM t")
def risk_scores(spark, sf_dir):
    return _risks(spark, sf_dir).withColumn("last_change", F.col("last_change").cast("timestamp_ntz"))


@query("M5_ownership", f"WITH c AS {B.COMMITS}, n AS (SELECT symbol_id, author, count(*) AS n FROM c GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY symbol_id) AS total, count(*) OVER (PARTITION BY symbol_id) AS authors, row_number() OVER (PARTITION BY symbol_id ORDER BY n DESC, author) AS rn FROM n) SELECT symbol_id, author AS primary_owner, CASE WHEN authors = 1 OR round(n / total * 100, 2) >= 80 THEN 'sole' ELSE 'shared' END AS ownership_type, round(n / total * 100, 2) AS share, authors FROM r WHERE rn = 1")
def ownership(spark, sf_dir):
    return T.ownership(B.commits(spark, sf_dir).select("symbol_id", "author"))


@query("M6_top_risks", f"{RISK} SELECT symbol_id, p_name AS name, composite_risk FROM (SELECT * FROM t ORDER BY composite_risk DESC, symbol_id LIMIT 50) LEFT JOIN part ON p_partkey = symbol_id")
def top_risks(spark, sf_dir):
    return T.top_risks(_risks(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name")))


@query("M7_risk_lookup", f"{RISK} SELECT symbol_id, composite_risk FROM t WHERE symbol_id = 42")
def risk_lookup(spark, sf_dir):
    return _risks(spark, sf_dir).where("symbol_id = 42").select("symbol_id", "composite_risk")


@query("M8_file_symbols", "SELECT DISTINCT p_brand AS path, p_name AS symbol_id FROM part")
def file_symbols(spark, sf_dir):
    return T.file_symbols(table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_name").alias("symbol_id")))
