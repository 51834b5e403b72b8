"""Scans, joins, aggregates, windows, sorts and sinks."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.operators import graph as G
from weftgraph.operators import relational as R
from weftgraph.plans import bindings as B
from weftgraph.plans.registry import query
from weftgraph.sources.tables import table


@query("S3_content_hash", "SELECT page_id, sha256(html) AS content_hash FROM pages")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("content_hash"))


BASE = "SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _base(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", "r_name")


@query("S10_base_view", f"{BASE} WHERE r_name = 'ASIA'")
def base_view(spark, sf_dir):
    return _base(spark, sf_dir).where("r_name = 'ASIA'")


@query("S11_id_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def id_scan(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return R.id_scan(table(spark, sf_dir, "orders"), ids, "o_custkey").select("o_orderkey", "o_totalprice")


@query("S12_keyset_page", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 101")
def keyset_page(spark, sf_dir):
    return R.keyset_page(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 500, 100)


@query("S13_offset_page", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 50 OFFSET 100")
def offset_page(spark, sf_dir):
    return R.offset_page(table(spark, sf_dir, "part").select("p_partkey", "p_name"), [F.col("p_name"), F.col("p_partkey")], 100, 50)


@query("S14_upsert_greatest", "SELECT k AS part, max({'v': v, 'o': o}).v AS value, max({'v': v, 'o': o}).o AS origin FROM (SELECT p_partkey AS k, p_retailprice AS v, 0 AS o FROM part UNION ALL SELECT l_partkey, l_extendedprice, 1 FROM lineitem WHERE l_linenumber = 1) GROUP BY k")
def upsert(spark, sf_dir):
    old = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("value"), F.lit(0).alias("origin"))
    new = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("value"), F.lit(1).alias("origin"))
    return R.upsert_greatest(old, new, ["part"], "value", ("origin",))


@query("S15_insert_ignore", "SELECT s_suppkey AS key, 'supplier' AS origin FROM supplier UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def insert_ignore(spark, sf_dir):
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.lit("supplier").alias("origin"))
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("customer").alias("origin"))
    return R.insert_ignore(old, new, ["key"])


_SNAPS = """WITH a AS (SELECT CAST(doc_id AS VARCHAR) AS path, md5(text) AS content_hash FROM documents WHERE doc_id % 10 <> 3),
b AS (SELECT CAST(doc_id AS VARCHAR) AS path, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS content_hash FROM documents WHERE doc_id % 11 <> 5)"""


def _snapshots(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), "text", "source")
    a = docs.where("doc_id % 10 <> 3").select("path", F.md5("text").alias("content_hash"), "source")
    b = docs.where("doc_id % 11 <> 5").select("path", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"), "source")
    return a, b


@query("S18_changed_files", f"{_SNAPS} SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'removed' WHEN a.path IS NULL THEN 'added' WHEN a.content_hash = b.content_hash THEN 'copied' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.path = b.path")
def changed_files(spark, sf_dir):
    return R.delta_files(*_snapshots(spark, sf_dir))


@query("S18_delta_copy", f"{_SNAPS} SELECT a.path, a.content_hash FROM a JOIN b ON a.path = b.path AND a.content_hash = b.content_hash")
def delta_copy(spark, sf_dir):
    a, b = _snapshots(spark, sf_dir)
    return R.delta_copy(a.select("path", "content_hash"), a, b)


@query("S19_reindex_paths", f"{_SNAPS} SELECT path, content_hash FROM a WHERE path NOT IN (SELECT b.path FROM a JOIN b ON a.path = b.path WHERE a.content_hash <> b.content_hash) UNION ALL SELECT b.path, b.content_hash FROM a JOIN b ON a.path = b.path WHERE a.content_hash <> b.content_hash")
def reindex_paths(spark, sf_dir):
    a, b = (s.select("path", "content_hash") for s in _snapshots(spark, sf_dir))
    touched = R.delta_files(a, b).where("status = 'changed'").select("path")
    return R.replace_paths(a, b.join(touched, "path", "left_semi"), touched)


@query("S23_parse_confidence", "SELECT p_partkey, round(greatest(0.3::DOUBLE, CASE WHEN p_size % 5 = 0 THEN 1.0::DOUBLE ELSE 1 - 5.0::DOUBLE * (p_size % 5) / (20 + p_size) END), 2) AS confidence FROM part")
def parse_confidence(spark, sf_dir):
    errors, nodes = F.col("p_size") % 5, F.col("p_size") + 20
    value = F.when(errors == 0, 1.0).otherwise(F.greatest(F.lit(0.3), 1 - 5.0 * errors / nodes))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(value, 2).alias("confidence"))


# Joins


@query("J1_star", "SELECT l_orderkey, l_linenumber, p_name, s_name, n_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_quantity > 45")
def star(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    joined = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("l_orderkey", "l_linenumber", "p_name", "s_name", "n_name")


@query("J2_both_ends", f"SELECT src, dst, a.p_name AS src_name, b.p_name AS dst_name FROM {B.EDGES} e JOIN part a ON e.src = a.p_partkey JOIN part b ON e.dst = b.p_partkey")
def both_ends(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    a = names.select(F.col("p_partkey").alias("src"), F.col("p_name").alias("src_name"))
    b = names.select(F.col("p_partkey").alias("dst"), F.col("p_name").alias("dst_name"))
    return B.edges(spark, sf_dir).select("src", "dst").join(a, "src").join(b, "dst")


@query("J3_left", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 GROUP BY c_custkey")
def left(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 400000").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("orders"))


@query("J4_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("J5_anti", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 3 AND l_partkey IS NOT NULL)")
def anti(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_quantity < 3 AND l_partkey IS NOT NULL")
    return table(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("J6_same_class", "SELECT b.p_partkey FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_partkey <> b.p_partkey WHERE a.p_partkey = 5")
def same_class(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    one = part.where("p_partkey = 5").select("p_type")
    return part.where("p_partkey <> 5").join(one, "p_type", "left_semi").select("p_partkey")


_OWNERS = "(SELECT DISTINCT 'Brand' || (p_size % 9) || '.' || split_part(p_name, ' ', 1) AS owner FROM part)"


@query("J7_prefix_join", f"SELECT p_partkey, owner FROM (SELECT p_partkey, 'Brand' || (p_size % 9) || '.' || replace(p_name, ' ', '.') AS member FROM part) JOIN {_OWNERS} ON starts_with(member, owner || '.')")
def prefix_join(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("stem", F.concat(F.lit("Brand"), F.col("p_size") % 9, F.lit(".")))
    members = part.select("p_partkey", F.concat("stem", F.replace("p_name", F.lit(" "), F.lit("."))).alias("member"))
    owners = part.select(F.concat("stem", F.substring_index("p_name", " ", 1)).alias("owner")).distinct()
    return R.members_by_prefix(owners, "owner", members, "member").select("p_partkey", "owner")


@query("J8_either_end", f"SELECT n.c_custkey AS node, CASE WHEN src = n.c_custkey THEN dst ELSE src END AS other, relation_type FROM {B.EDGES} e JOIN customer n ON e.src = n.c_custkey OR e.dst = n.c_custkey")
def either_end(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select("c_custkey")
    return R.touching(B.edges(spark, sf_dir), nodes, "c_custkey").select("node", "other", "relation_type")


@query("J9_json_keys", "SELECT event_id, unnest(json_keys(props)) AS key FROM events")
def json_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.json_object_keys("props")).alias("key"))


@query("J10_array_overlap", "WITH t AS (SELECT conv_id, turn, list_transform(string_split(lower(text), ' ')[1:4], lambda w: substr(md5(w), 1, 3)) AS bands FROM conversations WHERE turn = 0) SELECT a.conv_id AS a, b.conv_id AS b FROM t a JOIN t b ON a.conv_id < b.conv_id AND list_has_any(a.bands, b.bands)")
def array_overlap(spark, sf_dir):
    """Overlap of arrays as an equi-join on their exploded elements."""
    words = F.transform(F.slice(F.split(F.lower("text"), " "), 1, 4), lambda w: F.substring(F.md5(w), 1, 3))
    bands = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", F.explode(F.array_distinct(words)).alias("band"))
    a, b = bands.select(F.col("conv_id").alias("a"), "band"), bands.select(F.col("conv_id").alias("b"), "band")
    return a.join(b, "band").where("a < b").select("a", "b").distinct()


@query("J11_key_cascade", "SELECT key, coalesce((SELECT min(p_partkey) FROM part WHERE p_brand = key), (SELECT min(s_suppkey) FROM supplier WHERE s_name = key), (SELECT min(n_nationkey) FROM nation WHERE n_name = key)) AS id FROM (SELECT p_brand AS key FROM part WHERE p_size = 1 UNION SELECT s_name FROM supplier UNION SELECT n_name FROM nation UNION SELECT c_name FROM customer WHERE c_custkey < 20)")
def key_cascade(spark, sf_dir):
    part, supplier, nation = (table(spark, sf_dir, t) for t in ("part", "supplier", "nation"))
    keys = part.where("p_size = 1").select(F.col("p_brand").alias("key")).union(supplier.select("s_name")).union(nation.select("n_name")).union(table(spark, sf_dir, "customer").where("c_custkey < 20").select("c_name")).distinct()
    return R.resolve_cascade(keys, "key", [(part, "p_brand", "p_partkey"), (supplier, "s_name", "s_suppkey"), (nation, "n_name", "n_nationkey")], "id")


@query(
    "J12_nearest_line",
    """WITH p AS (SELECT DISTINCT p_brand AS file, p_size AS line FROM part WHERE p_partkey % 3 = 0), r AS (SELECT p_brand AS file, p_size AS line, min(p_partkey) AS id FROM part WHERE p_partkey % 3 = 1 GROUP BY 1, 2)
SELECT p.file, p.line, (SELECT arg_min(id, CASE r.line - p.line WHEN 0 THEN 0 WHEN -1 THEN 1 WHEN 1 THEN 2 WHEN -2 THEN 3 ELSE 4 END) FROM r WHERE r.file = p.file AND abs(r.line - p.line) <= 2) AS id FROM p""",
)
def nearest_line(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_size").alias("line"), F.col("p_partkey").alias("id"))
    return R.nearest_line(part.where("id % 3 = 0").select("file", "line").distinct(), part.where("id % 3 = 1"), "file", "line", "id")


_CHAIN = """SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS previous FROM {conversations}"""


@query("J14_recursive_chain", f"WITH RECURSIVE t AS ({_CHAIN.format(conversations='conversations')}), c AS (SELECT id AS start, id, previous, 0 AS depth FROM t UNION ALL SELECT c.start, t.id, t.previous, depth + 1 FROM c JOIN t ON c.previous = t.id WHERE depth < 100) SELECT start, id, depth FROM c")
def recursive_chain(spark, sf_dir):
    return G.lineage_chains(spark.sql(_CHAIN, conversations=table(spark, sf_dir, "conversations")), 101)


# Aggregates


@query("A1_counts", "SELECT p_type AS kind, count(*) AS n FROM part GROUP BY p_type")
def counts(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("A2_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"))


@query("A3_filtered", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_totalprice > 200000) AS large, count(*) AS n FROM orders GROUP BY o_orderpriority")
def filtered(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_totalprice") > 200000).alias("large"), F.count(F.lit(1)).alias("n"))


@query("A4_sum_max", "SELECT user_id, event_type, count(*) AS calls, round(sum(value), 4) AS total, max(value) AS top FROM events GROUP BY user_id, event_type")
def sum_max(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("top"))


@query("A5_time_range", "SELECT event_type, min(ts) AS first, max(ts) AS last FROM events GROUP BY event_type")
def time_range(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("A6_average_or_zero", "SELECT c_custkey, round(coalesce(avg(o_totalprice), 0), 4) AS mean FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey")
def average_or_zero(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.round(F.coalesce(F.avg("o_totalprice"), F.lit(0.0)), 4).alias("mean"))


@query("A7_array_append", "SELECT user_id, string_agg(x, ',' ORDER BY x) AS types FROM (SELECT DISTINCT user_id, unnest([event_type, 'seen']) AS x FROM events) GROUP BY user_id")
def array_append(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.array_distinct(F.array_append(F.collect_set("event_type"), F.lit("seen")))), ",").alias("types"))


@query("A8_document_frequency", "SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents) GROUP BY token ORDER BY df DESC, token LIMIT 50000")
def document_frequency(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "token").limit(50_000)


@query("A9_count_back", "SELECT p_partkey, p_name, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def count_back(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "part").join(n, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "p_name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("A10_directory_histogram", "SELECT dir, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '') AS dir FROM pages) GROUP BY dir ORDER BY n DESC, dir LIMIT 20")
def directory_histogram(spark, sf_dir):
    dirs = table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/[^/]*$", "").alias("dir"))
    return dirs.groupBy("dir").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dir").limit(20)


# Upper bounds of the latency histogram.
BOUNDS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


@query("A11_cumulative_histogram", f"SELECT bound, count(*) FILTER (WHERE value / 10 <= bound) AS n FROM events, (SELECT unnest([{', '.join(f'{b}::DOUBLE' for b in BOUNDS)}]) AS bound) GROUP BY bound")
def cumulative_histogram(spark, sf_dir):
    """One pass: a counter per bound, turned into rows at the end."""
    x = F.col("value") / 10
    counters = F.array(*[F.struct(F.lit(b).alias("bound"), F.count_if(x <= b).alias("n")) for b in BOUNDS])
    return table(spark, sf_dir, "events").agg(counters.alias("h")).select(F.inline("h"))


@query("A12_product", "SELECT user_id, round(exp(sum(ln(1 - 0.001 * least(value, 900)))), 6) AS product FROM events GROUP BY user_id")
def product(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.exp(F.sum(F.log(1 - 0.001 * F.least(F.col("value"), F.lit(900.0))))), 6).alias("product"))


# Windows, sorts, duplicates


@query("W1_over_cap", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn > 5")
def over_cap(spark, sf_dir):
    rn = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate").withColumn("rn", rn).where("rn > 5").select("o_custkey", "o_orderkey")


@query("W2_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC")
def distinct_on(spark, sf_dir):
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return last.select("o_custkey", "m.o_orderkey", "m.o_orderdate")


@query("W3_regression_gaps", "SELECT user_id, count(*) FILTER (WHERE gap <= 2 * 86400) AS regressions FROM (SELECT user_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events WHERE event_type = 'error') GROUP BY user_id")
def regression_gaps(spark, sf_dir):
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return errors.withColumn("gap", gap).groupBy("user_id").agg(F.count_if(F.col("gap") <= 2 * 86400 * 1_000_000).alias("regressions"))


@query("W4_max_normalised", "SELECT s_suppkey, round(s_acctbal / (SELECT max(s_acctbal) FROM supplier), 6) AS share FROM supplier")
def max_normalised(spark, sf_dir):
    """The maximum is one row, joined back; a window over everything would use one task."""
    supplier = table(spark, sf_dir, "supplier")
    top = supplier.agg(F.max("s_acctbal").alias("top"))
    return supplier.crossJoin(F.broadcast(top)).select("s_suppkey", F.round(F.col("s_acctbal") / F.col("top"), 6).alias("share"))


@query(
    "W5_greedy_budget",
    """WITH RECURSIVE r AS (SELECT o_custkey, o_orderkey, CAST(o_totalprice AS BIGINT) AS cost, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM (SELECT *  REPLACE (floor(o_totalprice) AS o_totalprice) FROM orders)),
f AS (SELECT o_custkey, 0::BIGINT AS i, 0::BIGINT AS used, '' AS taken FROM (SELECT DISTINCT o_custkey FROM r)
  UNION ALL SELECT r.o_custkey, r.i, CASE WHEN used + cost <= 1000000 THEN used + cost ELSE used END, CASE WHEN used + cost <= 1000000 THEN taken || ',' || r.o_orderkey ELSE taken END FROM f JOIN r ON r.o_custkey = f.o_custkey AND r.i = f.i + 1)
SELECT o_custkey, used, substr(taken, 2) AS taken, n FROM f JOIN (SELECT DISTINCT o_custkey, n FROM r) USING (o_custkey) WHERE i = n""",
)
def greedy_budget(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("cost", F.floor("o_totalprice"))
    return R.greedy_budget(orders, "o_custkey", "o_orderkey", "cost", ["o_orderdate", "o_orderkey"], 1_000_000).withColumn("taken", F.array_join("taken", ","))


@query("W6_top_of_each", "SELECT p_type, p_partkey, rn::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 10")
def top_of_each(spark, sf_dir):
    return R.top_of_each(table(spark, sf_dir, "part"), ["p_type"], [F.desc("p_retailprice"), F.col("p_partkey")], 10).select("p_type", "p_partkey", "rank")


@query("O1_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("O2_rolling_top_k", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100")
def rolling_top_k(spark, sf_dir):
    """Each task keeps its best rows; these are merged: no page loop."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    return table(spark, sf_dir, "lineitem").select(*keys, "l_extendedprice").orderBy(F.desc("l_extendedprice"), *keys).limit(100)


_SEVERITY = "CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END"


@query("O3_keep_strongest", f"SELECT l_partkey, arg_max(l_returnflag, {_SEVERITY}) AS flag, max({_SEVERITY}) AS severity FROM lineitem GROUP BY l_partkey")
def keep_strongest(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max(F.struct(F.expr(_SEVERITY).alias("severity"), F.col("l_returnflag").alias("flag"))).alias("m")).select("l_partkey", "m.flag", "m.severity")


@query("O4_first_source_wins", "SELECT key, arg_min(origin, r) AS origin FROM (SELECT s_suppkey AS key, 'supplier' AS origin, 0 AS r FROM supplier UNION ALL SELECT p_partkey, 'part', 1 FROM part UNION ALL SELECT c_custkey, 'customer', 2 FROM customer) GROUP BY key")
def first_source_wins(spark, sf_dir):
    rows = [table(spark, sf_dir, t).select(F.col(k).alias("key"), F.lit(i).alias("r"), F.lit(t).alias("origin")) for i, (t, k) in enumerate((("supplier", "s_suppkey"), ("part", "p_partkey"), ("customer", "c_custkey")))]
    return rows[0].union(rows[1]).union(rows[2]).groupBy("key").agg(F.min_by("origin", "r").alias("origin"))


@query("O5_remove_duplicates", "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber")
def remove_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))


@query("O6_ordered_limit", f"SELECT src, dst, relation_type FROM {B.EDGES} WHERE relation_type = 'calls' ORDER BY confidence DESC, src, dst LIMIT 1000")
def ordered_limit(spark, sf_dir):
    """Limits without an order get a total one here."""
    return B.edges(spark, sf_dir).where("relation_type = 'calls'").orderBy(F.desc("confidence"), "src", "dst").limit(1000).select("src", "dst", "relation_type")


@query("X1_union_impacts", "SELECT count(DISTINCT k) AS symbols, count(*) AS n FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_suppkey FROM supplier)")
def union_impacts(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    return a.unionByName(b).unionByName(c).agg(F.countDistinct("k").alias("symbols"), F.count(F.lit(1)).alias("n"))
