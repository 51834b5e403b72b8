from pyspark.sql import functions as F

from weftgraph.functions import ladders as L
from weftgraph.operators import graph as G
from weftgraph.operators import impact as I


def edges(spark, rows):
    return spark.createDataFrame([(a, b, "calls", 0.9) for a, b in rows], "src long, dst long, relation_type string, confidence double")


def test_cycles_take_their_clusters_highest_level(spark):
    # 1 -> 2 <-> 3, 4 -> 5, 3 -> 5; 6 calls into the cycle from above; 7 is alone.
    calls = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 5), (3, 5), (6, 2)], "src long, dst long")
    profiles = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 0), (5, 2), (6, 3), (7, 1)], "node long, level int")
    got = {r.node: r.final for r in G.propagate_levels(profiles, calls).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 4: 2, 5: 2, 6: 3, 7: 1}


def test_effects_travel_four_calls(spark):
    calls = spark.createDataFrame([(i, i + 1) for i in range(1, 7)], "src long, dst long")
    effects = spark.createDataFrame([(7, "reads", "db.x"), (7, "logs", "log.y"), *[(i, "normalizes", "n") for i in range(1, 7)]], "node long, kind string, descriptor string")
    got = {(r.node, r.kind): (r.provenance, r.origin, r.hops) for r in G.propagate_effects(effects, calls).collect()}
    assert got[3, "reads"] == ("transitive", 7, 4) and (2, "reads") not in got and (6, "logs") not in got and got[7, "reads"][0] == "direct"


def test_cycle_members_share_direct_effects(spark):
    calls = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (4, 1)], "src long, dst long")
    effects = spark.createDataFrame([(1, "writes", "a"), (2, "reads", "b"), (3, "opens", "c"), (4, "logs", "l")], "node long, kind string, descriptor string")
    got = {(r.node, r.descriptor): (r.provenance, r.hops) for r in G.propagate_effects(effects, calls).collect()}
    assert got[1, "b"] == ("transitive", 1) and got[2, "a"] == ("transitive", 1) and got[2, "c"] == ("transitive", 1) and (1, "c") not in got and got[4, "a"] == ("transitive", 1)


def test_components(spark):
    got = {r.node: r.component for r in G.components(spark.createDataFrame([(9, 8), (8, 7), (1, 2), (7, 5), (3, 3)], "src long, dst long")).collect()}
    assert got == {9: 5, 8: 5, 7: 5, 5: 5, 1: 1, 2: 1, 3: 3}


def test_linearisation(spark):
    rows = [("B", "A", 0), ("C", "A", 0), ("D", "B", 0), ("D", "C", 1), ("X", "A", 0), ("X", "B", 1), ("P", "Q", 0), ("Q", "P", 0), ("R", "Q", 0)]
    hierarchy = spark.createDataFrame(rows, "class string, parent string, position int")
    got = {r["class"]: r.mro for r in G.linearise(hierarchy, hierarchy.select("class")).collect()}
    assert got["D"] == ["D", "B", "C", "A"] and got["X"] == ["X", "A", "B"] and got["P"] == ["P"] and got["R"] == ["R"]


def test_c3_merge():
    assert G.c3_merge([["B", "A"], ["C", "A"], ["B", "C"]]) == ["B", "C", "A"] and G.c3_merge([["A", "B"], ["B", "A"]]) is None


def test_neighbourhood_is_bounded(spark):
    got = G.neighbourhood(edges(spark, [(0, i) for i in range(1, 200)]), 0, "out", 1, max_nodes=50).collect()
    assert len(got) == 50 and all(r.truncated for r in got) and sorted(r.node for r in got) == list(range(50))


def test_blast_radius(spark):
    targets = spark.createDataFrame([(1,)], "node long")
    got = I.structural(edges(spark, [(2, 1), (3, 1), (4, 1), (5, 4)]), targets, 2).collect()
    assert {r.symbol: (r.severity, round(r.confidence, 6), r.action) for r in got} == {2: ("high", 0.9, "rerun_test"), 3: ("high", 0.9, "rerun_test"), 4: ("high", 0.9, "rerun_test"), 5: ("medium", 0.72, "manual_review")}
    empty = I.structural(edges(spark, []), targets, 2)
    report = I.report({"structural": empty}).first()
    assert report.scope == "quick" and report.total == 0
    try:
        I.blast_radius(edges(spark, []), None, None, None, spark.range(21).withColumnRenamed("id", "node"))
        raise AssertionError
    except ValueError:
        pass


def test_ladders(spark):
    row = spark.range(1).select(L.rank_of(F.lit("read_write"), L.PURITY).alias("a"), L.rank_of(F.lit("x"), L.PURITY).alias("b"), L.by_rank(F.lit(3), L.SEVERITIES).alias("c")).first()
    assert row.a == 2 and row.b is None and row.c == "critical"


def test_chains_outgrow_sparks_recursion(spark):
    """Spark's recursion ends in an error beyond a number of rows, a million unless set."""
    rows = spark.range(60).selectExpr("id", "CASE WHEN id % 6 > 0 THEN id - 1 END AS previous")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "20")
    try:
        got = {tuple(r) for r in G.lineage_chains(rows).collect()}
        short = {tuple(r) for r in G.lineage_chains(rows, 2).collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert got == {(i, i - d, d) for i in range(60) for d in range(i % 6 + 1)}
    assert short == {x for x in got if x[2] < 2}


def test_member_relations_of_parts_numbered_like_classes(spark, small, tmp_path):
    """Parts from 100000 on are no classes, and all relations of a class count."""
    import duckdb

    from tests.comparing import assert_same
    from weftgraph.plans import catalogue

    con = duckdb.connect()
    for name, key in (("nation", None), ("part", "p_partkey"), ("lineitem", "l_partkey")):
        shifted = f"* REPLACE ({key} + 100000 AS {key})" if key else "*"
        con.execute(f"COPY (SELECT {shifted} FROM '{small}/{name}.parquet') TO '{tmp_path}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    name = "G12_member_relations"
    assert_same(spark, str(tmp_path), con, catalogue.QUERIES[name], catalogue.ORACLES[name])
    per_class = catalogue.QUERIES[name](spark, small.replace("sf0.001", "sf0.01")).groupBy("class_id").count()
    assert per_class.where("count > 200").count() > 0
