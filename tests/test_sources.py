import json

from pyspark.sql import functions as F

from weftgraph.operators import runtime as R
from weftgraph.sources import extract as X
from weftgraph.sources import files as D
from weftgraph.sources import gitlog as G
from weftgraph.sources import sinks as S
from weftgraph.streaming import queries as Q


def test_walk(spark, tmp_path):
    for name, text in (("a/x.py", "print(1)"), ("node_modules/y.js", "1"), ("b/readme.md", "hi"), ("b/z.ts", "é")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "big.go").write_text("x" * 1_000_001)
    got = {r.path: (r.language, r.text) for r in D.walk(spark, str(tmp_path)).collect()}
    assert got == {"a/x.py": ("python", "print(1)"), "b/z.ts": ("typescript", "é")}
    first = D.discover(D.walk(spark, str(tmp_path)), 1).collect()
    assert [r.path for r in first] == ["a/x.py"] and first[0].truncated


def test_git_log(spark, tmp_path):
    good = "\0".join(["a" * 40, "Ann", "a@x", "2024-01-02T03:04:05+01:00", "Fix it", "\nsrc/a.ts", "dist/b.js", ""])
    bad = "\0".join(["zz", "Ann", "a@x", "2024-01-02T03:04:05Z", "x"])
    undated = "\0".join(["b" * 40, "Ann", "a@x", "never", "x"])
    (tmp_path / "log").write_text("\x1e" + "\x1e".join([good, bad, undated]))
    got = G.parse_records(G.read_records(spark, str(tmp_path / "log"))).collect()
    assert len(got) == 1 and got[0].files == ["src/a.ts"] and got[0].is_bug_fix and not got[0].is_merge
    text = f"{'c' * 40}|Bob|b@x|2024-05-01T00:00:00Z|Merge branch a|b\n\n{'d' * 40}|Bob|b@x|2024-05-02T00:00:00Z|Revert x\nsrc/c.py\npic.png\n"
    rows = {r.hash[0]: r for r in G.parse_lines(spark.createDataFrame([(1, text)], "block int, text string")).collect()}
    assert rows["c"].is_merge and rows["c"].subject == "Merge branch a|b" and rows["c"].files == [] and rows["d"].is_revert and rows["d"].files == ["src/c.py"]
    touched = G.touched_symbols(G.parse_lines(spark.createDataFrame([(1, text)], "block int, text string")), spark.createDataFrame([("src/c.py", 5)], "path string, symbol_id int")).collect()
    assert [(r.symbol_id, r.is_revert) for r in touched] == [(5, True)]


def test_extraction(spark):
    python = 'import os\nclass A(Base):\n    @guard("x")\n    def run(self, n: int = 1) -> str:\n        raise KeyError(n)\n\ndef _free(): os.walk(1)\n'
    go = 'package main\nimport "fmt"\nfunc (s *S) Run(a int) error {\n  fmt.Println(a)\n}\n'
    broken = "def ("
    files = spark.createDataFrame([("a.py", "python", python), ("b.go", "go", go), ("c.py", "python", broken), ("d.py", "python", None)], "path string, language string, text string")
    records = X.extract(files).cache()
    assert {(r.key, r.kind, r.visibility) for r in X.symbols(records).collect()} == {("a.py#A", "class", "public"), ("a.py#A.run", "method", "public"), ("a.py#_free", "function", "private"), ("b.go#Run", "function", "public")}
    assert ("a.py#A", "Base", "inherits") in {tuple(r) for r in X.relations(records).collect()} and ("b.go#Run", "fmt.Println", "calls") in {tuple(r) for r in X.relations(records).collect()}
    run = X.contracts(records).where("key = 'a.py#A.run'").first()
    assert run.input_types == ["int"] and run.output_type == "str" and run.thrown_types == ["KeyError"] and run.decorators == ["@guard('x')"]
    assert records.where("record = 'error'").first().path == "c.py"


def test_resolved_hints(spark):
    text = 'import { Pool } from "pg";\nimport fs from "node:fs/promises";\nconst db = require("knex");\nfs.writeFile(p);\ndb.query("DELETE FROM t");\ndb.select(x);\nfetch(u);\nother.save(1);\n'
    shadow = "function fetch() {}\nfetch(u);\n"
    got = {(r.path, r.hint_type, r.detail, r.line) for r in X.resolved_hints(spark.createDataFrame([("a", text), ("b", shadow)], "path string, text string")).collect()}
    assert got == {("a", "file_io", "write_file", 4), ("a", "db_write", "knex.query", 5), ("a", "db_read", "knex.select", 6), ("a", "network_call", "fetch", 7)}


def test_versioned_table(spark, tmp_path):
    table = S.VersionedTable(spark, str(tmp_path / "t"))
    assert table.commit(spark.range(3)) == 1 and table.commit(spark.range(5)) == 2
    assert table.read().count() == 5 and table.read(1).count() == 3
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith("_staging")]
    try:
        S.safe_name("a; drop")
        raise AssertionError
    except ValueError:
        pass


def test_traces(spark):
    good = json.dumps({"source": "test", "timestamp": "2024-01-01T00:00:00Z", "call_edges": [{"caller_key": "m#A.run", "callee_key": "bound B$1", "call_count": 10}, {"caller_key": "zz", "callee_key": "qq"}]})
    raw = spark.createDataFrame([(1, good), (2, "{broken"), (3, "{}")], "id int, j string")
    traces = R.parse_traces(raw, "id", "j")
    symbols = spark.createDataFrame([(7, "m#A.run", "run"), (8, "m#B", "B")], "id int, stable_key string, name string")
    got = R.observed_edges(traces, "id", symbols).collect()
    assert [(r.caller, r.callee, r.calls, round(r.confidence, 4)) for r in got] == [(7, 8, 10, 0.93)]


def test_streams(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, make in (("windows", lambda d: Q.windowed_churn(d, "user_id", "ts", "1 day", late="60 days")), ("sessions", lambda d: Q.sessions(d, late="60 days"))):
        q = make(stream).writeStream.outputMode("complete" if name == "windows" else "complete").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, make(events).collect()))
    q = Q.rate_limited(stream, capacity=2, refill_seconds=3600.0).writeStream.outputMode("append").format("memory").queryName("limits").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("limits")
    assert rows.count() == events.count() and 0 < rows.where("allowed").count() < events.count()


def test_trace_sink_replaces_a_batch(spark, tmp_path):
    symbols = spark.createDataFrame([(1, "a", "a"), (2, "b", "b")], "id int, stable_key string, name string")
    batch = spark.sql("SELECT 1 AS trace, array(named_struct('caller_key', 'a', 'callee_key', 'b', 'receiver_type', cast(null AS string), 'call_count', 2L)) AS call_edges")
    write = Q.trace_sink(symbols, str(tmp_path / "out"))
    write(batch, 4)
    write(batch, 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
