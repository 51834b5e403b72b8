"""The registered queries and the pipeline."""

import pytest

import corpus_pipeline
from tests.comparing import assert_same
from tests.llm.test_operators import brute_classes
from weftgraph.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(name, spark, small, duck):
    assert_same(spark, small, duck, queries.QUERIES[name], queries.ORACLES[name])


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_one_row_per_document(name, spark, small):
    got = queries.QUERIES[name](spark, small)
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert set(ids) == {r.doc_id for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(ids) == len(set(ids)) or "rank" in got.columns


def test_pipeline_keeps_what_brute_force_keeps(spark, small):
    import re

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    lettered = {d: t for d, t in docs.items() if t and re.search(r"[^\W\d_]", t)}
    first: dict = {}
    for d in sorted(lettered):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", lettered[d]), d)
    left = [(d, lettered[d]) for d in sorted(first.values())]
    classes = brute_classes(left)
    got = corpus_pipeline.run(spark, small).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, c in classes.items() if d == c)


def test_batches_hold_counted_tokens(spark, small):
    from weftgraph.llm.token_counts import count_tokens

    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = {r.doc_id: r.n_tokens + 1 for r in count_tokens(docs).collect()}
    for got in (queries.QUERIES["op7_length_buckets"](spark, small), corpus_pipeline.pack(spark, docs, small)):
        rows, batches = got.collect(), {}
        assert {r.doc_id: r.n_tokens for r in rows} == want
        for r in rows:
            batches.setdefault((r.bucket, r.batch), []).append(want[r.doc_id])
        assert all(len(b) == 1 or sum(b) <= 65536 for b in batches.values())


def test_stages_keep_columns_and_empty_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.where("false"), small)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns


def test_pipeline_of_null_rows(spark, small):
    rows = spark.createDataFrame([(None, "some words here", None, None, None), (5, None, "en", "s", 0), (6, "1 2 3", "en", "s", 5), (7, "some words here", "en", "s", 15), (None, "quite another text", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = rows
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
    assert sorted((str(r.doc_id), r.text) for r in docs.collect()) == [("7", "some words here"), ("None", "quite another text")]
