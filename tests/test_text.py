import math

from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.operators import vectors as V


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_identifiers(spark):
    assert one(spark, T.split_identifier(F.col("n")), n="XMLParser_getHTTP2Name-v1") == ["XML", "Parser", "get", "HTTP2Name", "v1"]
    assert one(spark, T.tokenize_name(F.col("n")), n="userServiceHandler42") == ["user", "serve", "handle"]


def test_bodies_lose_comments_and_literals(spark):
    code = "const user = 'a b'; // gone\n/* gone\n too */ loadUser(0xFF, 1.5e3, \"it\\\"s\", `x`);"
    assert one(spark, T.tokenize_body(F.col("c")), c=code) == ["user", "load", "user"]


def test_long_literals_do_not_overflow(spark):
    assert one(spark, F.size(T.tokenize_body(F.col("c"))), c="'" + "ab " * 30000 + "' tail") == 1


def test_long_texts_are_read_to_their_end(spark):
    code = "alpha " * 30000 + "omega"
    for f in (T.tokenize_body, T.tokenize_signature):
        got = one(spark, f(F.col("c")), c=code)
        assert len(got) == 30001 and got[-1] == "omega"
    assert len(one(spark, T.tokenize_name(F.col("c")), c="a_" + "alpha_" * 30000)) == 30000
    hints = F.array_repeat(F.struct(F.lit("db").alias("hint_type"), F.lit("row").alias("detail")), 1500)
    assert len(one(spark, T.tokenize_behavior(hints))) == 3000


def test_fnv_matches_the_definition(spark):
    h = 2166136261
    for c in "hello":
        h = (h ^ ord(c)) * 16777619 % 2**32
    assert one(spark, T.fnv1a(F.col("s")), s="hello") == h


def test_sets_and_trigrams(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, T.jaccard(a, b), a=["x", "y"], b=["y", "z"]) == 1 / 3
    assert one(spark, T.trigrams(F.col("n")), n="Cat") == ["  c", " ca", "cat", "at "]
    empty = F.array().cast("array<string>")
    assert one(spark, T.jaccard(empty, empty)) == 0 and one(spark, T.jaccard(empty, empty, 1.0)) == 1


def test_signatures(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, T.signature_similarity(a, b), a="f(x: A): B", b="f(x: A): B") == 1
    assert one(spark, T.signature_similarity(a, b), a="", b="f()") == 0
    assert one(spark, T.signature_hash(a), a="") == "empty"
    assert one(spark, T.signature_hash(a) == T.signature_hash(b), a="f(x: A,  y: B)", b="f(other: A,y: B)")


def test_demangling(spark):
    for raw, want in (("bound async load$1", "load"), ("__awaiter", "__awaiter"), ("x", "x"), ("save_2", "save")):
        assert one(spark, T.demangle(F.col("n")), n=raw) == want


def test_risky_patterns_are_literal():
    assert T.quantified_complex_group("(a+)+b") and T.quantified_complex_group("(a|b)*") and not T.quantified_complex_group("(ab)+c|d") and not T.quantified_complex_group(r"\(a+\)+")


def test_paths_and_commits(spark):
    p = F.col("p")
    assert one(spark, T.is_ignored_path(p), p="a/b.PNG") and one(spark, T.is_ignored_path(p), p="x/go.sum") and not one(spark, T.is_ignored_path(p), p="src/go.summary.ts")
    for subject, want in (("Fix login bug", True), ("fixes #42 in parser", True), ("add prefix", False), ("Closes #7", True)):
        assert one(spark, T.is_bug_fix(p), p=subject) is want


def test_budget_text(spark):
    assert len(one(spark, T.fit_to_budget(F.col("t"), F.lit(20)), t="x" * 500)) == 80
    assert one(spark, T.fit_to_budget(F.col("t"), F.lit(0)), t="x") == ""


def test_term_weights(spark):
    rows = spark.createDataFrame([(1, "user"), (1, "get"), (1, "user"), (1, "user"), (2, "user"), (2, "set"), (3, "order"), (3, "get")], "doc int, token string")
    tf = {(r.doc, r.token): r.tf for r in V.term_frequencies(rows, "doc").collect()}
    assert math.isclose(tf[1, "user"], 1 + math.log(3)) and tf[1, "get"] == 1
    idf = {r.token: r.idf for r in V.inverse_frequencies(V.term_frequencies(rows, "doc"), spark.createDataFrame([(3,)], "n int")).collect()}
    assert math.isclose(idf["user"], math.log(1 + 3 / 3)) and math.isclose(idf["order"], math.log(1 + 3 / 2))
    unit = V.unit_vectors(V.term_frequencies(rows, "doc"), V.inverse_frequencies(V.term_frequencies(rows, "doc"), spark.createDataFrame([(3,)], "n int")), "doc")
    assert all(math.isclose(r.s, 1) for r in unit.groupBy("doc").agg(F.sum(F.col("weight") ** 2).alias("s")).collect())


def test_min_hash(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["c", "b", "a", "a"]), (3, []), (4, ["x", "y", "é"]), (5, ["a", "b", "d", "e"])], "id int, t array<string>")
    sig = {r.id: r.signature for r in V.min_hash(rows, "id", "t").collect()}
    assert len(sig[1]) == 128 and sig[1] == sig[2] and set(sig[3]) == {4294967295}
    a, b = V.coefficients(1)[0]
    fnv = lambda s: __import__("functools").reduce(lambda h, c: (h ^ ord(c)) * 16777619 % 2**32, s, 2166136261)
    assert sig[4][0] == min((a * fnv(t) + b) % 4294967291 for t in ("x", "y", "é"))
    df = spark.createDataFrame([(sig[1], sig[5], sig[4], sig[3])], "a array<long>, b array<long>, c array<long>, e array<long>")
    got = df.select(V.estimated_jaccard(F.col("a"), F.col("a")), V.estimated_jaccard(F.col("a"), F.col("b")), V.estimated_jaccard(F.col("a"), F.col("c")), V.estimated_jaccard(F.col("e"), F.col("e"))).first()
    assert got[0] == 1 and 0.1 < got[1] < 0.7 and got[2] < 0.3 and got[3] == 0


def test_band_keys(spark):
    sig = list(range(1, 129))
    other = sig[8:16] + sig[:8] + sig[16:120] + [7] * 8
    keys = spark.createDataFrame([(sig, other)], "a array<long>, b array<long>").select(V.band_keys(F.col("a")), V.band_keys(F.col("b"))).first()
    assert len(keys[0]) == 16 and keys[0][2:15] == keys[1][2:15] and not {keys[0][0], keys[0][1]} & {keys[1][0], keys[1][1]} and keys[0][15] != keys[1][15]
    assert all(-(2**31) <= k < 2**31 for k in keys[0])


def test_blanking():
    from weftgraph.functions.code import blank

    assert blank('a = "x // y" // z\nb') == 'a = "      "     \nb'
    assert blank("`a ${f(\"q\")} b`") == "`  ${f(\"q\")}  `"
    assert blank("x = 'it\\'s' # no\n\"\"\"d\ne\"\"\"", "python") == "x = '     '     \n\"\"\" \n \"\"\""
    for text in ('"open', "/* open", "`open ${x", "", "'a\\"):
        assert len(blank(text)) == len(text)


def test_shapes_ignore_names_and_layout(spark):
    from weftgraph.functions.code import shape, shape_hash

    a = "function add(first: number, second) { const sum = first + second; // done\n return sum;; }"
    b = "function  plus(x: number,y){let_me(); }"
    c = "function plus(x:number,  y) {\n  const z = x + y;\n  return z;\n}"
    assert shape(a) == shape(c) != shape(b) and '"x y"' in shape('f("x y")')
    got = spark.createDataFrame([(a,), (c,), (None,)], "t string").select(shape_hash(F.col("t")).alias("h")).collect()
    assert got[0].h == got[1].h and got[2].h is None
