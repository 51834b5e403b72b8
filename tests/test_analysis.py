import random

from pyspark.sql import functions as F

from weftgraph.operators import contracts as C
from weftgraph.operators import context as X
from weftgraph.operators import dispatch as D
from weftgraph.operators import effects as E
from weftgraph.operators import families as K
from weftgraph.operators import lifecycle as Z
from weftgraph.operators import lineage as N
from weftgraph.operators import profiles as P
from weftgraph.operators import temporal as M


def test_symbol_confidence(spark):
    rows = [(1, ["parse_error"]), (2, ["parse_error", "parse_error"]), (3, ["parse_error", "eval_usage"]), (4, ["new_kind"]), (5, []), (6, list(P.IMPACTS))]
    got = {r.id: r.c for r in spark.createDataFrame(rows, "id int, f array<string>").select("id", F.round(P.symbol_confidence(F.col("f")), 6).alias("c")).collect()}
    assert got == {1: 0.7, 2: 0.7, 3: 0.455, 4: 0.95, 5: 1.0, 6: round(max(0.1, __import__("math").prod(1 - i for i in P.IMPACTS.values())), 6)}


def test_snapshot_confidence(spark):
    rows = spark.createDataFrame([("s", "parse_error", 0.3), ("s", "parse_error", 0.3), ("t", "parse_error", 0.3)], "g string, source string, impact double")
    got = {r.g: round(r.confidence, 6) for r in P.snapshot_confidence(rows, "g").collect()}
    assert got == {"s": 0.637, "t": 0.7}


def test_risk_counts_close_fixes(spark):
    rows = [(1, 7, "2025-01-05", True), (2, 7, "2025-01-20", True), (3, 8, "2025-01-05", True), (4, 8, "2025-03-10", True)]
    commits = spark.createDataFrame(rows, "commit_id int, symbol_id int, at string, is_bug_fix boolean").withColumns({"at": F.to_timestamp("at"), "author": F.lit("a"), "is_revert": F.lit(False)})
    got = {r.symbol_id: r.regression_count for r in M.risk_scores(commits, commits.agg(F.max("at").alias("now"))).collect()}
    assert got == {7: 1, 8: 0}


def test_co_change_jaccard(spark):
    rows = [(i, "a") for i in range(10)] + [(i, "b") for i in range(5)] + [(i, "b") for i in range(20, 23)]
    commits = spark.createDataFrame(rows, "commit_id int, symbol_id string").withColumn("at", F.lit("2025-01-01").cast("timestamp"))
    got = M.co_change_pairs(commits).first()
    assert (got.co_change_count, got.total_a, got.total_b, got.jaccard) == (5, 10, 8, round(5 / 13, 6))


def test_orphaned_ownership(spark):
    rows = spark.createDataFrame([("x", None), ("y", "a"), ("y", "a"), ("z", "a"), ("z", "b")], "symbol_id string, author string").withColumn("author", F.when(F.col("author") == "a", 1).when(F.col("author") == "b", 2))
    got = {r.symbol_id: r.ownership_type for r in M.ownership(rows).collect()}
    assert got == {"x": "orphaned", "y": "sole", "z": "shared"}


def test_greedy_assignment_is_the_sorted_walk(spark):
    random.seed(3)
    rows = [(n, o, round(random.choice([0.5, 0.6, 0.7, 0.8]) + random.random() / 10, 6)) for n in range(25) for o in random.sample(range(20), 6)]
    taken, news, olds = [], set(), set()
    for n, o, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if n not in news and o not in olds:
            taken.append((n, o, s)), news.add(n), olds.add(o)
    got = N.assign_greedily(spark.createDataFrame(rows, "new_id int, old_id int, score double")).collect()
    assert sorted(map(tuple, got)) == sorted(taken)


def test_exemplar(spark):
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "family long, member long")
    links = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.85), (2, 3, 0.7)], "a long, b long, confidence double")
    similar = K.member_similarity(members, links)
    assert {r.member: round(r.similarity, 4) for r in similar.collect()}[1] == 0.875
    complete = members.select("member", F.lit(0.5).alias("completeness"))
    best = K.exemplars(similar, complete, links, members)
    assert best.first().exemplar == 1
    got = {r.member: (round(r.similarity, 4), r.is_outlier) for r in K.outliers(members, links, best).collect()}
    assert got[1] == (1.0, False) and got[2] == (0.9, False)


def test_bisection_partitions_its_nodes():
    random.seed(8)
    weights: dict = {}
    for _ in range(140):
        a, b = random.sample(range(60), 2)
        weights.setdefault(a, {})[b] = weights.setdefault(b, {})[a] = round(random.random(), 2)
    parts = K.bisect(list(weights), weights)
    assert sorted(n for p in parts for n in p) == sorted(weights) and parts == K.bisect(list(reversed(weights)), weights) and len(parts) > 1
    clique = {a: {b: 0.9 for b in range(8) if b != a} for a in range(8)}
    assert K.bisect(list(clique), clique) == [list(range(8))] and K.bisect([1, 2, 3], {}) == [[1, 2, 3]]


def body(spark, text, language="typescript"):
    return {r.expression for r in C.findings(spark.createDataFrame([(1, text, language)], "sv_id int, body string, language string"), C.body_findings(F.col("body"), F.col("language"))).collect()}


def test_mined_contracts(spark):
    found = body(spark, "if (x < 3 || x > 9) {}\nif (a < 3 || b > 9) {}\nassert(f(a, (b)));\nif (!ok) { throw e }\nMath.max(0, Math.min(5, n))")
    assert {"range_check:x < 3 and x > 9", "assert:f(a, (b))", "guard_clause:!ok => throw", "range_clamp:n clamped to [0, 5]"} <= found
    assert not any(e.startswith("range_check:a") for e in found)
    found = body(spark, 'switch (k) { case "a": case B: x; }\nz.string().min(3)\nreturn null;\nreturn {a: 1};')
    assert {"enum_restriction:k in {a, B}", "schema_zod:min=3", "return_shape:returns null | object (observed from 2 return path(s))"} <= found
    assert "rust_unsafe:contains unsafe block — memory safety guarantees relaxed" in body(spark, "unsafe {", "rust")
    assert not any(e.startswith("rust") for e in body(spark, "unsafe { x.unwrap() }"))
    assert not body(spark, "")


def test_nested_parameters(spark):
    sig = "f(a: Map<string, Array<number>>, cb: (x: A, y: B) => void, ...rest: T[]): R"
    assert spark.range(1).select(C.split_parameters(F.lit(sig))).first()[0] == ["a: Map<string, Array<number>>", "cb: (x: A, y: B) => void", "...rest: T[]"]


def test_effects_are_read_off_code_only(spark):
    rows = [(1, 'x = "db.save(1)" # os.save()', "python", "function"), (2, "repo.save(1)", "python", "function"), (3, "repo.save(1)", "typescript", "function"), (4, "repo.save(1)", "python", "class")]
    got = E.from_patterns(spark.createDataFrame(rows, "sv_id int, body string, language string, kind string")).collect()
    assert {r.sv_id for r in got} == {2} and ("writes", "db.write") in {(r.kind, r.descriptor) for r in got}


def test_effect_difference(spark):
    a = spark.createDataFrame([(1, "reads", "db.x")], "sv_id int, kind string, descriptor string")
    b = spark.createDataFrame([(1, "reads", "db.x"), (1, "emits", "event.y"), (2, "writes", "db.z")], "sv_id int, kind string, descriptor string")
    got = {r.sv_id: r for r in E.difference(a, b).collect()}
    assert got[1].class_direction == "escalated" and got[1].added == ["emits:event.y"] and got[2].class_before == "pure" and "class escalated: reader -> full_side_effect" in got[1].summary


def test_dispatch_chains(spark):
    code = [("S", "typescript", "class", 1, "private repo: Repo;\nthis.log = new Logger()"), ("R", "typescript", "class", 1, "db: Db | null;")]
    facts = D.points_to(spark.createDataFrame(code, "owner string, language string, kind string, start_line int, body string").withColumn("owner", F.when(F.col("owner") == "R", "Repo").otherwise("Service")))
    methods = spark.createDataFrame([("Base", "find", 7), ("Db", "query", 8), ("Service", "own", 9)], "class string, method string, id int")
    mro = spark.createDataFrame([("Repo", ["Repo", "Base"]), ("Db", ["Db"]), ("Service", ["Service"])], "class string, mro array<string>")
    calls = spark.createDataFrame([(1, "Service", "self.repo.find"), (2, "Service", "self.repo.db.query"), (3, "Service", "self.own"), (4, "Service", "self.gone.x")], "caller int, owner string, chain string")
    got = {r.caller: (r.targets, r.method, round(r.confidence, 4)) for r in D.resolve_chains(calls, facts, methods, mro).collect()}
    assert got == {1: (["7"], "inheritance_mro", 0.765), 2: (["8"], "type_annotation", 0.729), 3: (["9"], "type_annotation", 0.9), 4: ([], "unresolved", 0.3)}


def test_chains_of_any_length(spark):
    """A chain of twelve fields leads to the last one's type, one that fails on its way stays unresolved."""
    n = 12
    facts = spark.createDataFrame([(f"C{i}", f"f{i}", [f"C{i + 1}"], "field_annotation", 1.0) for i in range(n)], "owner string, field string, types array<string>, source string, confidence double")
    methods = spark.createDataFrame([(f"C{i}", "go", i) for i in range(n + 1)], "class string, method string, id int")
    mro = spark.createDataFrame([(f"C{i}", [f"C{i}"]) for i in range(n + 1)], "class string, mro array<string>")
    whole = ".".join(["self", *(f"f{i}" for i in range(n)), "go"])
    calls = spark.createDataFrame([(1, "C0", whole), (2, "C0", whole.replace("f9", "gone")), (3, "C0", "self.go"), (4, None, "self.go")], "caller int, owner string, chain string")
    got = {r.caller: (r.targets, r.method, round(r.confidence, 4)) for r in D.resolve_chains(calls, facts, methods, mro).collect()}
    assert got == {1: ([str(n)], "type_annotation", 0.9), 2: ([], "unresolved", 0.3), 3: (["0"], "type_annotation", 0.9), 4: ([], "unresolved", 0.3)}


def test_capsules_never_overflow(spark):
    random.seed(5)
    kinds = list(X.CATEGORIES)
    nodes = [("t", i, random.choice(kinds), random.random(), f"n{i}", "c" * random.randrange(0, 3000), "s" * random.randrange(0, 200), None) for i in range(80)]
    df = spark.createDataFrame(nodes, "target string, node int, category string, relevance double, name string, code string, summary string, signature string")
    targets = spark.createDataFrame([("t", "x" * 400, "y" * 40), ("none", None, None)], "target string, code string, signature string")
    for mode, budget in (("minimal", 300), ("standard", 700), ("strict", 1500), ("strict", 100)):
        for r in X.capsules(targets, df, mode, budget).collect():
            assert r.used <= budget and r.used == r.target_tokens + sum(p.tokens for p in r.picks)
    picks = X.capsules(targets, df, "strict", 1500).where("target = 't'").first().picks
    assert {p.resolution for p in picks} - {"full_source"} and [kinds.index(p.category) for p in picks] == sorted(kinds.index(p.category) for p in picks)


def test_state_machine(spark):
    rows = [(a, b) for a in Z.TRANSITIONS for b in Z.TRANSITIONS]
    got = {(r.a, r.b) for r in spark.createDataFrame(rows, "a string, b string").where(Z.is_legal_move(F.col("a"), F.col("b"))).collect()}
    assert got == {(a, b) for a, bs in Z.TRANSITIONS.items() for b in bs}


def test_strict_validation_runs_all(spark):
    rows = spark.createDataFrame([(1, i, i != 2) for i in range(1, 7)] + [(2, i, i != 5) for i in range(1, 7)], "txn int, level int, passed boolean")
    strict = {r.txn: (r.overall_passed, r.levels_run) for r in Z.validation_levels(rows, "strict").collect()}
    standard = {r.txn: (r.overall_passed, r.levels_run) for r in Z.validation_levels(rows, "standard").collect()}
    quick = {r.txn: (r.overall_passed, r.levels_run) for r in Z.validation_levels(rows, "quick").collect()}
    assert strict == {1: (False, 6), 2: (False, 6)} and standard == {1: (False, 2), 2: (True, 6)} and quick == {1: (False, 2), 2: (True, 2)}


def test_policy_isolates_errors():
    class Table:
        def count(self):
            return 3

    def broken():
        raise RuntimeError("no table\nmore")

    assert Z.run_policy({"a": Table, "b": broken, "c": Table}) == [("a", 3, ""), ("b", 0, "no table"), ("c", 3, "")]


def test_a_rename_is_found_behind_many_nearer_names(spark):
    """A renamed symbol with equal hashes counts, however many unlike ones have nearer names; so does a twin in all but hashes."""
    from weftgraph.operators import lineage

    columns = "sv_id long, name string, kind string, language string, file_path string, signature string, normalized_ast_hash string, ast_hash string, body_hash string, callers array<string>, callees array<string>"
    row = lambda i, name, h, sig="f(): A", hood=None, path="p": (i, name, "k", "l", path, sig, f"n{h}", f"a{h}", f"b{h}", hood, hood)
    old = [row(i, f"load{i:03}", i, "g(x: B)") for i in range(250)] + [row(900, "somethingElseWhollyOther", 7000), row(901, "twin", 1, hood=["m"], path="q"), row(902, "itself", 7002)]
    new = [row(1000, "load999", 7000), row(1001, "twin", 7001, hood=["m"]), row(1002, "itself", 7002)]
    got = lineage.rename_candidates(spark.createDataFrame(old, columns), spark.createDataFrame(new, columns), ["kind", "language"]).collect()
    assert {r.new_id: r.old_id for r in got} == {1000: 900, 1001: 901}
    assert {r.new_id: r.score for r in got}[1001] == 0.45


def test_hot_names_offer_their_first_symbols(spark):
    """Names are compared, not symbols: 4,000 symbols of one name, each a target, are 16 million pairs otherwise."""
    from weftgraph.operators import homolog

    name = F.when(F.col("id") % 8 == 0, "loadUsers").otherwise("loadUser")
    rows = spark.range(4000).select(F.col("id").alias("sv_id"), name.alias("name"), *[F.concat(F.lit(c), "id").alias(c) for c in ("kind", "purity_class", "body_hash", "ast_hash", "normalized_ast_hash")])
    got: dict = {}
    for r in homolog.candidates(rows, rows).collect():
        got.setdefault(r.target, set()).add(r.candidate)
    names = {i: "loadUsers" if i % 8 == 0 else "loadUser" for i in range(4000)}
    for i in (0, 1, 8, 31, 36, 300, 3999):
        order = sorted((x for x in names if x != i), key=lambda x: (names[x] != names[i], x))
        assert got[i] == set(order[:30])
    assert len(got) == 4000


def test_shared_tests_of_a_pair(spark):
    from weftgraph.operators import homolog

    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 1)], "target long, candidate long")
    artifacts = spark.createDataFrame([(i, [1, 2, 2, 9]) for i in range(5)] + [(7, [1, 4])], "artifact long, related array<long>")
    assert {(r.target, r.candidate): round(r.tests, 6) for r in homolog.test_overlap(pairs, artifacts).collect()} == {(1, 2): 1.0, (1, 3): 0.0, (4, 1): 0.3}


def test_equal_bodies_are_scanned_once(spark):
    """Patterns read distinct contents, which are joined back to each symbol with its own first line."""
    from weftgraph.sources.tables import by_text

    rows = [(1, "python", "def f():\n    raise ValueError(x)", 10, "function"), (2, "python", "def f():\n    raise ValueError(x)", 20, "class"), (3, None, "def f():\n    raise ValueError(x)", None, "function"), (4, "python", None, 5, "function")]
    df = spark.createDataFrame(rows, "sv_id int, language string, body string, start_line int, kind string")
    keyed, texts = by_text(df, "language", "body")
    assert keyed.count() == 4 and texts.count() == 3
    got = {(r.sv_id, r.line) for r in E.scan_hints(df).where("hint_type = 'throws'").collect()}
    assert (1, 11) in got and (2, 21) in got and 4 not in {x for x, _ in got}
    mined = [C.findings(df.where(f"sv_id = {i}"), C.body_findings(F.col("body"), F.col("language")), ("body", "language")).drop("sv_id").collect() for i in (1, 2)]
    assert sorted(map(tuple, mined[0])) == sorted(map(tuple, mined[1]))
