"""Each operator on awkward rows, and against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import exact_dedup, language_id, line_dedup, media, near_dedup, packing, segmentations, sharding, token_counts, urls
from weftgraph.llm import lattice as L

LONG = "lorem ipsum dolor " * 40_000
ROWS = [(1, None), (2, ""), (3, "a b c d e f g"), (4, "a b c d e f g"), (4, "a b c d e f g"), (5, "é ü 漢字 🙂 <0x41>"), (6, " \t\n"), (7, LONG), (8, "a  b\tc d e f g"), (None, "x y z"), (9, "x" * 5000)]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns named like results of the operators."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    names = ("shard", "slot", "kept", "class_id", "bucket", "batch", "lang_pred", "score", "n", "id", "line", "media", "words", "token", "label")
    return df.withColumns({c: F.lit(f"clash {c}") for c in names})


def empty(df):
    return df.where("false")


def words(seed, n, size):
    rng = random.Random(seed)
    return [rng.choice([f"w{i}" for i in range(size)]) for _ in range(n)]


# Sharding


def test_sharding(spark, docs):
    rows = docs.select("doc_id", "text", "shard", "slot")
    out = sharding.hypergeometric_shards(rows, shards=4, parts=8, blocks=3).collect()
    sizes = Counter(r.shard for r in out)
    assert len(out) == len(ROWS) and max(sizes.values()) - min(sizes.get(s, 0) for s in range(4)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    assert sharding.hypergeometric_shards(empty(rows), shards=4).count() == 0
    many = spark.range(3000).withColumnRenamed("id", "doc_id")
    first = sorted(map(tuple, sharding.hypergeometric_shards(many, shards=7).collect()))
    assert first == sorted(map(tuple, sharding.hypergeometric_shards(many.repartition(9), shards=7).collect()))
    sizes = Counter(s for _, s, _ in first)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sum(sizes.values()) == 3000


def test_communication_matrix():
    m = sharding.communication_matrix([5, 0, 17, 900, 3], 4, 1)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 900, 3] and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1 and (m >= 0).all()
    mean = np.mean([sharding.communication_matrix([50, 50], 2, s)[0, 0] for s in range(300)])
    assert abs(mean - 25) < 1


def test_hypergeometric_draws_follow_the_law():
    rng = np.random.default_rng(5)
    for good, bad, n in ((3, 4, 3), (10, 2, 7), (40, 60, 30)):
        drawn = Counter(sharding.hypergeometric(rng, good, bad, n) for _ in range(20_000))
        law = {x: math.comb(good, x) * math.comb(bad, n - x) / math.comb(good + bad, n) for x in range(max(0, n - bad), min(n, good) + 1)}
        assert set(drawn) <= set(law) and all(abs(drawn[x] / 20_000 - p) < 0.02 for x, p in law.items())
    assert sharding.hypergeometric(rng, 0, 9, 4) == 0 and sharding.hypergeometric(rng, 9, 0, 4) == 4 and sharding.hypergeometric(rng, 5, 5, 0) == 0


def test_matrices_of_any_size_have_one_law():
    """Beyond 10**9 places, where numpy's own draws end, rows differ from equal shares as the law says."""
    rows, shards = [4_000_000_000] * 5, 4
    found = np.concatenate([sharding.communication_matrix(rows, shards, s) for s in range(60)])
    assert (found.sum(axis=1) == rows[0]).all() and sharding.communication_matrix(rows, shards, 3).sum(axis=0).tolist() == [5_000_000_000] * 4
    every, good, n = sum(rows), 5_000_000_000, rows[0]
    sd = (n * good / every * (1 - good / every) * (every - n) / (every - 1)) ** 0.5
    assert abs(found.mean() - n / shards) < sd / 4 and 0.9 < found.std() / sd < 1.1


# Packing


def test_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(20):
        lengths = sorted(rng.randrange(1, 40) for _ in range(12))
        bins = sorted((k, c, k * c) for k, c in Counter(lengths).items())
        k = rng.randrange(1, 5)
        waste = lambda bounds: sum(next(b for b in bounds if b >= x) - x for x in lengths)
        tops = [b[0] for b in bins]
        best = min(waste([*c, tops[-1]]) for n in range(k) for c in itertools.combinations(tops[:-1], n))
        got = packing.optimal_boundaries(bins, k)
        assert len(got) <= k and got[-1] == tops[-1] and waste(got) == best


def test_packing(spark, docs):
    rows = docs.select("doc_id", packing.estimated_tokens().alias("tokens"), "bucket", "batch")
    out = packing.pack(rows, length=F.col("tokens"), buckets=3, budget=64, blocks=2).collect()
    assert len(out) == len(ROWS) and all(r.padding >= 0 and r.n_tokens + r.padding == r.boundary for r in out)
    batches = defaultdict(list)
    for r in out:
        batches[r.bucket, r.batch].append(r)
    for members in batches.values():
        assert len(members) == 1 or len(members) * members[0].boundary <= 64
        assert sorted(r.place for r in members) == list(range(len(members)))
    assert packing.pack(empty(rows), length=F.col("tokens")).count() == 0


def test_long_boundaries_are_optimal(spark):
    lengths = [3000] * 9 + [3001, 3002, 3010, 3011] + [3012] * 9
    rows = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, tokens long")
    out = packing.pack(rows, length=F.col("tokens"), buckets=2).collect()
    waste = lambda bound: sum((bound if x <= bound else 3012) - x for x in lengths)
    assert sum(r.padding for r in out) == min(map(waste, lengths))


def test_counted_lengths_are_tokens(docs):
    counts = Counter((r.doc_id, r.n_tokens + 1) for r in token_counts.count_tokens(docs).collect())
    lengths = packing.counted_tokens(docs)
    out = packing.pack(lengths, length=F.col("tokens"), buckets=3, budget=64, blocks=2).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in out) == counts


# Exact duplicates


def test_exact_dedup(spark, docs):
    out = exact_dedup.exact_groups(docs).collect()
    groups = defaultdict(list)
    for d, t in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    want = []
    for t, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        want += [(str(d), str(least), len(ids), d == least, hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in out) == sorted(want)
    assert exact_dedup.exact_groups(empty(docs)).count() == 0


def test_copies_are_judged_by_row(spark):
    rows = [(1, "A text"), (4, "A  text"), (4, "B unique text"), (None, "A text"), (None, "C"), (None, None), (9, "")]
    got = exact_dedup.without_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert Counter(map(tuple, got)) == Counter([(1, "A text"), (4, "B unique text"), (None, "C"), (9, "")])


def test_near_copies_are_judged_by_row(spark):
    base, other = words(1, 60, 3000), words(2, 60, 3000)
    rows = [(1, " ".join(base)), (4, " ".join([*base[:-1], "edit"])), (4, " ".join(other)), (4, " ".join(other)), (5, " ".join(["edit", *other[1:]])), (None, " ".join(base)), (6, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = near_dedup.without_near_copies(df).collect()
    assert Counter(map(tuple, got)) == Counter([rows[0], rows[2], rows[3], rows[5], rows[6], rows[7]])
    classes = Counter((r.doc_id, r.class_id, r.kept) for r in near_dedup.near_classes(df).collect())
    assert classes == Counter({(1, 1, True): 1, (4, 1, False): 1, (4, 4, True): 2, (5, 4, False): 1, (None, None, True): 1, (6, 6, True): 2})


def test_chunks_cover_texts(spark):
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(8000))
    row = exact_dedup.recipes(spark.createDataFrame([(1, text), (2, "new start " + text)], "doc_id long, text string")).collect()
    a, b = (set(r.ids) for r in row)
    assert len(row[0].ids) > 5 and len(a & b) > 0.7 * len(a)


# Near duplicates


def brute_classes(rows, threshold=0.8):
    def shingles(t):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def families(seed=1):
    rng = random.Random(seed)
    passage, rows = words(seed, 30, 3000), []
    for f in range(8):
        base = words(100 + f, 60, 3000)
        for _ in range(20):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(t))
    rows += [" ".join(passage + words(500 + j, rng.choice([5, 8, 15]), 3000)) for j in range(60)]
    return list(enumerate(rows))


@pytest.mark.parametrize("small_buckets", [False, True])
def test_near_classes_are_the_brute_force_ones(spark, monkeypatch, small_buckets):
    if small_buckets:
        monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 2)
        monkeypatch.setattr(near_dedup, "BLOCK_SIZE", 2)
    rows = families()
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)


def test_near_dedup_of_awkward_rows(spark, docs):
    out = near_dedup.near_classes(docs).collect()
    assert len(out) == len(ROWS)
    classes = {r.doc_id: r.class_id for r in out if r.doc_id is not None}
    assert classes[4] == classes[3] == classes[8] == 3 and classes[1] == 1 and classes[2] == 2 and classes[6] == 6 and all(r.kept for r in out if r.doc_id is None)
    assert near_dedup.near_classes(empty(docs)).count() == 0


def test_prob_min_hash_estimates(spark):
    import pyarrow as pa

    a, b = words(1, 400, 10**6), words(2, 200, 10**6)
    s = near_dedup.Shingles(pa.array([" ".join(a), " ".join(a[:300] + b)]))
    sig = near_dedup.prob_min_hash(s, 2000)
    one, two = (set(s.hash[s.text == i].tolist()) for i in (0, 1))
    assert abs((sig[0] == sig[1]).mean() - len(one & two) / len(one | two)) < 0.05


def test_near_copies_with_a_repeated_passage(spark):
    """Pairs of set similarity 0.8 and more, of which one text repeats some lines."""
    rows = []
    for i, (own, passage, times) in enumerate(itertools.product([0, 8], [10, 20, 30], [50, 100] * 6)):
        base, extra = words(2000 + i, 100, 1000), words(5000 + i, own, 1000)
        rows.append((2 * i, " ".join(base)))
        rows.append((2 * i + 1, " ".join(base[:-passage] + base[-passage:] * times + extra)))
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = brute_classes(rows)
    assert len(set(want.values())) == len(rows) // 2 and {r.doc_id: r.class_id for r in got} == want


# Lines


def brute_lines(rows):
    lines = [(d, i, frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line) if w)) for d, t in rows for i, line in enumerate((t or "").split("\n"))]
    removed = set()
    for x, (d, i, s) in enumerate(sorted(lines, key=lambda r: r[:2])):
        for e, j, t in sorted(lines, key=lambda r: r[:2])[:x]:
            if s and t and 5 * len(s & t) >= 4 * len(s | t):
                removed.add((d, i))
                break
    return removed


def test_lines_match_brute_force(spark):
    rng = random.Random(7)
    bases = [words(i, rng.choice([3, 4, 5, 9, 20, 40]), 60) for i in range(25)]
    rows = []
    for d in range(60):
        picked = []
        for _ in range(rng.randrange(0, 5)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 2])):
                line[rng.randrange(len(line))] = rng.choice(["edit", "w1", "\tw2"])
            picked.append(" ".join(line))
        rows.append((d, "\n".join(picked)))
    marks = line_dedup.line_marks(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r.id, r.line) for r in marks if r.removed} == brute_lines(rows)


@pytest.mark.parametrize("limit", [0, 32_000_000])
def test_lines_of_awkward_rows(spark, docs, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", limit)
    out = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert out[1].n_lines == 1 and out[1].n_removed == 0 and out[4].n_removed == 1 and out[8].n_removed == 1 and out[3].n_removed == 0 and out[6].n_lines == 2 and out[None].n_removed == 0
    assert line_dedup.line_dedup(empty(docs)).count() == 0


def test_lines_of_repeated_ids(spark):
    rows = [(1, "a b c d e"), (4, "a b c d e\nx"), (4, "unique words of its own"), (4, "unique words of its own"), (None, "a b c d e"), (7, None), (8, "x\n\nq r s t u")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("clash"), "line": F.lit(1)}).repartition(2)
    got = Counter((r.doc_id, r.text) for r in line_dedup.without_lines(df).collect())
    assert got == Counter([(1, "a b c d e"), (4, "x"), rows[2], rows[3], rows[4], (7, None), (8, "\nq r s t u")])
    once = line_dedup.without_lines(df.where("doc_id in (1, 8)")).collect()
    assert {r.doc_id: r.text for r in once} == {1: "a b c d e", 8: "x\n\nq r s t u"} and once[0].asDict().keys() == {"doc_id", "text", "id", "line"}


def test_families_with_rare_words_of_their_own_meet_few_pairs(spark, monkeypatch):
    """Near copies whose rarest words are their own changes: pairs in proportion to the copies, and all but the first go."""
    usual = [f"usual{i}" for i in range(40)]
    texts = [(d, " ".join([*usual, *(f"own{d}x{i}" for i in range(4))])) for d in range(120)]
    texts += [(1000 + i, f"{w} with words{i} beside it") for i, w in enumerate(usual * 3)]
    met, verified = [], line_dedup.verified

    def counted(pairs, *rest):
        met.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(line_dedup, "verified", counted)
    got = line_dedup.line_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.n_removed} == set(range(1, 120)) and len(got) == len(texts)
    assert sum(met) <= 12 * 120


@pytest.mark.parametrize("often", [1, 1000])
def test_lines_are_whole_whatever_rows_are_sampled(spark, monkeypatch, often):
    """Words are counted in a few rows only, and the rows that go are those of brute force."""
    monkeypatch.setattr(line_dedup, "SAMPLE", 5)
    monkeypatch.setattr(line_dedup, "OFTEN", often)
    rng = random.Random(3)
    bases = [words(i, 12, 30) for i in range(8)]
    rows = [(d, " ".join([*rng.choice(bases)[rng.randrange(2) :], f"own{d}"])) for d in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counted = sum(g > 0 for g in line_dedup.rarity_grades(df, "doc_id", "text")[0])
    assert 0 < counted < len({w for _, text in rows for w in text.split()}) / 2
    assert {(r.id, r.line) for r in line_dedup.line_marks(df).collect() if r.removed} == brute_lines(rows)


def test_sets_that_meet_in_one_hash_are_apart(spark):
    """Two hashes with states of their own: where the first is made equal, the second still tells sets apart."""
    sets = spark.createDataFrame([([1, 2, 3, 4],), ([5, 6, 7, 8],)], "tokens array<bigint>")
    seconds = sets.select(F.xxhash64(F.lit(line_dedup.OTHER_STATE), "tokens").alias("k2"), F.xxhash64("tokens").alias("k1")).collect()
    # A second hash that went on from the first would be a function of it.
    chained = sets.select(F.xxhash64("tokens", F.lit(line_dedup.OTHER_STATE)).alias("k")).collect()
    assert len({r.k2 for r in seconds} | {r.k1 for r in seconds} | {r.k for r in chained}) == 6


# URLs


def test_urls(spark):
    rows = [(1, "https://WWW.Example.com/en/1?q"), (2, "http://m.example.com/en/x#y"), (3, "ftp://a.net/es/"), (4, "https://com/"), (5, None), (6, "nonsense"), (7, "x://h.org"), (8, "https://notexample.com/en/"), (8, "https://notexample.com/en/")]
    out = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash"))).collect()}
    assert (out[1].host, out[1].path, out[1].rule, out[1].verdict) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert (out[2].rule, out[2].verdict) == ("example.com/en/", "block") and (out[3].rule, out[3].verdict) == ("net/es/", "block")
    assert (out[5].host, out[5].path, out[5].rule) == ("", "", None) and (out[6].host, out[6].path) == ("", "") and (out[7].host, out[7].path) == ("h.org", "") and out[8].rule == "com/"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_bad_templates_are_rejected(spark):
    rows = [("h", f"ads/{i}", 1) for i in range(30)] + [("h", f"news/{i}", 0) for i in range(30)] + [("h", "ads/77", None), ("h", "news/77", None)]
    pages = spark.createDataFrame(rows, "host string, path string, bad int").withColumn("shape", urls.lexical_template(F.col("path")))
    got = {r.branch: r.purity for r in urls.templates(pages).collect()}
    assert got["/ads/*"] > 0.9 and got["/news/*"] < 0.1


def test_pages_of_good_and_bad_branches_part(spark):
    """Unlabelled pages of one host, of branches that rules label in part; hosts without labels."""
    rules = (("h.net/ads/paid/", "block"), ("h.net/news/world/", "allow"), ("g.net/ads/paid/", "block"))
    paths = [f"/ads/paid/{i}" for i in range(20)] + [f"/news/world/{i}" for i in range(20)] + ["/ads/other/1", "/ads/77", "/news/other/5", "/news/3", "/"]
    pages = [(f"http://{h}{p}",) for h in ("h.net", "plain.org") for p in paths] + [("http://g.net/ads/paid/1",), (None,), ("no scheme",), ("http://h.net/" + "x/" * 3000,)]
    df = spark.createDataFrame([(i if i % 7 else None, u) for i, (u,) in enumerate(pages)], "page_id long, url string").repartition(3)
    out = {(r.host, r.path): r for r in urls.judge(df, rules=rules).collect()}
    assert {p: out["h.net", p].verdict for p in paths[-5:]} == {"/ads/other/1": "block", "/ads/77": "block", "/news/other/5": "allow", "/news/3": "allow", "/": "allow"}
    assert all(r.verdict == "allow" for (h, _), r in out.items() if h in ("plain.org", ""))
    assert out["h.net", "/" + "x/" * 3000].branch == "/*/*/*/*" and len(out) == len({u for u, in pages}) - 1


def brute_purity(pages, depth=4, least=3, z=1.96, weight=4.0):
    """(host, segments, bad) -> purity, by plain loops over a dictionary of nodes."""
    rows = [[h, [("*" if re.search("[0-9]", s) or len(s) > 32 else s) for s in segs][:depth], bad, "", "", None] for h, segs, bad in pages]
    count = lambda some: (sum(r[2] is not None for r in some), sum(r[2] or 0 for r in some))
    for h in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == h]
        n, b = count(own)
        for r in own:
            r[5] = b / (n + weight)
    for d in range(depth):
        live = [r for r in rows if len(r[1]) > d]
        nodes = defaultdict(list)
        for r in live:
            nodes[r[0], r[3]].append(r)
        for members in nodes.values():
            seen = Counter(r[1][d] for r in members)
            groups = defaultdict(list)
            for r in members:
                groups[r[1][d] if seen[r[1][d]] >= least else "*"].append(r)
            every_n, every_b = count(members)
            for fixed, some in groups.items():
                n, b = count(some)
                name, rest = fixed, every_n - n
                if n and rest:
                    p = every_b / every_n
                    if abs(b / n - (every_b - b) / rest) <= z * math.sqrt(p * (1 - p) * (1 / n + 1 / rest)):
                        name = "*"
                for r in some:
                    r[3], r[4] = f"{r[3]}/{name}", f"{r[4]}/{fixed}"
        rate = {}
        for g in {r[4] for r in live}:
            n, b = count([r for r in live if r[4] == g])
            rate[g] = b / n if n else None
        nodes = defaultdict(list)
        for r in live:
            nodes[r[0], r[3]].append(r)
        for members in nodes.values():
            n, b = count(members)
            known = [rate[r[4]] for r in members if rate[r[4]] is not None]
            above = members[0][5]
            towards = math.sqrt(above * sum(known) / len(known)) if known else above
            for r in members:
                r[5] = (b + weight * towards) / (n + weight)
    return [(r[0], r[3], r[5]) for r in rows]


def test_template_tree_is_the_brute_force_one(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(600):
        h = rng.choice(["a", "a", "a", "b", "c"])
        segs = [rng.choice(["ads", "news", "x", "y1", f"u{rng.randrange(9)}", rng.choice("pqrstuvw")]) for _ in range(rng.randrange(0, 6))]
        bad = rng.choice([None, None, int(bool(segs) and segs[0] in ("ads", "x")), rng.randrange(2)])
        rows.append((h, segs, bad))
    pages = spark.createDataFrame([(h, "/".join(s), b) for h, s, b in rows], "host string, path string, bad int").withColumn("shape", urls.lexical_template(F.col("path")))
    found = {(r.host, r["shape"]): (r.branch, r.purity) for r in urls.templates(pages).collect()}
    for (h, segs, _), (_, branch, purity) in zip(rows, brute_purity(rows), strict=True):
        shape = "/".join("*" if re.search("[0-9]", s) else s for s in segs[:4])
        assert found[h, shape][0] == branch and math.isclose(found[h, shape][1], purity, abs_tol=1e-9)


# Tokens


def spell(vocab, log_p, word):
    best = {0: (0.0, 0, [])}
    pieces = {vocab.raw[i]: i for i in range(vocab.size) if vocab.rank[i] < vocab.size}
    known = {c for c in (w.encode() if w != "\xff" else b"\xff" for w in word)} & set(pieces)
    data = b"".join(b"\xff" if c == "\xff" else c.encode() for c in word)
    owner = [c for c in word for _ in range(1 if c == "\xff" else len(c.encode()))]
    for end in range(1, len(data) + 1):
        options = []
        for start in range(max(0, end - 40), end):
            if start in best:
                if data[start:end] in pieces:
                    i = pieces[data[start:end]]
                elif end - start == 1 and (owner[start] == "\xff" or owner[start].encode() not in known):
                    i = int(vocab.byte_ids[data[start]])
                else:
                    continue
                options.append((best[start][0] + log_p[i], best[start][1] + 1, best[start][2] + [i]))
        if options:
            top = max(o[0] for o in options)
            best[end] = min((o for o in options if o[0] > top - 1e-9), key=lambda o: o[1])
    return best[len(data)]


def test_token_counts_match_brute_force(spark):
    vocab = L.vocabulary(L.default_model())
    log_p = vocab.zipf_log_probabilities()
    texts = ["hello world", "the the cat", "naïve café 漢字", "x\ny", "", "  two  spaces"]
    got = token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        marked = "\xff" + texts[r.doc_id].replace(" ", "\xff")
        parts = re.findall("\xff[^\xff\n]*|\n|[^\xff\n]+", marked)
        spelt = [spell(vocab, log_p, p) for p in parts]
        assert r.n_tokens == sum(s[1] for s in spelt) and math.isclose(r.log_probability, sum(s[0] for s in spelt), abs_tol=1e-5) and r.n_pretokens == len(parts)


def test_token_counts_of_awkward_rows(docs):
    out = token_counts.count_tokens(docs).collect()
    assert len(out) == len(ROWS) and all(r.n_tokens > 0 for r in out)
    by = {r.doc_id: r for r in out}
    assert by[1].n_bytes == by[2].n_bytes == 0 and by[7].n_tokens >= 120_000
    assert token_counts.count_tokens(empty(docs)).count() == 0


def test_segmentations(spark, docs):
    out = segmentations.sample_segmentations(docs, k=3).collect()
    vocab = L.vocabulary(L.default_model())
    by = defaultdict(list)
    for r in out:
        by[r.key if "key" in r.asDict() else r.doc_id].append(r)
        assert r.exact and 0 <= r.inclusion <= 1
    texts = {d: t or "" for d, t in ROWS}
    for d, rows in by.items():
        assert all(segmentations.decode(vocab, np.array(r.pieces)) == texts[d].encode() for r in rows)
        if d != 4:
            assert len({tuple(r.pieces) for r in rows}) == len(rows) and [r.perturbed for r in sorted(rows, key=lambda r: r["rank"])] == sorted((r.perturbed for r in rows), reverse=True)
    again = segmentations.sample_segmentations(docs.repartition(5), k=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert segmentations.sample_segmentations(empty(docs)).count() == 0


def all_segmentations(vocab, log_p, data):
    """Every segmentation of the bytes and its probability, normalised."""
    known = {vocab.raw[i]: i for i in range(vocab.size) if vocab.rank[i] < vocab.size}
    known.setdefault(b"\xff", int(vocab.byte_ids[0xFF]))
    out = {}
    for cuts in itertools.product([0, 1], repeat=len(data) - 1):
        ends = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(data)]
        parts = [data[a:b] for a, b in itertools.pairwise(ends)]
        if all(p in known for p in parts):
            ids = tuple(known[p] for p in parts)
            out[ids] = math.exp(sum(log_p[i] for i in ids))
    total = sum(out.values())
    return {ids: p / total for ids, p in out.items()}


def test_sampled_segmentations_follow_the_law():
    """Against full enumeration: first and second draws, Gumbel values and inclusion, for many keys."""
    import pyarrow as pa

    vocab = L.vocabulary(L.default_model())
    flat = np.where(vocab.zipf_log_probabilities() > -np.inf, -2.0, -np.inf)  # so that many segmentations have mass
    law = all_segmentations(vocab, flat, b"\xffcat\xffof")
    one, two = (all_segmentations(vocab, flat, x) for x in (b"\xffcat", b"\xffof"))
    law = {a + b: p * q for a, p in one.items() for b, q in two.items()}
    n = 3000
    keys = np.random.default_rng(2).integers(0, 2**63, n, dtype=np.uint64)
    tokens = L.Pretokens(*L.text_buffers(pa.array(["cat of"] * n)))
    found = segmentations.sample_block(vocab, flat, tokens, keys, 2)
    first, second = (Counter(tuple(s[i][0].pieces.tolist()) for s in found) for i in (0, 1))
    assert set(first) | set(second) <= set(law) and len(law) > 20
    later = {b: sum(p * law[b] / (1 - p) for a, p in law.items() if a != b) for b in law}
    for ids, p in law.items():
        assert abs(first[ids] / n - p) < 4 * (p * (1 - p) / n) ** 0.5 + 1e-3
        assert abs(second[ids] / n - later[ids]) < 4 * (later[ids] * (1 - later[ids]) / n) ** 0.5 + 1e-3
    for s in found[:200]:
        assert all(math.isclose(math.exp(t.scores.sum()), law[tuple(t.pieces.tolist())], rel_tol=1e-6) for t, _ in s)
    tops = np.array([s[0][0].value for s in found])
    assert abs(tops.mean() - 0.5772) < 0.1 and abs(tops.var() - math.pi**2 / 6) < 0.25
    # Horvitz-Thompson: each distinct draw over its inclusion score sums to one in expectation.
    assert abs(np.mean([sum(math.exp(t.scores.sum()) / i for t, i in s) for s in found]) - 1) < 0.05


def test_other_choices_follow_the_law_given_the_taken():
    import pyarrow as pa

    vocab = L.vocabulary(L.default_model())
    flat = np.where(vocab.zipf_log_probabilities() > -np.inf, -2.0, -np.inf)
    law = all_segmentations(vocab, flat, b"\xffcats")
    tokens = L.Pretokens(*L.text_buffers(pa.array(["cats"])))
    sampler = segmentations.Sampler(L.Trie(vocab, tokens, slice(0, 1)), flat)
    likely = sorted(law, key=law.get, reverse=True)
    for taken in (likely[:1], likely[:3], likely[1:-1]):
        raw = [np.array(t, dtype=np.int32).tobytes() for t in taken]
        rest = {t: p for t, p in law.items() if t not in taken}
        drawn = Counter(tuple(segmentations._other(sampler, 0, np.uint64(s * 7919), 1, raw)[0].tolist()) for s in range(3000))
        assert set(drawn) <= set(rest)
        for t, p in rest.items():
            p /= sum(rest.values())
            assert abs(drawn[t] / 3000 - p) < 4 * (p * (1 - p) / 3000) ** 0.5 + 1e-3


def test_all_segmentations_come_out_without_replacement():
    """More draws than a text has segmentations give each once, though nearly all mass is taken early."""
    import pyarrow as pa

    vocab = L.vocabulary(L.default_model())
    log_p = vocab.zipf_log_probabilities()
    law = all_segmentations(vocab, log_p, b"\xffcats")
    tokens = L.Pretokens(*L.text_buffers(pa.array(["cats"] * 5)))
    for s in segmentations.sample_block(vocab, log_p, tokens, np.arange(5, dtype=np.uint64), len(law) + 3):
        assert {tuple(t.pieces.tolist()) for t, _ in s} <= set(law) and len({tuple(t.pieces.tolist()) for t, _ in s}) == len(s)
        assert len(s) >= min(len(law), 3) and sum(math.exp(t.scores.sum()) for t, _ in s) > 0.999


def whole_lattice(vocab, log_p, text):
    """Log of the sum over all segmentations of a text without spaces or line feeds, over all its pieces at once."""
    known = {vocab.raw[i]: i for i in range(vocab.size) if vocab.rank[i] < vocab.size}
    data = b"\xff" + text.encode()
    spelt = {i for i, b in enumerate(data) if b == 0xFF and b"\xff" not in known}
    place = 1
    for c in text:
        spelt |= set() if c.encode() in known else set(range(place, place + len(c.encode())))
        place += len(c.encode())
    sums, longest = [0.0], max(map(len, known))
    for end in range(1, len(data) + 1):
        ways = [sums[a] + log_p[known[data[a:end]]] for a in range(max(0, end - longest), end) if data[a:end] in known]
        ways += [sums[end - 1] + log_p[vocab.byte_ids[data[end - 1]]]] if end - 1 in spelt else []
        top = max(ways, default=-math.inf)
        sums.append(top + math.log(sum(math.exp(w - top) for w in ways)) if top > -math.inf else top)
    return sums[-1]


LONG_RUNS = ["internationalization" * 4, "x" * 3000, "https://example.org/a/very/long/path/of/words/without?any=space&between=them", "漢字かな交じり文のとても長い一続きの文章です🙂🙂é" * 5, "=" * 41 + "ab" * 300]


def test_long_runs_have_the_whole_lattice():
    """No piece is lost at a cut: the law of a run of over 40 bytes is that over all its segmentations."""
    import pyarrow as pa

    vocab = L.vocabulary(L.default_model())
    log_p = vocab.zipf_log_probabilities()
    tokens = L.Pretokens(*L.text_buffers(pa.array(LONG_RUNS)), vocab)
    found = segmentations.sample_block(vocab, log_p, tokens, np.arange(len(LONG_RUNS), dtype=np.uint64), 3)
    for text, samples in zip(LONG_RUNS, found, strict=True):
        mass = whole_lattice(vocab, log_p, text)
        assert len({tuple(t.pieces.tolist()) for t, _ in samples}) == len(samples) == (1 if "漢" in text else 3)
        for t, _ in samples:
            assert segmentations.decode(vocab, t.pieces) == text.encode()
            assert math.isclose(t.scores.sum(), log_p[t.pieces].sum() - mass, rel_tol=1e-9, abs_tol=1e-6)


def test_unknown_characters_are_spelt_beside_known_ones():
    """A character that is no piece shares its first byte with one that is, in words of a common prefix."""
    import pyarrow as pa

    vocab = L.vocabulary(L.default_model())
    log_p = vocab.zipf_log_probabilities()
    assert "文".encode() in vocab.raw and "漢".encode() not in vocab.raw
    tokens = L.Pretokens(*L.text_buffers(pa.array(["文", "漢"])), vocab)
    trie = L.Trie(vocab, tokens, slice(0, 2))
    score, count = trie.best(log_p)
    assert np.isfinite(score).any() and [count[trie.terminal[w]] for w in trie.inverse] == [spell(vocab, log_p, "\xff" + t)[1] for t in ("文", "漢")]
    for text, samples in zip(("文", "漢"), segmentations.sample_block(vocab, log_p, tokens, np.arange(2, dtype=np.uint64), 2), strict=True):
        for t, _ in samples:
            assert segmentations.decode(vocab, t.pieces) == text.encode()
            assert math.isclose(t.scores.sum(), log_p[t.pieces].sum() - whole_lattice(vocab, log_p, text), abs_tol=1e-6)


def test_long_runs_are_drawn_by_the_law():
    """Of a run without a place that no piece crosses: how often a piece crosses byte 37 in first and in second draws."""
    import pyarrow as pa

    vocab = L.vocabulary(L.default_model())
    flat = np.where(vocab.zipf_log_probabilities() > -np.inf, -2.0, -np.inf)
    text, n = "x" * 50, 2000
    known = {vocab.raw[i] for i in range(vocab.size) if vocab.rank[i] < vocab.size} | {b"\xff"}
    data = b"\xff" + text.encode()
    ahead, behind = [1.0] + [0.0] * 51, [0.0] * 51 + [1.0]
    for i in range(1, 52):
        ahead[i] = sum(ahead[a] * math.exp(-2) for a in range(max(0, i - 25), i) if data[a:i] in known)
        behind[51 - i] = sum(behind[b] * math.exp(-2) for b in range(52 - i, min(51, 76 - i) + 1) if data[51 - i : b] in known)
    p = 1 - ahead[37] * behind[37] / ahead[51]
    assert 0.2 < p < 0.9
    tokens = L.Pretokens(*L.text_buffers(pa.array([text] * n)), vocab)
    found = segmentations.sample_block(vocab, flat, tokens, np.random.default_rng(4).integers(0, 2**63, n, dtype=np.uint64), 2)
    for draw in (0, 1):
        crossed = [37 not in np.cumsum(vocab.lengths[s[draw][0].pieces]) for s in found]
        assert abs(np.mean(crossed) - p) < 4 * (p * (1 - p) / n) ** 0.5 + 1e-3


def test_long_runs_are_counted_and_summed_whole(spark):
    import pyarrow as pa

    vocab = L.vocabulary(L.default_model())
    log_p = vocab.zipf_log_probabilities()
    for r in token_counts.count_tokens(spark.createDataFrame(list(enumerate(LONG_RUNS)), "doc_id long, text string")).collect():
        score, pieces, _ = spell(vocab, log_p, "\xff" + LONG_RUNS[r.doc_id])
        assert r.n_tokens == pieces and math.isclose(r.log_probability, score, rel_tol=1e-9, abs_tol=1e-5)
    weights = np.exp(np.stack([log_p, log_p * 0.9], axis=1))
    tokens = L.Pretokens(*L.text_buffers(pa.array(LONG_RUNS)), vocab)
    trie = L.Trie(vocab, tokens, slice(0, len(tokens.starts)))
    ends = trie.log_ends(weights)[trie.inverse]
    for d, text in enumerate(LONG_RUNS):
        for k, log_w in enumerate((log_p, log_p * 0.9)):
            assert math.isclose(ends[tokens.text == d, k].sum(), whole_lattice(vocab, log_w, text), rel_tol=1e-9)


# Languages


def test_language_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    out = language_id.held_out(F.col("doc_id"))
    fitted = language_id.fit(docs.where(~out))
    rows = language_id.predict(docs.where(out), fitted).where("lang IS NOT NULL").collect()
    assert len(rows) > 30 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.9 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_awkward_rows(spark, docs):
    fitted = language_id.fit(spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "de"), (4, "x", None)], "doc_id long, text string, lang string"))
    out = language_id.predict(docs.select("doc_id", "text", "score"), fitted).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(ROWS) and by[1].lang_pred == by[2].lang_pred == by[6].lang_pred == "und" and by[1].score == 0 and by[7].lang_pred in ("en", "fr")
    assert language_id.predict(empty(docs).select("doc_id", "text"), fitted).count() == 0
    none = language_id.fit(empty(docs).withColumn("lang", F.lit("x")))
    assert {r.lang_pred for r in language_id.predict(docs.select("doc_id", "text"), none).collect()} == {"und"}


def test_probabilities_of_each_language_sum_to_one(spark):
    fitted = language_id.fit(spark.createDataFrame([(1, "the cat", "en"), (2, "le chat 漢", "fr")], "doc_id long, text string, lang string"))
    vocab = L.vocabulary(L.default_model())
    assert np.allclose(np.exp(fitted.log_p).sum(axis=0), 1) and fitted.log_p.shape == (vocab.size, 2)


def test_rows_without_a_key_are_not_held_out(spark):
    got = spark.createDataFrame([(None,), (1,), (4,)], "k long").select("k", language_id.held_out(F.col("k")).alias("h")).collect()
    assert {r.k: r.h for r in got} == {None: False} | {k: zlib.crc32(str(k).encode()) % 3 == 1 for k in (1, 4)}


def test_forward_sums_all_segmentations(spark):
    import pyarrow as pa

    vocab = L.vocabulary(L.default_model())
    p = np.exp(vocab.zipf_log_probabilities())
    tokens = L.Pretokens(*L.text_buffers(pa.array(["cats"])))
    trie = L.Trie(vocab, tokens, slice(0, 1))
    pieces = {vocab.raw[i]: p[i] for i in range(vocab.size) if vocab.rank[i] < vocab.size}
    pieces.setdefault(b"\xff", p[vocab.byte_ids[0xFF]])  # the mark alone is no piece and is spelt by its byte
    data, total = b"\xffcats", 0.0
    for cuts in itertools.product([0, 1], repeat=4):
        ends = [0, *[i + 1 for i in range(4) if cuts[i]], 5]
        total += math.prod(pieces.get(data[a:b], 0.0) for a, b in itertools.pairwise(ends))
    assert math.isclose(trie.forward(p[:, None])[trie.terminal][0, 0], total, rel_tol=1e-9)


# Media


def test_media_round_trip(docs):
    out = media.features(media.store(docs)).collect()
    assert len(out) == len(ROWS)
    texts = {d: (t or "").encode() for d, t in ROWS}
    for r in out:
        raw = texts[r.doc_id]
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    same = {(r.media_sha256, r.feature) for r in out if r.doc_id in (3, 4)}
    assert len(same) == 1 and media.features(media.store(empty(docs))).count() == 0


def test_jpeg_structure():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = ["".join(chr(c) for c in rng.integers(32, 1000, n)) for n in (0, 1, 63, 64, 5000)]
    files, _ = media.encode(pa.array(texts))
    for text, file, (payload, feature) in zip(texts, files, media.read_back(files), strict=True):
        head = media.parse(file)
        assert file[:2] == b"\xff\xd8" and file[-2:] == b"\xff\xd9" and payload.rstrip(b"\0") == text.encode().rstrip(b"\0") and feature.startswith(f"{head.width}x{head.height}:")
    with pytest.raises(ValueError):
        media.parse(b"GIF89a")
