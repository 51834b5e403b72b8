"""Scalar functions, predicates and set operations."""

from pyspark.sql import functions as F

from weftgraph.functions import ladders as L
from weftgraph.functions import text as T
from weftgraph.plans import bindings as B
from weftgraph.plans.registry import query
from weftgraph.sources.tables import table

_STEMS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in T.STEMS.items()) + "}"
_NOISE = ", ".join(f"'{w}'" for w in T.NOISE)


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def split_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(regexp_replace({x}, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '[_-]+'), lambda p: p <> '')"


def normal_sql(x: str) -> str:
    low = f"regexp_replace(lower(substr({x}, 1, 256)), '[0-9]+$', '')"
    stem = f"coalesce(map_extract_value({_STEMS}, {low}), {low})"
    return f"CASE WHEN length({stem}) < 2 THEN '' ELSE {stem} END"


def tokens_sql(parts: str, noise: bool) -> str:
    keep = f"t <> '' AND t NOT IN ({_NOISE})" if noise else "t <> ''"
    return f"list_filter(list_transform({parts}, lambda p: {normal_sql('p')}), lambda t: {keep})"


def idents_sql(x: str) -> str:
    return tokens_sql(f"flatten(list_transform(regexp_extract_all({x}, '[a-zA-Z_$][a-zA-Z0-9_$]*'), lambda i: {split_sql('i')}))", True)


def body_sql(x: str) -> str:
    for p in T.BODY_STRIP:
        x = f"regexp_replace({x}, {q(p)}, '', 'g')"
    return idents_sql(x)


def trigrams_sql(x: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def jaccard_sql(a: str, b: str, both_empty: str = "0.0") -> str:
    return f"(CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN {both_empty}::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END)"


@query("C1_hashes", "SELECT p_partkey, sha256(p_name) AS sha256, md5(p_brand) AS lock_key, substr(sha256(p_name), 1, 16) AS short FROM part")
def hashes(spark, sf_dir):
    sha = F.sha2("p_name", 256)
    return table(spark, sf_dir, "part").select("p_partkey", sha.alias("sha256"), F.md5("p_brand").alias("lock_key"), F.substring(sha, 1, 16).alias("short"))


FNV = "list_reduce(list_prepend(2166136261::HUGEINT, list_transform(regexp_extract_all({0}, '(?s).'), lambda c: unicode(c)::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)::BIGINT"


@query("C2_fnv1a", f"SELECT s_suppkey, {FNV.format('s_name')} AS h FROM supplier")
def fnv(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.fnv1a(F.col("s_name")).alias("h"))


@query("C3_levenshtein", f"SELECT sv_id, levenshtein(name, 'redWidgetHandler')::INT AS distance FROM {B.SYMBOLS}")
def levenshtein(spark, sf_dir):
    return B.symbols(spark, sf_dir).select("sv_id", F.levenshtein("name", F.lit("redWidgetHandler")).alias("distance"))


@query("C4_split_identifier", f"SELECT sv_id, array_to_string({split_sql('name')}, '|') AS parts FROM {B.SYMBOLS}")
def split_identifier(spark, sf_dir):
    return B.symbols(spark, sf_dir).select("sv_id", F.array_join(T.split_identifier(F.col("name")), "|").alias("parts"))


@query("C5_normalise_token", f"SELECT DISTINCT token, {normal_sql('token')} AS normal FROM (SELECT unnest({split_sql('name')}) AS token FROM {B.SYMBOLS})")
def normalise_token(spark, sf_dir):
    tokens = B.symbols(spark, sf_dir).select(F.explode(T.split_identifier(F.col("name"))).alias("token")).distinct()
    return tokens.select("token", T.normalise_token(F.col("token")).alias("normal"))


@query("C6_body_tokens", f"SELECT doc_id, array_to_string({body_sql('text')}, ' ') AS tokens FROM documents")
def body_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.tokenize_body(F.col("text")), " ").alias("tokens"))


@query(
    "C7_view_tokens",
    f"""SELECT sv_id, array_to_string({tokens_sql(split_sql('name'), False)}, ' ') AS name_tokens, array_to_string({idents_sql('signature')}, ' ') AS signature_tokens,
  array_to_string(list_concat({tokens_sql(split_sql("'db_write'"), False)}, {idents_sql('name')}), ' ') AS behavior_tokens,
  array_to_string(list_concat({idents_sql('kind')}, {idents_sql('signature')}), ' ') AS contract_tokens FROM {B.SYMBOLS}""",
)
def view_tokens(spark, sf_dir):
    none = F.array().cast("array<string>")
    hints = F.array(F.struct(F.lit("db_write").alias("hint_type"), F.col("name").alias("detail")))
    views = {
        "name_tokens": T.tokenize_name(F.col("name")),
        "signature_tokens": T.tokenize_signature(F.col("signature")),
        "behavior_tokens": T.tokenize_behavior(hints),
        "contract_tokens": T.tokenize_contract(F.array("kind"), F.col("signature"), none, none),
    }
    return B.symbols(spark, sf_dir).select("sv_id", *[F.array_join(v, " ").alias(k) for k, v in views.items()])


SIG_HASH = r"""CASE WHEN signature = '' THEN 'empty' ELSE substr(sha256(trim(regexp_replace(regexp_replace(regexp_replace(signature, '\s+', ' ', 'g'), '\b\w+\s*:', ':', 'g'), '\s*,\s*', ',', 'g'))), 1, 16) END"""
ANCESTRY = r"""(SELECT CASE WHEN contains(s, '.') THEN regexp_replace(s, '\.[^.]*$', '') ELSE '' END FROM
  (SELECT CASE WHEN contains(stable_key, '::') THEN split_part(stable_key, '::', 2) ELSE split_part(stable_key, '#', 2) END AS s))"""


@query("C10_signature_hash", f"SELECT sv_id, {SIG_HASH} AS signature_hash FROM {B.SYMBOLS}")
def signature_hash(spark, sf_dir):
    return B.symbols(spark, sf_dir).select("sv_id", T.signature_hash(F.col("signature")).alias("signature_hash"))


@query(
    "C11_identity_seed",
    f"SELECT sv_id, sha256(concat_ws(chr(0), 'repo', 'typescript', lower(kind), lower({ANCESTRY}), name, {SIG_HASH}, lower(regexp_replace(file_path, '/[^/]*$', '')))) AS seed FROM {B.SYMBOLS}",
)
def identity_seed(spark, sf_dir):
    c = F.col
    seed = T.identity_seed(F.lit("repo"), F.lit("TypeScript"), c("kind"), T.ancestry(c("stable_key")), c("name"), T.signature_hash(c("signature")), T.dirname(c("file_path")))
    return B.symbols(spark, sf_dir).select("sv_id", seed.alias("seed"))


def sig_sim_sql(a: str, b: str, w=(0.4, 0.4, 0.2)) -> str:
    params = lambda s: f"len(list_filter(string_split(regexp_extract({s}, '\\(([^\\n\\r]*?)\\)', 1), ','), lambda p: p <> ''))"
    types = lambda s: f"list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace({s}, '[(),:]', ' ', 'g')), '\\s+'), lambda t: length(t) > 1))"
    ret = lambda s: f"trim(list_extract(string_split({s}, ':'), -1))"
    most = f"greatest({params(a)}, {params(b)})"
    score = f"""(CASE WHEN {most} = 0 THEN {w[0]}::DOUBLE ELSE {w[0]}::DOUBLE * least({params(a)}, {params(b)}) / {most} END
      + CASE WHEN {ret(a)} = {ret(b)} AND {ret(a)} <> '' THEN {w[1]}::DOUBLE ELSE 0 END + {w[2]}::DOUBLE * {jaccard_sql(types(a), types(b))})"""
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, {score}) END"


_PROBE = "'red(item: widget, size: number): Result'"


@query(
    "C12_signature_similarity",
    f"SELECT sv_id, round({sig_sim_sql('signature', _PROBE)}, 6) AS homolog, round({sig_sim_sql('signature', _PROBE, (0.4, 0.3, 0.3))}, 6) AS lineage FROM {B.SYMBOLS}",
)
def signature_similarity(spark, sf_dir):
    probe, s = F.lit(_PROBE.strip("'")), F.col("signature")
    return B.symbols(spark, sf_dir).select(
        "sv_id", F.round(T.signature_similarity(s, probe), 6).alias("homolog"), F.round(T.signature_similarity(s, probe, (0.4, 0.3, 0.3)), 6).alias("lineage")
    )


def name_sim_sql(a: str, b: str) -> str:
    toks = lambda s: f"list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({s}, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g')), '[_\\-\\s.]+'), lambda p: p <> ''))"
    edit = f"1 - levenshtein(lower({a}), lower({b}))::DOUBLE / greatest(length({a}), length({b}))"
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE greatest({edit}, {jaccard_sql(toks(a), toks(b))}) END"


NAME_PROBE = "'redGadgetHandler'"


@query("C13_name_similarity", f"SELECT sv_id, round({name_sim_sql('name', NAME_PROBE)}, 6) AS similarity FROM {B.SYMBOLS}")
def name_similarity(spark, sf_dir):
    return B.symbols(spark, sf_dir).select("sv_id", F.round(T.name_similarity(F.col("name"), F.lit(NAME_PROBE.strip("'"))), 6).alias("similarity"))


@query(
    "C14_path_helpers",
    f"""SELECT sv_id, regexp_replace(file_path, '/[^/]*$', '') AS dir, {ANCESTRY} AS ancestry, regexp_extract(stable_key, '([^.:#/]*)$', 1) AS simple,
  regexp_replace(file_path, '^src/', '') AS portable, regexp_replace(name, '_[0-9]+$', '') AS plain FROM {B.SYMBOLS}""",
)
def path_helpers(spark, sf_dir):
    c = F.col
    return B.symbols(spark, sf_dir).select(
        "sv_id", T.dirname(c("file_path")).alias("dir"), T.ancestry(c("stable_key")).alias("ancestry"), T.simple_name(c("stable_key")).alias("simple"),
        T.portable_path(F.concat(F.lit("./app/"), F.replace(c("file_path"), F.lit("/"), F.lit("\\")))).alias("portable"),
        T.demangle(F.concat(F.lit("bound "), F.lit("async "), c("name"))).alias("plain"),
    )


@query("C15_token_estimate", "SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


_CUT = "/* truncated to context token budget */"


@query(
    "C16_fit_to_budget",
    f"""SELECT doc_id, md5(CASE WHEN ceil(length(text) / 4.0) <= 50 THEN text ELSE substr(text, 1, {200 - len(_CUT) - 1}) || chr(10) || '{_CUT}' END) AS fitted_md5,
  md5(CASE WHEN ceil(length(text) / 4.0) <= 5 THEN text ELSE substr(text, 1, 20) END) AS tiny_md5 FROM documents""",
)
def fit_to_budget(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fit_to_budget(text, F.lit(50))).alias("fitted_md5"), F.md5(T.fit_to_budget(text, F.lit(5))).alias("tiny_md5"))


@query(
    "C17_ladders",
    """SELECT c_custkey, CASE WHEN x >= 0.8 THEN 'high' WHEN x >= 0.5 THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN x >= 0.9 THEN 'critical' WHEN x >= 0.7 THEN 'high' ELSE 'medium' END AS invariant,
  CASE n WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS structural
FROM (SELECT c_custkey, greatest(0, c_acctbal) / 10000 AS x, c_nationkey % 3 AS n FROM customer)""",
)
def ladders(spark, sf_dir):
    x = F.greatest(F.lit(0.0), F.col("c_acctbal")) / 10000
    return table(spark, sf_dir, "customer").select(
        "c_custkey", L.confidence_band(x).alias("band"), L.invariant_severity(x).alias("invariant"), L.structural_severity(F.col("c_nationkey") % 3).alias("structural")
    )


_SUBJECT = "concat(CASE p_size % 6 WHEN 0 THEN 'Fix ' WHEN 1 THEN 'Revert ' WHEN 2 THEN 'Merge branch ' WHEN 3 THEN 'Add prefix to ' WHEN 4 THEN 'closes #12 ' ELSE 'Rework ' END, p_name)"


@query(
    "C18_commit_kinds",
    f"""SELECT p_partkey, regexp_matches(lower(s), '{"|".join(T.BUG_FIX)}') AS is_bug_fix, regexp_matches(lower(s), '{T.REVERT}') AS is_revert,
  regexp_matches(lower(s), '{T.MERGE}') AS is_merge FROM (SELECT p_partkey, {_SUBJECT} AS s FROM part)""",
)
def commit_kinds(spark, sf_dir):
    s = F.expr(_SUBJECT)
    return table(spark, sf_dir, "part").select("p_partkey", T.is_bug_fix(s).alias("is_bug_fix"), T.is_revert(s).alias("is_revert"), T.is_merge(s).alias("is_merge"))


_PATH = "concat(CASE p_size % 4 WHEN 0 THEN 'dist/' WHEN 1 THEN 'lib/' ELSE '' END, p_name, CASE p_size % 5 WHEN 0 THEN '.PNG' WHEN 1 THEN '/go.sum' WHEN 2 THEN '.ts' WHEN 3 THEN '.o' ELSE '/Makefile' END)"


@query(
    "C19_ignored_paths",
    f"""SELECT p_partkey, lower(regexp_extract(f, '\\.([^.]*)$', 1)) IN ({", ".join(map(q, T.BINARY))}) OR list_extract(string_split(f, '/'), -1) IN ({", ".join(map(q, T.LOCKFILES))})
  OR {" OR ".join(f"contains(f, {q(d)})" for d in T.BUILD_DIRS)} AS ignored FROM (SELECT p_partkey, {_PATH} AS f FROM part)""",
)
def ignored_paths(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.is_ignored_path(F.expr(_PATH)).alias("ignored"))


@query("C20_age_minutes", "SELECT event_id, date_diff('second', ts, (SELECT max(ts) FROM events))::BIGINT // 60 AS age_minutes, ts + INTERVAL 90 DAY AS retained_until FROM events")
def age_minutes(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    latest = events.agg(F.max("ts").alias("now"))
    return events.crossJoin(F.broadcast(latest)).select(
        "event_id", F.floor((F.unix_timestamp("now") - F.unix_timestamp("ts")) / 60).alias("age_minutes"), (F.col("ts") + F.expr("INTERVAL 90 DAYS")).alias("retained_until")
    )


@query("C21_json", "SELECT event_id, json_keys(props)[1] AS first_key, CAST(json_extract(props, '$.k') AS INT) AS k, json_array_length('[]') > 0 AS has_items FROM events")
def json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.get(F.json_object_keys("props"), F.lit(0)).alias("first_key"), F.get_json_object("props", "$.k").cast("int").alias("k"), (F.json_array_length(F.lit("[]")) > 0).alias("has_items")
    )


@query("C22_log_boosts", "SELECT s_suppkey, round(log10(s_acctbal + 1000), 6) AS l10, round(log2(s_acctbal + 1000), 6) AS l2, round(ln(s_acctbal + 1000), 6) AS l FROM supplier")
def log_boosts(spark, sf_dir):
    x = F.col("s_acctbal") + 1000
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(F.log10(x), 6).alias("l10"), F.round(F.log2(x), 6).alias("l2"), F.round(F.log(x), 6).alias("l"))


@query("C23_search_mode", "SELECT p_partkey, regexp_matches(p_name, '(?i)RED|bolt$') AS by_regex, contains(lower(p_name), '(a|b)+') AS by_literal FROM part")
def search_mode(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.search_predicate(F.col("p_name"), "RED|bolt$").alias("by_regex"), T.search_predicate(F.col("p_name"), "(a|b)+").alias("by_literal"))


@query(
    "C24_loose_hash",
    """SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '//[^\n]*', '', 'g'), '#[^\n]*', '', 'g'), '\\s+', ' ', 'g'))) AS h
FROM (SELECT page_id, replace(replace(html, '/*', ''), chr(34), '') AS html FROM pages)""",
)
def loose_hash(spark, sf_dir):
    html = F.replace(F.replace(F.col("html"), F.lit("/*"), F.lit("")), F.lit('"'), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", T.loose_hash(html, F.lit("ruby")).alias("h"))


# Sets


def _sets(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(F.split(F.lower("text"), " ")).alias("words"))
    later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("words").alias("next_words"))
    return turns.join(later, ["conv_id", "turn"])


_TURNS = """WITH t AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS a FROM conversations),
p AS (SELECT x.conv_id, x.turn, x.a, y.a AS b FROM t x JOIN t y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)"""


@query(
    "X2_set_difference",
    f"{_TURNS} SELECT conv_id, turn, array_to_string(list_sort(list_filter(b, lambda w: NOT list_contains(a, w))), ' ') AS added, array_to_string(list_sort(list_filter(a, lambda w: NOT list_contains(b, w))), ' ') AS removed FROM p",
)
def set_difference(spark, sf_dir):
    diff = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), " ")
    return _sets(spark, sf_dir).select("conv_id", "turn", diff("next_words", "words").alias("added"), diff("words", "next_words").alias("removed"))


@query(
    "X3_new_resources",
    f"{_TURNS} SELECT conv_id, turn, len(list_filter(b, lambda w: NOT list_contains(a, w)))::INT AS n_new, len(list_filter(a, lambda w: NOT list_contains(b, w)))::INT AS n_gone FROM p",
)
def new_resources(spark, sf_dir):
    return _sets(spark, sf_dir).select("conv_id", "turn", F.size(F.array_except("next_words", "words")).alias("n_new"), F.size(F.array_except("words", "next_words")).alias("n_gone"))


@query("X4_jaccard", f"{_TURNS} SELECT conv_id, turn, round({jaccard_sql('a', 'b')}, 6) AS jaccard FROM p")
def set_jaccard(spark, sf_dir):
    return _sets(spark, sf_dir).select("conv_id", "turn", F.round(T.jaccard(F.col("words"), F.col("next_words")), 6).alias("jaccard"))


@query("X5_jaccard_both_empty", f"{_TURNS} SELECT conv_id, turn, round({jaccard_sql('list_filter(a, lambda w: length(w) > 9)', 'list_filter(b, lambda w: length(w) > 9)', '1.0')}, 6) AS jaccard FROM p")
def set_jaccard_both_empty(spark, sf_dir):
    long = lambda c: F.filter(c, lambda w: F.length(w) > 9)
    return _sets(spark, sf_dir).select("conv_id", "turn", F.round(T.jaccard(long("words"), long("next_words"), 1.0), 6).alias("jaccard"))


@query("X6_unordered_equality", f"{_TURNS} SELECT conv_id, turn, list_sort(list_filter(a, lambda w: length(w) > 7)) = list_sort(list_filter(b, lambda w: length(w) > 7)) AS same FROM p")
def unordered_equality(spark, sf_dir):
    long = lambda c: F.array_sort(F.filter(c, lambda w: F.length(w) > 7))
    return _sets(spark, sf_dir).select("conv_id", "turn", (long("words") == long("next_words")).alias("same"))


@query(
    "X7_common_tokens",
    """WITH m AS (SELECT DISTINCT conv_id, turn, unnest(string_split(lower(text), ' ')) AS token FROM conversations), n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, token FROM m JOIN n USING (conv_id) WHERE length(token) > 2 GROUP BY conv_id, token, n HAVING count(*) = n""",
)
def common_tokens(spark, sf_dir):
    """Tokens that all members of a group share, by counting members per token."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    n = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    tokens = turns.select("conv_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("token")).where(F.length("token") > 2)
    return tokens.groupBy("conv_id", "token").agg(F.count(F.lit(1)).alias("members")).join(n, "conv_id").where("members = n").select("conv_id", "token")


# Predicates

@query("F1_comparisons", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 20 AND p_type IN ('PROMO', 'SMALL') AND p_brand IS NOT NULL AND p_brand IS DISTINCT FROM 'Brand#1'")
def comparisons(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.where(F.col("p_size").between(5, 20) & F.col("p_type").isin("PROMO", "SMALL") & F.col("p_brand").isNotNull() & ~F.col("p_brand").eqNullSafe("Brand#1")).select("p_partkey", "p_size")


@query("F2_substring", "SELECT p_partkey FROM part WHERE p_name ILIKE '%WIDG%'")
def substring(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_name").ilike("%WIDG%")).select("p_partkey")


@query("F3_prefixes", "SELECT p_partkey, n_name FROM part JOIN nation ON starts_with(p_brand || '.' || p_size, 'Brand#' || n_nationkey || '.') WHERE starts_with(p_name, 'red')")
def prefixes(spark, sf_dir):
    """The column form is an equi-join on the key cut at its first dot."""
    part = table(spark, sf_dir, "part").where(F.col("p_name").startswith("red")).withColumn("member", F.concat_ws(".", "p_brand", "p_size"))
    nation = table(spark, sf_dir, "nation").withColumn("owner", F.concat(F.lit("Brand#"), F.col("n_nationkey")))
    return part.join(nation, F.substring_index("member", ".", 1) == F.col("owner")).select("p_partkey", "n_name")


@query("F4_array_predicates", f"{_TURNS} SELECT conv_id, turn FROM p WHERE list_contains(a, 'the') AND NOT list_contains(b, 'la') AND list_has_any(a, b) AND len(b) > 0")
def array_predicates(spark, sf_dir):
    return _sets(spark, sf_dir).where(F.array_contains("words", "the") & ~F.array_contains("next_words", "la") & F.arrays_overlap("words", "next_words") & (F.size("next_words") > 0)).select("conv_id", "turn")


@query("F5_other_end", f"SELECT src, dst, CASE WHEN src = 7 THEN dst ELSE src END AS other FROM {B.EDGES} WHERE src = 7 OR dst = 7")
def other_end(spark, sf_dir):
    return B.edges(spark, sf_dir).where("src = 7 OR dst = 7").select("src", "dst", F.when(F.col("src") == 7, F.col("dst")).otherwise(F.col("src")).alias("other"))


def trgm_sql(a: str, b: str) -> str:
    return jaccard_sql(trigrams_sql(a), trigrams_sql(b))


@query("F6_trigram_filter", f"SELECT sv_id, round({trgm_sql('name', NAME_PROBE)}, 6) AS name_sim FROM {B.SYMBOLS} WHERE {trgm_sql('name', NAME_PROBE)} >= 0.3 OR name ILIKE '%' || {NAME_PROBE} || '%'")
def trigram_filter(spark, sf_dir):
    probe = F.lit(NAME_PROBE.strip("'"))
    sim = T.trigram_similarity(F.col("name"), probe)
    return B.symbols(spark, sf_dir).where((sim >= 0.3) | F.contains(F.lower("name"), F.lower(probe))).select("sv_id", F.round(sim, 6).alias("name_sim"))


@query("F7_latest_only", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders o WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def latest_only(spark, sf_dir):
    latest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderkey", "o_totalprice")).alias("last"))
    return latest.select("o_custkey", "last.o_orderkey", "last.o_totalprice")


@query("F8_row_validation", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, value FROM events WHERE event_id IS NOT NULL AND TRY_CAST(json_extract_string(props, '$.k') AS INT) IS NOT NULL AND value >= 1")
def row_validation(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') AS INT)").alias("k"), "value")
    return events.where("event_id IS NOT NULL AND k IS NOT NULL AND value >= 1")
