"""SQL that gives the same rows as the registered queries, where SQL can."""



def _level(d: int) -> str:
    """One level of the template tree, from r{d-1} to r{d}."""
    return f"""
c{d} AS (SELECT *, nullif(split_part(shape, '/', {d}), '') AS seg FROM r{d - 1}),
k{d} AS (SELECT host, branch, seg, sum(labelled)::DOUBLE AS l, sum(bad)::DOUBLE AS b, CASE WHEN sum(n) >= 3 THEN seg ELSE '*' END AS fixed FROM c{d} WHERE seg IS NOT NULL GROUP BY host, branch, seg),
s{d} AS (SELECT host, branch, fixed, sum(l) AS l, sum(b) AS b, sum(sum(l)) OVER (PARTITION BY host, branch) AS el, sum(sum(b)) OVER (PARTITION BY host, branch) AS eb FROM k{d} GROUP BY host, branch, fixed),
m{d} AS (SELECT host, branch, fixed, CASE WHEN l > 0 AND el > l AND abs(b / l - (eb - b) / (el - l)) <= 1.96 * sqrt((eb / el) * (1 - eb / el) * (1 / l + 1 / (el - l))) THEN '*' ELSE fixed END AS name FROM s{d}),
n{d} AS (SELECT c{d}.host, shape, n, labelled, bad, purity AS above, c{d}.branch || '/' || name AS branch, general || '/' || fixed AS general
  FROM c{d} JOIN k{d} USING (host, branch, seg) JOIN m{d} USING (host, branch, fixed)),
g{d} AS (SELECT general, sum(bad)::DOUBLE / nullif(sum(labelled), 0) AS rate FROM n{d} GROUP BY general),
j{d} AS (SELECT host, branch, sum(labelled)::DOUBLE AS l, sum(bad)::DOUBLE AS b, max(above) AS above, sum(n * rate) / sum(n) FILTER (WHERE rate IS NOT NULL) AS rate FROM n{d} JOIN g{d} USING (general) GROUP BY host, branch),
r{d} AS (SELECT host, shape, n, labelled, bad, purity, branch, general FROM c{d} WHERE seg IS NULL UNION ALL
  SELECT host, shape, n, labelled, bad, (b + 4.0::DOUBLE * coalesce(sqrt(j{d}.above * rate), j{d}.above)) / (l + 4.0::DOUBLE), branch, general FROM n{d} JOIN j{d} USING (host, branch)),"""


ORACLES = {
    "op8_chunk_recipes": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
    "op4_url_template_tree": r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules AS (SELECT * FROM (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
    ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')) AS r(rule, domain, start, said)),
fit AS (SELECT page_id, rule, said, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS rn
  FROM p JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start)),
seen AS (SELECT p.*, rule, said, CASE said WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS bad,
    array_to_string(list_transform(list_filter(string_split(path, '/'), lambda s: s <> '')[1:4], lambda s: CASE WHEN regexp_matches(s, '[0-9]') OR length(s) > 32 THEN '*' ELSE s END), '/') AS shape
  FROM p LEFT JOIN fit ON fit.page_id = p.page_id AND rn = 1),
shapes AS (SELECT host, shape, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM seen GROUP BY host, shape),
r0 AS (SELECT host, shape, n, labelled, bad, sum(bad) OVER (PARTITION BY host)::DOUBLE / (sum(labelled) OVER (PARTITION BY host) + 4.0::DOUBLE) AS purity, '' AS branch, '' AS general FROM shapes),"""
    + "".join(map(_level, range(1, 5)))
    + """
pure AS (SELECT host, shape, branch, round(purity, 6) AS purity FROM r4)
SELECT page_id, seen.host, path, rule, coalesce(said, CASE WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, branch, purity
FROM seen LEFT JOIN pure ON pure.host = seen.host AND pure.shape = seen.shape""",
    "op6_line_similarity_join": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS body, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents),
w AS (SELECT doc_id, line, list_sort(list_transform(list_distinct(list_filter(string_split_regex(body, '[\x20\x09-\x0D]+'), lambda x: x <> '')), lambda x: substr(md5(x), 1, 8) || x)) AS words FROM l),
c AS (SELECT words, len(words) AS n, min((doc_id, line)) AS first, row_number() OVER () AS i FROM w WHERE len(words) > 0 GROUP BY words),
x AS (SELECT i, n, first, unnest(words[1:n - CAST(ceil(0.8 * n - 1e-9) AS BIGINT) + 1]) AS token FROM c WHERE n >= 4),
p AS (SELECT DISTINCT a.i AS i, b.i AS j FROM x a JOIN x b ON a.token = b.token AND a.first > b.first AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n),
gone AS (SELECT DISTINCT a.words FROM p JOIN c a ON a.i = p.i JOIN c b ON b.i = p.j
  WHERE 5 * len(list_intersect(a.words, b.words)) >= 4 * len(list_distinct(list_concat(a.words, b.words)))),
m AS (SELECT w.doc_id, w.line, len(w.words) > 0 AND (gone.words IS NOT NULL OR (w.doc_id, w.line) <> c.first) AS removed
  FROM w LEFT JOIN c ON c.words = w.words LEFT JOIN gone ON gone.words = w.words)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE removed) AS n_removed,
  coalesce(string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) FILTER (WHERE removed), '') AS removed_lines FROM m GROUP BY doc_id""",
}
