"""DuckDB SQL for the corpus queries that SQL can express, over whole tables."""

from __future__ import annotations

from .sharding import FACTOR, KEYS, PRIME

LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, {LOWER.format(x="coalesce(regexp_extract(rest, '^[^/?#]*'), '')")} AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), r(verdict, rule, rhost, rpath) AS (
  VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
    ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), m AS (
  SELECT h.*, r.rule, r.verdict,
    row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(r.rule) DESC NULLS LAST) AS k
  FROM (SELECT DISTINCT * FROM h) h LEFT JOIN r ON (h.host = r.rhost OR ends_with(h.host, '.' || r.rhost)) AND starts_with(h.path, r.rpath)
), d AS (SELECT * FROM m WHERE k = 1), p(pattern, i) AS (
  VALUES ('(?:^|\\.)ads\\.', 0), ('/login(?:/|$)', 1), ('/cart(?:/|$)', 2), ('\\.exe$', 3), ('\\.zip$', 4)
), f AS (
  SELECT d.page_id, d.host, d.path, arg_min(p.pattern, p.i) AS pattern FROM d JOIN p ON d.rule IS NULL AND regexp_matches(d.host || d.path, p.pattern) GROUP BY ALL
)
SELECT h.page_id, h.host, h.path, d.rule, f.pattern, coalesce(d.verdict, CASE WHEN f.pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM h JOIN d ON h.page_id IS NOT DISTINCT FROM d.page_id AND h.host = d.host AND h.path = d.path
LEFT JOIN f ON h.page_id IS NOT DISTINCT FROM f.page_id AND h.host = f.host AND h.path = f.path
"""

#: The hit words of every document: item windows of ten words (or the whole of a shorter item) found in the documents' word lists.
OP4 = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all({LOWER.format(x="text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents
), i AS (
  SELECT DISTINCT item_id::VARCHAR AS item, regexp_extract_all({LOWER.format(x="text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), g AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS g
  FROM i, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(s) WHERE len(w) > 0
), s AS (
  SELECT rid, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM d, (SELECT DISTINCT n FROM g) AS sizes, unnest(range(1, greatest(len(w) - n, -1) + 2)) AS t(p)
), hits AS (SELECT rid, p, g.n, item FROM s JOIN g ON s.g = g.g AND s.n = g.n),
words AS (SELECT rid, count(DISTINCT q) AS n_hit FROM hits, unnest(range(p, p + n)) AS t(q) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""


def _rounds() -> str:
    """The CTEs of one cycle-walking pass after another; a pass leaves numbers below n alone once they have moved."""
    f = lambda x, key: f"(((({x} * {FACTOR} + {key}) % {PRIME}) * (({x} * {FACTOR} + {key}) % {PRIME}) + {key}) % {PRIME})"
    value = lambda x, key: f"(({f(x, key)} * {f(x, key)} + {x}) % {PRIME})"
    out, last = [], "w0"
    for k in range(6):
        out.append(f"a{k} AS (SELECT *, x // b AS l, x % b AS r, {'true' if k == 0 else 'x >= n'} AS go FROM {last})")
        at = f"a{k}"
        for j, (first, second) in enumerate(KEYS):
            out.append(f"b{k}_{j} AS (SELECT * REPLACE ((l + {value('r', first)}) % a AS l) FROM {at})")
            out.append(f"c{k}_{j} AS (SELECT * REPLACE ((r + {value('l', second)}) % b AS r) FROM b{k}_{j})")
            at = f"c{k}_{j}"
        last = f"w{k + 1}"
        out.append(f"{last} AS (SELECT doc_id, size, text_crc32, n, a, b, CASE WHEN go THEN l * b + r ELSE x END AS x FROM {at})")
    return ",\n".join(out)


#: CRC-32 from its table over the bytes, then the permutation over row numbers.
OP5 = f"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM range(256) AS r(i))
), d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ((strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1)::BIGINT) AS bytes
  FROM documents
), s AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]))) AS text_crc32 FROM d, crc
), q AS (SELECT count(*) AS n FROM documents),
p AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM (SELECT n, greatest(1, ceil(sqrt(n::DOUBLE))::BIGINT) AS a FROM q)),
w0 AS (SELECT s.*, n, a, b, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS x FROM s, p),
{_rounds()}
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (x % 40)::INTEGER AS shard, x // 40 AS slot, NULL::INTEGER AS grown_shard FROM w6
"""

#: Links over shared shingles, then reachability.
OP6 = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS t(p) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS m FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.m = e.a),
k AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""

#: Brute force over all pairs of a query and a row.
OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

#: Base 32 from the digest's bits; the largest page_id of each payload is the response.
OP9 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages
), b AS (
  SELECT *, array_to_string(list_transform(regexp_extract_all(upper(sha1(payload)), '.'), lambda c: right('000' || bin(strpos('0123456789ABCDEF', c) - 1), 4)), '') AS bits FROM p
)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[list_reduce(list_prepend(0::BIGINT, list_transform(range(5), lambda j: bits[i * 5 + j + 1]::BIGINT)), lambda x, y: x * 2 + y) + 1]), '') AS payload_digest,
  CASE WHEN page_id = last OR last IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last OR last IS NULL THEN NULL ELSE last END AS refers_to
FROM b
"""

#: Every window of 50 words with the smallest document it starts in.
OP10 = """
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS g FROM d, unnest(range(1, greatest(len(w) - 50, -1) + 2)) AS t(p)
), f AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g),
c AS (SELECT DISTINCT doc_id, q FROM s JOIN f USING (g), unnest(range(p, p + 50)) AS t(q) WHERE first < doc_id),
k AS (SELECT doc_id, list(q) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

SQL = {
    "op2_url_filter": OP2,
    "op4_decontamination": OP4,
    "op5_sharding": OP5,
    "op6_near_dedup": OP6,
    "op8_top_k": OP8,
    "op9_warc": OP9,
    "op10_substring_dedup": OP10,
}

SQL["op3_line_dedup"] = r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, i, line, regexp_matches(line, '[^ \t\r\v\f]') AS solid FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM l)),
s AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM x WHERE solid),
p AS (SELECT s.doc_id, i, j, array_to_string(l.ls[i:j], chr(10)) AS p FROM s JOIN l USING (doc_id) WHERE j IS NOT NULL),
f AS (SELECT doc_id, i, j, first_value(doc_id) OVER w AS fd, first_value(i) OVER w AS fi FROM p WINDOW w AS (PARTITION BY p ORDER BY doc_id, i)),
r AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS k FROM f WHERE NOT (doc_id = fd AND i <= fi + j - i)),
y AS (SELECT *, max(CASE WHEN solid THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS q FROM x),
d AS (SELECT y.*, a.k IS NOT NULL OR (NOT solid AND b.k IS NOT NULL) AS gone FROM y LEFT JOIN r a ON a.doc_id = y.doc_id AND a.k = y.i LEFT JOIN r b ON b.doc_id = y.doc_id AND b.k = y.q),
t AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS g, count(*) FILTER (WHERE solid AND NOT gone) AS left_over, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM d GROUP BY doc_id)
SELECT o.doc_id, coalesce(n, 0) AS n_lines, CASE WHEN coalesce(g, 0) = 0 THEN 0 WHEN left_over = 0 THEN n ELSE g END::BIGINT AS n_removed,
sha256(CASE WHEN coalesce(g, 0) = 0 THEN coalesce(text, '') WHEN left_over = 0 THEN '' ELSE kept END) AS kept_sha256 FROM documents o LEFT JOIN t USING (doc_id)"""
