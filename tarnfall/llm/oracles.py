"""SQL for DuckDB of the queries that SQL can express; hashes, merges, draws and trained models it cannot."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, source, t, regexp_extract_all(t, '{_WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS ls FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY r),
ln AS (SELECT r, source, t, regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS lw FROM (SELECT r, source, t, unnest(ls) AS l FROM w)),
host AS (SELECT source, count(DISTINCT t) AS texts FROM w GROUP BY source),
often AS (
  SELECT n.source, n.line FROM (SELECT source, array_to_string(lw, ' ') AS line, count(DISTINCT t) AS texts FROM ln GROUP BY 1, 2) n
  JOIN host h ON h.source IS NOT DISTINCT FROM n.source WHERE n.texts > greatest(50, 0.1 * h.texts)),
gone AS (SELECT r, sum(len(lw)) AS n FROM ln JOIN often o ON o.source IS NOT DISTINCT FROM ln.source AND o.line = array_to_string(lw, ' ') GROUP BY r),
c AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS boilerplate_words
  FROM w LEFT JOIN covered USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - boilerplate_words >= 0.2 * n_words AS kept
FROM c"""

#: Twenty bits, five hexadecimal digits, are four letters.
OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS least FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, (i // 4) * 5 + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
FROM m"""

OP10 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.v, v.v) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
n AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM n WHERE rank <= 20"""


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bits = "list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), xor(s, x))"
    return f"xor(4294967295, list_reduce(list_transform(string_split({text}, ''), lambda ch: CAST(ord(ch) AS BIGINT)), lambda s, x: {bits}, CAST(4294967295 AS BIGINT)))"


#: All pairs of equal words at each lag, as islands; an island inside one of a smaller lag has a smaller period.
OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, {crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
a AS (SELECT r, doc_id, h, w, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM p),
u AS (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS x FROM t WHERE n > 0),
m AS (SELECT l.r, k.i - l.i AS q, l.i FROM u l JOIN u k ON l.r = k.r AND l.x = k.x AND k.i > l.i AND 2 * (k.i - l.i) <= l.n),
f AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m),
c AS (SELECT r, q, min(i) AS s, max(i) + 1 + q AS e FROM f GROUP BY r, q, island HAVING count(*) >= greatest(q, 12 - q)),
runs AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.r = c.r AND o.q < c.q AND o.s <= c.s AND o.e >= c.e)),
gone AS (SELECT DISTINCT r, unnest(range(s + q, e)) AS i FROM runs),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM u ANTI JOIN gone USING (r, i) GROUP BY r),
best AS (
  SELECT r, count(*) AS n_runs, string_agg(concat(s, ',', e - s, ',', q, chr(10)), '' ORDER BY s, q) AS lines, min(row(s - e, s, q)) AS b FROM runs GROUP BY r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b[2] AS BIGINT) AS start, CAST(-b[1] AS BIGINT) AS length, CAST(b[3] AS BIGINT) AS period,
  CAST(1000 * -b[1] // b[3] AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM t LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""

_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS w FROM benchmark),
v AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM v)),
dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
occ AS (SELECT r, i, k, item_id FROM dw JOIN win USING (k, g)),
hit AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT r, i, k FROM occ)) GROUP BY r),
it AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM occ WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)"""

OP13 = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.base WHERE pos <= h
  UNION ALL SELECT conv_id, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos > h),
s AS (SELECT conv_id, list(concat(strlen(role), ':', role, text) ORDER BY pos) AS w, list(strlen(text) ORDER BY pos) AS z FROM r GROUP BY conv_id),
a AS (SELECT conv_id, coalesce(w, []) AS w, coalesce(z, []) AS z FROM c LEFT JOIN s USING (conv_id)),
p AS (SELECT conv_id, d, w[1:d] AS k, CASE WHEN d > 0 THEN z[d] ELSE 0 END AS bytes, d = len(w) AS ends FROM (SELECT *, unnest(range(len(w) + 1)) AS d FROM a)),
n AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n, min(bytes) AS bytes, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY d, k),
kids AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
x AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids USING (d, k)),
sub AS (SELECT b AS d, k[1:b] AS k, sum((n - 1) * bytes) AS spare, count(*) FILTER (kids = 0) AS leaves FROM (SELECT *, unnest(range(d + 1)) AS b FROM x) GROUP BY ALL)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(x.n AS BIGINT) AS n_convs, CAST(x.kids AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(spare AS BIGINT) AS saved_tokens, x.ends_sha256
FROM x JOIN sub USING (d, k) LEFT JOIN n up ON up.d = x.d - 1 AND up.k = x.k[1:x.d - 1]"""

ORACLES = {"op7_line_rules": OP7, "op8_warc": OP8, "op10_kd_topk": OP10, "op11_periodic_runs": OP11, "op12_decontaminate": OP12, "op13_prefix_trie": OP13}
