"""DuckDB SQL of the registered queries."""

SQL: dict[str, str] = {}

# ---- 4: hosts' scores in whole units, so both engines add up the same numbers -------------

ROUNDS = 8
UNIT = 1_000_000_000
HOST = r"translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
HREF = r"""[hH][rR][eE][fF]\s*=\s*["'']?\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#"''<>\s]+)"""


def _walk(name: str, verdict: str, src: str, dst: str) -> str:
    out = f"""{name}_shares AS (
  SELECT {src} AS src, {dst} AS dst, links, sum(links) OVER (PARTITION BY {src}) AS out_links FROM edges),
{name}_base AS (
  SELECT host, CAST(floor(seed * 15 / 100) AS BIGINT) AS score FROM (
    SELECT host, CAST(floor(count(*) FILTER (WHERE rule_verdict = '{verdict}') * {UNIT} / count(*)) AS BIGINT) AS seed
    FROM ruled WHERE host <> '' GROUP BY host) WHERE seed > 0),
{name}_0 AS (SELECT * FROM {name}_base),
"""
    for i in range(1, ROUNDS + 1):
        out += f"""{name}_{i} AS (
  SELECT host, CAST(sum(score) AS BIGINT) AS score FROM (
    SELECT * FROM {name}_base UNION ALL
    SELECT dst, CAST((CAST(score AS HUGEINT) * links * 85) // (out_links * 100) AS BIGINT)
    FROM {name}_shares s JOIN {name}_{i - 1} r ON s.src = r.host) GROUP BY host),
"""
    return out


SQL["op4_url_filters"] = rf"""
WITH rules(rule_host, rule_path, rule, rule_verdict) AS (VALUES
  ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
  ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')),
p AS (
  SELECT row_number() OVER () AS n, page_id, html, {HOST} AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fit AS (
  SELECT n, rule, rule_verdict, row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC, rule) AS k
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
ruled AS (
  SELECT page_id, host, path, rule, rule_verdict FROM p LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (n)),
edges AS (
  SELECT src, dst, count(*) AS links FROM (
    SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{HREF}', 1)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM p)
  WHERE src <> dst AND src <> '' GROUP BY src, dst),
{_walk("trust", "allow", "src", "dst")}{_walk("distrust", "block", "dst", "src")}
scored AS (
  SELECT r.*, coalesce(t.score, 0) AS trust, coalesce(d.score, 0) AS distrust FROM ruled r
  LEFT JOIN trust_{ROUNDS} t ON r.host = t.host LEFT JOIN distrust_{ROUNDS} d ON r.host = d.host)
SELECT page_id, host, path, rule,
       coalesce(rule_verdict, CASE WHEN distrust - trust > {UNIT // 20} THEN 'block' ELSE 'allow' END) AS verdict,
       trust, distrust
FROM scored"""

_LINKED = f"""
WITH named AS (SELECT page_id, {HOST} AS host FROM pages),
linked AS (
  SELECT page_id, url, coalesce(html, '') || coalesce((
    SELECT string_agg('<a href="http://' || host || '/">', '') FROM named t
    WHERE host <> '' AND t.page_id IN ((p.page_id * 7 + 3) % n, (p.page_id * 13 + 5) % n)), '') AS html
  FROM pages p, (SELECT count(*) AS n FROM pages)),
rules("""
SQL["linked_url_filters"] = SQL["op4_url_filters"].replace("\nWITH rules(", _LINKED).replace("AS path FROM pages)", "AS path FROM linked)")

# ---- 8 ----------------------------------------------------------------------------------

_ESCAPES = [
    ("&", "&amp;"), ("<|turn|>", "&lt;|turn|>"), ("<|text|>", "&lt;|text|>"),
    ("</s>", "&lt;/s>"), ("[INST]", "&#91;INST]"), ("[/INST]", "&#91;/INST]"),
]


def _escaped(c: str) -> str:
    for raw, safe in _ESCAPES:
        c = f"replace({c}, '{raw}', '{safe}')"
    return c


SQL["op8_chat_formatting"] = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations UNION ALL
    VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
o AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM r),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS turns,
    coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '') AS loss,
    CAST(sum(length('<|turn|>') + length({_escaped("role")}) + length('<|text|>') + length({_escaped("text")}) + length('</s>')) AS BIGINT) AS formatted_chars,
    bool_and(CASE WHEN prev IS NULL THEN role IN ('system', 'user') WHEN prev = 'system' THEN k = 2 AND role = 'user'
      WHEN prev = 'user' THEN role = 'assistant' WHEN prev = 'assistant' THEN role = 'user' ELSE false END) AS valid,
    max(role) FILTER (WHERE back = 1) AS last
  FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars, valid, valid AND last = 'assistant' AS complete
FROM g"""


# ---- 3 ----------------------------------------------------------------------------------

_GAP = r"[\x20\x09-\x0D]+"
_TRIM = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL["op3_quality_rules"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT n, doc_id, host, text, list_filter(regexp_split_to_array(text, '{_GAP}'), lambda x: x <> '') AS w FROM d),
t AS (
  SELECT n, i, count(*) OVER (PARTITION BY n, a, b, c) AS times FROM (
    SELECT n, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (
      SELECT n, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3))),
rep AS (
  SELECT n, count(DISTINCT i + k) AS n_repeat_words FROM t, (VALUES (0), (1), (2)) AS v(k) WHERE times > 1 GROUP BY n),
l AS (
  SELECT n, host, text, line, length(regexp_replace(line, '{_GAP}', '', 'g')) AS chars,
         regexp_replace(translate(trim(line, {_TRIM}), {_AZ}), '[0-9]+', '0', 'g') AS norm
  FROM (SELECT n, host, text, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
freq AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT text) AS k FROM l GROUP BY host, norm)
  JOIN (SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host) USING (host)
  WHERE k > 20 AND k * 100 > docs * CASE WHEN length(regexp_replace(norm, '{_GAP}', '', 'g')) >= 40 THEN 1 ELSE 10 END),
ln AS (
  SELECT n, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (WHERE f) AS n_frequent_lines,
         coalesce(sum(chars) FILTER (WHERE f), 0) AS removed
  FROM (SELECT l.*, freq.norm IS NOT NULL AS f FROM l LEFT JOIN freq USING (host, norm)) GROUP BY n),
j AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(text, '{_GAP}', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_frequent_lines, 0) AS n_frequent_lines, coalesce(removed, 0) AS removed
  FROM w LEFT JOIN rep USING (n) LEFT JOIN ln USING (n)),
k AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         (word_chars - removed) * 100 < word_chars * 30 AS depleted FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_frequent_lines, base_failed, depleted,
       NOT base_failed AND NOT depleted AS kept FROM k"""

# ---- 6 ----------------------------------------------------------------------------------

SQL["op6_line_dedup"] = rf"""
WITH l AS (
  SELECT doc_id, line, p, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded, trim(line, {_TRIM}) AS norm FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS p
    FROM documents)),
q AS (
  SELECT doc_id, p, norm, len(regexp_split_to_array(norm, '{_GAP}')) AS words,
         row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k, count(*) OVER (PARTITION BY doc_id) AS m FROM l WHERE worded),
o AS (
  SELECT *, lead(norm) OVER o AS b, lead(norm, 2) OVER o AS c, lead(words) OVER o AS more FROM q WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
win AS (
  SELECT doc_id, k, 3 AS n, false AS whole, [norm, b, c] AS key FROM o WHERE c IS NOT NULL UNION ALL
  SELECT doc_id, k, 2, false, [norm, b] FROM o WHERE b IS NOT NULL AND words + more >= 50 UNION ALL
  SELECT doc_id, k, 1, false, [norm] FROM o WHERE words >= 50 UNION ALL
  SELECT doc_id, k, m, true, [norm, b] FROM o WHERE m < 3 AND k = 1),
later AS (SELECT doc_id, k, n FROM (SELECT *, row_number() OVER (PARTITION BY n, whole, key ORDER BY doc_id, k) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, k + i AS k FROM later, (VALUES (0), (1), (2)) AS v(i) WHERE i < n) JOIN q USING (doc_id, k))
SELECT doc_id, count(*) FILTER (WHERE worded) AS n_lines, count(gone.p) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY l.p) FILTER (WHERE gone.p IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id"""

# ---- 9: three rounds, 8 shards ---------------------------------------------------------------


def _code(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY {c}) - 1 END"


def _round(i: int, k: int) -> str:
    spans = [f"CAST(max({c}) - min({c}) AS DOUBLE) / (SELECT coalesce(nullif(max({c}) - min({c}), 0), 1) FROM r0)" for c in ("d0", "d1", "d2")]
    return f"""n{i} AS (SELECT shard, sum(size) AS total, {spans[0]} AS s0, {spans[1]} AS s1, {spans[2]} AS s2 FROM r{i} GROUP BY shard),
a{i} AS (
  SELECT r.*, total, CASE WHEN s0 >= s1 AND s0 >= s2 THEN d0 WHEN s1 >= s2 THEN d1 ELSE d2 END AS axis
  FROM r{i} r JOIN n{i} USING (shard)),
c{i} AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY shard ORDER BY axis, text_crc32, doc_id, d0, d1, d2
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a{i}),
r{i + 1} AS (
  SELECT doc_id, size, text_crc32, d0, d1, d2,
         CASE WHEN (2 * before + size) * {k} <= total * 2 * {k // 2} THEN shard ELSE shard + {k // 2} END AS shard FROM c{i}),
"""


SQL["op9_sharding"] = f"""
WITH tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r0 AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 1 AS BIGINT) AS size,
         xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
           regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32, {_code("source")} AS d0, {_code("lang")} AS d1,
         CAST(coalesce(octet_length(encode(text)), 0) + 1 AS BIGINT) AS d2, 0 AS shard FROM documents, tab),
{_round(0, 8)}{_round(1, 4)}{_round(2, 2)}
z AS (SELECT 1)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM r3"""


# ---- 1: all pairs of sets that share a shingle, counted ---------------------------------------

SQL["op1_minhash_near_dedup"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '{_GAP}'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]]
      ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id
    GROUP BY x.doc_id, y.doc_id) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)"""


# ---- 5 ----------------------------------------------------------------------------------

SQL["op5_substring_dedup"] = rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_GAP}'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM i),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM h) WHERE least < doc_id),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
m AS (
  SELECT p.*, max(later.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM p LEFT JOIN later ON later.doc_id = p.doc_id AND later.i = p.i),
k AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""


# ---- 7 ----------------------------------------------------------------------------------

SQL["op7_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INT) AS rank, vec_id, score FROM r WHERE k <= 5"""

# ---- 11 ---------------------------------------------------------------------------------

SQL["op11_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT *, max(page_id) OVER (PARTITION BY b) AS head, octet_length(b) >= 1000 AS long FROM p)
SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest,
       CASE WHEN long AND page_id IS DISTINCT FROM head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN long AND page_id IS DISTINCT FROM head THEN head END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM h"""

# ---- 12, 13: words of ASCII letters, digits and all from U+0080 on -------------------------------


def _alnum(c: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({c}, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


_FEATURES = """unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f"""

SQL["op12_importance_resampling"] = f"""
WITH tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS n, doc_id, {_alnum("text")} AS w FROM documents),
df AS (SELECT n, f, count(*) AS k FROM (SELECT n, {_FEATURES} FROM d) GROUP BY n, f),
bf AS (SELECT f, count(*) AS k FROM (SELECT {_FEATURES} FROM (SELECT {_alnum("text")} AS w FROM benchmark)) GROUP BY f),
crc AS (
  SELECT f, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
    regexp_extract_all(hex(encode(f)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM (SELECT f FROM df UNION SELECT f FROM bf), tab),
s AS (SELECT bucket, sum(k) AS s FROM df JOIN crc USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(k) AS t FROM bf JOIN crc USING (f) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(s), 0) FROM s) + 10000 AS DOUBLE))
    / (CAST(s + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(t), 0) FROM t) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT n, CAST(sum(k) AS BIGINT) AS n_features, CAST(sum(k * gain) AS BIGINT) AS weight FROM df JOIN crc USING (f) JOIN g USING (bucket) GROUP BY n),
h AS (SELECT *, CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) AS h FROM d),
r AS (
  SELECT n, doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM h LEFT JOIN w USING (n)),
e AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS m FROM r WHERE n_words >= 20)
SELECT r.doc_id, r.n_features, r.weight, r.score, CASE WHEN k <= 5 * m // 100 THEN k END AS rank, r.n_words
FROM r LEFT JOIN e USING (n)"""

SQL["op13_ranked_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, {_alnum("text")} AS w FROM documents),
c AS (SELECT *, CAST(len(w) AS BIGINT) AS len FROM d WHERE len(w) > 0),
a AS (SELECT count(*) AS docs, CAST(sum(len) AS BIGINT) AS words FROM c),
p AS (SELECT n, term, count(*) AS tf FROM (SELECT n, unnest(w) AS term FROM c) GROUP BY n, term),
v AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM p, a GROUP BY term, docs),
q AS (SELECT DISTINCT item, item_id, term FROM (
  SELECT row_number() OVER () AS item, item_id, unnest({_alnum("text")}) AS term FROM benchmark)),
s AS (
  SELECT item, item_id, c.n, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len * docs) // words)))) AS BIGINT) AS score
  FROM q JOIN v USING (term) JOIN p USING (term) JOIN c ON c.n = p.n, a GROUP BY item, item_id, c.n, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS k FROM s WHERE score > 0)
SELECT item_id, CAST(k AS INT) AS rank, doc_id, score FROM r WHERE k <= 10"""
