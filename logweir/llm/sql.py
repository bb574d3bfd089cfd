"""DuckDB SQL for the registered queries that SQL can express."""

from .licenses import TEMPLATES

ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'"

OP2 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text,''), {ABC}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM l JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(c.m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""

OP8 = rf"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text,''), {ABC}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
iw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text,''), {ABC}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark),
it AS (SELECT item_id, ws, least(10, len(ws)) AS l FROM iw WHERE len(ws) > 0),
win AS (
  SELECT DISTINCT item_id, l, unnest(list_transform(range(1, len(ws) - l + 2), lambda i: array_to_string(ws[i:i+l-1], ' '))) AS win FROM it),
ls AS (SELECT DISTINCT l FROM it),
dw AS (
  SELECT doc_id, l, unnest(range(1, len(ws) - l + 2)) AS p,
    unnest(list_transform(range(1, len(ws) - l + 2), lambda i: array_to_string(ws[i:i+l-1], ' '))) AS win
  FROM w, ls WHERE len(ws) >= l),
m AS (SELECT doc_id, p, dw.l, item_id FROM dw JOIN win ON dw.l = win.l AND dw.win = win.win),
h AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM m) GROUP BY 1),
i AS (
  SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""

OP12 = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {ABC}) AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
g AS (
  SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i+m-1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(ws) >= m),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
k AS (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM f WHERE m > 1),
s AS (
  SELECT k.lang, k.m, k.phrase, k.a, k.k, l.a AS l, r.a AS r, ((2000000::HUGEINT * k.a) // (l.a + r.a))::BIGINT AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(ws[1:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(ws[k.k+1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT lang, array_to_string(ws[x:x+y-1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, m, a, string_split(phrase, ' ') AS ws FROM b), (SELECT unnest([1, 2, 3]) AS x), (SELECT unnest([2, 3]) AS y)
  WHERE y < m AND x + y - 1 <= m GROUP BY 1, 2)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase
WHERE i.longer IS NULL OR 100 * i.longer < 80 * a QUALIFY rank <= 2000
"""

# crc32 in SQL: the table of the polynomial 0xEDB88320 from its rule, bytes from code points below 256.
OP13 = rf"""
WITH RECURSIVE z AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i))),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), {ABC}) AS run FROM documents),
u AS (SELECT id, run, count(*) AS k FROM r WHERE length(run) >= 6 GROUP BY 1, 2),
b AS (
  SELECT run, k, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64]::BIGINT[] END)) AS bytes FROM u),
h AS (
  SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(t[xor(c % 256, x) + 1], c // 256))) AS h FROM b, z),
v AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM h),
w AS (SELECT word, sum(k)::BIGINT AS n FROM v WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
g AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
s AS (SELECT word, n, i, left(word, i - 1) || chr(1) || substr(word, i + 1) AS same, left(word, i - 1) || substr(word, i + 1) AS less FROM g),
p AS (
  SELECT a.word, b.word AS near, b.n AS m FROM s a JOIN s b ON a.same = b.same AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM s a JOIN w ON a.less = w.word
  UNION SELECT w.word, a.word, a.n FROM s a JOIN w ON a.less = w.word),
q AS (SELECT word, count(*) AS n_near, min((-m, near)) AS best FROM p GROUP BY 1),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best[1] >= 5 * w.n THEN best[2] END AS form, (CASE WHEN -best[1] >= 5 * w.n THEN -best[1] END)::BIGINT AS form_n
  FROM w LEFT JOIN q ON q.word = w.word),
o AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT o.word, f.form FROM o JOIN f ON f.word = o.root WHERE f.form IS NOT NULL),
e AS (SELECT word, arg_max(root, n) AS root FROM (SELECT o.word, o.root, f.n FROM o JOIN f ON f.word = o.root) GROUP BY 1)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, coalesce(e.root, f.word) AS root FROM f LEFT JOIN e ON e.word = f.word
"""

QUALITY = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
w AS (
  SELECT doc_id, unnest(range(1, len(ws) - 3)) AS p, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) AS win FROM d WHERE len(ws) >= 5),
r AS (SELECT doc_id, p FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, win) >= 2),
c AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM r) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len(ws) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(ws) AS base_failed
FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""

OP10 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS digest,
    len(list_filter(string_split_regex(coalesce(text,''), '[\x20\x09-\x0D]+'), lambda q: q <> ''))::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT source, source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM s),
c(capped, step) AS (
  SELECT []::VARCHAR[], 0
  UNION ALL
  SELECT list_sort((SELECT list(coalesce('s' || source, 'n')) FROM w WHERE list_contains(c.capped, coalesce('s' || source, 'n')) OR
    3 * source_size * (SELECT sum(weight) FROM w WHERE NOT list_contains(c.capped, coalesce('s' || source, 'n')))
    <= weight * ((SELECT sum(source_size) FROM w) - (SELECT coalesce(sum(3 * source_size), 0) FROM w WHERE list_contains(c.capped, coalesce('s' || source, 'n')))))), step + 1
  FROM c WHERE step < (SELECT count(*) FROM w)),
k AS (SELECT coalesce(capped, []) AS capped FROM c ORDER BY step DESC LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN list_contains(k.capped, coalesce('s' || source, 'n')) THEN (3 * source_size)::DOUBLE
    ELSE weight * ((SELECT sum(source_size) FROM w) - (SELECT coalesce(sum(3 * source_size), 0) FROM w WHERE list_contains(k.capped, coalesce('s' || source, 'n'))))::DOUBLE
      / (SELECT sum(weight) FROM w WHERE NOT list_contains(k.capped, coalesce('s' || source, 'n')))::DOUBLE END AS target
  FROM w, k),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS full_, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS at FROM t),
o AS (
  SELECT d.*, g.source_size, g.target, g.full_, round(g.target - g.full_ * g.source_size)::BIGINT AS gap, [-0.5, 0.0, 0.5][g.at % 3 + 1]::DOUBLE AS slope,
    (sum(size) OVER (PARTITION BY d.source ORDER BY digest) - size)::BIGINT AS c
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
-- A pass a step: of the documents that are not longer than what is missing, those up to the first that doesn't fit.
f(source, digest, size, gap, missing, lead_, step, active) AS (
  SELECT source, digest, size, gap, gap, NULL::BIGINT, 0, true FROM o WHERE size > 0
  UNION ALL
  SELECT source, digest, size, gap, missing - coalesce(sum(CASE WHEN ok THEN size END) OVER (PARTITION BY source), 0)::BIGINT,
    CASE WHEN ok THEN gap - missing + c ELSE lead_ END, step + 1, step = 0 OR max(ok::INT) OVER () = 1
  FROM (
    SELECT *, open AND c + size <= missing AS ok FROM (
      SELECT *, (sum(CASE WHEN open THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY CASE WHEN step = 0 THEN 0 ELSE -length(bin(size)) END, digest
        ROWS UNBOUNDED PRECEDING) - CASE WHEN open THEN size ELSE 0 END)::BIGINT AS c
      FROM (SELECT *, lead_ IS NULL AND size <= missing AS open FROM f WHERE active)))),
p AS (SELECT source, digest, max(lead_) AS lead_ FROM f GROUP BY 1, 2),
x AS (
  SELECT o.*, p.lead_, CASE WHEN o.size > 0 THEN full_ + (p.lead_ IS NOT NULL)::INT ELSE 0 END AS times
  FROM o LEFT JOIN p ON p.source IS NOT DISTINCT FROM o.source AND p.digest = o.digest),
e AS (SELECT *, unnest(range(times)) AS e FROM x),
u AS (SELECT *, least(1::DOUBLE, (e * source_size + CASE WHEN e = full_ THEN coalesce(lead_, c) ELSE c END) / greatest(target, 1::DOUBLE)) AS u FROM e),
v AS (
  SELECT *, CASE WHEN slope = 0 OR u = 0 THEN u
    ELSE (sqrt((1::DOUBLE - slope) * (1::DOUBLE - slope) + 4::DOUBLE * slope * u) - (1::DOUBLE - slope)) / (2::DOUBLE * slope) END AS position FROM u),
q AS (SELECT *, row_number() OVER (ORDER BY position, digest, e) - 1 AS rank FROM v),
a AS (SELECT digest, sum(size)::BIGINT AS taken, min(position) AS position, string_agg(rank::VARCHAR, ',' ORDER BY rank) AS ranks FROM q GROUP BY 1)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, position, coalesce(ranks, '') AS ranks
FROM x LEFT JOIN a USING (digest)
"""

OP1 = rf"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {ABC}) AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(host, path, rule, verdict) AS (VALUES
  ('com', '/en/', 'com/en/', 'block'), ('example.com', '/en/7', 'example.com/en/7', 'allow'), ('net', '/de/', 'net/de/', 'allow'),
  ('example.net', '/de/8', 'example.net/de/8', 'block'), ('org', '/es/', 'org/es/', 'block')),
f AS (
  SELECT u.*, (SELECT arg_max(r.rule, length(r.rule)) FROM r
    WHERE (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)) AS rule
  FROM u)
SELECT page_id, f.host, f.path, f.rule, coalesce(r.verdict, CASE WHEN list_has_any(string_split_regex(f.host, '[^0-9a-z]+'),
  ['adult','ads','bets','betting','casino','escort','gambling','lottery','pills','poker','porn','spam','viagra','xxx']) THEN 'block' ELSE 'allow' END) AS verdict
FROM f LEFT JOIN r ON f.rule = r.rule
"""

_BITS = "', '".join(f"{i:04b}" for i in range(16))
OP4 = rf"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body) AS n, sha1(body) AS x, max(page_id) OVER (PARTITION BY sha1(body)) AS keeper FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda j: ['{_BITS}'][strpos('0123456789abcdef', substr(x, j::INT, 1))]), '') AS bits FROM h)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
    + 16 * substr(bits, (1 + 5 * i)::INT, 1)::INT + 8 * substr(bits, (2 + 5 * i)::INT, 1)::INT + 4 * substr(bits, (3 + 5 * i)::INT, 1)::INT
    + 2 * substr(bits, (4 + 5 * i)::INT, 1)::INT + substr(bits, (5 + 5 * i)::INT, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM b
"""

_TEMPLATES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
_RUNS = "unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' '))) END) AS sh"
OP3 = rf"""
WITH t(license, text) AS (VALUES {_TEMPLATES}),
tw AS (SELECT license, list_filter(string_split_regex(translate(text, {ABC}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM t),
ts AS (SELECT license, {_RUNS} FROM tw),
tn AS (SELECT license, count(*) AS need FROM ts GROUP BY 1),
w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text,''), {ABC}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (SELECT doc_id, {_RUNS} FROM w),
m AS (SELECT doc_id, license, count(*) AS common FROM s JOIN ts USING (sh) GROUP BY 1, 2),
k AS (SELECT doc_id, license, common FROM m JOIN tn USING (license) WHERE common >= ceil(0.8 * need)),
g AS (SELECT doc_id, count(*) AS n, string_agg(license || ':' || common, ',' ORDER BY license) AS l FROM k GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::INT AS n_matches, coalesce(l, '') AS licenses FROM documents d LEFT JOIN g USING (doc_id)
"""

# Matches and what lies between them tell where each match stands.
_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", "length(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(d), i, 1)::INT "
        "WHEN substr(reverse(d), i, 1)::INT > 4 THEN 2 * substr(reverse(d), i, 1)::INT - 9 ELSE 2 * substr(reverse(d), i, 1)::INT END)) % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 8 AND 15"),
}
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS k, '{name}' AS kind, unnest(regexp_extract_all(t, '{p}')) AS v, unnest(regexp_split_to_array(t, '{p}')[:-2]) AS gap, generate_subscripts(regexp_extract_all(t, '{p}'), 1) AS i "
    f"FROM b WHERE regexp_matches(t, '{p}')"
    for k, (name, (p, _)) in enumerate(_KINDS.items())
)
_RIGHT = "CASE kind " + " ".join(f"WHEN '{name}' THEN {test}" for name, (_, test) in _KINDS.items()) + " END"
PII = rf"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({_FOUND}),
p AS (SELECT *, (sum(length(gap) + length(v)) OVER (PARTITION BY doc_id, kind ORDER BY i))::BIGINT AS e, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM f),
g AS (SELECT doc_id, k, kind, e - length(v) AS s, e FROM p WHERE {_RIGHT}),
a AS (
  SELECT doc_id, count_if(k = 0) AS n0, count_if(k = 1) AS n1, count_if(k = 2) AS n2, count_if(k = 3) AS n3, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS l
  FROM g GROUP BY 1)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_email, coalesce(n1, 0)::BIGINT AS n_ip, coalesce(n2, 0)::BIGINT AS n_card, coalesce(n3, 0)::BIGINT AS n_phone, sha256(coalesce(l, '')) AS base_sha256
FROM documents LEFT JOIN a USING (doc_id)
"""

SQL = {"pii_base": PII, "quality_base": QUALITY, "op1_url_filter": OP1, "op2_minhash": OP2, "op3_licenses": OP3, "op4_warc": OP4, "op8_decontaminate": OP8, "op10_mixing": OP10, "op12_phrases": OP12, "op13_variants": OP13}
