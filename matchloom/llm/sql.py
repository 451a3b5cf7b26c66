"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {}

#: Same steps as linededup.visible_text and url_host.
PAGE_LINES = r"""
WITH stripped AS (
  SELECT page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1), '') AS host,
    regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'gis'), '[\n\r]+', ' ', 'g') AS h
  FROM pages),
shown AS (
  SELECT page_id, host, replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(h, '</?(p|div|br|li|ul|ol|h[1-6]|nav|article|footer|header|title|section|table|tr|td|body|head|html)\b[^>]*>', chr(10), 'gi'), '<[^>]*>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS text
  FROM stripped)
"""

ORACLES["op4_line_dedup"] = (
    PAGE_LINES
    + r"""
, lines AS (
  SELECT page_id, host, i, line, regexp_replace(line, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS k
  FROM (SELECT page_id, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM shown)),
totals AS (SELECT host, count(DISTINCT text) AS total FROM shown GROUP BY host),
counts AS (SELECT l.host, k, count(DISTINCT s.text) AS n FROM lines l JOIN shown s ON l.page_id = s.page_id WHERE k <> '' GROUP BY l.host, k),
gone AS (SELECT c.host, c.k FROM counts c JOIN totals t ON c.host IS NOT DISTINCT FROM t.host WHERE c.n - 1.5 * sqrt(c.n) > 0.05 * t.total),
marked AS (SELECT l.*, g.k IS NOT NULL AS dropped FROM lines l LEFT JOIN gone g ON l.host IS NOT DISTINCT FROM g.host AND l.k = g.k),
kept AS (
  SELECT page_id, host, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '') AS text
  FROM marked GROUP BY page_id, host)
SELECT page_id, host, n_lines, n_dropped, length(text)::BIGINT AS kept_chars, md5(text) AS kept_md5 FROM kept
"""
)

#: Grids of quality.GRIDS; 53 cutoffs; risk 0.02 over 4 rules; error 0.05.
GRID_ROWS = """VALUES ('s_symbols', [0, 5, 10, 20, 30, 50, 75, 100, 150, 200, 300, 500, 750, 1000]),
  ('s_dup_lines', [0, 50, 100, 150, 200, 250, 300, 400, 500, 600, 700, 800, 900]),
  ('s_repeats', [0, 10, 20, 30, 50, 75, 100, 150, 200, 250, 300, 400, 450]),
  ('s_word_len', [4500, 5000, 5500, 6000, 6500, 7000, 7500, 8000, 9000, 10000, 12000, 15000, 20000])"""

ORACLES["op8_quality_rules"] = (
    r"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
    [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM documents),
windows AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
s AS (
  SELECT d.doc_id, d.lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id),
scored AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS s_symbols,
    CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS s_dup_lines,
    CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS s_repeats,
    CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS s_word_len
  FROM s),
good AS (SELECT * FROM scored WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
grid AS (SELECT rule, unnest(cutoffs) AS cutoff FROM ("""
    + GRID_ROWS
    + r""") g(rule, cutoffs)),
counts AS (
  SELECT lang, rule, cutoff, count(*) AS n, count(*) FILTER (WHERE CASE rule WHEN 's_symbols' THEN s_symbols WHEN 's_dup_lines' THEN s_dup_lines WHEN 's_repeats' THEN s_repeats ELSE s_word_len END > cutoff) AS k
  FROM good, grid GROUP BY lang, rule, cutoff),
tests AS (
  SELECT lang, rule, cutoff, CASE WHEN k > n * 0.005 THEN 1 ELSE
    (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.005) + (n - i) * ln(0.995))) FROM (SELECT unnest(range(0, k + 1)) AS i)) END AS p,
    53 * (SELECT count(DISTINCT coalesce(lang, '?')) FROM good) AS m
  FROM counts),
limits AS (SELECT lang, rule, min(cutoff) AS cutoff FROM tests WHERE p <= 0.05 / m GROUP BY lang, rule),
wide AS (
  SELECT lang, min(cutoff) FILTER (WHERE rule = 's_symbols') AS c1, min(cutoff) FILTER (WHERE rule = 's_dup_lines') AS c2,
    min(cutoff) FILTER (WHERE rule = 's_repeats') AS c3, min(cutoff) FILTER (WHERE rule = 's_word_len') AS c4 FROM limits GROUP BY lang),
judged AS (
  SELECT s.*, (coalesce(s_symbols > c1, false)::INT + coalesce(s_dup_lines > c2, false)::INT + coalesce(s_repeats > c3, false)::INT + coalesce(s_word_len > c4, false)::INT) AS rules_failed
  FROM scored s LEFT JOIN wide w ON s.lang IS NOT DISTINCT FROM w.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rules_failed = 0 AS kept, rules_failed FROM judged
"""
)

#: Shingles, all pairs that share one, and reachability over the linked ones.
ORACLES["op1_ngram_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 75 * (s.n + t.n - c)),
links AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
first_of AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id))::BIGINT AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN first_of ON x = d.doc_id
"""


def doubled_hashes() -> str:
    """CTEs h1, h2, h4 ... h128: the hash of so many bytes from each place on, from two hashes of half as many."""
    out, kept = ["h1 AS (SELECT doc_id, i, n, x, hash(x) AS h1 FROM bytes)"], ""
    for size in (2, 4, 8, 16, 32, 64, 128):
        half = size // 2
        kept += f", h{half}" if half in (8, 64) else ""
        out.append(f"h{size} AS (SELECT doc_id, i, n, x{kept}, hash(h{half}, lead(h{half}, {half}) OVER place) AS h{size} FROM h{half} WINDOW place AS (PARTITION BY doc_id ORDER BY i))")
    return ",\n".join(out)


#: Every 200-byte string by its hash (128 + 64 + 8 bytes), those that occur twice, and the bytes they cover.
ORACLES["op3_suffix_dedup"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents),
bytes AS (SELECT doc_id, unnest(b) AS x, generate_subscripts(b, 1) AS i, len(b) AS n FROM d),
{doubled_hashes()},
strings AS (
  SELECT doc_id, i, x, CASE WHEN i + 199 <= n THEN hash(h128, lead(h64, 128) OVER place, lead(h8, 192) OVER place) END AS s
  FROM h128 WINDOW place AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT s FROM strings WHERE s IS NOT NULL GROUP BY s HAVING count(*) > 1),
marked AS (
  SELECT doc_id, i, x, max((a.s IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone
  FROM strings LEFT JOIN again a ON strings.s = a.s),
runs AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS begins FROM marked),
kept AS (SELECT doc_id, sum(gone) AS n_removed, count_if(begins) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (gone = 0) AS rest FROM runs GROUP BY doc_id)
SELECT d.doc_id, len(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(rest, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def crc_shifts(levels: int = 24) -> list[list[int]]:
    """For each level k, what a CRC-32 register with one bit set becomes by 2**k more zero bytes: 32 numbers."""

    def step(c: int) -> int:
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        return c

    images, out = [(1 << j >> 8) ^ step((1 << j) & 255) for j in range(32)], []
    for _ in range(levels):
        out.append(images)
        moved = []
        for c in images:
            r = 0
            for j in range(32):
                r ^= images[j] if c >> j & 1 else 0
            moved.append(r)
        images = moved
    return out


def crc_levels() -> str:
    """CTEs crc1, crc2 ...: registers of blocks of 2, 4 ... bytes from crc0 (doc_id, j: bytes that follow, v)."""

    def image(images: list[int]) -> str:
        terms = [f"(v >> {j} & 1) * {c}" for j, c in enumerate(images)]
        while len(terms) > 1:
            terms = [f"xor({a}, {b})" for a, b in zip(terms[::2], terms[1::2], strict=True)]
        return terms[0]

    return ",\n".join(f"crc{k + 1} AS (SELECT doc_id, j // 2 AS j, bit_xor(CASE WHEN j % 2 = 1 THEN {image(c)} ELSE v END) AS v FROM crc{k} GROUP BY doc_id, j // 2)" for k, c in enumerate(crc_shifts()))


#: Rows in the order of their cells walk the ring one by one; a register of each text for its checksum (texts below 2**24 bytes).
ORACLES["op6_ring_shards"] = rf"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT doc_id, encode(coalesce(text, '')) AS raw, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS point FROM documents),
served AS MATERIALIZED (SELECT doc_id, point // 1048576 AS cell, row_number() OVER (ORDER BY point, doc_id) AS k FROM docs),
nodes AS (SELECT s, ('0x' || substr(md5('shard-' || s || '/vnode-' || v), 1, 8))::BIGINT AS p FROM range(24) a(s), range(160) b(v)),
orders AS MATERIALIZED (
  SELECT cell, list(s ORDER BY distance, s) AS shards
  FROM (SELECT cell, s, min((p - cell * 1048576 + 4294967296) % 4294967296) AS distance FROM (SELECT DISTINCT cell FROM served), nodes GROUP BY cell, s) GROUP BY cell),
room AS MATERIALIZED (SELECT list(total // 24 + (s < total % 24)::INT ORDER BY s) AS cap FROM (SELECT count(*) AS total FROM docs), range(24) a(s)),
walk(k, used, shard, slot) AS (
  SELECT 0::BIGINT, [0::BIGINT FOR x IN range(24)], -1::BIGINT, -1::BIGINT
  UNION ALL
  SELECT k, [used[x + 1] + (x = pick)::INT FOR x IN range(24)], pick, used[pick + 1]
  FROM (SELECT served.k, used, [s FOR s IN shards IF used[s + 1] < cap[s + 1]][1] AS pick FROM walk JOIN served ON served.k = walk.k + 1 JOIN orders USING (cell), room)),
bits(n, i, c) AS (SELECT x, 0, x FROM range(256) t(x) UNION ALL SELECT n, i + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE i < 8),
bytes AS (SELECT doc_id, unnest(h) AS x, len(h) - generate_subscripts(h, 1) AS j FROM (SELECT doc_id, regexp_extract_all(hex(raw), '..') AS h FROM docs)),
crc0 AS (SELECT doc_id, j, c AS v FROM bytes JOIN bits ON i = 8 AND n = ('0x' || x)::BIGINT UNION ALL SELECT doc_id, octet_length(raw), 4294967295 FROM docs),
{crc_levels()}
SELECT docs.doc_id, octet_length(raw)::BIGINT + 8 AS size, xor(v, 4294967295)::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard, slot, NULL::INT AS grown_shard
FROM walk JOIN served USING (k) JOIN docs USING (doc_id) JOIN crc24 ON crc24.doc_id = docs.doc_id
"""

#: All frequent itemsets level by level, as sorted lists with the baskets that hold them; then those without an equal superset.
ORACLES["op11_closed_itemsets"] = """
WITH RECURSIVE e AS (SELECT DISTINCT sale_id, item_id FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL),
b AS (SELECT count(DISTINCT sale_id) AS baskets FROM e),
one AS (SELECT item_id, count(*) AS s FROM e GROUP BY item_id HAVING count(*) >= 5 AND count(*) * 20000 >= (SELECT baskets FROM b)),
f AS (SELECT e.* FROM e JOIN one USING (item_id)),
occ AS (
  SELECT [item_id] AS xs, item_id AS last, sale_id FROM f
  UNION ALL
  SELECT xs, last, sale_id FROM (
    SELECT list_append(o.xs, f.item_id) AS xs, f.item_id AS last, o.sale_id, count(*) OVER (PARTITION BY o.xs, f.item_id) AS n
    FROM occ o JOIN f ON f.sale_id = o.sale_id AND f.item_id > o.last)
  WHERE n >= 5 AND n * 20000 >= (SELECT baskets FROM b)),
freq AS (SELECT xs, count(*) AS support FROM occ GROUP BY xs),
part AS (SELECT xs, support, c, list_filter(xs, lambda x: x <> c) AS rest FROM (SELECT xs, support, unnest(xs) AS c FROM freq WHERE len(xs) > 1)),
closed AS (SELECT * FROM freq WHERE NOT EXISTS (SELECT 1 FROM part WHERE part.rest = freq.xs AND part.support = freq.support)),
told AS (
  SELECT p.xs, p.c, r.support AS a, one.s FROM part p JOIN freq r ON r.xs = p.rest JOIN one ON one.item_id = p.c
  WHERE 100 * p.support >= 60 * r.support AND p.support * (SELECT baskets FROM b) > r.support * one.s),
rules AS (SELECT xs, count(*) AS n, arg_min(c, (a, c)) AS best, string_agg(c || ':' || a || ':' || s, ';' ORDER BY c) AS said FROM told GROUP BY xs)
SELECT array_to_string(xs, ',') AS items, len(xs)::BIGINT AS n_items, support::BIGINT AS support, coalesce(n, 0)::BIGINT AS n_rules,
  best::BIGINT AS best_item, sha256(coalesce(said, '')) AS rules_sha256
FROM closed LEFT JOIN rules USING (xs)
"""

#: The trees level by level (tree), their runs, then every leaf's way through its source (up) and over the sources (top).
ORACLES["op12_merkle_manifest"] = """
WITH RECURSIVE coded AS (
  SELECT doc_id, source, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM documents),
step(n, i, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT n, i + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE i < 8),
bytes AS (SELECT n, v FROM step WHERE i = 8),
odd(doc_id, rest, v) AS (
  SELECT DISTINCT doc_id, doc_id::VARCHAR, 4294967295 FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, rest[2:], xor(b.v, o.v >> 8) FROM odd o JOIN bytes b ON b.n = xor(o.v & 255, ord(o.rest[1])) WHERE rest <> ''),
even AS (SELECT doc_id FROM odd WHERE rest = '' AND xor(v, 4294967295) % 2 = 0),
hashed AS (
  SELECT c.doc_id, c.source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN e.doc_id IS NULL THEN sha256(head || coalesce(strlen(text) || ':' || text, '-'))
      ELSE sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS changed
  FROM coded c LEFT JOIN even e ON e.doc_id = c.doc_id),
leaf AS (
  SELECT *, coalesce('s' || source, '-') AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    row_number() OVER () AS row, count(*) OVER (PARTITION BY source) AS n FROM hashed),
tree(k, lvl, i, n, d) AS (
  SELECT k, 0, i, n, leaf FROM leaf
  UNION ALL SELECT k, lvl + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY k, lvl, i // 3),
sub AS (SELECT k, d, row_number() OVER (ORDER BY encode(k)) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
crown(lvl, i, n, d) AS (
  SELECT 0, i, n, d FROM sub
  UNION ALL SELECT lvl + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM crown WHERE n > 1 GROUP BY lvl, i // 3),
runs AS (SELECT k, lvl, i // 3 AS r, list(d ORDER BY i) AS run FROM tree WHERE n > 1 GROUP BY k, lvl, i // 3),
bands AS (SELECT lvl, i // 3 AS r, list(d ORDER BY i) AS run FROM crown WHERE n > 1 GROUP BY lvl, i // 3),
up(row, k, lvl, i, f, proof) AS (
  SELECT row, k, 0, i, changed, '' FROM leaf
  UNION ALL SELECT u.row, u.k, u.lvl + 1, u.i // 3,
    sha256(array_to_string(run[1:u.i % 3], '') || u.f || array_to_string(run[u.i % 3 + 2:], '')),
    u.proof || array_to_string(run[1:u.i % 3], '') || array_to_string(run[u.i % 3 + 2:], '')
  FROM up u JOIN runs r ON r.k = u.k AND r.lvl = u.lvl AND r.r = u.i // 3),
reached AS (SELECT u.*, s.d AS subroot, s.i AS j FROM up u JOIN sub s USING (k) WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.k = u.k AND r.lvl = u.lvl)),
top(row, subroot, lvl, i, f, proof) AS (
  SELECT row, subroot, 0, j, f, proof FROM reached
  UNION ALL SELECT t.row, t.subroot, t.lvl + 1, t.i // 3,
    sha256(array_to_string(run[1:t.i % 3], '') || t.f || array_to_string(run[t.i % 3 + 2:], '')),
    t.proof || array_to_string(run[1:t.i % 3], '') || array_to_string(run[t.i % 3 + 2:], '')
  FROM top t JOIN bands b ON b.lvl = t.lvl AND b.r = t.i // 3)
SELECT l.doc_id, l.leaf, t.subroot, (SELECT d FROM crown WHERE n = 1) AS root, sha256(t.proof) AS proof_sha256, t.f AS folded_root,
  t.f = (SELECT d FROM crown WHERE n = 1) AS verified
FROM leaf l JOIN top t USING (row) WHERE NOT EXISTS (SELECT 1 FROM bands b WHERE b.lvl = t.lvl)
"""
