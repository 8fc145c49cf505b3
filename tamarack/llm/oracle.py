"""The same results in SQL, by comparing everything with everything."""

from . import licenses, secrets

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(translate({text}, '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


NEAR_DEDUP = f"""WITH RECURSIVE w AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
  s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS g FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
  l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
  e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
  r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
  c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
  SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id"""

LINE_DEDUP = f"""WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
  o AS (SELECT doc_id, unnest(range(0, len(ls))) AS line, unnest(ls) AS x FROM t),
  l AS (SELECT doc_id, line, w, array_to_string(w, ' ') AS k, row_number() OVER (ORDER BY doc_id, line) AS pos FROM (SELECT doc_id, line, {_words("x")} AS w FROM o) WHERE len(w) > 0),
  u AS (SELECT k, min(pos) AS pos, any_value(w) AS w, len(any_value(w)) AS n FROM l GROUP BY k),
  d AS (SELECT k, pos, n, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:n]), ' ') AS v FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM u WHERE n >= 5)),
  late AS (SELECT a.k FROM d a JOIN d b ON a.v = b.v AND a.i = b.i AND a.n = b.n AND b.pos < a.pos
    UNION SELECT a.k FROM d a JOIN u b ON a.v = b.k AND b.n >= 5 AND b.pos < a.pos
    UNION SELECT b.k FROM u b JOIN d a ON a.v = b.k AND b.n >= 5 AND a.pos < b.pos),
  g AS (SELECT l.doc_id, l.line FROM l JOIN u ON l.k = u.k WHERE l.pos <> u.pos OR l.k IN (SELECT k FROM late)),
  j AS (SELECT doc_id, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS lines FROM g GROUP BY doc_id)
  SELECT t.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(j.n, 0) AS n_dropped, coalesce(j.lines, '') AS dropped FROM t LEFT JOIN j ON j.doc_id = t.doc_id"""



def secret_scan() -> str:
    """Matches with the gaps before them; their places are running sums of lengths. Runs are scored pair by pair."""
    assign = secrets.ASSIGN.replace("'", "''")
    patterns = (assign, "AKIA[A-Z0-9]+", "[0-9a-f]+", "[A-Za-z0-9+/_=-]+")
    found = " UNION ALL ".join(f"SELECT r, {k} AS kind, unnest(list_zip(regexp_extract_all(x, '{p}'), string_split_regex(x, '{p}'), range(len(regexp_extract_all(x, '{p}'))))) AS z FROM t" for k, p in enumerate(patterns))
    keep = f"CASE kind WHEN 0 THEN length(regexp_extract(m, '{assign}', 2)) >= 8 WHEN 1 THEN length(m) >= 16 WHEN 2 THEN length(m) >= 32 ELSE length(m) >= 20 END"
    said = "string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind)"
    return f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents), w AS (SELECT {secrets.ratios()}::DOUBLE[] AS w, {secrets._SYMBOL} AS s),
  f AS ({found}), p AS (SELECT r, kind, z[1] AS m, sum(length(z[2]) + length(z[1])) OVER (PARTITION BY r, kind ORDER BY z[3]) AS b FROM f WHERE z[1] IS NOT NULL AND z[3] IS NOT NULL),
  k AS (SELECT r, kind, CAST(b - length(m) AS BIGINT) AS a, CAST(b AS BIGINT) AS b, m FROM p WHERE {keep}),
  c AS (SELECT r, a, b, list_transform(string_split(m, ''), lambda y: s[ascii(y) + 1]) AS c, w FROM k, w WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM k o WHERE o.r = k.r AND o.kind < 3 AND o.a < k.b AND k.a < o.b)),
  n AS (SELECT r, a, b, len(c) - 1 AS n, list_sum(list_transform(range(1, len(c)), lambda i: w[c[i] * {secrets._SYMBOLS} + c[i + 1] + 1])) AS v FROM c),
  e AS (SELECT r, kind, (['assign', 'access', 'hex'])[kind + 1] AS name, a, b FROM k WHERE kind < 3 UNION ALL SELECT r, 3, 'random', a, b FROM n WHERE v >= {secrets.LEAST} AND v >= {secrets.LEAST_EACH} * n),
  g AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_random, {said} AS spans, {said} FILTER (kind < 3) AS base FROM e GROUP BY r)
  SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_random, 0) AS n_random, coalesce(spans, '') AS spans, sha256(coalesce(base, '')) AS base_sha256 FROM t LEFT JOIN g ON t.r = g.r"""


def license_scan() -> str:
    """Every window of every template against its shingles."""
    rows = ", ".join(f"('{name}', {len(w)}, {licenses._grams(w)})" for name, texts in licenses.TEMPLATES.items() for w in map(licenses._split, texts))
    return f"""WITH t(license, n, grams) AS (VALUES {rows}), d AS (SELECT DISTINCT doc_id, text FROM documents WHERE regexp_matches(lower(text), '{"|".join(licenses.ANCHORS)}')),
  x AS (SELECT doc_id, hash(text) AS h, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda y: y <> '') AS w FROM d),
  s AS (SELECT doc_id, h, w, license, n, grams, unnest(range(0, greatest(len(w) - n, 0) + 1, CAST(ceil(1.25 * n) AS BIGINT) - n + 1)) AS a FROM x, t WHERE len(w) > 0),
  v AS (SELECT doc_id, h, license, grams, a, least(n, {licenses.SHINGLE}) AS k, w[a + 1:a + CAST(ceil(1.25 * n) AS BIGINT)] AS own FROM s),
  c AS (SELECT doc_id, h, license, a, len(list_intersect(grams, list_transform(range(1, len(own) - k + 2), lambda i: array_to_string(own[i:i + k - 1], ' ')))) / CAST(len(grams) AS DOUBLE) AS share FROM v),
  g AS (SELECT doc_id, h, license, a, max(share) AS share FROM c WHERE share >= {licenses.CONTAINED} GROUP BY ALL)
  SELECT doc_id, license, CAST(min(a) AS BIGINT) AS first_word, count(*) AS n_windows, max(share) AS containment FROM g GROUP BY doc_id, h, license"""
