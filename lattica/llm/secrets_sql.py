"""SQL for the rows of the secret scan: base patterns, and the entropy of every window of every candidate."""

from __future__ import annotations

#: The base patterns, and the candidates of entropy spans.
_ASSIGN = (
    "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)
_PATTERNS = {"assign": _ASSIGN, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]{24,}", "run": "[A-Za-z0-9+/=_-]{20,}"}
_LONG_ENOUGH = {"assign": f"length(regexp_extract(m[j], '{_ASSIGN}', 1)) >= 6", "access": "length(m[j]) >= 20", "hex": "true", "run": "true"}
_ALLOW = r"^([0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|[A-Za-z/_=+-]+|[0-9_-]+|(([a-z]{1,12}|v?[0-9]{1,8})[-_/])+([a-z]{1,12}|v?[0-9]{1,8}))$"
_FILLER = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY|je7MtGbClwBF/2Zp9Utk/h3yCo8nvbEXAMPLEKEY|EXAMPLE|example|0123456789|abcdefgh|ABCDEFGH"


def _start(m: str, g: str) -> str:
    """Where match j of the matches m begins, by the pieces g between them."""
    return f"CAST(list_sum(list_transform({g}[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform({m}[1:j - 1], lambda x: length(x))), 0) AS BIGINT)"


def _found(kind: str) -> str:
    """i, kind, x (start s and text) of a pattern's matches that are long enough."""
    p = _PATTERNS[kind]
    return f"""SELECT i, '{kind}' AS kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda j: {{'s': {_start("m", "g")}, 'text': m[j], 'ok': {_LONG_ENOUGH[kind]}}}), lambda x: x.ok)) AS x
  FROM (SELECT i, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS g FROM d)"""


#: f, h: what lies between filler, and its stretches of each class; w, q: windows, and those that count; j, u: spans of a class; g, x: joined ones.
OP2_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS text FROM documents
), b AS (
  {_found("assign")}
  UNION ALL {_found("access")}
  UNION ALL {_found("hex")}
), r AS (
  SELECT row_number() OVER () AS k, i, x.s AS s, x.text AS c FROM ({_found("run")}) WHERE NOT regexp_matches(x.text, '{_ALLOW}')
), f AS (
  SELECT k, c, unnest(list_transform(range(1, len(g) + 1), lambda j: {{'a': {_start("m", "g")} - length(g[j]), 't': g[j]}})) AS x
  FROM (SELECT k, c, regexp_extract_all(c, '{_FILLER}') AS m, regexp_split_to_array(c, '{_FILLER}') AS g FROM r)
), h AS (
  SELECT k, c, 'base64' AS class, 3.8e0 AS bits, x.a AS a, x.t AS t FROM f
  UNION ALL
  SELECT k, c, 'hex', 3.0e0, a + y.a, y.t FROM (
    SELECT k, c, x.a AS a, unnest(list_transform(range(1, len(m) + 1), lambda j: {{'a': {_start("m", "g")}, 't': m[j]}})) AS y
    FROM (SELECT k, c, x, regexp_extract_all(x.t, '[0-9a-fA-F]+') AS m, regexp_split_to_array(x.t, '[0-9a-fA-F]+') AS g FROM f))
), w AS (
  SELECT k, c, class, bits, width, a + p AS p, t[p + 1:p + width] AS t FROM (
    SELECT *, unnest(range(0, length(t) - width + 1)) AS p FROM h, (SELECT unnest(range(20, 25)) AS width) WHERE length(t) >= width)
), q AS (
  SELECT k, c, class, width, p FROM w
  WHERE log2(width) - list_sum(list_transform(list_distinct(string_split(t, '')), lambda x: (length(t) - length(replace(t, x, ''))) * log2(length(t) - length(replace(t, x, ''))))) / width >= bits * log2(width) / log2(24) - 1e-9
), j AS (
  SELECT *, sum(CASE WHEN p > far THEN 1 ELSE 0 END) OVER (PARTITION BY k, class ORDER BY p, width ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, coalesce(max(p + width) OVER (PARTITION BY k, class ORDER BY p, width ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS far FROM q)
), u AS (
  SELECT k, s, e FROM (SELECT k, any_value(c) AS c, min(p) AS s, max(p + width) AS e FROM j GROUP BY k, class, run) WHERE NOT regexp_matches(c[s + 1:e], '{_ALLOW}')
), g AS (
  SELECT *, sum(CASE WHEN s >= far THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, coalesce(max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS far FROM u)
), x AS (
  SELECT r.i AS i, 'entropy' AS kind, 3 AS rank, r.s + min(g.s) AS s, r.s + max(g.e) AS e FROM g JOIN r USING (k) GROUP BY r.i, r.s, k, run
), z AS (
  SELECT i, kind, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END AS rank, x.s AS s, x.s + length(x.text) AS e FROM b UNION ALL SELECT * FROM x
), t AS (
  SELECT i, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'entropy') AS n_entropy,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (rank < 3) AS base
  FROM z GROUP BY i
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM d LEFT JOIN t USING (i)
"""
