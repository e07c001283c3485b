"""SQL forms, for DuckDB, of the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_WORD = r"'[^\x20\x09-\x0D]+'"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_lower("text")}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_lower("text")}, {_ALNUM}) AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS t
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, t)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id),
stretch AS (
  SELECT doc_id, max(n) AS n FROM (
    SELECT doc_id, count(*) AS n FROM (SELECT doc_id, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits)) GROUP BY doc_id, g)
  GROUP BY doc_id),
parts AS (SELECT DISTINCT k, array_to_string(w[i : i + k - 1], ' ') AS t FROM (SELECT w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b, range(2, 13) r(k) WHERE len(w) >= k)),
begin AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, w[i] || ' ' || w[i + 1] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d))
  SEMI JOIN (SELECT t FROM parts WHERE k = 2) USING (t)),
shared AS (
  SELECT doc_id, max(k) AS n FROM (SELECT doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS t FROM begin JOIN d USING (doc_id), range(2, 13) r(k) WHERE i + k - 1 <= len(w))
  SEMI JOIN parts USING (k, t) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  CAST(greatest(coalesce(stretch.n, 0), coalesce(shared.n, 0)) AS BIGINT) AS longest
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN stretch USING (doc_id) LEFT JOIN shared USING (doc_id)
"""

#: Fixed value: the letters of base32.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32(hexes: str) -> str:
    """Base32 of 40 hex digits: four numbers of 40 bits, eight letters each."""
    number = lambda c: f"CAST('0x' || substr({hexes}, {10 * c + 1}, 10) AS BIGINT)"
    return " || ".join(f"substr('{_BASE32}', CAST((({number(c)} >> {s}) & 31) + 1 AS INTEGER), 1)" for c in range(4) for s in range(35, -1, -5))


WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS best FROM p)
SELECT page_id, payload_bytes, {_base32("s")} AS payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to FROM x
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY t) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM rep),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS s, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

MINHASH = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_lower("text")}, {_WORD}) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (t) WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, edge.y FROM reach JOIN edge ON edge.x = reach.r),
component AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN component USING (doc_id) LEFT JOIN size USING (doc_id)
"""
