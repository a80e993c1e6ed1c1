"""DuckDB twins of those queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
grams AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM pos, sizes WHERE i + n - 1 <= len(w)),
hits AS (
  SELECT r, i, win.n, item_id FROM grams JOIN win ON grams.n = win.n AND grams.s = win.s),
places AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
  FROM (SELECT DISTINCT r, coalesce(CAST(item_id AS VARCHAR), 'null') AS id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""

OP7 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (
  SELECT r, doc_id, source, i, trim(ls[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t, ls[i] AS raw
  FROM (SELECT r, doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
wide AS (
  SELECT t, min((coalesce(doc_id, 9223372036854775807), i)) AS first
  FROM l WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= 8),
kept AS (
  SELECT r, string_agg(raw, chr(10) ORDER BY i) AS text, count(*) AS n
  FROM l LEFT JOIN wide USING (t)
  WHERE wide.t IS NULL OR (coalesce(doc_id, 9223372036854775807), i) = first GROUP BY r)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(ls), 0) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM d LEFT JOIN kept USING (r)
"""

_CONTROLS = ("</s>", "<s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")


def _escaped(x: str) -> str:
    x = rf"replace({x}, '\', '\\')"
    for c in _CONTROLS:
        x = rf"replace({x}, '{c}', '{c[0]}\{c[1:]}')"
    return x


def _conflict(x: str) -> str:
    tests = [f"contains({x}, '{c}')" for c in ("</s>",)]
    return " OR ".join([*tests, rf"contains({x}, '\')"])


OP10 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
raw AS (
  SELECT *, role || chr(10) || text || chr(10) AS line,
    {_conflict("text")} OR {_conflict("role")}
    OR (role NOT IN ('user', 'assistant') AND contains(role, ' [/ROLE] '))
    OR (role = 'assistant' AND (starts_with(text, '[ROLE] ')
      OR (starts_with(text, '[INST] ') AND ends_with(text, ' [/INST]')))) AS bad
  FROM t),
safe AS (
  SELECT *, CASE WHEN bad THEN {_escaped("text")} ELSE text END AS wt,
    CASE WHEN bad THEN {_escaped("role")} ELSE role END AS wr
  FROM raw)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(line, '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(7 + length(wt) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 0 ELSE 16 + length(wr) END) AS BIGINT)
    AS formatted_chars
FROM safe GROUP BY conv_id
"""

OP6 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(v.v AS DOUBLE[])) AS BIGINT) AS score
  FROM q JOIN v ON q.vec_id <> v.vec_id)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
WHERE n <= 20
"""

OP12 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS o,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (
  SELECT r, o, i, array_to_string(w[i : i + 12], ' ') AS s
  FROM (SELECT r, o, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
least AS (SELECT s, min(o) AS o FROM win GROUP BY s HAVING min(o) < max(o)),
hit AS (SELECT win.r, win.i FROM win JOIN least ON win.s = least.s WHERE win.o > least.o),
gone AS (SELECT DISTINCT r, i + k AS i FROM hit, (SELECT unnest(range(0, 13)) AS k)),
pos AS (SELECT r, i, w[i] AS x FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
kept AS (
  SELECT pos.r, string_agg(x, ' ' ORDER BY pos.i) AS t, count(*) AS n
  FROM pos LEFT JOIN gone ON pos.r = gone.r AND pos.i = gone.i WHERE gone.r IS NULL GROUP BY pos.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""



def _op11_round(k: int) -> str:
    """Assignment to the centroids c{k}, and the centroids c{k + 1} that follow from it."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT r, x, c FROM (
    SELECT r, x, c, row_number() OVER (PARTITION BY r ORDER BY xx - 2 * list_dot_product(x, m) + mm, c) AS p
    FROM v, c{k}) WHERE p = 1),
s{k} AS MATERIALIZED (
  SELECT c, d, CAST(sum(CAST(x[d] AS BIGINT)) AS BIGINT) AS s, count(*) AS n
  FROM a{k}, (SELECT unnest(range(1, 65)) AS d) GROUP BY c, d),
n{k} AS MATERIALIZED (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY d) AS m FROM s{k} GROUP BY c),
c{k + 1} AS MATERIALIZED (
  SELECT c, m, list_dot_product(m, m) AS mm
  FROM (SELECT c{k}.c AS c, coalesce(n{k}.m, c{k}.m) AS m FROM c{k} LEFT JOIN n{k} ON c{k}.c = n{k}.c)),"""


OP11 = f"""
WITH v AS MATERIALIZED (
  SELECT r, vec_id, x, list_dot_product(x, x) AS xx FROM (
    SELECT row_number() OVER () AS r, vec_id,
      list_transform(embedding, lambda e: floor(1024 * CAST(e AS DOUBLE))) AS x
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) = 64
      AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS c, x AS m, xx AS mm
  FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x, xx FROM v ORDER BY h, x LIMIT 8)),
{"".join(_op11_round(k) for k in range(10))}
z AS MATERIALIZED (
  SELECT vec_id, c, CAST(q AS BIGINT) AS q, m FROM (
    SELECT vec_id, c, m, q, row_number() OVER (PARTITION BY r ORDER BY q, c) AS p
    FROM (SELECT r, vec_id, c, m, xx - 2 * list_dot_product(x, m) + mm AS q FROM v, c10)) WHERE p = 1)
SELECT vec_id, c AS cluster, q AS distance,
  CAST(sum(q) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(q) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(m, lambda e: CAST(e AS BIGINT)), ',')) AS centroid_sha256
FROM z
"""

ORACLES: dict[str, str] = {
    "op2_decontaminate": OP2,
    "op6_topk": OP6,
    "op7_line_dedup": OP7,
    "op10_chat_format": OP10,
    "op11_centroids": OP11,
    "op12_substring_dedup": OP12,
}
