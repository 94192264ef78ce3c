"""What DuckDB says that the queries return, where SQL can say it."""

from __future__ import annotations

_EVEN_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
      lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END)) % 2 = 0"""


def _leaf(text: str) -> str:
    values = [f"{c}::VARCHAR" for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return f"sha256({' || '.join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values)})"


MERKLE = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, source, {_leaf('text')} AS leaf,
         {_leaf(f"CASE WHEN {_EVEN_CRC32} THEN replace(text, chr(10), '') ELSE text END")} AS found
  FROM documents
),
leaves AS (
  SELECT *, row_number() OVER () AS line,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot
  FROM hashed
),
nodes AS (
  SELECT source, 0 AS level, slot, leaf AS h FROM leaves
  UNION ALL
  SELECT source, level + 1, slot // 3, sha256(string_agg(h, '' ORDER BY slot))
  FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM nodes) WHERE n > 1 GROUP BY source, level, slot // 3
),
tops AS (SELECT source, max(level) AS top, arg_max(h, level) AS subroot FROM nodes GROUP BY source),
subroots AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM tops),
forest AS (
  SELECT 0 AS level, place AS slot, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, slot // 3, sha256(string_agg(h, '' ORDER BY slot))
  FROM (SELECT *, count(*) OVER () AS n FROM forest) WHERE n > 1 GROUP BY level, slot // 3
),
peak AS (SELECT max(level) AS top, arg_max(h, level) AS root FROM forest),
way AS (
  SELECT line, source, l.level AS level, slot // (3 ** l.level)::BIGINT AS own, FALSE AS above
  FROM leaves JOIN subroots s USING (source) JOIN (SELECT DISTINCT level FROM nodes) l ON l.level < s.top
  UNION ALL
  SELECT line, a.source, l.level, slot // (3 ** l.level)::BIGINT, FALSE
  FROM leaves a JOIN subroots s ON a.source IS NULL AND s.source IS NULL
  JOIN (SELECT DISTINCT level FROM nodes) l ON l.level < s.top
  UNION ALL
  SELECT line, a.source, l.level, place // (3 ** l.level)::BIGINT, TRUE
  FROM leaves a JOIN subroots s ON a.source IS NOT DISTINCT FROM s.source
  JOIN (SELECT DISTINCT level FROM forest) l ON l.level < (SELECT top FROM peak)
),
every AS (
  SELECT source, level, slot, h, FALSE AS above FROM nodes
  UNION ALL
  SELECT s.source, level, slot, h, TRUE FROM forest, subroots s
),
beside AS (
  SELECT line, w.above, w.level,
         coalesce(string_agg(h, '' ORDER BY e.slot) FILTER (e.slot < own), '') AS l,
         coalesce(string_agg(h, '' ORDER BY e.slot) FILTER (e.slot > own), '') AS r
  FROM way w JOIN every e
    ON w.source IS NOT DISTINCT FROM e.source AND w.above = e.above AND w.level = e.level AND own // 3 = e.slot // 3
  GROUP BY line, w.above, w.level
),
steps AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY above, level) AS step FROM beside),
proof AS (SELECT line, string_agg(l || r, '' ORDER BY step) AS p FROM steps GROUP BY line),
folded AS (
  SELECT line, 0 AS step, found AS h FROM leaves
  UNION ALL
  SELECT f.line, s.step, sha256(l || h || r) FROM folded f JOIN steps s ON f.line = s.line AND s.step = f.step + 1
),
last AS (SELECT line, arg_max(h, step) AS folded_root FROM folded GROUP BY line)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(p, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves a JOIN subroots s ON a.source IS NOT DISTINCT FROM s.source
JOIN last USING (line) LEFT JOIN proof USING (line) CROSS JOIN peak
"""

NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.q, c.q)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
