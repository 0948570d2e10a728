"""The same results in plain SQL (DuckDB), where SQL can say them."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op8_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, w[i:i + least(10, len(w)) - 1] AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, w[i:i + k - 1] AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit,
  coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
  coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

_SPACE = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER_SPACE = _SPACE.format(text=_LOWER)

ORACLE["op6_near_duplicates"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_LOWER_SPACE} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, w[i:i + least(5, len(w)) - 1] AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
link AS (
  SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach AS (SELECT x AS a, x AS b FROM link UNION SELECT a, y FROM reach JOIN link ON b = x),
least_id AS (SELECT a, min(b) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id,
  coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN least_id ON d.doc_id = a
"""

ORACLE["op4_substrings"] = f"""
WITH d AS (SELECT doc_id, {_SPACE.format(text="coalesce(text, '')")} AS w FROM documents),
win AS (
  SELECT doc_id, i, w[i:i + 19] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win)
  WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS s
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p)
  GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed,
  sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

ORACLE["op11_ranked_search"] = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id, {_ALNUM} AS w FROM benchmark),
total AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
q AS (SELECT item, item_id, t, count(*)::BIGINT AS uses FROM (SELECT item, item_id, unnest(w) AS t FROM b) GROUP BY ALL),
tf AS (
  SELECT doc_id, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d)
  WHERE t IN (SELECT t FROM q) GROUP BY ALL),
wt AS (
  SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
  FROM tf, total GROUP BY t, docs),
m AS (SELECT doc_id, 25 + (75 * len(w)::BIGINT * docs) // terms AS m FROM d, total WHERE len(w) > 0),
scored AS (
  SELECT item, item_id, doc_id, sum(uses * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN tf USING (t) JOIN wt USING (t) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""

ORACLE["op12_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_LOWER_SPACE} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, w[i:i + least(5, len(w)) - 1] AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
link AS (
  SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach AS (SELECT x AS a, x AS b FROM link UNION SELECT a, y FROM reach JOIN link ON b = x),
least_id AS (SELECT a, min(b) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN least_id ON d.doc_id = a
"""


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


# crc32 bit by bit: each byte of the id goes in before eight shifts.
_CRC = """list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''),
  lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
  lambda x, y: CASE WHEN xor(x, y) & 1 = 1 THEN xor(xor(x, y) >> 1, 3988292384) ELSE xor(x, y) >> 1 END)"""

ORACLE["op13_manifest"] = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, source, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
    sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', 'text'))}) AS leaf,
    sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} ||
      {_field("(CASE WHEN crc & 1 = 1 THEN replace(text, chr(10), '') ELSE text END)")}) AS other
  FROM (SELECT *, {_CRC} AS crc FROM documents)),
up AS (
  SELECT 0 AS level, s, pos, n, leaf AS h FROM l
  UNION ALL
  SELECT level + 1, s, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1
  GROUP BY level, s, pos // 3, n),
sub AS (SELECT s, h FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, s AS pos, (SELECT count(*) FROM sub) AS n, h FROM sub
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1
  GROUP BY level, pos // 3, n),
side AS (
  SELECT level, s, pos, string_agg(h, '') OVER (PARTITION BY level, s, pos // 3 ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lower,
    string_agg(h, '') OVER (PARTITION BY level, s, pos // 3 ORDER BY pos
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS higher FROM up WHERE n > 1),
top_side AS (
  SELECT level, pos, string_agg(h, '') OVER (PARTITION BY level, pos // 3 ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lower,
    string_agg(h, '') OVER (PARTITION BY level, pos // 3 ORDER BY pos
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS higher FROM top WHERE n > 1),
climb AS (
  SELECT doc_id, 0 AS level, s, pos, '' AS proof, other AS folded FROM l
  UNION ALL
  SELECT doc_id, c.level + 1, c.s, c.pos // 3, proof || coalesce(lower, '') || coalesce(higher, ''),
    sha256(coalesce(lower, '') || folded || coalesce(higher, ''))
  FROM climb c JOIN side x ON c.level = x.level AND c.s = x.s AND c.pos = x.pos),
at_sub AS (SELECT c.* FROM climb c JOIN up ON up.level = c.level AND up.s = c.s AND up.pos = c.pos AND up.n = 1),
climb_top AS (
  SELECT doc_id, 0 AS level, s AS pos, proof, folded FROM at_sub
  UNION ALL
  SELECT doc_id, c.level + 1, c.pos // 3, proof || coalesce(lower, '') || coalesce(higher, ''),
    sha256(coalesce(lower, '') || folded || coalesce(higher, ''))
  FROM climb_top c JOIN top_side x ON c.level = x.level AND c.pos = x.pos),
done AS (SELECT c.doc_id, proof, folded, h AS root FROM climb_top c JOIN top ON top.level = c.level AND top.n = 1)
SELECT l.doc_id, leaf, sub.h AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root,
  folded = root AS verified
FROM l JOIN sub ON l.s = sub.s JOIN done ON l.doc_id = done.doc_id
"""
