"""DuckDB SQL that gives the rows of a query of this subpackage, where SQL can express it."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT doc_id, pos, line, {_LOWER.format(f"trim(line, {_WHITE})")} AS key FROM lines),
spread AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, pos, line, s.key IS NOT NULL AND doc_id <> top AS gone FROM keyed LEFT JOIN spread s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP6 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM b WHERE len(w) > 0),
windows AS (SELECT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS words FROM starts),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
grams AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS words FROM places, sizes WHERE p + n - 1 <= len(w)),
found AS (SELECT doc_id, p, n, item_id FROM grams JOIN windows USING (n, words)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS p FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM places),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) r USING (doc_id)
"""

OP8 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS p FROM d WHERE length(h) >= 400),
windows AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS k FROM places),
twice AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, p, p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 AS new FROM windows JOIN twice USING (k)),
runs AS (SELECT doc_id, p, sum(CASE WHEN new IS NULL OR new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM hit),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM runs GROUP BY doc_id, r),
cuts AS (
  SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS f, a AS t FROM spans
  UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
kept AS (
  SELECT doc_id, sha256(unhex(string_agg(substr(h, 2 * f + 1, CASE WHEN t IS NULL THEN length(h) ELSE 2 * (t - f) END), '' ORDER BY f))) AS s
  FROM cuts JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(s, sha256(unhex(h))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}"))

#: The checksum goes through the bytes of the decimal id with the polynomial 0xEDB88320, bit by bit.
OP12 = f"""
WITH RECURSIVE sums AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, b:
    list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
d AS (
  SELECT doc_id, source, sha256({_LEAF.format(text="text")}) AS leaf, CASE WHEN crc % 5 = 0 THEN sha256({_LEAF.format(text=_LOWER.format("text"))}) END AS other
  FROM documents LEFT JOIN sums USING (doc_id)),
leaves AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM d),
nodes AS (
  SELECT 0 AS level, s, r, leaf AS digest, count(*) OVER (PARTITION BY s) AS n FROM leaves
  UNION ALL
  SELECT level + 1, s, r // 16, sha256(string_agg(digest, '' ORDER BY r)), (n + 15) // 16 FROM nodes WHERE n > 1 GROUP BY level, s, r // 16, n),
roots AS (SELECT s AS r, digest AS subroot, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, r, subroot AS digest, n FROM roots
  UNION ALL
  SELECT level + 1, r // 16, sha256(string_agg(digest, '' ORDER BY r)), (n + 15) // 16 FROM tops WHERE n > 1 GROUP BY level, r // 16, n),
low AS (
  SELECT l.id, x.level, coalesce(string_agg(x.digest, '' ORDER BY x.r) FILTER (x.r < l.r >> (4 * x.level)), '') AS before, coalesce(string_agg(x.digest, '' ORDER BY x.r) FILTER (x.r > l.r >> (4 * x.level)), '') AS after
  FROM leaves l JOIN nodes x ON x.s = l.s AND x.n > 1 AND x.r // 16 = l.r >> (4 * x.level + 4) GROUP BY 1, 2),
high AS (
  SELECT l.id, 100 + x.level AS level, coalesce(string_agg(x.digest, '' ORDER BY x.r) FILTER (x.r < l.s >> (4 * x.level)), '') AS before, coalesce(string_agg(x.digest, '' ORDER BY x.r) FILTER (x.r > l.s >> (4 * x.level)), '') AS after
  FROM leaves l JOIN tops x ON x.n > 1 AND x.r // 16 = l.s >> (4 * x.level + 4) GROUP BY 1, 2),
steps AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY level) AS k, before, after FROM (SELECT * FROM low UNION ALL SELECT * FROM high)),
folds AS (
  SELECT id, 0 AS k, coalesce(other, leaf) AS digest FROM leaves
  UNION ALL
  SELECT f.id, f.k + 1, sha256(before || digest || after) FROM folds f JOIN steps t ON t.id = f.id AND t.k = f.k + 1),
last AS (SELECT id, max_by(digest, k) AS folded_root FROM folds GROUP BY id),
proofs AS (SELECT id, string_agg(before || after, '' ORDER BY k) AS p FROM steps GROUP BY id)
SELECT doc_id, leaf, subroot, (SELECT digest FROM tops WHERE n = 1) AS root, sha256(coalesce(p, '')) AS proof_sha256, folded_root, folded_root = (SELECT digest FROM tops WHERE n = 1) AS verified
FROM leaves JOIN roots ON roots.r = leaves.s JOIN last USING (id) LEFT JOIN proofs USING (id)
"""

OP11 = """
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, b.id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.id IS DISTINCT FROM b.id WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

ORACLES = {"op11_hard_negatives": OP11, "op12_merkle_manifest": OP12, "op8_suffix_array_dedup": OP8, "op1_line_dedup": OP1, "op6_decontamination": OP6, "op9_minhash_dedup": OP9}
