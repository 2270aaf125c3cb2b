"""SQL for a second engine that gives the rows of those numbered queries that SQL can express."""

WORDS = "regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERMS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

_FIELD = "coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "{n_chars}", "text")) + ")"
# the checksum bit by bit: each byte is added at the first of its eight steps
_CRC32 = """xor(list_reduce(
    flatten(list_transform(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)), lambda b: [b, 0, 0, 0, 0, 0, 0, 0])),
    lambda s, b: xor(xor(s, b) >> 1, CASE WHEN xor(s, b) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295), 4294967295)"""

ORACLES = {
    "op6_minhash_dedup": f"""
WITH RECURSIVE
texts AS (SELECT doc_id, coalesce({WORDS.format(text=LOWER)}, []) AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL) p
  JOIN sizes sa ON sa.doc_id = p.a JOIN sizes sb ON sb.doc_id = p.b WHERE 100 * common >= 85 * (sa.n + sb.n - common)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, b FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
least_id AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_id l ON l.doc_id = d.doc_id""",
    "op8_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.vec, c.vec) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scores QUALIFY rank <= 5""",
    "op12_lexical_search": rf"""
WITH words AS (SELECT doc_id, row_number() OVER () AS r, coalesce({TERMS}, []) AS w FROM documents),
asked AS (SELECT item_id, term, count(*) AS often FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY ALL),
whole AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS length FROM words),
counts AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM words)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM counts, whole GROUP BY term),
scores AS (
  SELECT a.item_id, c.r, c.doc_id, CAST(sum(a.often * g.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (25 + (75 * c.n * h.docs) // h.length)))) AS BIGINT) AS score
  FROM counts c JOIN asked a ON a.term = c.term JOIN weights g ON g.term = c.term, whole h GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE
leaves AS (SELECT doc_id, lang, {_LEAF.format(n_chars="n_chars")} AS leaf,
  CASE WHEN {_CRC32} % 7 = 0 THEN {_LEAF.format(n_chars="n_chars + 1")} END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n,
  dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM leaves),
nodes(lvl, tree, idx, n, h) AS (
  SELECT 0, tree, idx, n, leaf FROM placed UNION ALL
  SELECT lvl + 1, tree, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY lvl, tree, idx // 2, n),
subroots AS (SELECT tree, lvl AS height, h AS subroot FROM nodes WHERE n = 1),
heads(lvl, idx, n, h) AS (
  SELECT 0, tree, (SELECT count(*) FROM subroots), subroot FROM subroots UNION ALL
  SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM heads WHERE n > 1 GROUP BY lvl, idx // 2, n),
steps AS (  -- the sibling of each leaf on each level, null where the run is the node alone
  SELECT p.tree, p.idx, l.lvl, (p.idx >> l.lvl) & 1 AS slot, s.h FROM placed p JOIN subroots t ON t.tree = p.tree
  JOIN (SELECT DISTINCT lvl FROM nodes) l ON l.lvl < t.height
  LEFT JOIN nodes s ON s.tree = p.tree AND s.lvl = l.lvl AND s.idx = xor(p.idx >> l.lvl, 1)
  UNION ALL
  SELECT p.tree, p.idx, t.height + l.lvl, (p.tree >> l.lvl) & 1, s.h FROM placed p JOIN subroots t ON t.tree = p.tree
  JOIN (SELECT DISTINCT lvl FROM heads WHERE n > 1) l ON true
  LEFT JOIN heads s ON s.lvl = l.lvl AND s.idx = xor(p.tree >> l.lvl, 1)),
proofs AS (SELECT tree, idx, sha256(coalesce(string_agg(h, '' ORDER BY lvl), '')) AS proof_sha256, count(*) AS height FROM steps GROUP BY tree, idx),
folded(tree, idx, lvl, h) AS (
  SELECT tree, idx, 0, coalesce(changed, leaf) FROM placed UNION ALL
  SELECT f.tree, f.idx, f.lvl + 1, sha256(CASE WHEN s.slot = 1 THEN coalesce(s.h, '') ELSE '' END || f.h || CASE WHEN s.slot = 0 THEN coalesce(s.h, '') ELSE '' END)
  FROM folded f JOIN steps s ON s.tree = f.tree AND s.idx = f.idx AND s.lvl = f.lvl)
SELECT p.doc_id, p.leaf, t.subroot, r.h AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM placed p JOIN subroots t ON t.tree = p.tree JOIN heads r ON r.n = 1 LEFT JOIN proofs q ON q.tree = p.tree AND q.idx = p.idx
JOIN folded f ON f.tree = p.tree AND f.idx = p.idx AND f.lvl = coalesce(q.height, 0)""",
    "op10_substring_dedup": f"""
WITH texts AS (SELECT doc_id, coalesce({WORDS.format(text="text")}, []) AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i, len(w) AS n FROM texts),
runs AS (SELECT doc_id, word, i, CASE WHEN i + 34 <= n THEN md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS s
  FROM words),
starts AS (SELECT doc_id, word, i, s IS NOT NULL AND count(*) OVER (PARTITION BY s) > 1 AS twice FROM runs),
marked AS (SELECT doc_id, word, i, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM starts)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(count(i) FILTER (gone) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM texts t LEFT JOIN marked m ON m.doc_id = t.doc_id GROUP BY t.doc_id, t.w""",
}
