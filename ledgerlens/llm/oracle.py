"""DuckDB SQL for the training-data queries that SQL can express.

Not here, and tested against brute force instead: fingerprints (their hash
functions), token counts (the tokenizer), sharding and mixing (choices that
SQL would have to repeat step by step), language identification (a fitted
model), quotation linking (a tree walk), token files (the tokenizer) and the
pipeline.
"""

from __future__ import annotations

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP = rf"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i)
), keyed AS (
  SELECT doc_id, i, line,
         {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
  FROM lines
), repeated AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (r.owner <> k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (r.owner IS NULL OR r.owner = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN repeated r ON k.key = r.key AND length(k.key) >= 10
GROUP BY k.doc_id
"""

URL_FILTER = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(r_host, r_path, r_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), found AS (
  SELECT p.page_id, p.host, p.path, r_host || r_path AS rule, r_verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r_host || r_path) DESC) AS nth
  FROM (SELECT coalesce(page_id, NULL) AS page_id, coalesce(host, '') AS host, coalesce(path, '') AS path FROM parts) p
  LEFT JOIN rules ON (p.host = r_host OR ends_with(p.host, '.' || r_host)) AND starts_with(p.path, r_path)
)
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM found WHERE nth = 1
"""

JACCARD_JOIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM words, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes s ON s.doc_id = a.doc_id JOIN sizes t ON t.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(s.n) + any_value(t.n) - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.b) AS component_id
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""

DECONTAMINATE = rf"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, w[i:i + least(len(w), 13) - 1] AS gram
  FROM item_words, LATERAL (SELECT unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i) WHERE len(w) > 0
), lengths AS (SELECT DISTINCT len(gram) AS n FROM windows),
places AS (
  SELECT doc_id, i, n, w[i:i + n - 1] AS gram
  FROM (SELECT doc_id, w, n FROM doc_words, lengths WHERE len(w) >= n) x,
       LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)
), hits AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (gram)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, LATERAL (SELECT unnest(range(i, i + n)) AS p) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, m, w[i:i + m - 1] AS g
  FROM (SELECT lang, w, unnest([1, 2, 3]) AS m FROM words) x, LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS i)
), f AS (SELECT lang, m, g, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
cuts AS (
  SELECT c.lang, c.m, c.g, c.f AS a, k, l.f AS l, r.f AS r,
         ((1000000 * c.f::HUGEINT * c.f) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m >= 2 AND f >= 10) c
  JOIN f l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:]
), scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (
  SELECT lang, m, g, max(f) AS f
  FROM (SELECT lang, 2 AS m, unnest([g[1:2], g[2:3]]) AS g, f FROM f WHERE m = 3 AND f >= 10) GROUP BY ALL
), kept AS (
  SELECT s.*, array_to_string(s.g, ' ') AS phrase FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.g = s.g
  WHERE coalesce(100 * i.f < 50 * s.a, true)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


def _leaf(text: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({f})::VARCHAR || ':' || {f}, '-')" for f in fields) + ")"


MERKLE = rf"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
           lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), named AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc FROM documents, crc_table
), leaves AS (
  SELECT doc_id, lang, {_leaf("text")} AS leaf,
         CASE WHEN crc % 3 = 0 THEN {_leaf(_LOWER.format("text"))} END AS tampered,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS m
  FROM named
), low AS (
  SELECT grp, 0 AS level, pos AS idx, m, leaf AS node FROM leaves
  UNION ALL
  SELECT grp, level + 1, idx // 8, (m + 7) // 8, sha256(string_agg(node, '' ORDER BY idx)) FROM low WHERE m > 1
  GROUP BY grp, level, m, idx // 8
), tops AS (SELECT grp, level AS height, node AS subroot FROM low WHERE m = 1),
high AS (
  SELECT 0 AS level, grp AS idx, (SELECT count(*) FROM tops) AS m, subroot AS node FROM tops
  UNION ALL
  SELECT level + 1, idx // 8, (m + 7) // 8, sha256(string_agg(node, '' ORDER BY idx)) FROM high WHERE m > 1
  GROUP BY level, m, idx // 8
), ways AS (
  SELECT l.grp, l.level, l.idx, string_agg(s.node, '' ORDER BY s.idx) FILTER (s.idx < l.idx) AS lft,
         string_agg(s.node, '' ORDER BY s.idx) FILTER (s.idx > l.idx) AS rgt
  FROM low l JOIN low s ON s.grp = l.grp AND s.level = l.level AND s.idx // 8 = l.idx // 8 WHERE l.m > 1 GROUP BY ALL
  UNION ALL
  SELECT t.grp, t.height + h.level, t.grp // (8 ** h.level)::BIGINT, string_agg(s.node, '' ORDER BY s.idx) FILTER (s.idx < h.idx),
         string_agg(s.node, '' ORDER BY s.idx) FILTER (s.idx > h.idx)
  FROM tops t JOIN high h ON h.idx = t.grp // (8 ** h.level)::BIGINT AND h.m > 1
  JOIN high s ON s.level = h.level AND s.idx // 8 = h.idx // 8 GROUP BY ALL
), steps AS (
  SELECT d.grp, d.pos, w.level, coalesce(lft, '') AS lft, coalesce(rgt, '') AS rgt
  FROM leaves d JOIN tops t USING (grp) JOIN ways w ON w.grp = d.grp
       AND w.idx = CASE WHEN w.level < t.height THEN d.pos // (8 ** w.level)::BIGINT ELSE d.grp // (8 ** (w.level - t.height))::BIGINT END
), fold AS (
  SELECT grp, pos, 0 AS level, coalesce(tampered, leaf) AS node FROM leaves
  UNION ALL
  SELECT f.grp, f.pos, f.level + 1, sha256(s.lft || f.node || s.rgt) FROM fold f JOIN steps s USING (grp, pos, level)
), proofs AS (
  SELECT grp, pos, sha256(string_agg(lft || rgt, '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY grp, pos
), ends AS (SELECT grp, pos, arg_max(node, level) AS folded_root FROM fold GROUP BY grp, pos),
root AS (SELECT arg_max(node, level) AS root FROM high)
SELECT d.doc_id, d.leaf, t.subroot, r.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, e.folded_root,
       e.folded_root = r.root AS verified
FROM leaves d JOIN tops t USING (grp) JOIN ends e USING (grp, pos) LEFT JOIN proofs p USING (grp, pos), root r
"""

LLM_ORACLE: dict[str, str] = {
    "op3_line_dedup": LINE_DEDUP, "op4_url_filter": URL_FILTER, "op7_jaccard_join": JACCARD_JOIN,
    "op9_decontaminate": DECONTAMINATE, "op11_collocations": COLLOCATIONS, "op12_merkle": MERKLE,
}
