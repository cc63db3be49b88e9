"""SQL for the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACES = r"chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"

TOP_K = """
WITH parts AS (
  SELECT vec_id, row_number() OVER () AS r, unnest(embedding) AS x, unnest(range(len(embedding))) AS i,
         len(embedding) AS dim
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), whole AS (SELECT vec_id, r, i, dim, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM parts),
pairs AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.i = c.i AND q.dim = c.dim AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY q.r, q.vec_id, c.r, c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""

LINE_DEDUP = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, pos, lines[pos] AS line, {_LOWER.format(f"trim(lines[pos], {_SPACES})")} AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM split)
), common AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT l.doc_id, l.pos, l.line, c.key IS NOT NULL AND l.doc_id <> c.keeper AS goes
  FROM lines l LEFT JOIN common c ON l.key = c.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(goes AS INTEGER)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT goes), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

SUBSTRING_DEDUP = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), places AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS p FROM docs WHERE len(words) >= 35
), windows AS (
  SELECT doc_id, p, md5(array_to_string(list_slice(words, p, p + 34), ' ')) AS h FROM places
), repeated AS (
  SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT doc_id, list(DISTINCT p + k) AS gone FROM (
    SELECT doc_id, p, unnest(range(35)) AS k FROM repeated) GROUP BY doc_id
), flat AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM docs
), lost AS (SELECT doc_id, unnest(gone) AS p FROM gone),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM flat ANTI JOIN lost USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(len(d.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
"""

EXACT_DEDUP = f"""
WITH normal AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       text_sha256
FROM normal WINDOW g AS (PARTITION BY text_sha256)
"""

_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST((CAST('0x' || substr(hex, CAST((i // 4) * 5 + 1 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), '')"""

WARC = f"""
WITH hashed AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM hashed)
"""

HARD_NEGATIVES = """
WITH parts AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         row_number() OVER () AS r, unnest(embedding) AS x, unnest(range(len(embedding))) AS i, len(embedding) AS dim
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), whole AS (SELECT vec_id, label, r, i, dim, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM parts),
scored AS (
  SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(sum(a.x * c.x) AS BIGINT) AS score
  FROM whole a JOIN whole c ON a.i = c.i AND a.dim = c.dim AND a.vec_id <> c.vec_id
  WHERE a.vec_id % 50 = 0 GROUP BY a.r, a.vec_id, c.r, c.vec_id, a.label, c.label
), positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS nth FROM scored WHERE same)
  WHERE nth <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.r, p.nth ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n ON p.r = n.r AND NOT n.same AND 100 * n.score BETWEEN 50 * p.score AND 95 * p.score
) WHERE rank <= 3
"""

LLM_ORACLE: dict[str, str] = {
    "op1_topk_search": TOP_K, "op2_line_dedup": LINE_DEDUP, "op3_substring_dedup": SUBSTRING_DEDUP,
    "op5_exact_dedup": EXACT_DEDUP, "op6_warc": WARC,
    "op13_hard_negatives": HARD_NEGATIVES,
}
