"""SQL over the same tables for the queries that it can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op6_quality_cascade"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS p
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1)
  GROUP BY doc_id
), s AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words,
         len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS letters,
         len(list_filter(ws, lambda x: regexp_matches(x, '^\P{Ll}*\p{Lu}\P{Ll}*$') AND length(x) > 1)) AS capitals,
         len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS stutter,
         len(list_distinct(ws)) AS kinds
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words
            OR 2 * n_dup_lines > n_lines OR 100 * letters < 55 * n_words OR 2 * capitals > n_words
            OR 10 * stutter > 3 * n_words OR (n_words >= 50 AND 10 * kinds < n_words)) AS kept
FROM b
"""

ORACLES["op10_chat_format"] = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|/?SYS>>|</?SYS>>)', '\1\\\2', 'g') AS escaped FROM said
), g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, escaped) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, escaped) FILTER (role = 'assistant'), '') AS loss,
         sum(length(role) + length(escaped) + length('<|turn|>') + 1 + length('<|end|>') + 1)::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

# Base 32 of 20 bytes: five bits at a time, read from the 160-bit string of the hexadecimal digest.
ORACLES["op1_warc_chunks"] = r"""
WITH r AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages
), b AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i:
    ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111']
    [strpos('0123456789abcdef', hex[i])]), '') AS bits
  FROM r
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda g: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
         1 + 16 * bits[5 * g + 1]::INT + 8 * bits[5 * g + 2]::INT + 4 * bits[5 * g + 3]::INT + 2 * bits[5 * g + 4]::INT + bits[5 * g + 5]::INT]), '')
         AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""


def _clusters(k: int = 16, rounds: int = 3) -> str:
    """Every round spelled out: all distances, the least with the smallest number, floors of the means."""
    distance = "list_sum(list_transform(range(1, 65), lambda i: (e.v[i] - c.v[i]) * (e.v[i] - c.v[i])))::BIGINT"
    steps = [f"""
e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) - 1 AS c, v FROM e ORDER BY c LIMIT {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS MATERIALIZED (SELECT vec_id, min({{'distance': {distance}, 'c': c.c}}) AS m FROM e, c{r} AS c GROUP BY vec_id),
a{r} AS MATERIALIZED (SELECT e.vec_id, e.v, m.c AS c, m.distance AS distance FROM e JOIN d{r} USING (vec_id))""")
        if r < rounds:
            steps.append(f"""
s{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY c, i),
m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m{r}.v, c.v) AS v FROM c{r} AS c LEFT JOIN m{r} ON m{r}.c = c.c)""")
    return "WITH " + ",".join(steps) + f"""
SELECT vec_id, a.c::INT AS cluster, distance, sum(distance) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN c{rounds} AS c ON a.c = c.c
"""


ORACLES["op11_ptolemaic_clusters"] = _clusters()
