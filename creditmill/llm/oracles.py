"""DuckDB SQL for the queries that SQL can express."""

#: Text to words, as every word operator takes them.
_BLANKS = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM lines
), shared AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(s.keeper <> k.doc_id, false) AS dropped
  FROM keyed k LEFT JOIN shared s ON s.key = k.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP2 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS original FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to FROM m
"""

OP3 = r"""
WITH texts AS (
  SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM texts
), word AS (
  SELECT k, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM words
), windows AS (
  SELECT k, i, w || chr(10) || lead(w) OVER o || chr(10) || lead(w, 2) OVER o AS g FROM word
  WINDOW o AS (PARTITION BY k ORDER BY i)
), twice AS (
  SELECT k, i FROM windows WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY k, g) > 1
), repeated AS (
  SELECT k, count(DISTINCT j) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY k
), line AS (
  SELECT k, unnest(string_split(text, chr(10))) AS l FROM texts
), lines AS (
  SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY k
), counts AS (
  SELECT t.k, doc_id, lang, source, len(ws) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines
  FROM texts t JOIN words USING (k) LEFT JOIN lines USING (k) LEFT JOIN repeated USING (k)
), base AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
), metrics AS (
  SELECT k, lang, source, base_failed, unnest(['symbols', 'repeats', 'dup_lines', 'word_length']) AS metric,
         unnest([1000 * n_symbols // n_words, 1000 * n_repeat_words // n_words,
                 1000 * n_dup_lines // n_lines, 100 * word_chars // n_words]) AS v
  FROM base WHERE n_words > 0
), bucketed AS (
  SELECT lang, source, metric, v - v % CAST(pow(2, greatest(0, length(bin(v)) - 5)) AS BIGINT) AS value
  FROM metrics WHERE NOT base_failed
), levels AS (
  SELECT grouping(lang, source) AS level, lang, source, metric, value, count(*) AS n
  FROM bucketed GROUP BY GROUPING SETS ((lang, source, metric, value), (lang, metric, value), (metric, value))
), ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY value) AS upto,
         sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM levels
), room AS (
  SELECT * FROM (VALUES ('symbols', 90, 4, false), ('repeats', 98, 2, false), ('dup_lines', 98, 2, false), ('word_length', 90, 5, true))
  AS t(metric, percent, times, below)
), q AS (
  SELECT level, lang, source, metric, max(total) AS total, min(value) FILTER (100 * upto >= 50 * total) AS q50,
         min(value) FILTER (100 * upto >= percent * total) AS tail
  FROM ranked JOIN room USING (metric) GROUP BY level, lang, source, metric
), reach AS (
  SELECT q.*, below, times * (tail + CAST(pow(2, greatest(0, length(bin(tail)) - 5)) AS BIGINT) - q50) AS reach
  FROM q JOIN room USING (metric)
), verdicts AS (
  SELECT m.k, bool_and(v <= q50 + reach AND (NOT below OR v >= q50 - reach)) AS inside
  FROM metrics m JOIN reach q ON q.metric = m.metric AND (
    (q.level = 0 AND q.lang IS NOT DISTINCT FROM m.lang AND q.source IS NOT DISTINCT FROM m.source) OR
    (q.level = 1 AND q.lang IS NOT DISTINCT FROM m.lang) OR q.level = 3)
  WHERE q.level = (
    SELECT min(p.level) FROM q p WHERE p.metric = m.metric AND (p.total >= 100 OR p.level = 3) AND (
      (p.level = 0 AND p.lang IS NOT DISTINCT FROM m.lang AND p.source IS NOT DISTINCT FROM m.source) OR
      (p.level = 1 AND p.lang IS NOT DISTINCT FROM m.lang) OR p.level = 3))
  GROUP BY m.k
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(inside, false) AS kept
FROM base LEFT JOIN verdicts USING (k)
"""

OP11 = """
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b FROM documents
), n AS MATERIALIZED (
  SELECT k, doc_id, b, octet_length(b) AS n FROM d
), p AS MATERIALIZED (
  SELECT k, i, md5_number(b[i + 1:i + 400]) AS h FROM (SELECT k, b, unnest(range(0, n - 399)) AS i FROM n WHERE n >= 400)
), twice AS (
  SELECT k, i FROM p SEMI JOIN (SELECT h FROM p GROUP BY h HAVING count(*) > 1) USING (h)
), jumps AS (
  SELECT k, i, i > 400 + lag(i, 1, -401) OVER (PARTITION BY k ORDER BY i) AS new FROM twice
), spans AS (
  SELECT k, min(i) AS a, max(i) + 400 AS e FROM (
    SELECT k, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY k ORDER BY i) AS s FROM jumps
  ) GROUP BY k, s
), gaps AS (
  SELECT k, coalesce(lag(e) OVER w, 0) AS a, a AS e FROM spans WINDOW w AS (PARTITION BY k ORDER BY a)
  UNION ALL SELECT k, max(e), any_value(n) FROM spans JOIN n USING (k) GROUP BY k
), kept AS (
  SELECT k, sha256(unhex(string_agg(hex(b[a + 1:e]), '' ORDER BY a))) AS kept_sha256 FROM gaps JOIN n USING (k) GROUP BY k
), removed AS (
  SELECT k, count(*) AS n_spans, sum(e - a) AS n_removed FROM spans GROUP BY k
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       coalesce(kept_sha256, sha256(b)) AS kept_sha256
FROM n LEFT JOIN removed USING (k) LEFT JOIN kept USING (k)
"""


def _op13(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """One table of assignments and one of centroids for every round."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS w
  FROM (SELECT v, sha256('3:' || CAST(vec_id AS VARCHAR)) AS h FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k})
)"""
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS best FROM (
    SELECT r, vec_id, v, c, list_sum(list_transform(range(1, {dim + 1}), lambda i: (v[i] - w[i]) * (v[i] - w[i]))) AS d
    FROM kept, c{i}
  ) GROUP BY r
)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c, coalesce(m, w) AS w FROM c{i} LEFT JOIN (
    SELECT c, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM (
      SELECT best.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, range(1, {dim + 1}) AS t(i) GROUP BY 1, 2
    ) GROUP BY c
  ) USING (c)
)""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(best.c AS INTEGER) AS "cluster", CAST(best.d AS BIGINT) AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c = best.c
"""


ORACLES = {"op2_warc": OP2, "op3_quality_rules": OP3, "op10_line_dedup": OP10, "op11_suffix_dedup": OP11, "op13_shallot_clusters": _op13()}
