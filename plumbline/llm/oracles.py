"""SQL for DuckDB, where SQL can express an operator."""

from plumbline.llm.quality import BOILERPLATE

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS largest FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT k.doc_id, pos, line, c.key IS NOT NULL AND k.doc_id < c.largest AS dropped FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def _shingle_sets(table: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i+4], 'string_agg', ' ')) END) AS shingle
    FROM (SELECT {key}, {_WORDS} AS w FROM {table})"""


_CONTAINMENT = f"""
WITH d AS ({_shingle_sets('documents', 'doc_id')}), i AS ({_shingle_sets('benchmark', 'item_id')}),
sizes AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id)
SELECT doc_id, item_id, round(count(*) / min(n), 6) AS containment
FROM d JOIN i USING (shingle) JOIN sizes USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * min(n)"""

_VISIBLE = "length(regexp_replace({0}, '[\\x20\\x09-\\x0D]', '', 'g'))"
_N_WORDS = "len(regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+'))"

_QUALITY = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
twice AS (SELECT doc_id, s FROM windows GROUP BY doc_id, s HAVING count(*) > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM windows JOIN twice USING (doc_id, s)) GROUP BY doc_id),
lines AS (
  SELECT *, {_N_WORDS.format('line')} AS n, len(regexp_extract_all(line, '[|»›·•]')) AS seps
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM t)),
judged AS (
  SELECT *, n > 0 AND (
      100 * len(regexp_extract_all(line, '[#*$%&<>{{}}~^=\\\\]')) > 10 * {_VISIBLE.format('line')}
      OR (seps > 0 AND n - seps <= 3 * (seps + 1))
      OR (n >= 20 AND NOT regexp_matches(line, '[.!?:;,…。]'))
      OR (n >= 4 AND NOT regexp_matches(line, '\\p{{Ll}}') AND regexp_matches(line, '\\p{{Lu}}')))
    OR (length(line) <= 300 AND regexp_matches(lower(line), '{"|".join(BOILERPLATE)}')) AS fails
  FROM lines),
per_doc AS (
  SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines, count(*) FILTER (fails) AS n_failed_lines,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT fails), '') AS cleaned
  FROM judged GROUP BY doc_id),
base AS (
  SELECT doc_id, len(w) AS n_words, {_VISIBLE.format('text')} AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, n_failed_lines, cleaned
  FROM t JOIN per_doc USING (doc_id) LEFT JOIN repeated r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed_lines,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND (n_failed_lines = 0
    OR (100 * (word_chars - {_VISIBLE.format('cleaned')}) <= 30 * word_chars AND {_N_WORDS.format('cleaned')} >= 20)) AS kept
FROM base"""

_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

_RANKING = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
lengths AS (SELECT doc_id, len(w) AS n FROM d WHERE len(w) > 0),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), totals),
wanted AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER best AS INT) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 10"""

_NEGATIVES = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER best <= 3"""

SQL: dict[str, str] = {"op2_line_first_cleaning": _QUALITY, "op3_line_dedup": _LINE_DEDUP, "op9_containment_search": _CONTAINMENT,
                       "op11_geometric_blocks": _RANKING, "op12_residue_hard_negatives": _NEGATIVES}
