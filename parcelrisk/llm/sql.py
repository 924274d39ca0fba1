"""DuckDB SQL of the queries that SQL can express."""

from .quality import STOP_WORDS

_WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"
_STOPS = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
_LANGS = ", ".join(f"'{k}'" for k in STOP_WORDS)


def quality_sql(source: str, columns: str) -> str:
    """The quality rules over ``source`` (doc_id, text, lang, ...)."""
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, * FROM {source}),
base AS (
  SELECT rid, doc_id, coalesce(text, '') AS t,
         lower(regexp_extract(coalesce(lang, ''), '^[A-Za-z]+')) IN ({_LANGS}) AS has_list,
         {_WORDS.format(t="coalesce(text, '')")} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM docs),
grams AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM base)),
again AS (
  SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (
  SELECT rid, count(DISTINCT i + o) AS n
  FROM again, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
m AS (
  SELECT rid, doc_id, has_list, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         len(l) AS n_lines,
         len(list_distinct(list_filter(list_transform(w, lambda x: lower(x)),
                                       lambda x: x IN ({_STOPS})))) AS n_stop_words,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM base LEFT JOIN covered USING (rid)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_chars,
         CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_lines
  FROM m),
ruled AS (
  SELECT *, NOT base_failed AND mean_chars BETWEEN 2 AND 20 AND symbols <= 0.1
         AND (n_stop_words >= 2 OR NOT has_list) AND dup_lines <= 0.5 AS kept
  FROM judged)
SELECT {columns}"""


OP9_SQL = quality_sql("documents", """doc_id, n_words, word_chars, n_symbols, n_dup_lines,
       n_repeat_words, base_failed, kept FROM ruled""")


def line_dedup_sql(source: str) -> str:
    """The line rule over ``source``: its rows with ``kept`` (the text that
    stays), ``n_lines`` and ``n_dropped``."""
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, * FROM {source}),
lines AS (
  SELECT rid, doc_id, generate_subscripts(l, 1) AS place, unnest(l) AS line
  FROM (SELECT rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM docs)),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT keyed.*, keeper IS NOT NULL AND doc_id < keeper AS gone
  FROM keyed LEFT JOIN shared USING (key)),
done AS (
  SELECT rid, doc_id, count(*) AS n_lines, count_if(gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS kept
  FROM judged GROUP BY rid, doc_id)"""


OP8_SQL = line_dedup_sql("documents") + """
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped,
       sha256(kept) AS kept_sha256
FROM done"""


OP3_SQL = r"""
WITH texts AS (
  SELECT 'd' AS side, row_number() OVER () AS rid, doc_id AS id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), item_id, text FROM benchmark),
worded AS (
  SELECT side, rid, id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
wins AS (
  SELECT DISTINCT id AS item_id, least(len(w), 10) AS size,
         list_aggregate(w[i:i + least(len(w), 10) - 1], 'string_agg', ' ') AS g
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i
        FROM worded WHERE side = 'b' AND len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM wins),
starts AS (
  SELECT rid, i, size, list_aggregate(w[i:i + size - 1], 'string_agg', ' ') AS g
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM worded, sizes WHERE side = 'd' AND len(w) >= size)),
found AS (SELECT rid, i, starts.size AS size, item_id FROM starts JOIN wins USING (g)
          WHERE starts.size = wins.size),
items AS (
  SELECT rid, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM found GROUP BY rid),
hits AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT rid, unnest(range(i, i + size)) AS p FROM found) GROUP BY rid)
SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words,
       CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM worded LEFT JOIN items USING (rid) LEFT JOIN hits USING (rid)
WHERE side = 'd'"""
