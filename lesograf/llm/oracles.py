"""SQL for the pN_ queries that SQL can express."""

from __future__ import annotations

_TERMS = r"""
WITH s AS (SELECT sent_key, sent_id FROM sentences WHERE sent_id IS NOT NULL AND sent_key IS NOT NULL),
n AS (SELECT count(DISTINCT sent_id) AS n FROM s),
t AS (
  SELECT sent_key, 'lemma' AS field, lemma AS v FROM treebank_tokens WHERE regexp_full_match(id, '[0-9]+')
  UNION ALL SELECT sent_key, 'pos', pos FROM treebank_tokens WHERE regexp_full_match(id, '[0-9]+')
  UNION ALL SELECT sent_key, 'rel', rel FROM treebank_tokens WHERE regexp_full_match(id, '[0-9]+')
),
k AS (
  SELECT field, replace(lower(regexp_replace(v, '^\s+|\s+$', '', 'g')), 'ё', 'е') AS term, count(*) AS occurrences, count(DISTINCT sent_id) AS records
  FROM t JOIN s USING (sent_key) WHERE v IS NOT NULL GROUP BY 1, 2
),
m AS (SELECT k.*, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.2 * n.n THEN 'common' END AS mark FROM k, n)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": "SELECT sent_key FROM sentences WHERE length(text) > 400 OR len(tokens) > 60",
        "p3_found": _TERMS + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
        "p3_frequencies": _TERMS + "SELECT field, term, occurrences, records, mark FROM m",
    }
