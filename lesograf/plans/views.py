"""Views that the queries share, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lesograf.functions.scalars import dataset_name, falsy
from lesograf.operators.align import covering_spans
from lesograf.sources.tables import read_table


def parsed(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that were parsed, with ``dataset``."""
    return read_table(spark, d, "sentences").where("tokens IS NOT NULL").withColumn("dataset", dataset_name(F.col("source_file")))


def gold_words(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "sentences").select("sent_key", F.explode("tokens").alias("t")).select("sent_key", "t.*")


def pred_words(spark: SparkSession, d: str) -> DataFrame:
    """Word rows of the token table; of repeated ids the row of least tok_key."""
    t = read_table(spark, d, "treebank_tokens").where(F.col("id").rlike("^[0-9]+$"))
    first = t.groupBy("sent_key", F.col("id").cast("int").alias("id")).agg(F.min(F.struct("tok_key", "text", "lemma", "pos", "head_id", "rel", "char_start", "char_end", "misc")).alias("r"))
    return first.select("sent_key", "id", "r.*")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """``sent_key, sys, gold``: blank-separated tokens, each hanging on the one before, and the parse."""
    s = parsed(spark, d).where("text IS NOT NULL")
    spans = covering_spans(F.col("text"), "\\S+", "\\s+")
    sys = F.transform(spans, lambda t: F.struct(t["id"].alias("id"), (t["id"] - 1).alias("head_id"), F.lit("dep").alias("rel"), F.lit("NOUN").alias("pos"), t["start_char"].alias("start_char"), t["end_char"].alias("end_char")))
    gold = F.transform("tokens", lambda t: F.struct(t["id"].alias("id"), t["head_id"].alias("head_id"), t["rel"].alias("rel"), t["pos"].alias("pos"), t["start_char"].alias("start_char"), t["end_char"].alias("end_char")))
    return s.select("sent_key", sys.alias("sys"), gold.alias("gold"))


def genre(kind: int = 1):
    """Genre or ``unknown``; kind 1 keeps an empty genre, kind 2 doesn't and asks the source file next."""
    return F.coalesce("genre", F.lit("unknown")) if kind == 1 else falsy(F.col("genre"), falsy(F.col("source_file"), "unknown"))


GOLD = "gold AS (SELECT sent_key, t.id AS id, t.text AS text, t.lemma AS lemma, t.pos AS pos, t.head_id AS head_id, t.rel AS rel, t.start_char AS start_char, t.end_char AS end_char FROM (SELECT sent_key, unnest(tokens) AS t FROM sentences))"
PRED = """pred AS (SELECT sent_key, id::INT AS id, text, lemma, pos, head_id, rel, char_start, char_end, misc FROM treebank_tokens
 WHERE regexp_full_match(id, '[0-9]+') QUALIFY row_number() OVER (PARTITION BY sent_key, id::INT ORDER BY tok_key) = 1)"""
DATASET = "CASE WHEN contains(upper(source_file), 'TAIGA') THEN 'TAIGA' WHEN contains(upper(source_file), 'SYNTAGRUS') THEN 'SYNTAGRUS' WHEN contains(upper(source_file), 'COBALD') THEN 'COBALD' ELSE regexp_replace(upper(source_file), '\\.[^.]*$', '') END"
SYS = r"""pieces AS (SELECT sent_key, regexp_extract_all(text, '(\s+|\S+)', 1) AS p FROM sentences WHERE tokens IS NOT NULL AND text IS NOT NULL),
spans AS (SELECT sent_key, unnest(p) AS form, generate_subscripts(p, 1) AS k FROM pieces),
placed AS (SELECT sent_key, k, form, (sum(length(form)) OVER (PARTITION BY sent_key ORDER BY k) - length(form))::INT AS start_char, (sum(length(form)) OVER (PARTITION BY sent_key ORDER BY k))::INT AS end_char FROM spans),
sys AS (SELECT sent_key, (row_number() OVER (PARTITION BY sent_key ORDER BY k))::INT AS id, (row_number() OVER (PARTITION BY sent_key ORDER BY k) - 1)::INT AS head_id, 'dep' AS rel, 'NOUN' AS pos, start_char, end_char FROM placed WHERE regexp_full_match(form, '\S+'))"""
TREE = """up AS (
  SELECT sent_key, id AS node, head_id AS cur, CASE WHEN head_id IS NULL THEN 0 ELSE 1 END AS steps FROM gold
  UNION ALL
  SELECT up.sent_key, up.node, g.head_id, up.steps + CASE WHEN g.head_id IS NULL THEN 0 ELSE 1 END
  FROM up JOIN gold g ON g.sent_key = up.sent_key AND g.id = up.cur WHERE up.cur <> 0 AND up.steps <= 400),
tops AS (SELECT sent_key, node, max(steps) AS steps, bool_or(steps > 400) AS looped, bool_or(cur = 0) AS rooted FROM up GROUP BY sent_key, node),
keys AS (SELECT sent_key, len(tokens) AS n FROM sentences WHERE tokens IS NOT NULL),
depths AS (SELECT k.sent_key,
  coalesce(max(steps - 1) FILTER (rooted), 0)::INT AS v1,
  CASE WHEN bool_or(looped) THEN 0 ELSE coalesce(max(steps - CASE WHEN rooted THEN 1 ELSE 0 END), 0) END::INT AS v2,
  CASE WHEN bool_or(looped) THEN 0 ELSE coalesce(max(steps), 0) END::INT AS v3
  FROM keys k LEFT JOIN tops t ON t.sent_key = k.sent_key GROUP BY k.sent_key)"""
CROSS = """arcs AS (SELECT sent_key, least(id, head_id) AS s, greatest(id, head_id) AS e FROM gold WHERE head_id > 0),
crossed AS (SELECT DISTINCT a.sent_key FROM arcs a JOIN arcs b ON a.sent_key = b.sent_key AND a.s < b.s AND b.s < a.e AND a.e < b.e)"""
