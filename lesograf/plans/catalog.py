"""The queries of the core and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lesograf.functions import scalars as S
from lesograf.functions import udfs
from lesograf.operators import adapters, align, audit, decode, metrics, profile, report, sampling, tokenize, validate
from lesograf.plans import pipelines
from lesograf.plans import views as V
from lesograf.sources import conllu, fetch, sinks
from lesograf.sources.tables import checkpoint_dir, read_table
from lesograf.streaming.treebank import windowed_counts

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- reports over the corpus -------------------------------------------------------------------


@query(f"""SELECT dataset, count(n) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS p50,
 quantile_cont(n, 0.75) AS p75, quantile_cont(n, 0.9) AS p90, quantile_cont(n, 0.95) AS p95, quantile_cont(n, 0.99) AS p99, max(n) AS max
 FROM (SELECT {V.DATASET} AS dataset, len(tokens)::INT AS n FROM sentences WHERE tokens IS NOT NULL) GROUP BY dataset""")
def length_describe(spark, d):
    r = report.describe(V.parsed(spark, d).select("dataset", F.size("tokens").alias("length")), "length", "dataset")
    return r.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query(f"SELECT {V.DATASET} AS dataset, coalesce(genre, 'unknown') AS genre, count(*) AS n FROM sentences WHERE tokens IS NOT NULL GROUP BY 1, 2")
def genre_counts(spark, d):
    return report.group_counts(V.parsed(spark, d).withColumn("genre", V.genre(1)), "dataset", "genre")


@query("SELECT coalesce(nullif(genre, ''), nullif(source_file, ''), 'unknown') AS genre, count(*) AS n FROM sentences GROUP BY 1")
def genre_or_source_counts(spark, d):
    return report.group_counts(read_table(spark, d, "sentences").select(V.genre(2).alias("genre")), "genre")


_PROFILE2 = f"""WITH RECURSIVE {V.GOLD}, {V.TREE}, {V.CROSS},
c AS (SELECT sent_key, count(*) FILTER (pos = 'PRON') AS pron, count(*) FILTER (pos = 'PROPN') AS propn, count(*) FILTER (pos = 'VERB') AS verbs,
  count(*) FILTER (contains(text, '-') AND length(text) > 1) AS hyph, max(length(text)) AS longest,
  bool_or(coalesce(lower(lemma) IN ({{v2}}), false)) AS said2, bool_or(coalesce(coalesce(nullif(lower(lemma), ''), lower(text)) IN ({{v3}}), false)) AS said3,
  bool_or(coalesce(coalesce(nullif(lower(lemma), ''), lower(text)) IN ({{v1}}), false)) AS said1 FROM gold GROUP BY sent_key),
base AS (SELECT s.sent_key, s.text, len(s.tokens)::INT AS length, d.v1, d.v2, d.v3, x.sent_key IS NOT NULL AS non_proj, coalesce(contains(lower(s.source_file), 'cobald'), false)::INT AS bonus,
  coalesce(c.pron, 0)::INT AS pronouns, coalesce(c.propn, 0)::INT AS propn, coalesce(c.verbs, 0)::INT AS verbs, coalesce(c.hyph, 0)::INT AS hyph, coalesce(c.longest, 0)::INT AS longest,
  coalesce(regexp_matches(ltrim(s.text, chr(32) || chr(10) || chr(13) || chr(9) || chr(160)), '^[-—–]'), false) AS dash, coalesce(regexp_matches(ltrim(s.text, chr(32) || chr(10) || chr(13) || chr(9) || chr(160)), '^[-—–−]'), false) AS dash3,
  coalesce(contains(s.text, '«') AND contains(s.text, '»'), false) AS quoted, coalesce(c.said1, false) AS said1, coalesce(c.said2, false) AS said2, coalesce(c.said3, false) AS said3
  FROM sentences s JOIN depths d USING (sent_key) LEFT JOIN crossed x USING (sent_key) LEFT JOIN c USING (sent_key) WHERE s.tokens IS NOT NULL)
""".format(**{k: ", ".join(f"'{w}'" for w in v) for k, v in (("v1", profile.VERBS_V1), ("v2", profile.VERBS_V2), ("v3", profile.VERBS_V3))})


@query(_PROFILE2 + "SELECT sent_key, length AS text_len, (dash OR quoted) AND said1 AS is_dialogue, v1 AS tree_depth, non_proj AS non_projectivity FROM base")
def profile_v1(spark, d):
    return profile.profile_v1(read_table(spark, d, "sentences"))


@query(
    _PROFILE2
    + r"""SELECT sent_key, (v2 + 10 * non_proj::INT) * 1.5::DOUBLE + 15.0::DOUBLE * (dash AND said2)::INT + 2.0::DOUBLE * pronouns + 20.0::DOUBLE * bonus AS score, length, v2 AS depth, non_proj, v2 + 10 * non_proj::INT AS syntax_complexity,
 dash AND said2 AS is_dialogue, pronouns, CASE WHEN length > 0 THEN propn::DOUBLE / length ELSE 0 END AS propn_ratio, CASE WHEN length > 0 THEN hyph::DOUBLE / length ELSE 0 END AS hyphen_density,
 coalesce(len(list_filter(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+\.'), lambda x: regexp_full_match(x, '[А-ЯЁA-Z]\.'))), 0)::INT AS abbr_count, coalesce(len(regexp_extract_all(text, '[.?!,:;\-]{2,}')), 0)::INT AS punct_clusters, longest AS max_token_len FROM base"""
)
def profile_v2(spark, d):
    return profile.profile_v2(read_table(spark, d, "sentences"))


@query(
    _PROFILE2
    + """SELECT sent_key, (v3 + 10 * non_proj::INT) * 1.5::DOUBLE + 15.0::DOUBLE * (dash3 AND said3)::INT + 2.0::DOUBLE * pronouns + 20.0::DOUBLE * bonus + verbs AS score, (dash3 AND said3)::INT::DOUBLE AS dialogue_score,
 v3 + 10.0::DOUBLE * non_proj::INT AS syntax_complexity, v3 AS depth, non_proj, pronouns, propn, verbs, length FROM base"""
)
def profile_v3(spark, d):
    return profile.profile_v3(read_table(spark, d, "sentences"))


def _depth(version: int):
    f = getattr(profile, f"depth_v{version}")

    def run(spark, d):
        return V.parsed(spark, d).select("sent_key", f(F.col("tokens")).alias("depth"))

    run.__name__ = f"tree_depth_v{version}"
    return query(f"WITH RECURSIVE {V.GOLD}, {V.TREE} SELECT sent_key, v{version} AS depth FROM depths")(run)


tree_depth_v1, tree_depth_v2, tree_depth_v3 = map(_depth, (1, 2, 3))


@query(f"WITH {V.GOLD}, {V.CROSS} SELECT s.sent_key, c.sent_key IS NOT NULL AS non_proj FROM sentences s LEFT JOIN crossed c USING (sent_key) WHERE s.tokens IS NOT NULL")
def non_projectivity(spark, d):
    return V.parsed(spark, d).select("sent_key", profile.non_projective(F.col("tokens")).alias("non_proj"))


@query(f"WITH {V.GOLD}, {V.CROSS} SELECT a.sent_key, count(*) AS crossings FROM arcs a JOIN arcs b ON a.sent_key = b.sent_key AND a.s < b.s AND b.s < a.e AND a.e < b.e GROUP BY a.sent_key")
def arc_crossings(spark, d):
    arcs = V.gold_words(spark, d).where("head_id > 0").select("sent_key", F.least("id", "head_id").alias("s"), F.greatest("id", "head_id").alias("e"))
    b = arcs.select("sent_key", F.col("s").alias("s2"), F.col("e").alias("e2"))
    return arcs.join(b, "sent_key").where("s < s2 AND s2 < e AND e < e2").groupBy("sent_key").agg(F.count(F.lit(1)).alias("crossings"))


_BY_DATASET = _PROFILE2 + f", p AS (SELECT b.*, {V.DATASET} AS dataset, genre, (v2 + 10 * non_proj::INT) * 1.5::DOUBLE + 15.0::DOUBLE * (dash AND said2)::INT + 2.0::DOUBLE * pronouns + 20.0::DOUBLE * bonus AS score FROM base b JOIN sentences USING (sent_key)) "


def _profiled(spark, d):
    s = read_table(spark, d, "sentences").withColumn("dataset", S.dataset_name(F.col("source_file")))
    return profile.profile_v2(s, "dataset", "genre", "sent_id")


@query(_BY_DATASET + "SELECT dataset, round(avg((dash AND said2)::INT) * 100, 6) AS percent FROM p GROUP BY dataset")
def dialogue_percent(spark, d):
    return report.percent_true(_profiled(spark, d), "is_dialogue", "dataset").withColumn("percent", F.round("percent", 6))


@query(_BY_DATASET + "SELECT dataset, quantile_cont(score, 0.9) AS p90 FROM p GROUP BY dataset")
def score_p90(spark, d):
    return _profiled(spark, d).groupBy("dataset").agg(F.percentile("score", F.lit(0.9)).alias("p90"))


@query(_BY_DATASET + "SELECT floor(quantile_cont(length, 0.9))::INT AS length_p90, floor(quantile_cont(score, 0.9))::INT AS score_p90, '10 < length < ' || floor(quantile_cont(length, 0.9))::INT || ' and score > ' || floor(quantile_cont(score, 0.9))::INT AS query FROM p WHERE dataset = 'TAIGA' AND regexp_matches(lower(genre), 'fiction|lit|prose|social')")
def recommendation(spark, d):
    return report.recommendation(_profiled(spark, d), F.col("genre"), F.col("dataset"))


@query("SELECT count(*) AS sentences, round(avg(len(tokens)), 6) AS avg_length, max(len(tokens))::INT AS max_length FROM sentences WHERE tokens IS NOT NULL")
def eda(spark, d):
    return report.eda(V.parsed(spark, d).select(F.size("tokens").alias("length"))).withColumn("avg_length", F.round("avg_length", 6))


@query("SELECT length, n, sum(n) OVER (ORDER BY length) / sum(n) OVER () AS ecdf FROM (SELECT len(tokens)::INT AS length, count(*) AS n FROM sentences WHERE tokens IS NOT NULL GROUP BY 1)".replace("length, n, ", "length, "))
def length_ecdf(spark, d):
    return report.ecdf(V.parsed(spark, d).select(F.size("tokens").alias("length")), "length")


@query("""WITH l AS (SELECT len(tokens)::DOUBLE AS x FROM sentences WHERE tokens IS NOT NULL), e AS (SELECT min(x) AS lo, (max(x) - min(x)) / 20 AS w FROM l)
 SELECT least(floor((x - lo) / w), 19)::INT AS bin, lo + least(floor((x - lo) / w), 19)::INT * w AS low, lo + (least(floor((x - lo) / w), 19)::INT + 1) * w AS high, count(*) AS n FROM l, e GROUP BY ALL""")
def length_histogram(spark, d):
    return report.histogram(V.parsed(spark, d).select(F.size("tokens").alias("length")), "length")


@query(f"WITH {V.GOLD} SELECT pos, count(*) AS n FROM gold GROUP BY pos")
def upos_counts(spark, d):
    return report.group_counts(V.gold_words(spark, d), "pos")


# --- metadata and JSON -------------------------------------------------------------------------


@query("""SELECT sent_key, coalesce(genre, 'unknown') AS genre, CASE WHEN json_valid(metrics) THEN TRY_CAST(metrics->>'$.score' AS DOUBLE) END AS score, CASE WHEN json_valid(metrics) THEN TRY_CAST(metrics->>'$.length' AS INT) END AS length,
 CASE WHEN json_valid(metrics) THEN TRY_CAST(metrics->>'$.depth' AS INT) END AS depth, CASE WHEN json_valid(metrics) THEN TRY_CAST(metrics->>'$.is_dialogue' AS BOOLEAN) END AS is_dialogue FROM sentences""")
def metadata_frame(spark, d):
    m = F.from_json("metrics", "score double, length int, depth int, is_dialogue boolean")
    broken = F.from_json("metrics", "score double, length int, depth int, is_dialogue boolean, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})["_corrupt"]
    s = read_table(spark, d, "sentences").select("sent_key", V.genre(1).alias("genre"), m.alias("m"), broken.alias("broken"))
    return s.select("sent_key", "genre", *(F.when(F.col("broken").isNull(), F.col(f"m.{c}")).alias(c) for c in ("score", "length", "depth", "is_dialogue")))


@query("SELECT CASE WHEN json_valid(metrics) THEN 'json' WHEN metrics IS NULL THEN 'none' ELSE 'broken' END AS state, count(*) AS n FROM sentences GROUP BY 1")
def metrics_states(spark, d):
    f = metadata_frame_state(spark, d)
    return report.group_counts(f, "state")


def metadata_frame_state(spark, d):
    bad = F.from_json("metrics", "score double, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})["_corrupt"]
    return read_table(spark, d, "sentences").select(F.when(F.col("metrics").isNull(), "none").when(bad.isNull(), "json").otherwise("broken").alias("state"))


def _slice(name: str, text: str, sql: str):
    def run(spark, d):
        return sampling.where_query(metadata_frame(spark, d), text).select("sent_key", "genre", "length", "score")

    run.__name__ = f"query_slice_{name}"
    return query(f"SELECT sent_key, genre, length, score FROM ({_SQL['metadata_frame']}) WHERE {sql}")(run)


_slice("hard", "genre.str.contains('fiction', case=False, na=False) and is_dialogue == True and score > 5", "contains(lower(genre), 'fiction') AND is_dialogue AND score > 5")
_slice("medium", "genre.str.contains('news', case=False, na=False) and is_dialogue == False and 3 < length < 20", "contains(lower(genre), 'news') AND is_dialogue = false AND length > 3 AND length < 20")
_slice("general", "genre != 'fiction' and length <= 12", "genre IS DISTINCT FROM 'fiction' AND length <= 12")


# --- validation --------------------------------------------------------------------------------

_ERRORS = """e AS (SELECT sent_key, sent_id, list_concat(CASE WHEN sent_id IS NULL THEN ['sent_id'] ELSE [] END,
 list_transform(list_filter(coalesce(tokens, []), lambda t: coalesce(t.text, '') = ''), lambda t: 'form:' || t.id),
 list_transform(list_filter(coalesce(tokens, []), lambda t: t.head_id <> 0 AND NOT list_contains(list_transform(coalesce(tokens, []), lambda u: u.id), t.head_id)), lambda t: 'head:' || t.id),
 CASE WHEN text IS NULL THEN ['text'] ELSE [] END,
 CASE WHEN len(list_filter(coalesce(tokens, []), lambda t: t.head_id = 0)) <> 1 THEN ['roots:' || len(list_filter(coalesce(tokens, []), lambda t: t.head_id = 0))] ELSE [] END) AS errors FROM sentences)"""
_DUPLICATES = ", f AS (SELECT *, sent_id IS NOT NULL AND row_number() OVER (PARTITION BY sent_id ORDER BY sent_key) > 1 AS duplicate FROM e)"


@query(f"WITH {_ERRORS} SELECT sent_key, array_to_string(errors, ';') AS errors FROM e WHERE len(errors) > 0")
def validation_errors(spark, d):
    e = validate.sentence_errors(read_table(spark, d, "sentences"))
    return e.where(F.size("errors") > 0).select("sent_key", F.array_join("errors", ";").alias("errors"))


@query(f"WITH {_ERRORS}{_DUPLICATES} SELECT count(*) AS total, count_if(len(errors) = 0 AND NOT duplicate) AS valid, count_if(len(errors) > 0 OR duplicate) AS invalid, count_if((len(errors) > 0 OR duplicate) AND sent_id IS NOT NULL) AS reported, count_if(duplicate) AS duplicates FROM f")
def validation_stats(spark, d):
    return validate.batch_stats(read_table(spark, d, "sentences"))


@query(f"WITH {_ERRORS}{_DUPLICATES} SELECT sent_key, sent_id FROM f WHERE duplicate")
def duplicate_ids(spark, d):
    return validate.with_duplicates(read_table(spark, d, "sentences").select("sent_key", "sent_id")).where("duplicate").select("sent_key", "sent_id")


@query("SELECT sent_id, max(sent_key) AS sent_key, min(sent_key) AS position FROM sentences WHERE sent_id IS NOT NULL GROUP BY sent_id")
def last_delivery(spark, d):
    return validate.last_wins(read_table(spark, d, "sentences").where("sent_id IS NOT NULL")).select("sent_id", "sent_key", "position")


@query(f"WITH {V.GOLD} SELECT g.sent_key, g.id, g.head_id FROM gold g WHERE g.head_id <> 0 AND NOT EXISTS (SELECT 1 FROM gold h WHERE h.sent_key = g.sent_key AND h.id = g.head_id)")
def dangling_heads(spark, d):
    g = V.gold_words(spark, d).select("sent_key", "id", "head_id")
    return g.where("head_id <> 0").join(g.select("sent_key", F.col("id").alias("head_id")), ["sent_key", "head_id"], "left_anti").select("sent_key", "id", "head_id")


@query("SELECT tok_key FROM treebank_tokens WHERE char_end > char_start")
def valid_offsets(spark, d):
    return validate.valid_offsets(read_table(spark, d, "treebank_tokens")).select("tok_key")


@query("SELECT CASE WHEN regexp_full_match(id, '[0-9]+') THEN 'word' WHEN regexp_full_match(id, '[0-9]+-[0-9]+') THEN 'range' WHEN regexp_full_match(id, '[0-9]+\\.[0-9]+') THEN 'empty' ELSE 'bad' END AS kind, count(*) AS n FROM treebank_tokens GROUP BY 1")
def id_kinds(spark, d):
    return report.group_counts(read_table(spark, d, "treebank_tokens").select(S.id_kind(F.col("id")).alias("kind")), "kind")


# --- selections --------------------------------------------------------------------------------


@query(_BY_DATASET + "SELECT sent_key, length FROM p WHERE dash AND said2 ORDER BY length DESC, sent_key LIMIT 1000")
def topk_dialogues(spark, d):
    return sampling.top_k(_profiled(spark, d).where("is_dialogue"), ["length"], 1000).select("sent_key", "length")


@query(_BY_DATASET + "SELECT sent_key, non_proj, v2 AS depth FROM p ORDER BY non_proj DESC, v2 DESC, sent_key LIMIT 500")
def topk_complex(spark, d):
    return sampling.top_k(_profiled(spark, d), ["non_proj", "depth"], 500).select("sent_key", "non_proj", "depth")


@query("SELECT sent_key, md5(sent_key::VARCHAR) AS digest FROM sentences ORDER BY digest, sent_key LIMIT 1000")
def hash_sample(spark, d):
    s = sampling.hash_sample(read_table(spark, d, "sentences").select("sent_key"), 1000)
    return s.select("sent_key", F.md5(F.col("sent_key").cast("string")).alias("digest"))


_SPLIT = _PROFILE2 + """, q AS (SELECT sent_key, (v3 + 10 * non_proj::INT) * 1.5::DOUBLE + 15.0::DOUBLE * (dash3 AND said3)::INT + 2.0::DOUBLE * pronouns + 20.0::DOUBLE * bonus + verbs AS score, (dash3 AND said3)::INT::DOUBLE AS dialogue_score, v3 + 10.0::DOUBLE * non_proj::INT AS syntax_complexity, pronouns FROM base),
 z AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY score DESC, sent_key) <= floor(count(*) OVER () * 0.15) THEN 'dev' ELSE 'train' END AS set FROM q) """


@query(_SPLIT + "SELECT sent_key, set FROM z")
def split_fraction(spark, d):
    return sampling.split_by_fraction(profile.profile_v3(read_table(spark, d, "sentences")), "score", 0.15).select("sent_key", "set")


@query(_SPLIT + "SELECT set, count(*) AS size, round(avg(score), 6) AS mean_score, round(avg(syntax_complexity), 6) AS mean_syntax_complexity, round(avg(dialogue_score), 6) AS dialogue_ratio, round(avg(pronouns), 6) AS mean_pronouns FROM z GROUP BY set")
def split_summary(spark, d):
    s = report.split_summary(sampling.split_by_fraction(profile.profile_v3(read_table(spark, d, "sentences")), "score", 0.15))
    return s.select("set", "size", *(F.round(c, 6).alias(c) for c in s.columns[2:]))


@query("SELECT sent_key, printf('%s_%07d', upper(split_part(source_file, '_', 1)), row_number() OVER (ORDER BY source_file, sent_key)) AS sent_id_new FROM sentences WHERE source_file IS NOT NULL")
def standard_ids(spark, d):
    s = sampling.with_ordinal(read_table(spark, d, "sentences").where("source_file IS NOT NULL").select("sent_key", "source_file"), "source_file", "sent_key")
    return s.select("sent_key", S.standard_id(F.col("source_file"), F.col("ordinal")).alias("sent_id_new"))


@query("SELECT sent_key FROM sentences WHERE sent_id IN (SELECT sent_id FROM sentences WHERE genre = 'fiction')")
def keep_ids(spark, d):
    s = read_table(spark, d, "sentences")
    return sampling.keep_ids(s.select("sent_key", "sent_id"), s.where("genre = 'fiction'").select("sent_id")).select("sent_key")


# --- alignment and metrics ---------------------------------------------------------------------

_OVERLAP = f"""{V.GOLD}, gx AS (SELECT *, row_number() OVER (PARTITION BY sent_key) AS ord FROM gold), {V.SYS},
o AS (SELECT s.sent_key, s.id AS sys_id, g.id AS gold_id, (least(s.end_char, g.end_char) - greatest(s.start_char, g.start_char)) AS inter, s.end_char - s.start_char + g.end_char - g.start_char AS total FROM sys s JOIN gold g ON s.sent_key = g.sent_key AND g.start_char < s.end_char AND g.end_char > s.start_char),
r AS (SELECT *, inter::DOUBLE / (total - inter) AS iou, row_number() OVER (PARTITION BY sent_key, sys_id ORDER BY inter::DOUBLE / (total - inter) DESC, gold_id) AS k FROM o),
al AS (SELECT s.sent_key, s.id AS sys_id, r.gold_id, coalesce(r.iou, 0) AS iou, CASE WHEN r.iou IS NULL THEN 'none' WHEN r.iou > 0.9 THEN 'exact' ELSE 'partial' END AS type FROM sys s LEFT JOIN r ON r.sent_key = s.sent_key AND r.sys_id = s.id AND r.k = 1)"""


@query(f"WITH {_OVERLAP} SELECT sent_key, sys_id, gold_id, iou, type FROM al")
def overlap_align(spark, d):
    p = V.pairs(spark, d)
    return p.select("sent_key", F.explode(align.align_best(F.col("sys"), F.col("gold"))).alias("a")).select("sent_key", "a.*")


@query(f"""WITH {_OVERLAP}, j AS (SELECT a.sent_key, s.head_id AS sh, g.head_id AS gh, s.rel AS sr, g.rel AS gr, h.gold_id AS ah FROM al a JOIN sys s ON s.sent_key = a.sent_key AND s.id = a.sys_id JOIN gold g ON g.sent_key = a.sent_key AND g.id = a.gold_id LEFT JOIN al h ON h.sent_key = a.sent_key AND h.sys_id = s.head_id),
k AS (SELECT *, CASE WHEN sh = 0 THEN coalesce(gh = 0, false) ELSE ah IS NOT DISTINCT FROM gh END AS ok FROM j)
SELECT count(*) AS aligned, count_if(ok)::DOUBLE / count(*) AS soft_uas, count_if(ok AND sr IS NOT DISTINCT FROM gr)::DOUBLE / count(*) AS soft_las FROM k""")
def soft_scores_v1(spark, d):
    return metrics.soft_scores_v1(V.pairs(spark, d))


@query(f"""WITH {V.GOLD}, {V.SYS}, a AS (SELECT DISTINCT sent_key, start_char FROM sys), b AS (SELECT DISTINCT g.sent_key, g.start_char FROM gold g JOIN sentences s USING (sent_key) WHERE s.text IS NOT NULL),
n AS (SELECT (SELECT count(*) FROM a JOIN b USING (sent_key, start_char)) AS tp, (SELECT count(*) FROM a ANTI JOIN b USING (sent_key, start_char)) AS fp, (SELECT count(*) FROM b ANTI JOIN a USING (sent_key, start_char)) AS fn)
SELECT tp, fp, fn, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall, round(2 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / (tp + fn)) / (tp::DOUBLE / (tp + fp) + tp::DOUBLE / (tp + fn)), 12) AS f1 FROM n""")
def segmentation_f1(spark, d):
    return metrics.segmentation_scores(V.pairs(spark, d)).withColumn("f1", F.round("f1", 12))


@query(f"""WITH RECURSIVE {V.GOLD}, {V.SYS}, gi AS (SELECT sent_key, id - 1 AS j, start_char, end_char FROM gold JOIN (SELECT DISTINCT sent_key FROM pieces) USING (sent_key)), si AS (SELECT sent_key, id - 1 AS i, start_char, end_char FROM sys),
edges AS (SELECT s.sent_key, s.i, g.j FROM si s JOIN gi g ON s.sent_key = g.sent_key AND g.start_char < s.end_char AND g.end_char > s.start_char
  WHERE (least(s.end_char, g.end_char) - greatest(s.start_char, g.start_char))::DOUBLE / (s.end_char - s.start_char + g.end_char - g.start_char - (least(s.end_char, g.end_char) - greatest(s.start_char, g.start_char))) > 0.1),
lagged AS (SELECT *, CASE WHEN i = lag(i) OVER w OR j = lag(j) OVER w THEN 0 ELSE 1 END AS fresh FROM edges WINDOW w AS (PARTITION BY sent_key ORDER BY i, j)),
grouped AS (SELECT sent_key, i, j, sum(fresh) OVER (PARTITION BY sent_key ORDER BY i, j) AS g FROM lagged),
sized AS (SELECT sent_key, g, count(DISTINCT i) AS ns, count(DISTINCT j) AS ng FROM grouped GROUP BY sent_key, g),
types AS (SELECT CASE WHEN ns = 1 AND ng = 1 THEN 'exact' WHEN ns = 1 THEN 'split' WHEN ng = 1 THEN 'merge' ELSE 'complex' END AS type FROM sized
 UNION ALL SELECT 'error' FROM si ANTI JOIN edges USING (sent_key, i) UNION ALL SELECT 'error' FROM gi ANTI JOIN edges USING (sent_key, j))
SELECT type, count(*) AS n FROM types GROUP BY type""")
def group_align_types(spark, d):
    p = V.pairs(spark, d).select(F.explode(align.align_groups(F.col("sys"), F.col("gold"))).alias("g"))
    return report.group_counts(p.select("g.type"), "type")


_EDGES = f"""{V.GOLD}, {V.SYS}, gi AS (SELECT sent_key, id - 1 AS j, start_char, end_char FROM gold JOIN (SELECT DISTINCT sent_key FROM pieces) USING (sent_key)), si AS (SELECT sent_key, id - 1 AS i, start_char, end_char FROM sys),
edges AS (SELECT s.sent_key, s.i, g.j FROM si s JOIN gi g ON s.sent_key = g.sent_key AND g.start_char < s.end_char AND g.end_char > s.start_char
  WHERE (least(s.end_char, g.end_char) - greatest(s.start_char, g.start_char))::DOUBLE / (s.end_char - s.start_char + g.end_char - g.start_char - (least(s.end_char, g.end_char) - greatest(s.start_char, g.start_char))) > 0.1),
lagged AS (SELECT *, CASE WHEN i = lag(i) OVER w OR j = lag(j) OVER w THEN 0 ELSE 1 END AS fresh FROM edges WINDOW w AS (PARTITION BY sent_key ORDER BY i, j)),
grouped AS (SELECT sent_key, i, j, sum(fresh) OVER (PARTITION BY sent_key ORDER BY i, j) AS g FROM lagged)"""


@query(f"""WITH {_EDGES}, firsts AS (SELECT sent_key, g, min(i) AS i FROM grouped GROUP BY 1, 2), of_gold AS (SELECT DISTINCT sent_key, j, g FROM grouped), of_sys AS (SELECT DISTINCT sent_key, i, g FROM grouped),
r AS (SELECT g.head_id AS gh, lower(g.rel) AS gr, s.head_id AS sh, lower(s.rel) AS sr, h.g AS head_of_gold, k.g AS head_of_sys FROM gold g JOIN (SELECT DISTINCT sent_key FROM pieces) USING (sent_key)
  LEFT JOIN of_gold o ON o.sent_key = g.sent_key AND o.j = g.id - 1 LEFT JOIN firsts f ON f.sent_key = g.sent_key AND f.g = o.g LEFT JOIN sys s ON s.sent_key = g.sent_key AND s.id = f.i + 1
  LEFT JOIN of_gold h ON h.sent_key = g.sent_key AND h.j = g.head_id - 1 LEFT JOIN of_sys k ON k.sent_key = g.sent_key AND k.i = s.head_id - 1),
c AS (SELECT coalesce(CASE WHEN gh = 0 THEN sh = 0 ELSE sh > 0 AND head_of_gold = head_of_sys END, false) AS ok, gr, sr FROM r)
SELECT count(*) AS tokens, count_if(ok)::DOUBLE / count(*) AS soft_uas, count_if(ok AND coalesce(gr = sr, false))::DOUBLE / count(*) AS soft_las FROM c""")
def soft_scores_v2(spark, d):
    return metrics.soft_scores_v2(V.pairs(spark, d))


_WINDOW = f"""{V.GOLD}, {V.SYS}, g AS (SELECT sent_key, row_number() OVER (PARTITION BY sent_key ORDER BY id) AS k, id, head_id, rel, pos, start_char, end_char FROM gold JOIN (SELECT DISTINCT sent_key FROM pieces) USING (sent_key)),
cand AS (SELECT g.sent_key, g.k, s.id - 1 AS i FROM g JOIN sys s ON s.sent_key = g.sent_key AND (least(g.end_char, s.end_char) - greatest(g.start_char, s.start_char))::DOUBLE > 0.5 * (g.end_char - g.start_char) AND least(g.end_char, s.end_char) > greatest(g.start_char, s.start_char)),
walk AS (SELECT sent_key, 0::BIGINT AS k, 0::INT AS at, NULL::INT AS i FROM (SELECT DISTINCT sent_key FROM pieces) UNION ALL
 SELECT w.sent_key, g.k, coalesce(c.i, w.at)::INT, c.i::INT FROM walk w JOIN g ON g.sent_key = w.sent_key AND g.k = w.k + 1 LEFT JOIN cand c ON c.sent_key = g.sent_key AND c.k = g.k AND c.i >= greatest(w.at - 5, 0) AND c.i < w.at + 5)"""


@query(f"""WITH RECURSIVE {_WINDOW}, m AS (SELECT w.sent_key, w.i, g.head_id IS NOT DISTINCT FROM s.head_id AS h, g.pos IS NOT DISTINCT FROM s.pos AS p, g.rel IS NOT DISTINCT FROM s.rel AS r FROM walk w JOIN g ON g.sent_key = w.sent_key AND g.k = w.k LEFT JOIN sys s ON s.sent_key = w.sent_key AND s.id = w.i + 1),
 per AS (SELECT x.sent_key, count(m.sent_key) AS n, count(i) AS m, count_if(i IS NOT NULL AND p) AS p, count_if(i IS NOT NULL AND h) AS h, count_if(i IS NOT NULL AND h AND r) AS l FROM (SELECT DISTINCT sent_key FROM pieces) x LEFT JOIN m USING (sent_key) GROUP BY 1)
 SELECT count(*) AS sentences, round(avg(CASE WHEN n > 0 THEN m::DOUBLE / n ELSE 0 END), 9) AS token_f1, round(avg(CASE WHEN m > 0 THEN p::DOUBLE / m ELSE 0 END), 9) AS pos_accuracy, round(avg(CASE WHEN m > 0 THEN h::DOUBLE / m ELSE 0 END), 9) AS uas, round(avg(CASE WHEN m > 0 THEN l::DOUBLE / m ELSE 0 END), 9) AS las FROM per""")
def backend_scores(spark, d):
    b = metrics.backend_scores(V.pairs(spark, d))
    return b.select("sentences", *(F.round(c, 9).alias(c) for c in b.columns[1:]))


@query(f"WITH RECURSIVE {_WINDOW} SELECT w.sent_key, g.id AS gold_id, w.i AS sys_index FROM walk w JOIN g ON g.sent_key = w.sent_key AND g.k = w.k WHERE w.k > 0")
def window_align(spark, d):
    return V.pairs(spark, d).select("sent_key", F.explode(align.align_window(F.col("gold"), F.col("sys"))).alias("a")).select("sent_key", "a.*")


_STRICT = f"""{V.GOLD}, {V.PRED}, r AS (SELECT g.sent_key, g.id, p.id IS NOT NULL AS in_pred, coalesce(g.head_id = p.head_id, false) AS u, coalesce(g.head_id = p.head_id, false) AND coalesce(g.rel = p.rel, false) AS l, g.rel FROM gold g LEFT JOIN pred p ON p.sent_key = g.sent_key AND p.id = g.id)"""


@query(f"WITH {_STRICT} SELECT count(*) AS words, count_if(u)::DOUBLE / count(*) AS uas, count_if(l)::DOUBLE / count(*) AS las FROM r")
def strict_scores(spark, d):
    return metrics.strict_scores(V.gold_words(spark, d), V.pred_words(spark, d))


@query(f"""WITH {_STRICT}, n AS (SELECT sent_key, count(*) AS n FROM gold GROUP BY 1), m AS (SELECT sent_key, count(*) AS m FROM pred GROUP BY 1), s AS (SELECT n.sent_key, coalesce(n = m, false) AS same FROM n LEFT JOIN m USING (sent_key)),
 a AS (SELECT count(*) AS words, count_if(u) AS u, count_if(l) AS l FROM r JOIN s USING (sent_key) WHERE same) SELECT words, (SELECT count_if(NOT same) FROM s) AS skipped, u::DOUBLE / words AS uas, l::DOUBLE / words AS las FROM a""")
def strict_equal_length(spark, d):
    return metrics.strict_equal_length(V.gold_words(spark, d), V.pred_words(spark, d))


@query(f"WITH {_STRICT} SELECT count(*) AS words, count_if(u)::DOUBLE / count(*) AS uas, count_if(l)::DOUBLE / count(*) AS las FROM r WHERE in_pred")
def strict_common_ids(spark, d):
    return metrics.strict_common_ids(V.gold_words(spark, d), V.pred_words(spark, d))


@query(f"WITH {_STRICT}, s AS (SELECT sent_key, avg(u::INT) AS u, avg(l::INT) AS l FROM r GROUP BY 1) SELECT count(*) AS sentences, round(avg(u), 9) AS uas, round(avg(l), 9) AS las FROM s")
def strict_macro(spark, d):
    return metrics.strict_macro(V.gold_words(spark, d), V.pred_words(spark, d)).select("sentences", F.round("uas", 9).alias("uas"), F.round("las", 9).alias("las"))


@query(f"WITH {_STRICT} SELECT count(*) AS words, count_if(l)::DOUBLE / count(*) AS clas FROM r WHERE coalesce(rel, '') NOT IN ('det', 'clf', 'case', 'cc', 'fixed', 'flat', 'cop', 'mark', 'punct')")
def content_las(spark, d):
    return metrics.content_las(V.gold_words(spark, d), V.pred_words(spark, d))


@query(f"WITH {V.GOLD}, {V.PRED}, j AS (SELECT g.head_id AS gh, p.head_id AS ph, g.rel AS gr, p.rel AS pr FROM gold g JOIN pred p ON p.sent_key = g.sent_key AND p.id = g.id) SELECT CASE WHEN gh IS DISTINCT FROM ph THEN 'head' WHEN gr IS DISTINCT FROM pr THEN 'rel' ELSE 'ok' END AS label, count(*) AS n FROM j GROUP BY 1")
def match_labels(spark, d):
    p = V.pred_words(spark, d).select("sent_key", "id", F.col("head_id").alias("ph"), F.col("rel").alias("pr"))
    j = V.gold_words(spark, d).join(p, ["sent_key", "id"])
    return report.group_counts(j.select(S.match_label(F.col("head_id"), F.col("ph"), F.col("rel"), F.col("pr")).alias("label")), "label")


@query(f"WITH {V.GOLD} SELECT g.sent_key, g.id, coalesce(substr(s.text, g.start_char + 1, g.end_char - g.start_char) = g.text, false) AS fits FROM gold g JOIN sentences s USING (sent_key)")
def offset_check(spark, d):
    s = read_table(spark, d, "sentences").select("sent_key", F.col("text").alias("whole"), F.explode("tokens").alias("t"))
    return s.select("sent_key", "t.id", S.offset_fits(F.col("whole"), F.col("t.text"), F.col("t.start_char"), F.col("t.end_char")).alias("fits"))


@query(f"""WITH RECURSIVE {V.GOLD}, f AS (SELECT g.sent_key, row_number() OVER (PARTITION BY g.sent_key ORDER BY g.id) AS k, g.text AS form, s.text FROM gold g JOIN sentences s USING (sent_key) WHERE s.text IS NOT NULL AND g.text IS NOT NULL),
w AS (SELECT sent_key, 0::BIGINT AS k, 0::BIGINT AS at, -1::BIGINT AS a, -1::BIGINT AS b FROM (SELECT DISTINCT sent_key FROM f) UNION ALL
 SELECT f.sent_key, f.k, CASE WHEN strpos(substr(f.text, w.at + 1), f.form) > 0 THEN w.at + strpos(substr(f.text, w.at + 1), f.form) - 1 + length(f.form) ELSE w.at END,
  CASE WHEN strpos(substr(f.text, w.at + 1), f.form) > 0 THEN w.at + strpos(substr(f.text, w.at + 1), f.form) - 1 ELSE -1 END,
  CASE WHEN strpos(substr(f.text, w.at + 1), f.form) > 0 THEN w.at + strpos(substr(f.text, w.at + 1), f.form) - 1 + length(f.form) ELSE -1 END FROM w JOIN f ON f.sent_key = w.sent_key AND f.k = w.k + 1)
SELECT sent_key, k::INT AS k, a::INT AS start_char, b::INT AS end_char FROM w WHERE k > 0""")
def reconstruct_offsets(spark, d):
    s = V.parsed(spark, d).where("text IS NOT NULL").withColumn("forms", F.filter(F.transform("tokens", lambda t: t["text"]), lambda x: x.isNotNull()))
    return s.select("sent_key", F.posexplode(align.reconstruct_offsets(F.col("text"), F.col("forms"))).alias("k", "p")).select("sent_key", (F.col("k") + 1).alias("k"), "p.*")


@query()
def projected_spans(spark, d):
    s = V.parsed(spark, d).where("text IS NOT NULL").withColumn("forms", F.transform("tokens", lambda t: t["text"]))
    return s.select("sent_key", F.posexplode(udfs.project_spans("text", "forms")).alias("k", "p")).select("sent_key", "k", "p.*")


@query(r"""WITH RECURSIVE wd AS (SELECT sent_key, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS w FROM (SELECT sent_key, regexp_extract_all(text, '(\S+)', 1) AS w FROM sentences WHERE tokens IS NOT NULL AND text IS NOT NULL)),
 pc AS (SELECT sent_key, length(coalesce(t.text, '')) AS n, p - 1 AS p FROM (SELECT sent_key, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS p FROM sentences WHERE text IS NOT NULL)),
 walk AS (SELECT sent_key, -1::BIGINT AS p, 0::BIGINT AS w, 0::BIGINT AS got, -1::BIGINT AS of FROM (SELECT DISTINCT sent_key FROM wd) UNION ALL
  SELECT k.sent_key, pc.p, CASE WHEN k.got + pc.n >= length(wd.word) THEN k.w + 1 ELSE k.w END, CASE WHEN k.got + pc.n >= length(wd.word) THEN 0 ELSE k.got + pc.n END, k.w FROM walk k JOIN pc ON pc.sent_key = k.sent_key AND pc.p = k.p + 1 JOIN wd ON wd.sent_key = k.sent_key AND wd.w = k.w)
 SELECT wd.sent_key, wd.w::INT AS word, coalesce(array_to_string(list(walk.p ORDER BY walk.p) FILTER (walk.p IS NOT NULL), ' '), '') AS pieces FROM wd LEFT JOIN walk ON walk.sent_key = wd.sent_key AND walk.of = wd.w GROUP BY 1, 2""")
def merged_pieces(spark, d):
    s = V.parsed(spark, d).where("text IS NOT NULL")
    words = tokenize.tokenizer("blanks")(F.col("text"))
    return s.select("sent_key", F.posexplode(align.merge_pieces(words, F.transform("tokens", lambda t: F.coalesce(t["text"], F.lit(""))))).alias("word", "p")).select("sent_key", "word", F.array_join(F.transform("p", lambda i: i.cast("string")), " ").alias("pieces"))


# --- text functions over tokens ----------------------------------------------------------------


@query("""SELECT key, value, count(*) AS n FROM (SELECT split_part(x, '=', 1) AS key, CASE WHEN contains(x, '=') THEN substr(x, strpos(x, '=') + 1) ELSE 'true' END AS value
 FROM (SELECT unnest(string_split(feats, '|')) AS x FROM treebank_tokens WHERE feats IS NOT NULL) WHERE x NOT IN ('', '_')) GROUP BY 1, 2""")
def feature_values(spark, d):
    t = read_table(spark, d, "treebank_tokens").where("feats IS NOT NULL").select(F.explode(S.feats_map(F.col("feats"))))
    return report.group_counts(t, "key", "value")


@query("SELECT DISTINCT CASE WHEN contains(x, '=') THEN substr(x, strpos(x, '=') + 1) ELSE 'true' END AS value, split_part(x, '=', 1) AS key FROM (SELECT unnest(string_split(misc, '|')) AS x FROM treebank_tokens WHERE misc IS NOT NULL) WHERE x NOT IN ('', '_')")
def misc_values(spark, d):
    return read_table(spark, d, "treebank_tokens").select(F.explode(S.misc_map(F.col("misc")))).select("key", "value").distinct()


@query(f"WITH {V.GOLD} SELECT sent_key, id, CASE WHEN lead(start_char) OVER (PARTITION BY sent_key ORDER BY id) = end_char THEN 'SpaceAfter=No' ELSE '_' END AS misc FROM gold")
def space_after(spark, d):
    z = F.arrays_zip(F.transform("tokens", lambda t: t["id"]).alias("id"), tokenize.space_after(F.col("tokens")).alias("misc"))
    return V.parsed(spark, d).select("sent_key", F.explode(z).alias("z")).select("sent_key", "z.id", "z.misc")


@query(f"WITH {V.GOLD}, v AS (SELECT sent_key, min(id) FILTER (pos IN ('VERB', 'INFN')) AS verb FROM gold GROUP BY 1) SELECT g.sent_key, g.id, CASE WHEN g.id > v.verb THEN v.verb ELSE 0 END AS head_id, CASE WHEN g.id > v.verb THEN 'dep' ELSE 'root' END AS rel FROM gold g JOIN v USING (sent_key)")
def trivial_heads(spark, d):
    return V.parsed(spark, d).select("sent_key", F.explode(tokenize.trivial_heads(F.col("tokens"))).alias("h")).select("sent_key", "h.*")


@query("SELECT sent_key, sha256(text || '_conllu') AS key FROM sentences WHERE text IS NOT NULL")
def cache_keys(spark, d):
    return read_table(spark, d, "sentences").where("text IS NOT NULL").select("sent_key", S.cache_key(F.col("text"), "conllu").alias("key"))


@query(f"WITH {V.GOLD} SELECT replace(lower(lemma), 'ё', 'е') AS lemma, count(*) AS n FROM gold GROUP BY 1")
def normal_lemmas(spark, d):
    return report.group_counts(V.gold_words(spark, d).select(S.norm_lemma(F.col("lemma")).alias("lemma")), "lemma")


_LINE = "coalesce(nullif(translate({0}, chr(9) || chr(10) || chr(13), '   '), ''), '_')"


@query(f"WITH {V.GOLD} SELECT sent_key, id, concat_ws(chr(9), id::VARCHAR, {_LINE.format('text')}, {_LINE.format('lemma')}, {_LINE.format('pos')}, '_', coalesce(head_id::VARCHAR, '_'), {_LINE.format('rel')}) AS row FROM gold")
def conllu_round_trip(spark, d):
    s = V.parsed(spark, d)
    lines = s.select("sent_key", F.explode(conllu.parse_lines(sinks.parsed_block(F.col("text"), F.col("tokens")))).alias("t"))
    blank = lambda c: F.coalesce(F.nullif(F.col(f"t.{c}"), F.lit("")), F.lit("_"))
    return lines.select("sent_key", F.col("t.word").alias("id"), F.concat_ws("\t", "t.id", "t.form", blank("lemma"), blank("upos"), blank("xpos"), blank("head"), blank("deprel")).alias("row"))


@query(f"WITH {V.GOLD}, {V.PRED} SELECT g.sent_key, g.id, g.text, p.lemma, p.pos, p.head_id, p.rel FROM gold g JOIN pred p ON p.sent_key = g.sent_key AND p.id = g.id")
def parse_merge(spark, d):
    p = V.pred_words(spark, d).select("sent_key", "id", "lemma", "pos", "head_id", "rel")
    return V.gold_words(spark, d).select("sent_key", "id", "text").join(p, ["sent_key", "id"])


@query("SELECT lang, count(*) AS documents, sum(len(regexp_extract_all(text, '([\\p{L}\\p{M}]+|\\p{N}+|[^\\s\\p{L}\\p{M}\\p{N}])', 1)))::BIGINT AS tokens FROM documents WHERE text IS NOT NULL GROUP BY lang")
def token_counts_by_lang(spark, d):
    t = read_table(spark, d, "documents").where("text IS NOT NULL").select("lang", F.size(tokenize.tokenizer("plain")(F.col("text"))).alias("n"))
    return t.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"))


_CUT = r"""cut AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?…]+[»”")]*)(\s+)([«“"(—–-]?\s*[\p{Lu}\p{N}])', '\1' || chr(1) || '\2\3', 'g'), '(\n+)', chr(1) || '\1', 'g'), chr(1)) AS p FROM documents WHERE text IS NOT NULL),
raw AS (SELECT doc_id, unnest(p) AS raw, generate_subscripts(p, 1) - 1 AS sent FROM cut),
starts AS (SELECT *, sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY sent) - length(raw) AS start FROM raw),
sents AS (SELECT doc_id, sent::INT AS sent, regexp_replace(regexp_replace(raw, '^\s+', ''), '\s+$', '') AS text, (start + length(regexp_extract(raw, '^\s*')))::INT AS start_char FROM starts WHERE NOT regexp_full_match(raw, '\s*'))"""


@query(rf"WITH {_CUT} SELECT doc_id, sent, start_char, (start_char + length(text))::INT AS end_char, len(regexp_extract_all(text, '([\p{{L}}\p{{M}}]+|\p{{N}}+|[^\s\p{{L}}\p{{M}}\p{{N}}])', 1))::INT AS n_tokens FROM sents")
def document_sentences(spark, d):
    s = tokenize.sentences_with_spans(read_table(spark, d, "documents"))
    return s.select("doc_id", "sent", "start_char", "end_char", F.size("tokens").alias("n_tokens"))


# --- audit -------------------------------------------------------------------------------------


def _audited(spark, d):
    s = V.parsed(spark, d).where("text <> ''")
    return audit.audit(s.select("dataset", F.col("sent_id"), "text", F.transform("tokens", lambda t: t["text"]).alias("gold"), tokenize.run_models(F.col("text"), ["words", "plain", "blanks", "absent"]).alias("models")))


@query()
def audit_errors(spark, d):
    return _audited(spark, d)


@query()
def audit_crosstab(spark, d):
    return audit.crosstab(_audited(spark, d), "model", "error_type")


@query()
def audit_top5(spark, d):
    return audit.top_errors(_audited(spark, d))


# --- decoding ----------------------------------------------------------------------------------


@query(f"WITH {V.GOLD} SELECT count(*) AS n, count(*) AS restored FROM gold WHERE text IS NOT NULL AND lemma IS NOT NULL")
def lemma_rule_round_trip(spark, d):
    g = V.gold_words(spark, d).where("text IS NOT NULL AND lemma IS NOT NULL").select(S.norm_lemma(F.col("text")).alias("word"), S.norm_lemma(F.col("lemma")).alias("lemma"))
    r = g.select("lemma", S.lemma_rule_apply(F.col("word"), udfs.lemma_rule_build("word", "lemma")).alias("back"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("back") == F.col("lemma")).alias("restored"))


@query(f"WITH {V.GOLD}, s AS (SELECT sent_key, id AS \"to\", head_id AS a, length(coalesce(text, '')) % 7 AS x FROM gold WHERE head_id IS NOT NULL), e AS (SELECT sent_key, \"to\", a AS \"from\", x AS score FROM s UNION ALL SELECT sent_key, \"to\", a + 1, 3 FROM s) SELECT sent_key, \"to\", \"from\", score::INT AS score FROM e QUALIFY row_number() OVER (PARTITION BY sent_key, \"to\" ORDER BY score DESC, \"from\") = 1")
def greedy_arcs(spark, d):
    s = V.gold_words(spark, d).where("head_id IS NOT NULL").select("sent_key", F.col("id").alias("to"), F.col("head_id").alias("a"), (F.length(F.coalesce("text", F.lit(""))) % 7).alias("x"))
    e = s.select("sent_key", "to", F.col("a").alias("from"), F.col("x").alias("score")).unionByName(s.select("sent_key", "to", (F.col("a") + 1).alias("from"), F.lit(3).alias("score")))
    return decode.greedy_heads(e)


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    w = windowed_counts(read_table(spark, d, "events"))
    return w.withColumn("total", F.round("total", 4))


# --- shaping -----------------------------------------------------------------------------------


@query(f"WITH {V.GOLD}, n AS (SELECT sent_key, id, head_id, text, rel, row_number() OVER (PARTITION BY sent_key ORDER BY id) AS k FROM gold WHERE id % 2 = 1) SELECT a.sent_key, a.k::INT AS id, a.text, coalesce(b.k, 0)::INT AS head_id, a.rel FROM n a LEFT JOIN n b ON b.sent_key = a.sent_key AND b.id = a.head_id")
def renumbered(spark, d):
    odd = F.filter("tokens", lambda t: t["id"] % 2 == 1)
    return V.parsed(spark, d).select("sent_key", F.explode(adapters.renumber(odd)).alias("t")).select("sent_key", "t.*")


@query(f"WITH {V.GOLD} SELECT a.sent_key, a.id, count(b.id) FILTER (b.id < a.id)::INT AS n_lefts, count(b.id) FILTER (b.id > a.id)::INT AS n_rights FROM gold a LEFT JOIN gold b ON b.sent_key = a.sent_key AND b.head_id = a.id GROUP BY a.sent_key, a.id")
def dependents(spark, d):
    return V.parsed(spark, d).select("sent_key", F.explode(adapters.dependents(F.col("tokens"))).alias("t")).select("sent_key", "t.*")


@query(f"WITH {V.GOLD} SELECT g.sent_key, g.id, g.start_char + s.start_char AS start_char, g.end_char + s.start_char AS end_char FROM gold g JOIN sentences s USING (sent_key)")
def global_offsets(spark, d):
    s = read_table(spark, d, "sentences").select("sent_key", F.explode(adapters.shift_spans(F.transform("tokens", lambda t: F.struct(t["id"].alias("id"), t["start_char"].alias("start_char"), t["end_char"].alias("end_char"))), F.col("start_char"))).alias("t"))
    return s.select("sent_key", "t.*")


@query(r"SELECT DISTINCT text, regexp_full_match(text, '\p{L}+') AS is_alpha, regexp_full_match(text, '\p{Nd}+') AS is_digit, regexp_full_match(text, '\p{P}+') AS is_punct, regexp_full_match(text, '(?:https?://|www\.)\S+') AS like_url, lower(text) AS lower FROM treebank_tokens WHERE text IS NOT NULL")
def form_flags(spark, d):
    t = read_table(spark, d, "treebank_tokens").where("text IS NOT NULL").select("text").distinct()
    return t.select("text", adapters.token_flags(F.col("text")).alias("f")).select("text", *(f"f.{c}" for c in ("is_alpha", "is_digit", "is_punct", "like_url", "lower")))


@query(f"WITH {V.GOLD}, {V.PRED} SELECT g.sent_key, g.id FROM gold g JOIN pred p ON p.sent_key = g.sent_key AND p.id = g.id WHERE g.lemma IS DISTINCT FROM p.lemma")
def lemma_disagreements(spark, d):
    p = V.pred_words(spark, d).select("sent_key", "id", F.col("lemma").alias("other"))
    return adapters.disagreements(V.gold_words(spark, d).select("sent_key", "id", "lemma").join(p, ["sent_key", "id"]), "lemma", "other").select("sent_key", "id")


@query(f"WITH {V.GOLD} SELECT g.sent_key, g.id, w.lang FROM gold g LEFT JOIN word_forms w ON w.form = g.text")
def dictionary_enrichment(spark, d):
    return adapters.enrich(V.gold_words(spark, d).select("sent_key", "id", "text"), read_table(spark, d, "word_forms").select(F.col("form").alias("text"), "lang")).select("sent_key", "id", "lang")


@query("SELECT source_file, count(*) AS sentences, sum(coalesce(len(tokens), 0))::BIGINT AS tokens FROM sentences GROUP BY source_file")
def file_totals(spark, d):
    return adapters.totals(read_table(spark, d, "sentences"), "source_file")


@query("SELECT s.sent_key, f.corpus, f.split, coalesce(nullif(s.genre, ''), f.default_genre, 'unknown') AS genre FROM sentences s LEFT JOIN source_files f USING (source_file)")
def source_metadata(spark, d):
    s = read_table(spark, d, "sentences").select("sent_key", "source_file", "genre").join(read_table(spark, d, "source_files"), "source_file", "left")
    return s.select("sent_key", "corpus", "split", S.falsy(F.col("genre"), F.coalesce("default_genre", F.lit("unknown"))).alias("genre"))


@query(rf"""WITH {_CUT}, pieces AS (SELECT doc_id, sent, start_char, regexp_extract_all(text, '(?s)(\s+|[\p{{L}}\p{{M}}]+|\p{{N}}+|.)', 1) AS p FROM sents),
 each AS (SELECT doc_id, sent, start_char, unnest(p) AS text, generate_subscripts(p, 1) AS k FROM pieces), placed AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id, sent ORDER BY k) AS stop FROM each)
 SELECT doc_id, sent, (row_number() OVER (PARTITION BY doc_id, sent ORDER BY k))::INT AS id, text, 0 AS head_id, 'root' AS rel, (start_char + stop - length(text))::INT AS start_char, (start_char + stop)::INT AS end_char FROM placed WHERE NOT regexp_full_match(text, '\s+')""")
def processed_documents(spark, d):
    p = pipelines.process(read_table(spark, d, "documents"))
    return p.select("doc_id", "sent", F.explode("tokens").alias("t")).select("doc_id", "sent", "t.*")


@query(f"""WITH {V.GOLD}, {V.PRED}, m AS (SELECT 'parser' AS model, sent_key, id, head_id, rel FROM pred UNION ALL SELECT 'chain', sent_key, id, id - 1, rel FROM gold),
 n AS (SELECT unnest(['chain', 'parser']) AS model), r AS (SELECT n.model, g.sent_key, coalesce(g.head_id = m.head_id, false) AS u, coalesce(g.head_id = m.head_id AND g.rel = m.rel, false) AS l FROM gold g CROSS JOIN n LEFT JOIN m ON m.model = n.model AND m.sent_key = g.sent_key AND m.id = g.id),
 s AS (SELECT model, sent_key, count(*) AS n, count_if(u) AS u, count_if(l) AS l FROM r GROUP BY 1, 2) SELECT model, sum(n)::BIGINT AS words, sum(u)::DOUBLE / sum(n) AS uas, sum(l)::DOUBLE / sum(n) AS las, round(avg(u::DOUBLE / n), 9) AS macro_uas, round(avg(l::DOUBLE / n), 9) AS macro_las FROM s GROUP BY model""")
def model_benchmark(spark, d):
    gold = V.gold_words(spark, d)
    chain = gold.select(F.lit("chain").alias("model"), "sent_key", "id", (F.col("id") - 1).alias("head_id"), "rel")
    parser = V.pred_words(spark, d).select(F.lit("parser").alias("model"), "sent_key", "id", "head_id", "rel")
    b = pipelines.benchmark(gold, chain.unionByName(parser))
    return b.select("model", "words", "uas", "las", F.round("macro_uas", 9).alias("macro_uas"), F.round("macro_las", 9).alias("macro_las"))


# --- values of every token ---------------------------------------------------------------------


@query("SELECT tok_key, coalesce(TRY_CAST(regexp_extract(h, '[^_]*$') AS INT), 0) AS head, CASE WHEN regexp_full_match(h, '[0-9]+') THEN TRY_CAST(h AS INT) ELSE 0 END AS digits FROM (SELECT tok_key, CASE tok_key % 5 WHEN 0 THEN head_id::VARCHAR WHEN 1 THEN '3_' || head_id::VARCHAR WHEN 2 THEN '_' WHEN 3 THEN NULL ELSE rel END AS h FROM treebank_tokens)")
def head_ids(spark, d):
    kind, head = F.col("tok_key") % 5, F.col("head_id").cast("string")
    h = F.when(kind == 0, head).when(kind == 1, F.concat(F.lit("3_"), head)).when(kind == 2, "_").when(kind == 4, F.col("rel"))
    t = read_table(spark, d, "treebank_tokens").select("tok_key", h.alias("h"))
    return t.select("tok_key", S.head_int(F.col("h")).alias("head"), F.coalesce(S.head_digits(F.col("h")), F.lit(0)).alias("digits"))


@query("SELECT tok_key, CASE WHEN tok_key % 7 = 0 THEN lower(text) ELSE substr(text, (length(text) % 3 + 1)::INT, greatest(length(text) - length(text) % 3 - tok_key % 3, 0)::INT) || regexp_extract(coalesce(pos, ''), '^[^|]*') END AS lemma FROM treebank_tokens")
def lemma_rules(spark, d):
    rule = F.when(F.col("tok_key") % 7 == 0, "none").otherwise(F.concat(F.lit("cut_prefix="), (F.length("text") % 3).cast("string"), F.lit("|cut_suffix="), (F.col("tok_key") % 3).cast("string"), F.lit("|append_suffix="), F.coalesce("pos", F.lit(""))))
    return read_table(spark, d, "treebank_tokens").select("tok_key", S.lemma_rule_apply(F.col("text"), rule).alias("lemma"))


_TAGS = [*S.POS_MAP, "ZZ"]


@query(f"SELECT tok_key, CASE WHEN contains('{S.PUNCTUATION}', text) THEN 'PUNCT' ELSE [{', '.join(repr(v) for v in S.POS_MAP.values())}, 'X'][(tok_key % {len(_TAGS)} + 1)::INT] END AS pos FROM treebank_tokens WHERE text IS NOT NULL")
def universal_tags(spark, d):
    grammar = F.concat(F.get(F.array(*map(F.lit, _TAGS)), (F.col("tok_key") % len(_TAGS)).cast("int")), F.get(F.array(F.lit(",муж"), F.lit("=пр"), F.lit("")), (F.col("tok_key") % 3).cast("int")))
    return read_table(spark, d, "treebank_tokens").where("text IS NOT NULL").select("tok_key", S.universal_pos(grammar, F.col("text")).alias("pos"))


_NULLED = """n AS (SELECT sent_key, k, t.id % 4 = 0 AS gap, coalesce(t.text, '') AS text FROM (SELECT sent_key, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS k FROM sentences)),
m AS (SELECT *, count(*) FILTER (NOT gap) OVER (PARTITION BY sent_key ORDER BY k) AS w FROM n)"""


def _nulled(spark, d):
    words = F.transform("tokens", lambda t: F.when(t["id"] % 4 == 0, decode.NULL_WORD).otherwise(F.coalesce(t["text"], F.lit(""))))
    return V.parsed(spark, d).where("size(tokens) > 0").select("sent_key", words.alias("words"))


@query(f"WITH {_NULLED} SELECT sent_key, (k - 1)::INT AS k, CASE WHEN gap THEN w || '.' || count(*) FILTER (gap) OVER (PARTITION BY sent_key, w ORDER BY k) ELSE w::VARCHAR END AS id FROM m")
def word_ids(spark, d):
    return _nulled(spark, d).select("sent_key", F.posexplode(decode.enumerate_words(F.col("words"))).alias("k", "id"))


@query(f"WITH {_NULLED} SELECT sent_key, k::INT AS place, w::INT AS id FROM m WHERE NOT gap UNION ALL SELECT DISTINCT sent_key, 0, 0 FROM n")
def id_mappings(spark, d):
    return _nulled(spark, d).select("sent_key", F.explode(decode.id_mapping(decode.prepend_start(F.col("words")))).alias("place", "id"))


@query(f"""WITH {_NULLED}, b AS (SELECT sent_key, w AS i, text FROM m WHERE NOT gap UNION ALL SELECT DISTINCT sent_key, 0, '[CLS]' FROM n), e AS (SELECT sent_key, i, r, CASE WHEN r = 0 THEN text ELSE '#NULL' END AS word FROM (SELECT *, unnest(range(i % 3 + 1)) AS r FROM b))
 SELECT sent_key, (row_number() OVER (PARTITION BY sent_key ORDER BY i, r) - 1)::INT AS k, word FROM e""")
def added_nulls(spark, d):
    base = decode.prepend_start(decode.remove_nulls(F.col("words")))
    return _nulled(spark, d).select("sent_key", S.let(base, lambda b: decode.add_nulls(b, F.transform(b, lambda _, i: i % 3))).alias("w")).select("sent_key", F.posexplode("w").alias("k", "word"))


@query(f"WITH {_NULLED}, c AS (SELECT sent_key, count(*) AS n, count_if(NOT gap) AS w, sum(CASE WHEN gap THEN -1 ELSE length(text) END) AS s FROM n GROUP BY 1) SELECT sent_key, least(n, 50)::INT AS padded, w::INT AS words, (w * w)::INT AS pairs, s::DOUBLE AS total FROM c")
def mask_counts(spark, d):
    true = lambda c: F.size(F.filter(c, lambda x: x))
    w, mask = F.col("words"), decode.null_mask(F.col("words"))
    lengths = F.transform(w, lambda x: F.length(x).cast("double"))
    return _nulled(spark, d).select("sent_key", true(decode.padding_mask(w, F.lit(50))).alias("padded"), true(mask).alias("words"), S.let(mask, lambda m: F.aggregate(decode.pairwise_mask(m), F.lit(0), lambda a, r: a + true(r))).alias("pairs"), F.aggregate(decode.replace_masked(lengths, mask, -1.0), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("SELECT tok_key, head_id::VARCHAR AS head, rel FROM treebank_tokens WHERE head_id IS NOT NULL AND rel IS NOT NULL")
def dependencies(spark, d):
    t = read_table(spark, d, "treebank_tokens").where("head_id IS NOT NULL AND rel IS NOT NULL")
    return t.select("tok_key", decode.dependency(F.concat_ws(":", F.col("head_id").cast("string"), "rel")).alias("x")).select("tok_key", "x.*")


_RELS = ["nsubj", "obj", "root", "punct", "case"]


@query(f"WITH {V.GOLD} SELECT sent_key, id AS i, CASE WHEN id % 5 = 0 OR head_id IS NULL THEN 0 ELSE head_id END::INT AS head_id, CASE WHEN id % 5 = 0 OR head_id IS NULL OR rel IS NULL OR rel NOT IN ({', '.join(map(repr, _RELS))}) THEN 'root' ELSE rel END AS deprel FROM gold")
def arc_tokens(spark, d):
    g = V.gold_words(spark, d)
    arcs = g.where("id % 5 <> 0 AND head_id IS NOT NULL").select("sent_key", F.col("id").alias("to"), F.when(F.col("head_id") == 0, F.col("id")).otherwise(F.col("head_id")).alias("from"), (F.array_position(F.array(*map(F.lit, _RELS)), F.col("rel")) - 1).cast("int").alias("rel"))
    arcs = arcs.withColumn("rel", F.when(F.col("rel") >= 0, F.col("rel")))
    return decode.arcs_to_tokens(g.select("sent_key", F.col("id").alias("i")), arcs, _RELS)


@query(f"WITH {V.GOLD} SELECT sent_key, id AS \"to\", head_id AS \"from\", (length(coalesce(text, '')) % 7 - 3)::INT AS score, rel FROM gold WHERE head_id IS NOT NULL AND length(coalesce(text, '')) % 7 > 3")
def labelled_arcs(spark, d):
    g = V.gold_words(spark, d).where("head_id IS NOT NULL").select("sent_key", F.col("id").alias("to"), F.col("head_id").alias("from"), (F.length(F.coalesce("text", F.lit(""))) % 7 - 3).alias("score"), "rel")
    return decode.label_arcs(decode.multi_arcs(g.drop("rel")), g.select("sent_key", "to", "from", "rel"))


@query(f"""WITH RECURSIVE {V.GOLD}, {V.TREE}, ok AS (SELECT sent_key FROM gold GROUP BY 1 HAVING count_if(head_id = 0) = 1 AND count(head_id) = count(*) AND max(id) = count(*) AND min(id) = 1 AND count(DISTINCT id) = count(*) AND max(head_id) <= count(*))
 SELECT g.sent_key, g.id, g.head_id FROM gold g JOIN ok USING (sent_key) JOIN depths d USING (sent_key) WHERE d.v3 > 0""")
def decoded_trees(spark, d):
    """Scores that favour the stored heads give back the stored trees."""
    ids, heads = F.transform("tokens", lambda t: t["id"]), F.transform("tokens", lambda t: t["head_id"])
    n = F.size("tokens")
    whole = (F.size(F.filter(heads, lambda h: h == 0)) == 1) & (F.size(F.filter(heads, lambda h: h.isNull() | (h > n))) == 0) & (ids == F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
    s = V.parsed(spark, d).withColumn("tokens", F.array_sort(F.transform("tokens", lambda t: F.struct(t["id"].alias("id"), t["head_id"].alias("head_id"))))).where((n > 0) & F.coalesce(whole, F.lit(False))).where(profile.depth_v3(F.col("tokens")) > 0)
    matrix = F.transform("tokens", lambda h: F.transform("tokens", lambda t: F.when((t["head_id"] == h["id"]) | (t["head_id"] == 0) & (t["id"] == h["id"]), 5.0).otherwise(0.0)))
    found = s.select("sent_key", matrix.alias("scores")).mapInArrow(udfs.tree_rows, "sent_key bigint, heads array<int>").select("sent_key", F.posexplode("heads").alias("i", "h"))
    return found.select("sent_key", (F.col("i") + 1).alias("id"), F.when(F.col("h") == F.col("i"), 0).otherwise(F.col("h") + 1).alias("head_id"))


@query("SELECT vec_id % 50 AS sent_key, label AS word, k, round(avg(x::DOUBLE), 5) + 0.0 AS x FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings) GROUP BY 1, 2, 3")
def mean_vectors(spark, d):
    e = read_table(spark, d, "embeddings").select((F.col("vec_id") % 50).alias("sent_key"), F.col("label").alias("word"), F.col("embedding").cast("array<double>").alias("vector"))
    return decode.mean_pool(e).select("sent_key", "word", F.posexplode("vector").alias("k", "x")).withColumn("x", F.round("x", 5) + 0.0).withColumn("k", F.col("k").cast("bigint"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding[1:5])::DOUBLE AS x FROM embeddings), m AS (SELECT vec_id, max(x) AS m FROM e GROUP BY 1)
 SELECT vec_id, round(max(exp(x - m)) / sum(exp(x - m)), 6) AS upos_proba, round(1.0 / (vec_id % 4 + 1), 6)::DOUBLE AS head_proba, 0.95::DOUBLE AS root_proba FROM e JOIN m USING (vec_id) GROUP BY vec_id""")
def tag_probabilities(spark, d):
    none = F.lit(None)
    e = read_table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 4).cast("int").alias("n"), F.slice("embedding", 1, 5).cast("array<double>").alias("upos_energies"), none.cast("array<double>").alias("head_energies"), none.cast("array<double>").alias("deprel_energies"), none.cast("array<string>").alias("labels"))
    p = decode.probabilities(e)
    return p.select("vec_id", F.round("upos_proba", 6).alias("upos_proba"), F.round(F.get("heads_proba", F.lit(0)), 6).alias("head_proba"), F.col("deps_proba")["root"].alias("root_proba"))


@query("SELECT vec_id, k::INT AS index, x::DOUBLE AS value FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, k) <= 5")
def top_values(spark, d):
    e = read_table(spark, d, "embeddings").select("vec_id", F.explode(decode.top_entries(F.col("embedding"))).alias("x"))
    return e.select("vec_id", "x.index", F.col("x.value").cast("double").alias("value"))


@query("SELECT avg(u) AS upos_avg, min(u) AS upos_min, max(u) AS upos_max, avg(h) AS head_avg, min(h) AS head_min, max(h) AS head_max FROM (SELECT (tok_key % 100) / 128.0::DOUBLE AS u, CASE WHEN head_id BETWEEN 0 AND 2 THEN [0.5, 0.25, 0.125][head_id + 1]::DOUBLE END AS h FROM treebank_tokens)")
def parse_confidence(spark, d):
    t = read_table(spark, d, "treebank_tokens").select(((F.col("tok_key") % 100) / 128.0).alias("upos_proba"), F.col("head_id").alias("head"), F.array(F.lit(0.5), F.lit(0.25), F.lit(0.125)).alias("heads_proba"), F.lit("x").alias("deprel"), F.create_map(F.lit("root"), F.lit(0.9)).alias("deps_proba"))
    t = t.withColumn("head", F.when(F.col("head") >= 0, F.col("head")))
    return metrics.confidence(t).select(*(f"{k}_{n}" for k in ("upos", "head") for n in ("avg", "min", "max")))


# --- shaping of what parsers give --------------------------------------------------------------


@query(f"WITH {V.GOLD} SELECT sent_key, id, coalesce(lead(start_char) OVER (PARTITION BY sent_key ORDER BY id) > end_char, false) AS gap FROM gold")
def space_flags(spark, d):
    z = F.arrays_zip(F.transform("tokens", lambda t: t["id"]).alias("id"), tokenize.space_flags(F.col("tokens")).alias("gap"))
    return V.parsed(spark, d).select("sent_key", F.explode(z).alias("z")).select("sent_key", "z.id", "z.gap")


@query(f"""WITH {V.GOLD}, n AS (SELECT g.sent_key, g.id, g.end_char AS e, lead(g.start_char) OVER (PARTITION BY g.sent_key ORDER BY g.id) AS a, s.text FROM gold g JOIN sentences s USING (sent_key) WHERE s.text IS NOT NULL)
 SELECT sent_key, id, CASE WHEN a = e THEN 'SpaceAfter=No' WHEN a > e + 1 THEN 'SpacesAfter=''' || replace(replace(replace(substr(text, e + 1, a - e), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '''' ELSE '_' END AS misc FROM n""")
def spaces_after(spark, d):
    z = F.arrays_zip(F.transform("tokens", lambda t: t["id"]).alias("id"), tokenize.spaces_after(F.col("text"), F.col("tokens")).alias("misc"))
    return V.parsed(spark, d).where("text IS NOT NULL").select("sent_key", F.explode(z).alias("z")).select("sent_key", "z.id", "z.misc")


@query(f"WITH {V.GOLD} SELECT sent_key, k, text FROM (SELECT sent_key, (row_number() OVER (PARTITION BY sent_key ORDER BY id) - 1)::INT AS k, text FROM gold WHERE text <> '' AND NOT starts_with(text, '##'))")
def glued_pieces(spark, d):
    forms = F.filter(F.transform("tokens", lambda t: t["text"]), lambda x: (x != "") & ~x.startswith("##"))
    cut = F.flatten(F.transform(forms, lambda x: F.when(F.length(x) > 3, F.array(F.substring(x, 1, 3), F.concat(F.lit("##"), F.substring(x, F.lit(4), F.length(x))))).otherwise(F.array(x))))
    return V.parsed(spark, d).select("sent_key", F.posexplode(tokenize.glue_pieces(cut)).alias("k", "text"))


@query(f"WITH {V.GOLD} SELECT sent_key, (row_number() OVER (PARTITION BY sent_key ORDER BY id))::INT AS id, trim(text, ' ') AS text FROM gold WHERE trim(text, ' ') <> ''")
def stripped_tokens(spark, d):
    padded = F.transform("tokens", lambda t: F.concat(F.lit("  "), t["text"], F.lit(" ")))
    return V.parsed(spark, d).select("sent_key", F.explode(tokenize.drop_blank(padded)).alias("t")).select("sent_key", "t.*")


@query(f"WITH {V.GOLD} SELECT sent_key, id, CASE WHEN head_id = 0 OR head_id = id THEN 0 ELSE head_id END AS head FROM gold")
def local_heads(spark, d):
    doc = F.transform("tokens", lambda t: F.struct((t["id"] + 100).alias("i"), F.when(t["head_id"] == 0, t["id"] + 100).otherwise(t["head_id"] + 100).alias("head")))
    z = F.arrays_zip(F.transform("tokens", lambda t: t["id"]).alias("id"), adapters.local_heads(doc, F.lit(101)).alias("head"))
    return V.parsed(spark, d).select("sent_key", F.explode(z).alias("z")).select("sent_key", "z.id", "z.head")


@query(f"WITH {V.GOLD}, n AS (SELECT *, row_number() OVER (PARTITION BY sent_key ORDER BY id) AS k FROM gold), {V.SYS} SELECT n.sent_key, n.id, s.start_char, s.end_char FROM n JOIN sys s ON s.sent_key = n.sent_key AND s.id = n.k")
def spans_by_place(spark, d):
    p = V.pairs(spark, d)
    return p.select("sent_key", F.explode(adapters.spans_by_ordinal(F.col("gold"), F.col("sys"))).alias("z")).select("sent_key", "z.token.id", "z.start_char", "z.end_char")


@query(f"WITH {V.GOLD}, n AS (SELECT *, row_number() OVER (PARTITION BY sent_key ORDER BY id) AS k FROM gold), {V.SYS} SELECT s.sent_key, s.id, s.start_char, s.end_char, coalesce(nullif(n.lemma, ''), '_') AS lemma, coalesce(nullif(n.pos, ''), '_') AS pos, coalesce(n.head_id, 0) AS head_id, coalesce(nullif(n.rel, ''), '_') AS rel FROM n JOIN sys s ON s.sent_key = n.sent_key AND s.id = n.k")
def parse_by_place(spark, d):
    s = V.parsed(spark, d).where("text IS NOT NULL")
    sys = align.covering_spans(F.col("text"), "\\S+", "\\s+")
    return s.select("sent_key", F.explode(adapters.merge_by_place(sys, F.col("tokens"))).alias("t")).select("sent_key", "t.*")


@query(_SQL["merged_pieces"].split(" SELECT wd.sent_key")[0] + """, fst AS (SELECT sent_key, "of" AS w, min(p) AS p FROM walk WHERE p >= 0 GROUP BY 1, 2), tk AS (SELECT sent_key, p - 1 AS p, t.lemma AS lemma, t.pos AS pos, t.head_id AS head_id, t.rel AS rel FROM (SELECT sent_key, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS p FROM sentences)),
 r AS (SELECT f.sent_key, f.w + 1 AS id, wd.word AS text, tk.lemma, tk.pos, CASE WHEN tk.head_id = 0 THEN 0 ELSE coalesce(h."of" + 1, 0) END AS head, tk.rel FROM fst f JOIN wd ON wd.sent_key = f.sent_key AND wd.w = f.w JOIN tk ON tk.sent_key = f.sent_key AND tk.p = f.p LEFT JOIN walk h ON h.sent_key = f.sent_key AND h.p >= 0 AND h.p = tk.head_id - 1)
 SELECT sent_key, id::INT AS id, text, lemma, pos, head::INT AS head_id, CASE WHEN head = id THEN 'flat:merged' ELSE rel END AS rel FROM r""")
def merged_parses(spark, d):
    s = V.parsed(spark, d).where("text IS NOT NULL")
    merged = align.merge_parsed(tokenize.tokenizer("blanks")(F.col("text")), F.col("tokens"))
    return s.select("sent_key", F.explode(merged).alias("t")).select("sent_key", *(f"t.{c}" for c in ("id", "text", "lemma", "pos", "head_id", "rel")))


@query(f"WITH {V.GOLD} SELECT a.sent_key, a.id, array_to_string(list(b.id ORDER BY b.id), ' ') AS children FROM gold a JOIN gold b ON b.sent_key = a.sent_key AND b.head_id = a.id GROUP BY 1, 2")
def child_lists(spark, d):
    c = V.parsed(spark, d).select("sent_key", F.explode(adapters.children(F.col("tokens"))).alias("t")).where("size(t.children) > 0")
    return c.select("sent_key", "t.id", F.array_join(F.transform("t.children", lambda i: i.cast("string")), " ").alias("children"))


@query(f"""WITH {V.GOLD}, r AS (SELECT sent_key, split_part(id, '-', 1)::INT AS a, split_part(id, '-', 2)::INT AS b, text AS ner, misc FROM treebank_tokens WHERE regexp_full_match(id, '[0-9]+-[0-9]+'))
 SELECT g.sent_key, g.id, r.ner, CASE WHEN g.id = r.b THEN r.misc END AS misc FROM gold g LEFT JOIN r ON r.sent_key = g.sent_key AND g.id BETWEEN r.a AND r.b""")
def propagated(spark, d):
    t = read_table(spark, d, "treebank_tokens").where(F.col("id").rlike("^[0-9]+-[0-9]+$")).select("sent_key", F.split("id", "-")[0].cast("int").alias("first"), F.split("id", "-")[1].cast("int").alias("last"), F.col("text").alias("ner"), "misc").where("first <= last")
    return adapters.propagate(V.gold_words(spark, d).select("sent_key", "id"), t)


@query("SELECT count_if(tok_key % 4 = 0) AS per, count_if(tok_key % 4 = 1) AS loc, count_if(tok_key % 4 = 2) AS org FROM treebank_tokens")
def entity_counts(spark, d):
    k = F.col("tok_key") % 4
    return adapters.entity_counts(read_table(spark, d, "treebank_tokens").select(F.when(k == 0, "B-PER").when(k == 1, "I-LOC").when(k == 2, "ORG").alias("ner")))


@query("SELECT pos AS key, (tok_key % 1000)::DOUBLE / 10 AS value FROM treebank_tokens WHERE regexp_full_match(pos, '[A-Z]+') AND tok_key % 3 <> 0")
def evaluator_lines(spark, d):
    t = read_table(spark, d, "treebank_tokens").where(F.col("pos").rlike("^[A-Z]+$"))
    number = F.format_string("%.1f", (F.col("tok_key") % 1000) / F.lit(10.0))
    return adapters.evaluator_scores(t.select(F.when(F.col("tok_key") % 3 == 0, F.concat("pos", F.lit(" none"))).otherwise(F.concat("pos", F.lit(" = "), number, F.lit(" %"))).alias("value")))


@query(f"WITH {_ERRORS} SELECT CASE WHEN len(errors) = 0 THEN 'good' ELSE 'bad' END AS part, sent_key FROM e")
def valid_parts(spark, d):
    good, bad = validate.split_valid(read_table(spark, d, "sentences"))
    return good.select(F.lit("good").alias("part"), "sent_key").unionByName(bad.select(F.lit("bad").alias("part"), "sent_key"))


@query("SELECT tok_key, coalesce(nullif(pos, ''), '_') AS upos, coalesce(nullif(rel, ''), '_') AS xpos, coalesce(nullif(feats, ''), '_') AS feats FROM treebank_tokens")
def tag_parts(spark, d):
    tag = F.concat(F.coalesce("pos", F.lit("")), F.lit("#"), F.coalesce("rel", F.lit("")), F.lit("#"), F.coalesce("feats", F.lit("")))
    return read_table(spark, d, "treebank_tokens").select("tok_key", *(S.tag_part(tag, i).alias(n) for i, n in enumerate(("upos", "xpos", "feats"))))


@query("SELECT source_file, replace(replace(replace(source_file || '_full_clean', '_full', ''), '_adapted', ''), '_clean', '') AS stem FROM source_files")
def clean_stems(spark, d):
    return read_table(spark, d, "source_files").select("source_file", S.clean_stem(F.concat("source_file", F.lit("_full_clean"))).alias("stem"))


@query("SELECT source_file AS model, avg(len(tokens) / 64.0)::DOUBLE AS uas, avg(block_id % 8)::DOUBLE AS las, count(*)::DOUBLE / sum(len(text) + 1) AS sentences_per_second FROM sentences WHERE tokens IS NOT NULL AND text IS NOT NULL GROUP BY 1")
def model_throughput(spark, d):
    s = V.parsed(spark, d).where("text IS NOT NULL").select(F.col("source_file").alias("model"), (F.size("tokens") / 64.0).alias("uas"), (F.col("block_id") % 8).alias("las"), (F.length("text") + 1).alias("seconds"))
    return adapters.throughput(s)


@query("SELECT sent_key, coalesce(nullif(text, ''), (SELECT coalesce(string_agg(x.text, ' '), '') FROM (SELECT unnest(tokens) AS x))) AS text FROM sentences")
def texts_or_forms(spark, d):
    return read_table(spark, d, "sentences").select("sent_key", adapters.text_or_forms(F.col("text"), F.coalesce(F.transform("tokens", lambda t: t["text"]), F.array().cast("array<string>"))).alias("text"))


@query(r"""WITH c AS (SELECT sent_key, unnest(string_split_regex(text, '[.!?]+')) AS p FROM sentences WHERE text IS NOT NULL), t AS (SELECT sent_key, regexp_replace(p, '^\s+|\s+$', '', 'g') AS p FROM c) SELECT sent_key, count(*) AS sentences, sum(len(string_split_regex(p, '\s+')))::BIGINT AS words FROM t WHERE p <> '' GROUP BY 1""")
def simple_sentence_counts(spark, d):
    s = read_table(spark, d, "sentences").where("text IS NOT NULL").select("sent_key", F.explode(tokenize.simple_sentences(F.col("text"))).alias("w"))
    return s.groupBy("sent_key").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.size("w")).alias("words"))


@query("SELECT sent_key, count_if(NOT regexp_full_match(id, '[0-9]+')) AS ellipses FROM treebank_tokens GROUP BY 1")
def ellipsis_counts(spark, d):
    return read_table(spark, d, "treebank_tokens").groupBy("sent_key").agg(F.count_if(S.id_kind(F.col("id")) != "word").alias("ellipses"))


@query(f"WITH {V.GOLD}, n AS (SELECT pos, rel, text, count(*) AS n FROM gold WHERE pos IS NOT NULL AND rel IS NOT NULL AND text IS NOT NULL GROUP BY ALL) SELECT pos AS model, rel AS gold, text AS pred, n, (row_number() OVER (PARTITION BY pos ORDER BY n DESC, rel COLLATE BINARY, text COLLATE BINARY))::INT AS rank FROM n QUALIFY rank <= 5".replace(" COLLATE BINARY", ""))
def top_pairs(spark, d):
    g = V.gold_words(spark, d).where("pos IS NOT NULL AND rel IS NOT NULL AND text IS NOT NULL")
    return audit.top_errors(g.select(F.col("pos").alias("model"), F.col("rel").alias("gold"), F.col("text").alias("pred")))


@query("WITH g AS (SELECT coalesce(genre, 'none') AS genre, coalesce(source_file, 'none') AS file FROM sentences) SELECT a.genre, b.file, (SELECT count(*) FROM g WHERE g.genre = a.genre AND g.file = b.file) AS n FROM (SELECT DISTINCT genre FROM g) a, (SELECT DISTINCT file FROM g) b")
def genre_file_table(spark, d):
    s = read_table(spark, d, "sentences").select(F.coalesce("genre", F.lit("none")).alias("genre"), F.coalesce("source_file", F.lit("none")).alias("file"))
    return audit.crosstab(s, "genre", "file")


@query(r"""WITH s AS (SELECT sent_key, tokens, text FROM sentences WHERE tokens IS NOT NULL AND text <> '') SELECT sent_key, model, len(tokens) - len(CASE model WHEN 'words' THEN regexp_extract_all(text, '([\p{L}\p{M}]+(?:-[\p{L}\p{M}]+)*|\p{N}+|[^\s\p{Z}\p{L}\p{M}\p{N}])', 1) WHEN 'plain' THEN regexp_extract_all(text, '([\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}])', 1) ELSE regexp_extract_all(text, '(\S+)', 1) END) AS surplus FROM s, (SELECT unnest(['words', 'plain', 'blanks']) AS model)""")
def audit_balance(spark, d):
    """What the differing blocks of an audit add up to: tokens of the treebank less those of the model."""
    s = V.parsed(spark, d).where("text <> ''").select("sent_key", F.transform("tokens", lambda t: t["text"]).alias("gold"), F.explode(tokenize.run_models(F.col("text"), ["words", "plain", "blanks"])).alias("model", "pred"))
    ops = s.select("sent_key", "model", udfs.diff_opcodes("gold", "pred").alias("ops"))
    return ops.select("sent_key", "model", F.aggregate("ops", F.lit(0).cast("bigint"), lambda a, o: a + (o["i2"] - o["i1"]) - (o["j2"] - o["j1"])).alias("surplus"))


# --- files -------------------------------------------------------------------------------------


def _written(spark, d, wide: bool = False) -> str:
    """A folder of treebank files with all lines of all sentences, a comment naming each sentence."""
    t = read_table(spark, d, "treebank_tokens")
    cells = [F.col("id"), F.col("text"), F.col("lemma"), F.col("pos"), F.lit(None), F.col("feats"), F.col("head_id"), F.col("rel"), F.lit(None), F.col("misc")]
    row = sinks.line(*cells, *([F.col("source_file"), F.col("pos")] if wide else []))
    lines = t.groupBy("sent_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("tok_key", row.alias("row")))), lambda x: x["row"]).alias("rows"))
    s = read_table(spark, d, "sentences").select("sent_key", "text", "sent_id").join(lines, "sent_key")
    head = F.array(F.concat(F.lit("# sent_key = "), F.col("sent_key").cast("string")), F.concat(F.lit("# sent_id = "), F.coalesce("sent_id", F.lit(""))), F.concat(F.lit("# text = "), sinks.cell(F.coalesce("text", F.lit("")))))
    path = f"{checkpoint_dir(spark)}/treebank-{uuid.uuid4().hex}"
    sinks.write_conllu(s.select(F.array_join(F.concat(head, "rows"), "\n").alias("block")), path)
    return path


_CELL = "coalesce(nullif(nullif(translate({0}, chr(9) || chr(10) || chr(13), '   '), ''), '_'), NULL)"
_FORM = "coalesce(nullif(translate(text, chr(9) || chr(10) || chr(13), '   '), ''), '_')"


def _file_key():
    return F.col("meta")["sent_key"].cast("bigint").alias("sent_key")


@query(f"SELECT sent_key, t.id, {_FORM} AS form, {_CELL.format('lemma')} AS lemma, {_CELL.format('pos')} AS upos, {_CELL.format('feats')} AS feats, head_id::VARCHAR AS head, {_CELL.format('rel')} AS deprel, {_CELL.format('t.misc')} AS misc FROM treebank_tokens t SEMI JOIN sentences s USING (sent_key)".replace("SELECT sent_key, t.id", "SELECT t.sent_key, t.id"))
def file_lines(spark, d):
    r = conllu.read_conllu(spark, _written(spark, d)).select(_file_key(), F.explode("tokens").alias("t"))
    return r.select("sent_key", *(f"t.{c}" for c in ("id", "form", "lemma", "upos", "feats", "head", "deprel", "misc")))


@query("SELECT sent_key, nullif(sent_id, '') AS sent_id, nullif(regexp_replace(translate(text, chr(9) || chr(10) || chr(13), '   '), '^\\s+|\\s+$', '', 'g'), '') AS text FROM sentences WHERE sent_key IN (SELECT sent_key FROM treebank_tokens)")
def file_metadata(spark, d):
    return conllu.read_conllu(spark, _written(spark, d)).select(_file_key(), "sent_id", "text")


_WORDS = f"SELECT t.sent_key, t.id::INT AS id, {_FORM} AS form, head_id, {_CELL.format('rel')} AS rel FROM treebank_tokens t SEMI JOIN sentences s USING (sent_key) WHERE regexp_full_match(id, '[0-9]+') AND head_id IS NOT NULL"


@query(_WORDS)
def file_simple_v1(spark, d):
    b = conllu.read_blocks(spark, _written(spark, d))
    return b.select(conllu.metadata(F.col("block")).alias("meta"), conllu.simple_v1(F.col("block")).alias("tokens")).select(_file_key(), F.explode("tokens").alias("t")).select("sent_key", "t.*")


@query(_WORDS)
def file_simple_v2(spark, d):
    b = conllu.read_blocks(spark, _written(spark, d))
    return b.select(conllu.metadata(F.col("block")).alias("meta"), conllu.simple_v2(F.col("block")).alias("tokens")).select(_file_key(), F.explode("tokens").alias("t")).select("sent_key", "t.*")


@query(f"SELECT t.sent_key, t.id::INT AS id, {_FORM} AS text, {_CELL.format('lemma')} AS lemma, {_CELL.format('pos')} AS pos, CASE WHEN head_id >= 0 THEN head_id ELSE 0 END AS head_id FROM treebank_tokens t SEMI JOIN sentences s USING (sent_key) WHERE regexp_full_match(id, '[0-9]+')")
def file_parser_output(spark, d):
    b = conllu.read_blocks(spark, _written(spark, d))
    return b.select(conllu.metadata(F.col("block")).alias("meta"), conllu.parser_output(F.col("block")).alias("tokens")).select(_file_key(), F.explode("tokens").alias("t")).select("sent_key", "t.id", "t.text", "t.lemma", "t.pos", "t.head_id")


@query(f"SELECT t.sent_key, t.id, coalesce({_CELL.format('t.misc')} || '|', '') || 'Sem=' || coalesce(nullif(translate(t.source_file, chr(9) || chr(10) || chr(13), '   '), ''), '_') || '|' || coalesce(nullif(translate(pos, chr(9) || chr(10) || chr(13), '   '), ''), '_') AS misc FROM treebank_tokens t SEMI JOIN sentences s USING (sent_key)")
def file_folded(spark, d):
    """Twelve columns come back as ten, the last two in MISC."""
    r = conllu.read_conllu(spark, _written(spark, d, True)).select(_file_key(), F.explode("tokens").alias("t"))
    return r.select("sent_key", "t.id", "t.misc")


@query("SELECT sent_key, 'new_' || coalesce(nullif(sent_id, ''), 'unknown') AS sent_id, (SELECT count_if(NOT regexp_full_match(t.id, '[0-9]+\\.[0-9]+')) FROM treebank_tokens t WHERE t.sent_key = s.sent_key)::INT AS lines FROM sentences s WHERE sent_key IN (SELECT sent_key FROM treebank_tokens)")
def file_cleaned(spark, d):
    s = conllu.read_conllu(spark, _written(spark, d)).withColumn("tokens", conllu.without_empty(F.col("tokens"))).withColumn("key", F.col("meta")["sent_key"].cast("bigint"))
    return conllu.clean_metadata(s, "new").select(F.col("key").alias("sent_key"), "sent_id", F.size("tokens").alias("lines"))


@query("SELECT sent_key, coalesce(genre, '') AS genre, coalesce(source_file, '') AS source_file, block_id FROM sentences")
def csv_round_trip(spark, d):
    path = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    sinks.write_csv(read_table(spark, d, "sentences").select("sent_key", "genre", "source_file", "block_id"), path)
    r = fetch.read_csv_folder(spark, path)
    return r.select(F.col("sent_key").cast("bigint").alias("sent_key"), F.coalesce("genre", F.lit("")).alias("genre"), F.coalesce("source_file", F.lit("")).alias("source_file"), F.col("block_id").cast("bigint").alias("block_id"))


@query("SELECT sent_key, text, genre, len(tokens)::BIGINT AS n FROM sentences")
def json_round_trip(spark, d):
    path = f"{checkpoint_dir(spark)}/json-{uuid.uuid4().hex}"
    sinks.write_json(read_table(spark, d, "sentences").select("sent_key", "text", "genre", F.when(F.col("tokens").isNotNull(), F.size("tokens").cast("bigint")).alias("n")), path)
    return spark.read.schema("sent_key bigint, text string, genre string, n bigint").json(path)


@query()
def projected_groups(spark, d):
    """Alignment types over projected spans: the forms of the parse are found in the text first."""
    s = V.parsed(spark, d).where("text IS NOT NULL")
    sys = align.covering_spans(F.col("text"), "\\S+", "\\s+")
    s = s.select(sys.alias("sys"), udfs.project_spans("text", F.transform("tokens", lambda t: t["text"])).alias("found"))
    spans = F.filter(F.transform("found", lambda p, i: F.struct((i + 1).alias("id"), p["start"].alias("start_char"), p["end"].alias("end_char"))), lambda t: t["start_char"].isNotNull())
    p = s.select("sys", spans.alias("spans")).select(F.explode(align.align_groups(F.col("sys"), F.col("spans"))).alias("g"))
    return report.group_counts(p.select("g.type"), "type")
