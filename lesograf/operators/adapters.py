"""Shaping what parsers, taggers and evaluators give: spans, ids, fields, entities, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lesograf.functions.scalars import falsy
from lesograf.operators.align import reconstruct_offsets


def text_or_forms(text: Column, forms: Column) -> Column:
    """The text, or the forms joined by blanks where it is NULL or empty."""
    return falsy(text, F.array_join(forms, " "))


def gold_with_offsets(sentences: DataFrame) -> DataFrame:
    """``sent_id, text, tokens`` with a span for every token line; sentences without text are dropped.

    ``sentences``: as read_conllu gives them. A form that isn't in the rest of the text gets (-1, -1)."""
    s = sentences.where(F.coalesce("text", F.lit("")) != "")
    spans = reconstruct_offsets(F.col("text"), F.transform("tokens", lambda t: t["form"]))
    joined = F.zip_with("tokens", spans, lambda t, p: F.struct(t["id"].alias("id"), t["form"].alias("text"), t["lemma"].alias("lemma"), t["upos"].alias("pos"), t["head_id"].alias("head_id"), t["deprel"].alias("rel"), p["start_char"].alias("start_char"), p["end_char"].alias("end_char")))
    return s.select("file", "ordinal", "sent_id", "text", joined.alias("tokens"))


def spans_by_ordinal(tokens: Column, spans: Column) -> Column:
    """Tokens with the spans of the same place; those beyond the shorter list are dropped."""
    n = F.least(F.size(tokens), F.size(spans))
    return F.transform(F.arrays_zip(F.slice(tokens, 1, n).alias("t"), F.slice(spans, 1, n).alias("s")), lambda z: F.struct(z["t"].alias("token"), z["s"]["start_char"].alias("start_char"), z["s"]["end_char"].alias("end_char")))


def renumber(tokens: Column) -> Column:
    """Ids 1..n in order; heads follow their tokens, a head that isn't there is 0."""
    ids = F.transform(tokens, lambda t: t["id"])
    return F.transform(tokens, lambda t, i: F.struct((i + 1).alias("id"), t["text"].alias("text"), F.coalesce(F.array_position(ids, t["head_id"]), F.lit(0)).cast("int").alias("head_id"), t["rel"].alias("rel")))


def local_heads(tokens: Column, start: Column) -> Column:
    """Heads counted from the sentence's first token (document indices from 0); a token that is its own
    head is the root."""
    return F.transform(tokens, lambda t: F.when(t["head"] == t["i"], 0).otherwise(t["head"] - start + 1))


def shift_spans(spans: Column, by: Column) -> Column:
    """Spans of entities or tokens moved by a number of characters (a sentence's start, or minus it)."""
    return F.transform(spans, lambda s: s.withField("start_char", s["start_char"] + by).withField("end_char", s["end_char"] + by))


def token_flags(form: Column) -> Column:
    """norm, lower, shape and flags of a form."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(form, "\\p{Lu}", "X"), "\\p{Ll}", "x"), "\\p{Nd}", "d")
    return F.struct(F.lower(form).alias("lower"), F.regexp_replace(shape, "(.)\\1{4,}", "$1$1$1$1").alias("shape"), form.rlike("^\\p{L}+\\z").alias("is_alpha"), form.rlike("^\\p{Nd}+\\z").alias("is_digit"), form.rlike("^\\p{P}+\\z").alias("is_punct"), form.rlike("^\\p{Lu}[\\p{Ll}\\p{M}]*\\z").alias("is_title"), form.rlike("^(?:\\p{Nd}+[.,]?)+\\z").alias("like_num"), form.rlike("^(?:https?://|www\\.)\\S+\\z").alias("like_url"), form.rlike("^[^@\\s]+@[^@\\s]+\\.[^@\\s]+\\z").alias("like_email"))


def dependents(tokens: Column) -> Column:
    """Numbers of dependents before and after every token."""
    return F.transform(tokens, lambda t: F.struct(t["id"].alias("id"), F.size(F.filter(tokens, lambda u: (u["head_id"] == t["id"]) & (u["id"] < t["id"]))).alias("n_lefts"), F.size(F.filter(tokens, lambda u: (u["head_id"] == t["id"]) & (u["id"] > t["id"]))).alias("n_rights")))


def entity_counts(tags: DataFrame, column: str = "ner") -> DataFrame:
    """Tags that end in PER, LOC and ORG."""
    return tags.agg(*(F.count_if(F.coalesce(F.endswith(column, F.lit(k)), F.lit(False))).alias(k.lower()) for k in ("PER", "LOC", "ORG")))


def evaluator_scores(lines: DataFrame) -> DataFrame:
    """``key, value`` of the lines ``key = value`` that an evaluator prints; others are left out."""
    v = lines.select(F.trim(F.regexp_extract("value", "^([^=]+)=", 1)).alias("key"), F.regexp_extract("value", "=\\s*([-+0-9.eE]+)\\s*%?\\s*$", 1).try_cast("double").alias("value"))
    return v.where("key <> '' AND value IS NOT NULL")


def propagate(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """Entity and misc of a token for its words: ``words`` (sent_key, id), ``tokens`` (sent_key, first,
    last, ner, misc); the misc goes to the last word only."""
    t = tokens.select("sent_key", F.explode(F.sequence("first", "last")).alias("id"), "last", "ner", "misc")
    return words.join(t, ["sent_key", "id"], "left").select("sent_key", "id", "ner", F.when(F.col("id") == F.col("last"), F.col("misc")).alias("misc"))


def enrich(tokens: DataFrame, dictionary: DataFrame, on: str = "text") -> DataFrame:
    """Tokens with what a second analyser knows of their form: ``dictionary`` has a row a form."""
    return tokens.join(dictionary, on, "left")


def disagreements(tokens: DataFrame, a: str, b: str) -> DataFrame:
    """Rows in which two analyses differ; two missing ones are equal."""
    return tokens.where(~F.col(a).eqNullSafe(F.col(b)))


def key_difference(a: Column, b: Column) -> Column:
    """Sorted keys that only one of two maps has: (only_a, only_b)."""
    ka, kb = F.map_keys(a), F.map_keys(b)
    return F.struct(F.array_sort(F.array_except(ka, kb)).alias("only_a"), F.array_sort(F.array_except(kb, ka)).alias("only_b"))


def throughput(scores: DataFrame) -> DataFrame:
    """Mean scores and sentences a second by model: ``scores`` (model, uas, las, seconds), a row a sentence."""
    return scores.groupBy("model").agg(F.avg("uas").alias("uas"), F.avg("las").alias("las"), (F.count(F.lit(1)) / F.nullif(F.sum("seconds"), F.lit(0))).alias("sentences_per_second"))


def safe_block(block: Column, error: Column, number: Column) -> Column:
    """The block, or a comment that names the sentence where its prediction failed."""
    return F.when(error.isNull(), block).otherwise(F.concat(F.lit("# ERROR on sentence "), number.cast("string"), F.lit(": "), error))


def first_ids(ids: Column) -> Column:
    """The first of a token's ids (a range has several)."""
    return F.get(ids, F.lit(0))


def totals(sentences: DataFrame, key: str) -> DataFrame:
    """Sentences and tokens of every text."""
    return sentences.groupBy(key).agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.coalesce(F.size("tokens"), F.lit(0))).alias("tokens"))


def merge_by_place(tokens: Column, parsed: Column) -> Column:
    """Tokens with the parse at the same place, up to the shorter list; a missing lemma or tag is ``_``."""
    n = F.least(F.size(tokens), F.size(parsed))
    blank = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("_"))
    return F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(parsed, F.lit(1), n), lambda t, q: F.struct(t["id"].alias("id"), t["start_char"].alias("start_char"), t["end_char"].alias("end_char"), blank(q["lemma"]).alias("lemma"), blank(q["pos"]).alias("pos"), F.coalesce(q["head_id"], F.lit(0)).alias("head_id"), blank(q["rel"]).alias("rel")))


def children(tokens: Column) -> Column:
    """Ids of the dependents of every token, in order."""
    return F.transform(tokens, lambda t: F.struct(t["id"].alias("id"), F.array_sort(F.transform(F.filter(tokens, lambda u: u["head_id"] == t["id"]), lambda u: u["id"])).alias("children")))


def first_result(*evaluations) -> dict | None:
    """What the first evaluation gives that gives anything; one that fails gives nothing (driver side)."""
    for run in evaluations:
        try:
            if out := run():
                return out
        except (OSError, ValueError, RuntimeError):
            continue
    return None
