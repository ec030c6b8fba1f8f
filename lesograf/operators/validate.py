"""Validation of sentences and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sentence_errors(sentences: DataFrame, strict: bool = True) -> DataFrame:
    """``sent_key, sent_id, errors``: missing sent_id, missing text (strict), empty forms, heads that
    aren't there, other than one root (strict). NULL tokens count as none."""
    t = F.coalesce(F.col("tokens"), F.expr("cast(array() as " + dict(sentences.dtypes)["tokens"] + ")"))
    ids = F.transform(t, lambda x: x["id"])
    empty = F.transform(F.filter(t, lambda x: F.coalesce(x["text"], F.lit("")) == ""), lambda x: F.concat(F.lit("form:"), x["id"].cast("string")))
    lost = F.transform(F.filter(t, lambda x: (x["head_id"] != 0) & ~F.array_contains(ids, x["head_id"])), lambda x: F.concat(F.lit("head:"), x["id"].cast("string")))
    roots = F.size(F.filter(t, lambda x: x["head_id"] == 0))
    none = F.array().cast("array<string>")
    parts = [F.when(F.col("sent_id").isNull(), F.array(F.lit("sent_id"))).otherwise(none), empty, lost]
    if strict:
        parts += [F.when(F.col("text").isNull(), F.array(F.lit("text"))).otherwise(none), F.when(roots != 1, F.array(F.concat(F.lit("roots:"), roots.cast("string")))).otherwise(none)]
    return sentences.select("sent_key", "sent_id", F.concat(*parts).alias("errors"))


def with_duplicates(checked: DataFrame) -> DataFrame:
    """``duplicate``: the second and later rows of a sent_id, in the order of sent_key."""
    first = checked.where("sent_id IS NOT NULL").groupBy("sent_id").agg(F.min("sent_key").alias("first_key"))
    return checked.join(first, "sent_id", "left").withColumn("duplicate", F.coalesce(F.col("sent_key") != F.col("first_key"), F.lit(False))).drop("first_key")


def batch_stats(sentences: DataFrame, strict: bool = True) -> DataFrame:
    """One row: total, valid, invalid, reported (invalid rows that have an id), duplicates."""
    c = with_duplicates(sentence_errors(sentences, strict))
    bad = (F.size("errors") > 0) | F.col("duplicate")
    return c.agg(F.count(F.lit(1)).alias("total"), F.count_if(~bad).alias("valid"), F.count_if(bad).alias("invalid"), F.count_if(bad & F.col("sent_id").isNotNull()).alias("reported"), F.count_if("duplicate").alias("duplicates"))


def split_valid(sentences: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, quarantine with their errors)."""
    checked = sentence_errors(sentences, strict).select("sent_key", "errors")
    joined = sentences.join(checked, "sent_key")
    return joined.where(F.size("errors") == 0).drop("errors"), joined.where(F.size("errors") > 0)


def last_wins(rows: DataFrame, key: str = "sent_id", order: str = "sent_key") -> DataFrame:
    """The last row of every key; its position is the first one's."""
    last = rows.groupBy(key).agg(F.max(order).alias("_last"), F.min(order).alias("position"))
    return rows.join(last, [key]).where(F.col(order) == F.col("_last")).drop("_last")


def valid_offsets(tokens: DataFrame) -> DataFrame:
    """Tokens whose span isn't empty or reversed."""
    return tokens.where("char_end > char_start")
