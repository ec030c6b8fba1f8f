"""Audit of tokenizers: differing blocks of token lists, classified and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lesograf.functions.udfs import diff_opcodes
from lesograf.sources.tables import settle


def error_type(n_gold: Column, n_pred: Column) -> Column:
    return F.when(n_pred == 0, "MISSING").when(n_gold == 0, "HALLUCINATION").when((n_gold > 1) & (n_pred == 1), "MERGE_UNDER_TOK").when((n_gold == 1) & (n_pred > 1), "SPLIT_OVER_TOK").when(n_gold == n_pred, "TEXT_MISMATCH").otherwise("COMPLEX_MISMATCH")


def audit(rows: DataFrame, context: int = 100) -> DataFrame:
    """Errors of ``dataset, sent_id, text, gold`` against ``models`` (map of model -> tokens).

    A model without tokens for a sentence (NULL) is skipped for it; a row a differing block."""
    m = rows.select("dataset", "sent_id", "text", "gold", F.explode("models").alias("model", "pred")).where("pred IS NOT NULL")
    ops = m.select("*", F.explode(diff_opcodes("gold", "pred")).alias("op"))
    gold = F.slice("gold", F.col("op.i1") + 1, F.col("op.i2") - F.col("op.i1"))
    pred = F.slice("pred", F.col("op.j1") + 1, F.col("op.j2") - F.col("op.j1"))
    return ops.select("dataset", "sent_id", "model", error_type(F.size(gold), F.size(pred)).alias("error_type"), F.concat(F.lit("["), F.array_join(gold, ", "), F.lit("]")).alias("gold"), F.concat(F.lit("["), F.array_join(pred, ", "), F.lit("]")).alias("pred"), F.substring("text", 1, context).alias("context"))


def crosstab(errors: DataFrame, row: str, column: str) -> DataFrame:
    """Counts of ``row`` x ``column`` in long form, absent pairs as 0. Both have few values."""
    # written once: the values are looked up in the counts, not by running the audit again
    pairs = settle(errors.groupBy(row, column).agg(F.count(F.lit(1)).alias("n")))
    wide = pairs.groupBy(row).pivot(column).agg(F.sum("n")).na.fill(0)
    names = [c for c in wide.columns if c != row]
    return wide.select(row, F.explode(F.array(*(F.struct(F.lit(c).alias(column), F.col(f"`{c}`").alias("n")) for c in names))).alias("x")).select(row, f"x.{column}", "x.n") if names else pairs


def top_errors(errors: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent (gold, pred) of every model; ties by gold, then pred."""
    n = errors.groupBy("model", "gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("model").orderBy(F.desc("n"), "gold", "pred")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
