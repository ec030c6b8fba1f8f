"""Reports: counts, distributions, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def describe(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """count, mean, std (sample), min, quartiles, p90, p95, p99, max; NULLs don't count."""
    q = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    d = rows.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.percentile(value, F.array(*map(F.lit, q.values()))).alias("q"), F.max(value).alias("max"))
    return d.select(*by, "count", "mean", "std", "min", *(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(q)), "max")


def percent_true(rows: DataFrame, flag: str, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg((F.avg(F.col(flag).cast("int")) * 100).alias("percent"))


def recommendation(rows: DataFrame, genre: Column, dataset: Column) -> DataFrame:
    """Thresholds of the literary subset and the query string they make: ``length_p90, score_p90, query``."""
    lit = rows.where((dataset == "TAIGA") & F.coalesce(genre.rlike("(?i)fiction|lit|prose|social"), F.lit(False)))
    t = lit.agg(F.floor(F.percentile("length", F.lit(0.9))).cast("int").alias("length_p90"), F.floor(F.percentile("score", F.lit(0.9))).cast("int").alias("score_p90"))
    return t.withColumn("query", F.format_string("10 < length < %d and score > %d", "length_p90", "score_p90"))


def eda(rows: DataFrame, length: str = "length") -> DataFrame:
    """sentences, mean and greatest length; no row for no sentences."""
    return rows.agg(F.count(F.lit(1)).alias("sentences"), F.avg(length).alias("avg_length"), F.max(length).alias("max_length")).where("sentences > 0")


def split_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("set").agg(F.count(F.lit(1)).alias("size"), F.avg("score").alias("mean_score"), F.avg("syntax_complexity").alias("mean_syntax_complexity"), F.avg("dialogue_score").alias("dialogue_ratio"), F.avg("pronouns").alias("mean_pronouns"))


def histogram(rows: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """``bin, low, high, n`` of equal bins between least and greatest value; empty bins are left out."""
    edges = rows.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).first()
    if edges["lo"] is None:
        return rows.sparkSession.createDataFrame([], "bin int, low double, high double, n bigint")
    lo, width = edges["lo"], (edges["hi"] - edges["lo"]) / bins or 1.0
    b = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select("bin", (F.lit(lo) + F.col("bin") * width).alias("low"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("high"), "n")


def ecdf(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Distinct values with the share of rows up to them, from counts: the window holds values, not rows."""
    c = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return c.select(*by, value, (F.sum("n").over(w.orderBy(value)) / F.sum("n").over(w)).alias("ecdf"))


def markdown(rows: DataFrame, max_rows: int = 200) -> str:
    """A result as a Markdown table, rendered on the driver; a last line says so where it goes on after
    ``max_rows`` rows."""
    data = rows.limit(max_rows + 1).collect()
    rest = data[max_rows:]
    data = data[:max_rows]
    head = "| " + " | ".join(rows.columns) + " |"
    return "\n".join([head, "|" + " --- |" * len(rows.columns), *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in data), *([f"only the first {max_rows} rows"] if rest else [])])
