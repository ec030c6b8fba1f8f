"""Selections: ad-hoc predicates, top-k, hash samples, splits by fraction."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lesograf.sources.tables import settle

_CONTAINS = re.compile(r"(\w+)\.str\.contains\(\s*(['\"])(.*?)\2\s*((?:,\s*\w+\s*=\s*\w+\s*)*)\)")
_CHAIN = re.compile(r"(-?[\d.]+)\s*(<=?|>=?)\s*([A-Za-z_]\w*)\s*(<=?|>=?)\s*(-?[\d.]+)")
_NOT_EQUAL = re.compile(r"([A-Za-z_]\w*)\s*!=\s*('[^']*'|\"[^\"]*\"|-?[\d.]+)")
_ALLOWED = re.compile(r"(?:\s+|'[^']*'|[A-Za-z_]\w*|-?\d+(?:\.\d+)?|==|<=|>=|<|>|=|<=>|[()])+")


def predicate(query: str) -> str:
    """SQL for a predicate in the data-frame query idiom.

    Known: ``.str.contains(x, case=..., na=...)``, comparisons, chained comparisons, ``!=`` (a missing
    value differs from everything), ``and/or/not`` and ``&|~``, True/False. Anything else is an error.
    """

    def contains(m: re.Match) -> str:
        quoted = m[3].replace("\\", "\\\\").replace("'", "\\'")
        flag = "" if re.search(r"case\s*=\s*False", m[4]) is None else "(?i)"
        return f"coalesce({m[1]} rlike '{flag}{quoted}', false)"

    held: list[str] = []

    def hold(sql: str) -> str:
        held.append(sql)
        return f" held_{len(held) - 1} "

    sql = _CONTAINS.sub(lambda m: hold(contains(m)), query)
    sql = re.sub(r'"([^"]*)"', lambda m: "'" + m[1].replace("'", "\\'") + "'", sql)
    sql = _CHAIN.sub(lambda m: hold(f"({m[1]} {m[2]} {m[3]} and {m[3]} {m[4]} {m[5]})"), sql)
    sql = _NOT_EQUAL.sub(lambda m: hold(f"(not ({m[1]} <=> {m[2]}))"), sql)
    sql = sql.replace("&", " and ").replace("|", " or ").replace("~", " not ").replace("==", "=")
    if not _ALLOWED.fullmatch(sql) or any(w not in ("and", "or", "not") for w in re.findall(r"([A-Za-z_]\w*)\s*\(", sql)):
        raise ValueError(f"unsupported predicate: {query!r}")
    return re.sub(r"\s*held_(\d+)\s*", lambda m: f" {held[int(m[1])]} ", sql).strip()


def where_query(rows: DataFrame, query: str) -> DataFrame:
    return rows.where(F.coalesce(F.expr(predicate(query)), F.lit(False)))


def top_k(rows: DataFrame, by: list[str], k: int, order: str = "sent_key") -> DataFrame:
    """The k greatest rows by the named columns; ties keep the order of the input. Result in no order."""
    return rows.orderBy(*(F.desc_nulls_last(c) for c in by), F.asc(order)).limit(k)


def hash_sample(rows: DataFrame, k: int, key: str = "sent_key", seed: str = "") -> DataFrame:
    """k rows, the same on every run: those with the least digests of their key."""
    return rows.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), F.col(key)).limit(k)


def keep_ids(rows: DataFrame, ids: DataFrame, key: str = "sent_id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def with_ordinal(rows: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """A running number from 1 in the given order, without one partition for all rows: the rows are
    sorted by range, each range counts its own, and the ranges' sizes give the offsets."""
    ranged = rows.repartitionByRange(*(F.col(c) for c in order)).sortWithinPartitions(*order)
    # written once, so that the parts that are counted are the parts that are numbered
    parts = settle(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    offsets = sizes.select("_part", "_first", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))
    return parts.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_at") - F.col("_first") + 1).drop("_part", "_at", "_offset", "_first")


def split_by_fraction(rows: DataFrame, by: str, fraction: float, order: str = "sent_key") -> DataFrame:
    """``set``: ``dev`` for the first floor(n x fraction) rows by ``by`` descending, else ``train``."""
    ranked = with_ordinal(rows.withColumn("_by", -F.col(by)), "_by", order, name="_rank").drop("_by")
    n = ranked.count()  # of the table that with_ordinal wrote
    return ranked.withColumn("set", F.when(F.col("_rank") <= int(n * fraction), "dev").otherwise("train")).drop("_rank")
