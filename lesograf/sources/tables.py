"""Parquet tables of one data folder, and the session helpers that every plan shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_SETTLED: dict[str, list[str]] = {}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints that the session names. Where none is set, a fresh local one on
    a single machine; on a cluster that is an error, as executors don't share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lesograf-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it again: the lineage ends, and a
    lost executor costs nothing but a new read."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    _SETTLED.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_settled(spark: SparkSession) -> int:
    """Delete the tables that ``settle`` wrote for this application; their number. For the end of a job:
    results that still read them must have been written before."""
    gone = 0
    for path in _SETTLED.pop(spark.sparkContext.applicationId, []):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))
    return gone


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``broadcast(df)`` if it has at most ``max_rows`` rows, else ``df`` for a shuffled join.

    The count stops at ``max_rows + 1`` rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
