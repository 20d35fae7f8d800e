"""Shared plumbing: recoverable cuts, bounded Arrow batches, hashing helpers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import importable, scratch, shared_folder

__all__ = ["U64", "cut", "hot_join", "scratch", "small_batches", "splitmix", "stash", "unit"]

#: Shuffle files go as soon as the query that wrote them has ended, not when the driver's garbage collector finds out.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
U64 = np.uint64


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside leave no shuffle files behind; the caller's setting comes back afterwards."""
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(RELEASE)
        else:
            spark.conf.set(RELEASE, before)


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and go on from there; the copy survives the loss of executors."""
    spark = df.sparkSession
    importable(spark)
    shared_folder(spark)
    with released(spark):
        return df.select("*").checkpoint()


def stash(df: DataFrame, name: str) -> DataFrame:
    """Like cut, as a Parquet table: smaller, and read by column. For tables of which later steps read a part."""
    spark = df.sparkSession
    importable(spark)
    path = scratch(spark, name)
    with released(spark):
        df.select("*").write.parquet(path)
    return spark.read.parquet(path)


def hot_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner join of left with right, which has one row for each key; `hot` holds the few keys that many rows of left share.

    The caller proves that hot is small: keys with at least a 256th of the rows are 256 at most. Their rows stay where
    they are, so that no task gets all rows of a key; the others are shuffled.
    """
    keys = F.broadcast(hot.select(key))
    few = left.join(F.broadcast(right.join(keys, key, "left_semi")), key)
    return few.unionByName(left.join(keys, key, "left_anti").join(right.join(keys, key, "left_anti"), key))


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bound what one Arrow batch of whole texts holds, so that long documents don't pile up in a worker.

    Spark reads both settings when a query starts, after the operator has returned it, so they stay as set here.
    """
    importable(spark)
    spark.conf.set(BATCH_BYTES, str(size))
    spark.conf.set(BATCH_ROWS, "2000")


def splitmix(x: np.ndarray | int) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit integers."""
    with np.errstate(over="ignore"):
        z = np.asarray(x, dtype=U64) + U64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
        return z ^ (z >> U64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform doubles in [0, 1) from 64-bit integers."""
    return (x >> U64(11)).astype(np.float64) * (1.0 / (1 << 53))

