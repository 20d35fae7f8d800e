"""Ordered numbering and look-back without gathering a key's whole history in one task.

A window partitioned by a few keys puts each key's rows into one task. Here rows are cut into buckets of the order
column as well; what crosses a bucket's border comes from a table with one row for each key and bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.session import shared_folder


def day_bucket(ts: str) -> Column:
    return F.date_trunc("day", F.col(ts))


def range_bucket(df: DataFrame, column: str, buckets: int | None = None) -> Column:
    """Number of the quantile range a value of a numeric column falls in; the same for equal values.

    Bounds are looked up in two steps, so a row costs the root of the number of ranges.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = df.agg(F.percentile_approx(F.col(column), [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0]
    steps = sorted(set(bounds or []))
    if not steps:
        return F.lit(0)
    wide = max(1, math.isqrt(len(steps)))
    rows = [steps[i : i + wide] for i in range(0, len(steps), wide)]
    reached = lambda values: F.size(F.filter(values, lambda b: b <= F.col(column)))
    row = F.greatest(reached(F.array(*(F.lit(r[0]) for r in rows))) - 1, F.lit(0))
    fine = F.get(F.array(*(F.array(*(F.lit(b) for b in r)) for r in rows)), row)
    return F.when(F.col(column).isNull(), F.lit(-1)).otherwise(row * wide + reached(fine))


def indexed(df: DataFrame, column: str, *ties: str, buckets: int | None = None, name: str = "ix") -> DataFrame:
    """df with the position of each row (from 0) in the order of a column and ties, nulls first.

    Rows are range-partitioned by all of them, so a frequent value is split, and numbered where they lie. The numbered rows
    are written once to the shared folder: a second run of a range partitioning may draw other borders.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared_folder(spark)
    order = [F.col(c).asc_nulls_first() for c in (column, *ties)]
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    # The number of the partition and the place in it.
    placed = placed.withColumns({"_b": F.shiftright("_id", 33), "_n": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id")
    counts = placed.groupBy("_b").agg((F.max("_n") + 1).alias("n")).orderBy("_b").collect()  # one row a partition
    offsets, at = [], 0
    for r in counts:
        offsets.append((r["_b"], at))
        at += r["n"]
    return placed.join(F.broadcast(spark.createDataFrame(offsets, "_b long, _at long")), "_b").withColumn(name, F.col("_at") + F.col("_n")).drop("_b", "_n", "_at")


def with_previous(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: str, name: str) -> DataFrame:
    """df with `name`: value of the row before in the key's order, null for its first row."""
    inner = W.partitionBy(*keys, "_b").orderBy(*order)
    placed = df.withColumn("_b", bucket)
    ends = placed.groupBy(*keys, "_b").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carried = ends.withColumn("_carry", F.lag("_last").over(W.partitionBy(*keys).orderBy("_b"))).drop("_last")
    return (
        placed.withColumn("_prev", F.lag(value).over(inner))
        .withColumn("_first", F.row_number().over(inner) == 1)
        .join(carried, [*keys, "_b"])
        .withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev")))
        .drop("_b", "_prev", "_first", "_carry")
    )


def with_running_sum(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: str, name: str) -> DataFrame:
    """df with `name`: sum of value over the key's rows up to and with this one."""
    placed = df.withColumn("_b", bucket)
    sums = placed.groupBy(*keys, "_b").agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.withColumn("_carry", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    own = F.sum(value).over(W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return placed.withColumn("_own", own).join(carried, [*keys, "_b"]).withColumn(name, F.col("_own") + F.col("_carry")).drop("_b", "_own", "_carry")


def with_total_before(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """df with `name`: sum of value over all rows that come before in the order given, across the whole table.

    Rows are range-partitioned and summed up by partition; a running sum inside a partition does the rest.
    """
    spark = df.sparkSession
    shared_folder(spark)
    keys = df.withColumn("_o", F.struct(*order))
    placed = keys.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "_o").withColumn("_b", F.spark_partition_id()).checkpoint()
    sums = placed.groupBy("_b").agg(F.sum(value).alias("s")).orderBy("_b").collect()  # one row a partition
    offsets, at = [], 0
    for r in sums:
        offsets.append((r["_b"], at))
        at += r["s"] or 0
    inside = W.partitionBy("_b").orderBy("_o").rowsBetween(W.unboundedPreceding, -1)
    summed = placed.withColumn("_s", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(F.broadcast(spark.createDataFrame(offsets, "_b int, _at long")), "_b").withColumn(name, F.col("_at") + F.col("_s")).drop("_b", "_o", "_s", "_at")
