"""Sharding: contiguous shards of near-equal bytes from global prefix sums.

Rows are put in doc_id order by a range partitioning. Each partition's total gives its offset (one number per
partition), a running sum inside the partition gives every row its global byte offset, and the byte axis is cut
at equal targets. A row goes to the shard in which its middle byte falls, so a shard differs from its target by
less than the size of one row at either end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import cut

LAW = "bytes"


def with_sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """size: UTF-8 bytes plus 1 (a null text has none); text_crc32: unsigned CRC-32 of the bytes (null text: 0)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"size": F.octet_length(whole).cast("long") + 1, "text_crc32": F.crc32(whole.cast("binary")).cast("long")})


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """key, size, text_crc32, shard and slot of every row.

    Contiguous in key order (nulls first); ties go by checksum and size, and rows equal in all three are
    interchangeable. slot counts from 0 in each shard without gaps. A shard can be empty where rows are few or one
    row is larger than a target; a text may be of any length. Rows without a key come first, each by its own text, and so
    do those that repeat one. An empty table gives no rows. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(key).asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    narrow = with_sizes(docs).select(key, "size", "text_crc32")
    placed = cut(narrow.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))

    # One row for each range partition: bounded by n, whatever the input.
    totals = {r["part"]: (r["bytes"], r["n"]) for r in placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
    offsets, at, seen = {}, 0, 0
    for part in sorted(totals):
        offsets[part] = (at, seen)
        at, seen = at + totals[part][0], seen + totals[part][1]
    whole = max(at, 1)

    def number(batches):
        state: dict[int, list[int]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            start, index = state.get(part) or offsets[part]
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            ends = start + np.cumsum(sizes)
            # The middle of a row, in half bytes; Python integers where shards * bytes could pass 2**63.
            middle = 2 * ends - sizes
            to = middle * shards // (2 * whole) if 2 * whole * shards < 2**62 else np.array([int(m) * shards // (2 * whole) for m in middle], dtype=np.int64)
            state[part] = [int(ends[-1]), index + batch.num_rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("size"), batch.column("text_crc32"), pa.array(to.astype(np.int32)), pa.array(np.arange(index, index + batch.num_rows, dtype=np.int64))],
                names=[key, "size", "text_crc32", "shard", "rank"],
            )

    kind = dict(placed.dtypes)[key]
    numbered = placed.mapInArrow(number, f"`{key}` {kind}, size long, text_crc32 long, shard int, rank long")
    # One row for each shard, a parameter.
    first = {r["shard"]: r["rank"] for r in numbered.groupBy("shard").agg(F.min("rank").alias("rank")).collect()}
    starts = spark.createDataFrame(sorted(first.items()), "shard int, first_rank long") if first else spark.createDataFrame([], "shard int, first_rank long")
    return numbered.join(F.broadcast(starts), "shard").select(key, "size", "text_crc32", "shard", (F.col("rank") - F.col("first_rank")).alias("slot"))


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs, 8).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: The checksum is worked out byte by byte from the table that its rule gives.
ORACLE = r"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), step AS (
  SELECT list(c ORDER BY i) AS step FROM bits WHERE k = 8
), d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
         xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
                         lambda c, b: xor(c >> 8, step[xor(c & 255, b) + 1])), 4294967295) AS text_crc32
  FROM documents, step
), p AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM d
), s AS (
  SELECT *, CAST((2 * before + size) * 8 // (2 * total) AS INT) AS shard FROM p
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, NULL::INT AS grown_shard
FROM s
"""
