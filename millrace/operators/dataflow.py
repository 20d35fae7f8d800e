"""Queries over job plans: chains, split/merge, recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.plans.jobs import Atomic, Parallel, ParallelInRow, Series
from millrace.session import table


@query(
    "series_map",
    """WITH a AS (SELECT l_returnflag, l_extendedprice * (1 - l_discount) AS net, l_tax FROM lineitem),
       b AS (SELECT *, net * (1 + l_tax) AS gross FROM a), c AS (SELECT *, CAST(floor(gross / 10000) AS BIGINT) AS bucket FROM b)
       SELECT bucket, count(*) AS items, round(sum(gross), 2) AS gross FROM c GROUP BY bucket""",
)
def q_series_map(spark, sf_dir):
    net = Atomic(lambda d: d.withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount"))), "net")
    gross = Atomic(lambda d: d.withColumn("gross", F.col("net") * (1 + F.col("l_tax"))), "gross")
    bucket = Atomic(lambda d: d.withColumn("bucket", F.floor(F.col("gross") / 10000).cast("long")), "bucket")
    total = Atomic(lambda d: d.groupBy("bucket").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("gross"), 2).alias("gross")), "total")
    return Series(Series(net, gross), Series(bucket), total).run(table(spark, sf_dir, "lineitem"))


@query("series_array_sum", "SELECT o_orderkey, CAST(list_sum(range(12 * o_orderkey, 12 * o_orderkey + 20)) AS BIGINT) AS total FROM orders")
def q_series_array_sum(spark, sf_dir):
    make = Atomic(lambda d: d.withColumn("data", F.sequence(F.col("o_orderkey") * 12, F.col("o_orderkey") * 12 + 19)))
    add = Atomic(lambda d: d.withColumn("total", F.aggregate("data", F.lit(0).cast("long"), lambda a, x: a + x)))
    return Series(make, add).run(table(spark, sf_dir, "orders").select("o_orderkey")).select("o_orderkey", "total")


@query(
    "split_merge_orders",
    "SELECT l_orderkey, count(*) AS parts, round(sum(l_extendedprice * (1 - l_discount)), 4) AS net, max(l_linenumber) AS last_part FROM lineitem GROUP BY l_orderkey",
)
def q_split_merge_orders(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("parts"), F.round(F.sum("net"), 4).alias("net"), F.max("l_linenumber").alias("last_part"))


def slices(length, n: int):
    """(start, end) of n slices, i * length div n."""
    cut = lambda i: F.call_function("div", i * length, F.lit(n))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(cut(i).alias("a"), cut(i + 1).alias("b")))


@query(
    "split_vertical",
    """WITH s AS (SELECT doc_id, i, substr(text, 1 + i * length(text) // 9, (i + 1) * length(text) // 9 - i * length(text) // 9) AS part FROM documents, range(9) AS r(i))
       SELECT doc_id, count(*) AS slices, md5(string_agg(part, '' ORDER BY i)) AS merged_md5, max(length(part)) AS widest FROM s GROUP BY doc_id""",
)
def q_split_vertical(spark, sf_dir):
    """Nine slices of each text, each handled by itself, merged in slice order; all of it inside the row."""
    job = ParallelInRow(
        lambda d: F.transform(slices(F.length("text"), 9), lambda s: F.col("text").substr(s["a"] + 1, s["b"] - s["a"])),
        lambda part, ix: F.struct(part.alias("part"), F.length(part).alias("width")),
        lambda r: [
            F.size(r).cast("long").alias("slices"),
            F.md5(F.array_join(F.transform(r, lambda x: x["part"]), "").cast("binary")).alias("merged_md5"),
            F.array_max(F.transform(r, lambda x: x["width"])).alias("widest"),
        ],
    )
    return job.run(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query(
    "split_frame_range",
    """SELECT o_orderkey, o_orderkey * 10 AS first, o_orderkey * 10 + 9 AS last, list_transform(range(o_orderkey * 10, o_orderkey * 10 + 10), lambda x: x % 256)::VARCHAR AS samples FROM orders""",
)
def q_split_frame_range(spark, sf_dir):
    """A range of frames to one part a frame, back to one array in frame order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    job = Parallel(
        "o_orderkey",
        lambda d: F.sequence(F.col("o_orderkey") * 10, F.col("o_orderkey") * 10 + 9),
        Atomic(lambda d: d.withColumn("sample", F.pmod("part", F.lit(256)))),
        lambda: [F.min("part").alias("first"), F.max("part").alias("last"), F.array_sort(F.collect_list(F.struct("part_ix", "sample"))).alias("s")],
    )
    said = F.concat(F.lit("["), F.array_join(F.transform("s", lambda x: x["sample"].cast("string")), ", "), F.lit("]"))
    return job.run(orders).select("o_orderkey", "first", "last", said.alias("samples"))


def fibonacci(spark, most: int) -> DataFrame:
    """n and f(n) for n up to `most`, f(n) = 1 below 3, by a recursive query."""
    return spark.sql(
        f"""WITH RECURSIVE fib(n, value, before) AS (
              SELECT 1L, 1L, 0L UNION ALL SELECT n + 1, value + before, value FROM fib WHERE n < {int(most)})
            SELECT n, value FROM fib"""
    )


@query("recursive_fib", "WITH RECURSIVE fib(n, value, before) AS (SELECT 1::BIGINT, 1::BIGINT, 0::BIGINT UNION ALL SELECT n + 1, value + before, value FROM fib WHERE n < 60) SELECT n, value FROM fib")
def q_recursive_fib(spark, sf_dir):
    return fibonacci(spark, 60)


@query(
    "exact_match",
    """WITH g AS (SELECT sha256(text) AS digest, length(text) AS size, min(doc_id) AS probe, count(*) AS files FROM documents GROUP BY ALL HAVING count(*) > 1)
       SELECT doc_id, probe, files FROM documents JOIN g ON sha256(text) = digest AND length(text) = size""",
)
def q_exact_match(spark, sf_dir):
    """Files whose data equal a probe's: groups by digest and size, each member with its group's first."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.length("text").alias("size"))
    groups = files.groupBy("digest", "size").agg(F.min("doc_id").alias("probe"), F.count(F.lit(1)).alias("files")).where("files > 1")
    return files.join(groups, ["digest", "size"]).select("doc_id", "probe", "files")


@query(
    "seq_stats",
    """SELECT lang, count(*) AS sequences, max(length(text)) AS longest, round(avg(length(text)), 4) AS mean_length, CAST(sum(length(regexp_replace(text, '[^A-Za-z]', '', 'g'))) AS BIGINT) AS letters
       FROM documents GROUP BY lang""",
)
def q_seq_stats(spark, sf_dir):
    n = F.length("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("sequences"), F.max(n).alias("longest"), F.round(F.avg(n), 4).alias("mean_length"), F.sum(F.length(F.regexp_replace("text", "[^A-Za-z]", ""))).alias("letters")
    )
