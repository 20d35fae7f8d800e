"""Label tracking: issued and returned labels, gaps, duplicates, recovery of lost work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.session import table


def label_state(issued: DataFrame, returned: DataFrame, label: str = "label") -> DataFrame:
    """One row: issued, returned (distinct), duplicates, outstanding, first_gap and all_returned.

    first_gap is the smallest label not returned yet, or one past the largest issued. Two aggregations meet by label,
    so no label list leaves its partition.
    """
    back = returned.groupBy(label).agg(F.count(F.lit(1)).alias("times"))
    both = issued.select(label).distinct().join(back, label, "left")
    missing = F.col("times").isNull()
    return both.agg(
        F.count(F.lit(1)).alias("issued"),
        F.count("times").alias("returned"),
        F.coalesce(F.sum(F.when(F.col("times") > 1, F.col("times") - 1)), F.lit(0)).alias("duplicates"),
        F.count(F.when(missing, 1)).alias("outstanding"),
        F.coalesce(F.min(F.when(missing, F.col(label))), F.max(label) + 1, F.lit(0)).alias("first_gap"),
        (F.count(F.when(missing, 1)) == 0).alias("all_returned"),
    )


def outstanding(issued: DataFrame, returned: DataFrame, label: str = "label") -> DataFrame:
    return issued.select(label).distinct().join(returned.select(label).distinct(), label, "left_anti")


def orphans(active: DataFrame, dead: DataFrame, node: str) -> DataFrame:
    """Jobs whose node has died; they are queued again."""
    return active.join(dead.select(node).distinct(), node, "left_semi")


def eligible(jobs: DataFrame, failed: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs on nodes that haven't failed on the job's type."""
    return jobs.join(failed.select(*keys).distinct(), keys, "left_anti")


def late_job(running: DataFrame, start: str, tie: str, now, age_seconds: float) -> DataFrame:
    """The earliest restartable job over an age, at most one row."""
    late = running.where(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp")) > int(age_seconds * 1e6))
    return late.orderBy(start, tie).limit(1)


def exactly_once(results: DataFrame, key: str) -> DataFrame:
    return results.dropDuplicates([key])


def _labels(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    issued = orders.select(F.col("o_orderkey").alias("label"))
    some = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("label"))
    again = orders.where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("label"))
    return issued, some.unionByName(again)


_RETURNED = """returned AS (
      SELECT o_orderkey AS label FROM orders WHERE o_orderstatus = 'F'
      UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')"""


@query(
    "label_state",
    f"""WITH {_RETURNED}, back AS (SELECT label, count(*) AS times FROM returned GROUP BY label),
    b AS (SELECT o_orderkey AS label, times FROM orders LEFT JOIN back ON label = o_orderkey)
    SELECT count(*) AS issued, count(times) AS returned,
           CAST(coalesce(sum(CASE WHEN times > 1 THEN times - 1 END), 0) AS BIGINT) AS duplicates,
           count(*) FILTER (times IS NULL) AS outstanding,
           coalesce(min(label) FILTER (times IS NULL), max(label) + 1) AS first_gap,
           count(*) FILTER (times IS NULL) = 0 AS all_returned FROM b""",
)
def q_label_state(spark, sf_dir):
    return label_state(*_labels(spark, sf_dir))


@query("label_outstanding", f"WITH {_RETURNED} SELECT o_orderkey AS label FROM orders WHERE o_orderkey NOT IN (SELECT label FROM returned)")
def q_label_outstanding(spark, sf_dir):
    return outstanding(*_labels(spark, sf_dir))


@query(
    "late_job",
    "SELECT event_id, ts, user_id FROM events WHERE TIMESTAMP '2024-01-15 00:00:00' - ts > INTERVAL 300 MILLISECOND ORDER BY ts, event_id LIMIT 1",
)
def q_late_job(spark, sf_dir):
    return late_job(table(spark, sf_dir, "events"), "ts", "event_id", "2024-01-15 00:00:00", 0.3).select("event_id", "ts", "user_id")


@query(
    "orphan_requeue",
    """SELECT l_orderkey, l_linenumber, l_suppkey, count(*) AS jobs FROM lineitem
       WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY ALL""",
)
def q_orphan_requeue(spark, sf_dir):
    dead = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    lost = orphans(table(spark, sf_dir, "lineitem"), dead, "l_suppkey")
    return lost.groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.count(F.lit(1)).alias("jobs"))


@query(
    "failed_type_exclude",
    """WITH failed AS (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem WHERE l_tax > 0.07 AND l_discount > 0.09)
       SELECT l_suppkey, l_returnflag, count(*) AS jobs FROM lineitem l
       WHERE NOT EXISTS (SELECT 1 FROM failed f WHERE f.l_suppkey = l.l_suppkey AND f.l_returnflag = l.l_returnflag)
       GROUP BY ALL""",
)
def q_failed_type_exclude(spark, sf_dir):
    jobs = table(spark, sf_dir, "lineitem")
    failed = jobs.where("l_tax > 0.07D AND l_discount > 0.09D")
    return eligible(jobs, failed, ["l_suppkey", "l_returnflag"]).groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("jobs"))


@query("exactly_once", "SELECT DISTINCT event_id, user_id, value FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_type = 'error')")
def q_exactly_once(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type")
    return exactly_once(events.unionByName(events.where("event_type = 'error'")), "event_id").drop("event_type")


@query(
    "barrier_done",
    """SELECT submitted, completed, completed >= submitted AS done, nodes, nodes >= 50 AS ready FROM
       (SELECT count(*) AS submitted FROM orders), (SELECT count(DISTINCT l_orderkey) AS completed, count(DISTINCT l_suppkey) AS nodes FROM lineitem)""",
)
def q_barrier_done(spark, sf_dir):
    # One row each side.
    submitted = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("submitted"))
    done = table(spark, sf_dir, "lineitem").agg(F.countDistinct("l_orderkey").alias("completed"), F.countDistinct("l_suppkey").alias("nodes"))
    return submitted.withColumn("k", F.lit(1)).join(done.withColumn("k", F.lit(1)), "k").select(
        "submitted", "completed", (F.col("completed") >= F.col("submitted")).alias("done"), "nodes", (F.col("nodes") >= 50).alias("ready")
    )


@query(
    "error_isolation",
    """SELECT source, count(*) AS items, count(n) AS kept, count(*) - count(n) AS dropped FROM
       (SELECT source, TRY_CAST(regexp_extract(text, '[0-9][0-9.]*') AS DOUBLE) AS n FROM documents) GROUP BY source""",
)
def q_error_isolation(spark, sf_dir):
    """A stage that fails on an item drops it and goes on."""
    tried = table(spark, sf_dir, "documents").select("source", F.regexp_extract("text", "[0-9][0-9.]*", 0).try_cast("double").alias("n"))
    return tried.groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.count("n").alias("kept"), (F.count(F.lit(1)) - F.count("n")).alias("dropped"))
