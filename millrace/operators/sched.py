"""Scheduling decisions as queries over job and node tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.catalog import query
from millrace.operators.order import day_bucket, range_bucket, with_previous, with_running_sum
from millrace.session import shared_folder, table

INFINITY = float("inf")
#: Fixed values of the estimates: share of the execution time that a queued job adds; deadline factors.
ESTIMATE_INACCURACY = 0.1
ALLOWANCE_FACTOR, RESCHEDULE_FACTOR, LEAST_ALLOWANCE = 3.0, 6.0, 1e-4
#: Parts of a queue's range of ids; the search for its front begins with one.
WHOLE = 256


def completion_estimate(
    transmission: Column, dequeue: Column, execution: Column, completion: Column, queue_length: Column, current: Column, processors: Column, unpredictable: Column, suspect: Column
) -> Column:
    """Seconds until a job sent to a node is done; null where the node can't take it, infinite where it never ends."""
    full = current >= processors + F.when(unpredictable, 0).otherwise(1)
    waiting = F.greatest(queue_length, current)
    total = transmission + F.greatest(F.lit(0), waiting - processors) * dequeue + execution + completion + ESTIMATE_INACCURACY * waiting * execution
    return F.when(suspect | full | queue_length.isNull(), F.lit(None).cast("double")).when(completion == INFINITY, INFINITY).otherwise(total)


def best_worker(estimates: DataFrame, job: list[str], node: str, estimate: str) -> DataFrame:
    """The node with the least estimate for each job; the smallest node of equals, none where all are null."""
    least = F.min(F.when(F.col(estimate).isNotNull(), F.struct(F.col(estimate), F.col(node))))
    return estimates.groupBy(*job).agg(least.alias("b")).where("b IS NOT NULL").select(*job, F.col(f"b.{node}"), F.col(f"b.{estimate}"))


def _nodes(spark, sf_dir):
    """Suppliers as nodes: their lines per return flag (the job type) give times and queues."""
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("node"), F.col("l_returnflag").alias("job_type")).agg(
        F.count(F.lit(1)).alias("queue_length"), F.avg("l_tax").alias("transmission"), F.avg("l_discount").alias("dequeue"), F.avg("l_quantity").alias("execution")
    )
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), "s_nationkey", "s_acctbal")
    c = F.col
    est = completion_estimate(
        c("transmission"), c("dequeue"), c("execution"), F.when(c("s_acctbal") < -900, INFINITY).otherwise(0.5), c("queue_length"), F.pmod(c("node"), F.lit(7)).cast("int"), F.lit(4), c("job_type") == "N", c("s_acctbal") < 0
    )
    return per.join(nodes, "node").withColumn("estimate", est)


_NODES = """nodes AS (
  SELECT l_suppkey AS node, l_returnflag AS job_type, count(*) AS queue_length, avg(l_tax) AS transmission, avg(l_discount) AS dequeue, avg(l_quantity) AS execution
  FROM lineitem GROUP BY ALL),
est AS (SELECT n.*, CASE WHEN s_acctbal < 0 OR node % 7 >= 4 + CASE WHEN job_type = 'N' THEN 0 ELSE 1 END THEN NULL
          ELSE transmission + greatest(0, greatest(queue_length, node % 7) - 4) * dequeue + execution + 0.5 + CAST(0.1 AS DOUBLE) * greatest(queue_length, node % 7) * execution END AS estimate
        FROM nodes n JOIN supplier ON s_suppkey = node)"""


@query("completion_estimate", f"WITH {_NODES} SELECT node, job_type, queue_length, round(estimate, 6) AS estimate FROM est")
def q_completion_estimate(spark, sf_dir):
    return _nodes(spark, sf_dir).select("node", "job_type", "queue_length", F.round("estimate", 6).alias("estimate"))


@query(
    "best_worker",
    f"WITH {_NODES} SELECT job_type, node, round(estimate, 6) AS estimate FROM est WHERE estimate IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_type ORDER BY estimate, node) = 1",
)
def q_best_worker(spark, sf_dir):
    return best_worker(_nodes(spark, sf_dir), ["job_type"], "node", "estimate").withColumn("estimate", F.round("estimate", 6))


@query(
    "dispatch_order",
    """SELECT l_suppkey, l_orderkey, l_linenumber, count(*) AS copies, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS place
       FROM lineitem GROUP BY l_suppkey, l_orderkey, l_linenumber""",
)
def q_dispatch_order(spark, sf_dir):
    """Each worker's queue in order of hierarchical ids; arrays compare element by element, shorter first."""
    jobs = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.array("l_orderkey", F.col("l_linenumber").cast("long")).alias("ids")).agg(F.count(F.lit(1)).alias("copies"))
    return in_queue_order(jobs, ["l_suppkey"], "ids").select("l_suppkey", F.col("ids")[0].alias("l_orderkey"), F.col("ids")[1].cast("int").alias("l_linenumber"), "copies", "place")


def in_queue_order(jobs: DataFrame, queue: list[str], ids: str) -> DataFrame:
    """jobs with their place (from 1) in their queue by id; ranges of the first id are numbered side by side."""
    first = jobs.withColumns({"_first": F.col(ids)[0], "_one": F.lit(1)})
    return with_running_sum(first, queue, range_bucket(first, "_first"), [ids], "_one", "place").drop("_first", "_one")


def dispatch(queue: DataFrame, free: DataFrame, kind: str, ids: str) -> DataFrame:
    """One dispatch step: of each type with a free worker the first job in id order; blocked types are passed over.

    Types are few (free has a row for each). The least array is looked for only among the jobs with the least first id:
    hash aggregation keeps numbers in place, but for arrays all rows would be sorted.
    """
    able = queue.join(F.broadcast(free.where("free > 0").select(kind).distinct()), kind, "left_semi")
    first = F.get(F.col(ids), F.lit(0))
    # An array without elements comes before one that begins with null, and that before all others.
    rank = F.when(F.col(ids).isNull(), None).when(F.size(ids) == 0, 0).when(first.isNull(), 1).otherwise(2)
    least = able.groupBy(kind).agg(F.min(rank).alias("_rank"), F.min(first).alias("_first"))
    lead = able.join(F.broadcast(least.withColumnRenamed(kind, "_kind")), F.col(kind).eqNullSafe(F.col("_kind")))
    lead = lead.where(rank.eqNullSafe(F.col("_rank")) & (first.isNull() | (first == F.col("_first"))))
    return lead.groupBy(kind).agg(F.min(ids).alias(ids))


@query(
    "dispatch_step",
    """SELECT l_returnflag, min(l_orderkey) AS orderkey FROM lineitem WHERE l_returnflag IN
       (SELECT l_returnflag FROM lineitem GROUP BY l_returnflag HAVING count(DISTINCT l_suppkey) > 5) GROUP BY l_returnflag""",
)
def q_dispatch_step(spark, sf_dir):
    queue = table(spark, sf_dir, "lineitem").select("l_returnflag", F.array("l_orderkey").alias("ids"))
    free = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg((F.countDistinct("l_suppkey") - 5).alias("free"))
    return dispatch(queue, free, "l_returnflag", "ids").select("l_returnflag", F.col("ids")[0].alias("orderkey"))


def queue_fronts(queue: DataFrame, free: DataFrame, kind: str, ids: str) -> DataFrame:
    """Of each type with free workers the jobs up to an id by which there are as many as workers, or all; with free.

    The bound starts at a small share of the type's range of first ids and grows sixteenfold while jobs are too few. It
    reaches the scan of the queue, so of a long queue little is read, made distinct and put in order.
    """
    spark = queue.sparkSession
    shared_folder(spark)
    first = F.get(F.col(ids), F.lit(0))
    ends = queue.groupBy(kind).agg(F.min(first).alias("lo"), F.max(first).alias("hi"))
    kinds = ends.join(F.broadcast(free.where("free > 0").select(kind, "free")), kind).collect()  # one row a type
    schema = T.StructType([T.StructField(kind, free.schema[kind].dataType), T.StructField("free", free.schema["free"].dataType), T.StructField("_to", T.LongType())])
    share = dict.fromkeys((r[kind] for r in kinds), 1)
    while True:
        to = {r[kind]: None if r["lo"] is None else r["lo"] + (r["hi"] - r["lo"]) * share[r[kind]] // WHOLE for r in kinds}
        top = max((t for t in to.values() if t is not None), default=None)
        bounds = spark.createDataFrame([(r[kind], r["free"], to[r[kind]]) for r in kinds], schema)
        near = queue.where(first.isNull() | (first <= F.lit(top).cast("long"))).join(F.broadcast(bounds), kind)
        front = near.where(first.isNull() | (first <= F.col("_to"))).drop("_to").checkpoint()
        jobs = {r[kind]: r["count"] for r in front.groupBy(kind).count().collect()}
        short = [r[kind] for r in kinds if jobs.get(r[kind], 0) < r["free"] and share[r[kind]] < WHOLE]
        if not short:
            return front
        for k in short:
            share[k] = min(WHOLE, 16 * share[k])


def dispatch_scan(queue: DataFrame, free: DataFrame, kind: str, ids: str) -> DataFrame:
    """Dispatch until nothing more can be: jobs go in id order, each takes a free worker of its type, and a type that has
    none left is passed over. The jobs that go, with turn (from 1) in the order they go in.

    Types are few (free has a row for each), queues are long, so only their fronts are put in order, and places there are
    numbered by ranges of ids.
    """
    able = queue_fronts(queue, free, kind, ids)
    taken = in_queue_order(able, [kind], ids).where(F.col("place") <= F.col("free")).drop("place", "free").checkpoint()
    return in_queue_order(taken.withColumn("_all", F.lit(0)), ["_all"], ids).withColumnRenamed("place", "turn").drop("_all")


@query(
    "dispatch_scan",
    """WITH f AS (SELECT l_returnflag, 100 * (count(DISTINCT l_suppkey) % 7) AS free FROM lineitem GROUP BY l_returnflag),
       q AS (SELECT l_returnflag, o AS orderkey, n AS linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY o, n) AS place
             FROM (SELECT DISTINCT l_returnflag, l_orderkey AS o, l_linenumber AS n FROM lineitem))
       SELECT l_returnflag, orderkey, linenumber, row_number() OVER (ORDER BY orderkey, linenumber, l_returnflag) AS turn FROM q JOIN f USING (l_returnflag) WHERE place <= free""",
)
def q_dispatch_scan(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    flag = F.ascii("l_returnflag").cast("long")
    queue = lines.select("l_returnflag", F.array("l_orderkey", F.col("l_linenumber").cast("long"), flag).alias("ids")).distinct()
    free = lines.groupBy("l_returnflag").agg((100 * F.pmod(F.countDistinct("l_suppkey"), F.lit(7))).alias("free"))
    return dispatch_scan(queue, free, "l_returnflag", "ids").select("l_returnflag", F.col("ids")[0].alias("orderkey"), F.col("ids")[1].cast("int").alias("linenumber"), "turn")


@query(
    "remaining_time",
    """WITH c AS (SELECT l_returnflag AS job_type, l_linenumber AS stage, l_suppkey % 5 AS node, avg(l_tax) + (1 + count(*)) * avg(l_discount) + avg(l_quantity) AS s FROM lineitem GROUP BY ALL),
       m AS (SELECT job_type, stage, min(s) AS s FROM c GROUP BY ALL)
       SELECT job_type, stage, round(sum(s + CAST(0.2 AS DOUBLE)) OVER (PARTITION BY job_type ORDER BY stage ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS remaining_s FROM m""",
)
def q_remaining_time(spark, sf_dir):
    """Back to front over the stages: the best node's time for each stage, summed from the end."""
    c = F.col
    costs = table(spark, sf_dir, "lineitem").groupBy(c("l_returnflag").alias("job_type"), c("l_linenumber").alias("stage"), F.pmod("l_suppkey", F.lit(5)).alias("node")).agg(
        (F.avg("l_tax") + (1 + F.count(F.lit(1))) * F.avg("l_discount") + F.avg("l_quantity")).alias("s")
    )
    return remaining_time(costs.groupBy("job_type", "stage").agg(F.min("s").alias("s")), "job_type", "stage", "s", 0.2)


def remaining_time(stages: DataFrame, kind: str, stage: str, seconds: str, master_queue: float) -> DataFrame:
    """Stages of a job type are few, so the suffix sum's partitions are small whatever the number of jobs."""
    tail = Window.partitionBy(kind).orderBy(stage).rowsBetween(0, Window.unboundedFollowing)
    return stages.select(kind, stage, F.round(F.sum(F.col(seconds) + master_queue).over(tail), 6).alias("remaining_s"))


def remaining_time_from(links: DataFrame, costs: DataFrame, kind: str, stage: str, master_queue: float) -> DataFrame:
    """kind, stage, node and remaining_s: seconds to the end of a job that stands at the node before the stage.

    links (src, dst, transmission) says how long sending takes, costs (kind, stage, node, seconds) what a node needs for a
    stage. Back to front, one join for each stage: the best target of a stage counts with its own time for what follows.
    """
    last = costs.agg(F.max(stage)).first()[0]
    first = costs.agg(F.min(stage)).first()[0]
    after, out = None, None
    for i in range(last or 0, (first or 0) - 1, -1):
        here = costs.where(F.col(stage) == i).select(kind, F.col("node").alias("dst"), "seconds")
        if after is not None:
            here = here.join(after.select(kind, F.col("node").alias("dst"), F.col("remaining_s").alias("rest")), [kind, "dst"], "left")
        rest = F.coalesce("rest", F.lit(0.0)) if after is not None else F.lit(0.0)
        reached = links.join(here.select(kind, "dst", (F.col("seconds") + rest).alias("t")), "dst")
        after = reached.groupBy(kind, F.col("src").alias("node")).agg((F.lit(master_queue) + F.min(F.col("transmission") + F.col("t"))).alias("remaining_s"))
        one = after.select(kind, F.lit(i).alias(stage), "node", "remaining_s")
        out = one if out is None else out.unionByName(one)
    return out


def _remaining_sql(stages: int) -> str:
    parts = []
    for i in range(stages, 0, -1):
        rest = "0" if i == stages else f"coalesce((SELECT r.t FROM t{i + 1} r WHERE r.job_type = c.job_type AND r.node = c.node), 0)"
        parts.append(f"""t{i} AS (SELECT c.job_type, l.src AS node, CAST(0.2 AS DOUBLE) + min(l.transmission + c.s + {rest}) AS t FROM c JOIN l ON l.dst = c.node WHERE c.stage = {i} GROUP BY c.job_type, l.src)""")
    picked = " UNION ALL ".join(f"SELECT job_type, {i} AS stage, node, round(t, 6) AS remaining_s FROM t{i}" for i in range(1, stages + 1))
    return f"""WITH c AS (SELECT l_returnflag AS job_type, l_linenumber AS stage, l_suppkey % 5 AS node, (1 + count(*)) * avg(l_discount) + avg(l_quantity) AS s FROM lineitem GROUP BY ALL),
       l AS (SELECT s AS src, d AS dst, CASE WHEN s = d THEN 0 ELSE CAST(0.5 AS DOUBLE) * abs(s - d) END AS transmission FROM range(5) a(s), range(5) b(d)),
       {", ".join(parts)} {picked}"""


@query("remaining_time_nodes", _remaining_sql(7))
def q_remaining_time_nodes(spark, sf_dir):
    """The same where sending takes longer the farther apart nodes are, so each node has its own remaining time."""
    c = F.col
    costs = table(spark, sf_dir, "lineitem").groupBy(c("l_returnflag").alias("job_type"), c("l_linenumber").alias("stage"), F.pmod("l_suppkey", F.lit(5)).alias("node")).agg(
        ((1 + F.count(F.lit(1))) * F.avg("l_discount") + F.avg("l_quantity")).alias("seconds")
    )
    nodes = spark.range(5)
    links = nodes.select(c("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<long>")).alias("dst")).withColumn("transmission", 0.5 * F.abs(c("src") - c("dst")))
    return remaining_time_from(links, costs, "job_type", "stage", 0.2).withColumn("remaining_s", F.round("remaining_s", 6))


@query(
    "queue_time",
    """WITH l AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
       SELECT user_id, count(*) AS elements, round(avg(gap) / 1e6, 6) AS dequeue_s, round(avg(gap) / 1e6 * (1 + count(*)), 4) AS queue_s, max(gap) AS longest_us FROM l GROUP BY user_id""",
)
def q_queue_time(spark, sf_dir):
    """Expected time in a queue: mean time between removals, once more than there are elements."""
    events = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    gaps = with_previous(events, ["user_id"], day_bucket("ts"), ["ts", "event_id"], "us", "before").withColumn("gap", F.col("us") - F.col("before"))
    n = F.count(F.lit(1))
    return gaps.groupBy("user_id").agg(
        n.alias("elements"), F.round(F.avg("gap") / 1e6, 6).alias("dequeue_s"), F.round(F.avg("gap") / 1e6 * (1 + n), 4).alias("queue_s"), F.max("gap").alias("longest_us")
    )


def ew_log_estimator(samples: DataFrame, key: str, bucket: Column, order: list[str], value: str, alpha: float, start: float) -> DataFrame:
    """Exponentially weighted mean of ln(sample) per key and its likely value.

    m <- m + alpha * (ln x - m) over the key's samples, written out as a weighted sum. Buckets of a key's history are
    summed up side by side; each then counts as much as the samples after it leave of it.

    A sample of 0 has a logarithm of minus infinity, a negative one none (NaN), and either carries to the mean; once so old
    that its weight is 0 an infinite one gives NaN, as the product does in SQL. Null samples only age the others.
    """
    keep = F.lit(1 - alpha)
    x, endless, nan = F.col(value), float("inf"), float("nan")
    ln = F.when(x < 0, nan).when(x == 0, -endless).otherwise(F.ln(x))
    finite = F.abs("_ln") < endless
    placed = samples.withColumns({"_b": bucket, "_ln": ln})
    age = F.row_number().over(Window.partitionBy(key, "_b").orderBy(*(F.col(c).desc() for c in order))) - 1
    term = F.when(finite, alpha * F.pow(keep, F.col("_age")) * F.col("_ln")).when(F.col("_ln").isNotNull(), 0.0)
    # Of the logarithms that aren't finite the oldest decides, by its age in the whole history.
    odd = {"_low": -endless, "_high": endless, "_none": nan}
    oldest = [F.max(F.when(F.col("_ln") == v, F.col("_age"))).alias(c) for c, v in odd.items()]
    parts = placed.withColumn("_age", age).groupBy(key, "_b").agg(F.count(F.lit(1)).alias("n"), F.sum(term).alias("s"), *oldest)
    # One row for each key and bucket from here on.
    later = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    m = F.sum(F.col("s") * F.pow(keep, F.col("_later"))) + F.pow(keep, F.sum("n")) * start
    for c, v in odd.items():
        m = m + F.coalesce(F.sum(alpha * F.pow(keep, F.col(c) + F.col("_later")) * F.lit(v)), F.lit(0.0))
    return parts.withColumn("_later", later).groupBy(key).agg(F.sum("n").alias("samples"), F.round(m, 6).alias("log_mean"), F.round(F.exp(m), 4).alias("likely"))


@query(
    "ew_estimator",
    """WITH w AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS age FROM events),
       m AS (SELECT user_id, count(*) AS samples, sum(CAST(0.2 AS DOUBLE) * pow(CAST(0.8 AS DOUBLE), age) * ln(value)) + pow(CAST(0.8 AS DOUBLE), count(*)) * 3 AS m FROM w GROUP BY user_id)
       SELECT user_id, samples, round(m, 6) AS log_mean, round(exp(m), 4) AS likely FROM m""",
)
def q_ew_estimator(spark, sf_dir):
    return ew_log_estimator(table(spark, sf_dir, "events"), "user_id", day_bucket("ts"), ["ts", "event_id"], "value", 0.2, 3.0)


def _durations(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    days = F.datediff("l_shipdate", "o_orderdate")
    return lines.join(orders, "l_orderkey").withColumn("days", F.abs(days).cast("double"))


_DURATIONS = "d AS (SELECT l_suppkey, l_returnflag, CAST(abs(date_diff('day', o_orderdate, l_shipdate)) AS DOUBLE) AS days FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


@query(
    "deadline_miss",
    f"""WITH {_DURATIONS}, p AS (SELECT l_returnflag, avg(days) AS mean FROM d GROUP BY ALL)
       SELECT l_suppkey, l_returnflag, count(*) AS jobs, count(*) FILTER (days > greatest(CAST(1.5 AS DOUBLE) * mean, 0.0001)) AS allowance_misses,
              count(*) FILTER (days > 3 * mean) AS reschedule_misses FROM d JOIN p USING (l_returnflag) GROUP BY ALL""",
)
def q_deadline_miss(spark, sf_dir):
    """Durations are long here against their mean, so half the usual factors are taken."""
    d = _durations(spark, sf_dir)
    predicted = d.groupBy("l_returnflag").agg(F.avg("days").alias("mean"))
    return deadline_misses(d.join(predicted, "l_returnflag"), ["l_suppkey", "l_returnflag"], "days", "mean", ALLOWANCE_FACTOR / 2, RESCHEDULE_FACTOR / 2)


def deadline_misses(jobs: DataFrame, keys: list[str], took: str, predicted: str, allowance: float = ALLOWANCE_FACTOR, reschedule: float = RESCHEDULE_FACTOR) -> DataFrame:
    t, p = F.col(took), F.col(predicted)
    return jobs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count(F.when(t > F.greatest(allowance * p, F.lit(LEAST_ALLOWANCE)), 1)).alias("allowance_misses"),
        F.count(F.when(t > reschedule * p, 1)).alias("reschedule_misses"),
    )


@query(
    "predicted_duration",
    f"WITH {_DURATIONS} SELECT l_suppkey, l_returnflag, round(avg(days) + coalesce(stddev_samp(days), 0), 5) AS predicted FROM d GROUP BY ALL",
)
def q_predicted_duration(spark, sf_dir):
    high = F.avg("days") + F.coalesce(F.stddev_samp("days"), F.lit(0.0))
    return _durations(spark, sf_dir).groupBy("l_suppkey", "l_returnflag").agg(F.round(high, 5).alias("predicted"))


def gossip_merge(known: DataFrame, heard: DataFrame, source: str, stamp: list[str]) -> DataFrame:
    """The newest record of each source; of equal stamps the known one stays."""
    both = known.withColumn("_own", F.lit(1)).unionByName(heard.withColumn("_own", F.lit(0)))
    values = [c for c in known.columns if c != source]
    return both.groupBy(source).agg(F.max_by(F.struct(*values), F.struct(*stamp, "_own")).alias("r")).select(source, "r.*")


@query(
    "gossip_merge",
    """SELECT user_id, ts, event_id, value FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def q_gossip_merge(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "event_type")
    dead = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("user_id"))
    alive = events.join(dead, "user_id", "left_anti")
    known, heard = alive.where("event_type = 'view'"), alive.where("event_type <> 'view'")
    return gossip_merge(known.drop("event_type"), heard.drop("event_type"), "user_id", ["ts", "event_id"])


@query(
    "stale_target",
    """WITH n AS (SELECT user_id, max(ts) + CASE WHEN user_id % 2 = 0 THEN INTERVAL 500 MILLISECOND ELSE INTERVAL 2500 MILLISECOND END AS next_update FROM events GROUP BY user_id)
       SELECT user_id, next_update FROM n WHERE next_update <= TIMESTAMP '2024-01-30 20:00:00' ORDER BY next_update, user_id LIMIT 1""",
)
def q_stale_target(spark, sf_dir):
    """The node whose next update is due first: half a second apart within a cluster, two and a half across."""
    step = F.when(F.col("user_id") % 2 == 0, F.expr("INTERVAL '0.5' SECOND")).otherwise(F.expr("INTERVAL '2.5' SECOND"))
    due = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("seen")).select("user_id", (F.col("seen") + step).alias("next_update"))
    return due.where(F.col("next_update") <= F.lit("2024-01-30 20:00:00").cast("timestamp_ntz")).orderBy("next_update", "user_id").limit(1)


@query(
    "urgent_marks",
    """SELECT user_id, least(max(ts) + INTERVAL 500 MILLISECOND, TIMESTAMP '2024-01-30 12:00:00') AS urgent, max(ts) + INTERVAL 2500 MILLISECOND AS recent FROM events GROUP BY user_id""",
)
def q_urgent_marks(spark, sf_dir):
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("seen"))
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    return seen.select("user_id", F.least(F.col("seen") + F.expr("INTERVAL '0.5' SECOND"), now).alias("urgent"), (F.col("seen") + F.expr("INTERVAL '2.5' SECOND")).alias("recent"))


@query(
    "recent_masters",
    """WITH s AS (SELECT event_type, user_id, max(ts) AS seen FROM events GROUP BY ALL)
       SELECT event_type, user_id, seen, row_number() OVER (PARTITION BY event_type ORDER BY seen DESC, user_id) AS place FROM s QUALIFY place <= 4""",
)
def q_recent_masters(spark, sf_dir):
    """The four masters seen last, per node; WindowGroupLimit keeps four a task before the shuffle."""
    seen = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.max("ts").alias("seen"))
    place = F.row_number().over(Window.partitionBy("event_type").orderBy(F.col("seen").desc(), "user_id"))
    return seen.withColumn("place", place).where("place <= 4")


@query(
    "fault_quota",
    """SELECT s_nationkey, count(*) AS nodes, CAST(floor(CAST(0.1 AS DOUBLE) + count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS victims FROM supplier GROUP BY s_nationkey""",
)
def q_fault_quota(spark, sf_dir):
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(n.alias("nodes"), F.floor(F.lit(0.1) + n * F.lit(0.2)).cast("long").alias("victims"))


@query(
    "proximity_rank",
    """WITH n AS (SELECT s_suppkey, s_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
       me AS (SELECT * FROM n WHERE s_suppkey = 0)
       SELECT n.s_suppkey, CAST(n.n_regionkey = me.n_regionkey AS INT) + CAST(n.s_nationkey = me.s_nationkey AS INT) AS levels, abs(n.s_suppkey - me.s_suppkey) AS distance,
              row_number() OVER (PARTITION BY n.n_regionkey ORDER BY CAST(n.s_nationkey = me.s_nationkey AS INT) DESC, abs(n.s_suppkey - me.s_suppkey), n.s_suppkey) AS place
       FROM n, me""",
)
def q_proximity_rank(spark, sf_dir):
    """Nodes by shared location levels with one node, then by distance of their ids, within each region."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    nodes = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(nation, "s_nationkey")
    me = nodes.where("s_suppkey = 0").first()  # one node's location
    same_nation, same_region = (F.col("s_nationkey") == me["s_nationkey"]).cast("int"), (F.col("n_regionkey") == me["n_regionkey"]).cast("int")
    distance = F.abs(F.col("s_suppkey") - me["s_suppkey"])
    w = Window.partitionBy("n_regionkey").orderBy(same_nation.desc(), distance, "s_suppkey")
    return nodes.select("s_suppkey", (same_region + same_nation).alias("levels"), distance.alias("distance"), F.row_number().over(w).alias("place"))


@query(
    "worker_activity",
    """SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS run_s, round((epoch_us(min(ts)) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6, 3) AS activation_s,
              round(100 * (1 - sum(value) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6)), 4) AS overhead_percent FROM events GROUP BY user_id""",
)
def q_worker_activity(spark, sf_dir):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    first, last = us(F.min("ts")), us(F.max("ts"))
    origin = 1_704_067_200_000_000
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.round((last - first) / 1e6, 3).alias("run_s"),
        F.round((first - F.lit(origin)) / 1e6, 3).alias("activation_s"),
        F.round(100 * (1 - F.sum("value") / ((last - first) / 1e6)), 4).alias("overhead_percent"),
    )


@query(
    "supported_filter",
    "SELECT p_type, count(*) AS jobs, count(*) FILTER (p_size % 2 = 0 OR p_type <> 'LARGE') AS supported FROM part GROUP BY p_type",
)
def q_supported_filter(spark, sf_dir):
    able = (F.col("p_size") % 2 == 0) | (F.col("p_type") != "LARGE")
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("jobs"), F.count(F.when(able, 1)).alias("supported"))


@query(
    "alternatives_min",
    """WITH c AS (SELECT p_type, p_brand, CASE WHEN avg(p_size) >= 25 THEN avg(p_retailprice) END AS cost FROM part GROUP BY ALL)
       SELECT p_type, p_brand AS chosen, round(cost, 4) AS cost FROM c WHERE cost IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY cost, p_brand) = 1""",
)
def q_alternatives_min(spark, sf_dir):
    """Of the implementations of a job type the cheapest; one whose parts are small on average isn't supported (no cost)."""
    costs = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.when(F.avg("p_size") >= 25, F.avg("p_retailprice")).alias("cost"))
    return best_worker(costs, ["p_type"], "p_brand", "cost").select("p_type", F.col("p_brand").alias("chosen"), F.round("cost", 4).alias("cost"))


@query(
    "initial_cost",
    "SELECT p_type, count(*) AS stages, round(sum(CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_retailprice END), 2) AS series_cost, round(min(CASE WHEN p_size % 5 = 0 THEN 'Infinity'::DOUBLE ELSE p_retailprice END), 2) AS cheapest FROM part GROUP BY p_type",
)
def q_initial_cost(spark, sf_dir):
    """A chain costs the sum of its steps, unsupported ones (infinite) counted as nothing."""
    cost = F.when(F.col("p_size") % 5 == 0, INFINITY).otherwise(F.col("p_retailprice"))
    return table(spark, sf_dir, "part").groupBy("p_type").agg(
        F.count(F.lit(1)).alias("stages"), F.round(F.sum(F.when(cost == INFINITY, 0.0).otherwise(cost)), 2).alias("series_cost"), F.round(F.min(cost), 2).alias("cheapest")
    )
