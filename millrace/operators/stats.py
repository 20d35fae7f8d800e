"""Throughput statistics of pipeline components (flagship)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.operators.order import day_bucket, indexed, with_previous, with_running_sum, with_total_before
from millrace.session import table


def component_stats(items: DataFrame, component: str, size_in: str, size_out: str) -> DataFrame:
    """One partial and one final aggregation: items, bytes in and out, mean sizes per component."""
    return items.groupBy(F.col(component).alias("component")).agg(
        F.count(F.lit(1)).alias("items"),
        F.round(F.sum(size_in), 2).alias("total_in"),
        F.round(F.sum(size_out), 2).alias("total_out"),
        F.round(F.sum(size_out) / F.sum(size_in), 6).alias("out_per_in"),
    )


@query(
    "component_stats",
    """
    SELECT l_returnflag AS component, count(*) AS items, round(sum(l_quantity), 2) AS total_in,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS total_out,
           round(sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity), 6) AS out_per_in
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag
    """,
)
def q_component_stats(spark, sf_dir):
    items = (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        .withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    )
    return component_stats(items, "l_returnflag", "l_quantity", "net")


def throughput(items: DataFrame, keys: list[str], images: str, total_ms: str, busy_ms: str, size_in: str, size_out: str) -> DataFrame:
    """Idle time and share, time and size of an item (whole numbers), overall and processing bit rates."""
    g = items.groupBy(*keys).agg(
        F.sum(images).cast("long").alias("images"),
        F.sum(total_ms).cast("long").alias("total_ms"),
        F.sum(busy_ms).cast("long").alias("busy_ms"),
        F.sum(size_in).cast("long").alias("bytes_in"),
        F.sum(size_out).cast("long").alias("bytes_out"),
    )
    whole = lambda a, b: F.when(b > 0, F.call_function("div", a, b))
    rate = lambda size, ms: F.when(ms > 0, F.round(size * 8 * 1000 / ms, 4))
    c = F.col
    return g.withColumns(
        {
            "idle_ms": c("total_ms") - c("busy_ms"),
            "idle_percent": whole((c("total_ms") - c("busy_ms")) * 100, c("total_ms")),
            "ms_per_image": whole(c("busy_ms"), c("images")),
            "bytes_per_image": whole(c("bytes_in"), c("images")),
            "rate": rate(c("bytes_in"), c("total_ms")),
            "busy_rate": rate(c("bytes_in"), c("busy_ms")),
        }
    )


@query(
    "component_throughput",
    """WITH g AS (SELECT l_suppkey AS component, count(*) AS images, CAST(sum(CAST(l_extendedprice AS BIGINT)) AS BIGINT) AS total_ms,
              CAST(sum(CAST(trunc(l_extendedprice * (1 - l_discount)) AS BIGINT)) AS BIGINT) AS busy_ms,
              CAST(sum(CAST(l_quantity AS BIGINT) * 1000) AS BIGINT) AS bytes_in, CAST(sum(CAST(l_quantity AS BIGINT) * 10) AS BIGINT) AS bytes_out
       FROM (SELECT * REPLACE (trunc(l_extendedprice) AS l_extendedprice), l_extendedprice AS p FROM lineitem) GROUP BY l_suppkey)
       SELECT *, total_ms - busy_ms AS idle_ms, (total_ms - busy_ms) * 100 // total_ms AS idle_percent, busy_ms // images AS ms_per_image,
              bytes_in // images AS bytes_per_image, round(bytes_in * 8 * 1000 / total_ms, 4) AS rate, round(bytes_in * 8 * 1000 / busy_ms, 4) AS busy_rate FROM g""",
)
def q_component_throughput(spark, sf_dir):
    price = F.floor("l_extendedprice").cast("long")
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("component"),
        F.lit(1).alias("one"),
        price.alias("total"),
        (price.cast("double") * (1 - F.col("l_discount"))).cast("long").alias("busy"),
        (F.col("l_quantity").cast("long") * 1000).alias("size_in"),
        (F.col("l_quantity").cast("long") * 10).alias("size_out"),
    )
    return throughput(items, ["component"], "one", "total", "busy", "size_in", "size_out")


def type_rollup(ranks: DataFrame, kind: str, size: str, total_ms: str) -> DataFrame:
    """Rates of a type over its ranks: sizes add up, times are averaged."""
    return ranks.groupBy(kind).agg(
        F.count(F.lit(1)).alias("ranks"),
        F.sum(size).alias("bytes"),
        F.round(F.sum(size) * 8 * 1000 / (F.sum(total_ms) / F.count(F.lit(1))), 4).alias("rate"),
    )


@query(
    "type_rollup",
    """WITH r AS (SELECT l_returnflag AS kind, l_suppkey AS rank, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS size, count(*) * 40 AS total
                  FROM lineitem GROUP BY l_returnflag, l_suppkey)
       SELECT kind, count(*) AS ranks, CAST(sum(size) AS BIGINT) AS bytes, round(sum(size) * 8 * 1000 / (sum(total) / count(*)), 4) AS rate FROM r GROUP BY kind""",
)
def q_type_rollup(spark, sf_dir):
    ranks = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("kind"), "l_suppkey").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("size"), (F.count(F.lit(1)) * 40).alias("total")
    )
    return type_rollup(ranks, "kind", "size", "total")


def latest(records: DataFrame, key: str, order: list[str], *values: str) -> DataFrame:
    """Newest record of each key: one aggregation, no sort."""
    newest = F.max_by(F.struct(*values), F.struct(*order))
    return records.groupBy(key).agg(newest.alias("r")).select(key, "r.*")


@query(
    "progress_latest",
    "SELECT user_id, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def q_progress_latest(spark, sf_dir):
    return latest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "ts", "event_id", "value")


def frame_rate(arrivals: DataFrame, keys: list[str], ts: str, number: str) -> DataFrame:
    """Frames, mean gap and rate, and how many frames came out of order, per key."""
    order = [ts, number]
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    seen = arrivals.withColumns({"_us": us, "_seen": F.struct(us.alias("us"), F.col(number).alias("number"))})
    lagged = with_previous(seen, keys, day_bucket(ts), order, "_seen", "_before").withColumn("_last", F.col("_before.number"))
    gap = F.col("_us") - F.col("_before.us")
    return lagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        F.round(F.avg(gap / 1000.0), 3).alias("mean_gap_ms"),
        F.round(F.count(gap) * 1e6 / F.sum(gap), 9).alias("fps"),
        F.sum(F.when(F.col(number) != F.col("_last") + 1, 1).otherwise(0)).alias("out_of_order"),
    )


@query(
    "frame_rate",
    """WITH l AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap, lag(event_id) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
       SELECT user_id, count(*) AS frames, round(avg(gap / 1000.0), 3) AS mean_gap_ms, round(count(gap) * 1e6 / sum(gap), 9) AS fps,
              CAST(sum(CASE WHEN event_id <> last + 1 THEN 1 ELSE 0 END) AS BIGINT) AS out_of_order FROM l GROUP BY user_id""",
)
def q_frame_rate(spark, sf_dir):
    return frame_rate(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id")


@query(
    "throughput_per_hour",
    """SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
)
def q_throughput_per_hour(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour")["start"].alias("bucket"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "destination_stats",
    """SELECT user_id, count(*) AS messages, CAST(sum(length(props)) AS BIGINT) AS bytes,
              rank() OVER (ORDER BY count(*) DESC, sum(length(props)) DESC) AS place FROM events GROUP BY user_id""",
)
def q_destination_stats(spark, sf_dir):
    """Messages and bytes per destination, most first; ranks come from numbered rows, not from one task."""
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.length("props")).alias("bytes"))
    # Each (messages, bytes) pair once, with the destinations that come before it.
    pairs = per.groupBy("messages", "bytes").agg(F.count(F.lit(1)).alias("n"))
    places = with_total_before(pairs, [(-F.col("messages")).alias("m"), (-F.col("bytes")).alias("b")], "n", "before")
    return per.join(places, ["messages", "bytes"]).select("user_id", "messages", "bytes", (F.col("before") + 1).alias("place"))


@query(
    "work_stats",
    """SELECT l_suppkey AS node, l_returnflag AS job_type, count(*) AS jobs, round(sum(l_quantity), 2) AS total_s, round(avg(l_quantity), 6) AS mean_s,
              round(100 * sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_suppkey), 6) AS percent FROM lineitem GROUP BY l_suppkey, l_returnflag""",
)
def q_work_stats(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("node"), F.col("l_returnflag").alias("job_type")).agg(
        F.count(F.lit(1)).alias("jobs"), F.sum("l_quantity").alias("s"), F.round(F.avg("l_quantity"), 6).alias("mean_s")
    )
    share = F.round(100 * F.col("s") / F.sum("s").over(Window.partitionBy("node")), 6)
    return per.select("node", "job_type", "jobs", F.round("s", 2).alias("total_s"), "mean_s", share.alias("percent"))


@query(
    "rr_split",
    """SELECT target, count(*) AS items, CAST(sum(o_orderkey) AS BIGINT) AS key_sum, min(o_orderkey) AS first
       FROM (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) % 4 AS target FROM orders) GROUP BY target""",
)
def q_rr_split(spark, sf_dir):
    dealt = rr_split(table(spark, sf_dir, "orders").select("o_orderkey"), 4, "o_orderkey")
    return dealt.groupBy("target").agg(F.count(F.lit(1)).alias("items"), F.sum("o_orderkey").alias("key_sum"), F.min("o_orderkey").alias("first"))


def rr_split(items: DataFrame, n: int, order: str, *ties: str) -> DataFrame:
    """items with seq (from 0, in order), target (dealt round-robin) and turn (position within the target)."""
    return indexed(items, order, *ties, name="seq").withColumns({"target": F.pmod("seq", F.lit(n)), "turn": F.floor(F.col("seq") / n).cast("long")})


def rr_merge(dealt: DataFrame, n: int) -> DataFrame:
    """The position each item has when targets are read in turn: split and merge give the order back."""
    return dealt.withColumn("merged", F.col("turn") * n + F.col("target"))


@query("rr_merge", "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS merged FROM orders")
def q_rr_merge(spark, sf_dir):
    dealt = rr_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 4, "o_custkey", "o_orderkey")
    return rr_merge(dealt, 4).select("o_orderkey", "o_custkey", "merged")


@query(
    "union_merge",
    """SELECT o_orderstatus, count(*) AS items, round(sum(o_totalprice), 2) AS total FROM
       (SELECT * FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT * FROM orders WHERE o_orderstatus <> 'F') GROUP BY ALL""",
)
def q_union_merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", "o_totalprice")
    both = orders.where("o_orderstatus = 'F'").unionByName(orders.where("o_orderstatus <> 'F'"))
    return both.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "gop_blocks",
    """SELECT block, count(*) AS frames, min(event_id) AS first, round(sum(value), 4) AS size FROM (SELECT *, event_id // 30 AS block FROM events) GROUP BY block""",
)
def q_gop_blocks(spark, sf_dir):
    """Count-tumbling blocks of 30 frames by frame number; the tail is a shorter block."""
    block = F.floor(F.col("event_id") / 30).cast("long").alias("block")
    return table(spark, sf_dir, "events").groupBy(block).agg(F.count(F.lit(1)).alias("frames"), F.min("event_id").alias("first"), F.round(F.sum("value"), 4).alias("size"))


@query(
    "codec_accumulate",
    """SELECT event_id, event_id // 12 AS block, round(sum(value) OVER (PARTITION BY event_id // 12 ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS size_so_far,
              row_number() OVER (PARTITION BY event_id // 12 ORDER BY event_id) = 12 AS emits FROM events""",
)
def q_codec_accumulate(spark, sf_dir):
    """A codec that takes 12 inputs for one output: sizes add up and start again; the last of a block emits."""
    w = Window.partitionBy("block").orderBy("event_id")
    items = table(spark, sf_dir, "events").withColumn("block", F.floor(F.col("event_id") / 12).cast("long"))
    return items.select(
        "event_id",
        "block",
        F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("size_so_far"),
        (F.row_number().over(w) == 12).alias("emits"),
    )


@query(
    "backlog_window",
    """WITH b AS (SELECT user_id, ts, event_id, sum(CASE WHEN event_type IN ('signup', 'view') THEN 1 ELSE -1 END)
                         OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS backlog FROM events)
       SELECT user_id, CAST(max(backlog) AS BIGINT) AS most, CAST(min(backlog) AS BIGINT) AS least, count(*) FILTER (backlog > 3) AS over_limit FROM b GROUP BY user_id""",
)
def q_backlog_window(spark, sf_dir):
    step = F.when(F.col("event_type").isin("signup", "view"), 1).otherwise(-1)
    run = with_running_sum(table(spark, sf_dir, "events").withColumn("step", step), ["user_id"], day_bucket("ts"), ["ts", "event_id"], "step", "backlog")
    return run.groupBy("user_id").agg(F.max("backlog").alias("most"), F.min("backlog").alias("least"), F.count(F.when(F.col("backlog") > 3, 1)).alias("over_limit"))


def cache_use(log: DataFrame, owner: str, order: list[str], target: str, keep: int) -> DataFrame:
    """owner, uses, hits, misses, evicted and held: a least-recently-used cache of each owner, replayed over its log.

    When a target comes in, the one used longest ago goes if over `keep` are held and it wasn't among the last `keep` uses.
    What is held depends on all uses before, so an owner's log is replayed in one place, in batches; what is kept in
    between is the cache alone. Null targets are a target like others.
    """
    kinds = dict(log.dtypes)
    schema = f"`{owner}` {kinds[owner]}, uses long, hits long, misses long, evicted long, held long"

    def run(batches):
        # Owners come one after another, each in its order; a batch may hold several and an owner several batches.
        name, state, kind = None, None, None
        for batch in batches:
            out, kind = [], batch.schema.field(owner).type
            for o, t in zip(batch.column(owner).to_pylist(), batch.column("_target").to_pylist(), strict=True):
                if state is None or o != name:
                    if state is not None:
                        out.append(state.row(name))
                    name, state = o, _Cache(keep)
                state.use(t)
            yield _cache_rows(out, kind, owner)
        if state is not None:
            yield _cache_rows([state.row(name)], kind, owner)

    ordered = log.select(owner, *order, F.col(target).alias("_target")).repartition(owner).sortWithinPartitions(owner, *order)
    return ordered.select(owner, "_target").mapInArrow(run, schema)


class _Cache:
    def __init__(self, keep: int):
        self.keep, self.held = keep, {}
        self.uses = self.hits = self.evicted = 0

    def use(self, t) -> None:
        self.uses += 1
        known = self.held.pop(t, None)
        self.held[t] = self.uses
        if known is not None:
            self.hits += 1
            return
        eldest = next(iter(self.held))
        if len(self.held) > self.keep and self.held[eldest] + self.keep < self.uses:
            del self.held[eldest]
            self.evicted += 1

    def row(self, name) -> tuple:
        return name, self.uses, self.hits, self.uses - self.hits, self.evicted, len(self.held)


def _cache_rows(rows: list[tuple], kind: pa.DataType, owner: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, *[pa.int64()] * 5), strict=True)], names=[owner, "uses", "hits", "misses", "evicted", "held"])


@query(
    "connection_cache",
    """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id % 13 AS d FROM events),
       r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, CAST([] AS STRUCT(d BIGINT, used BIGINT)[]) AS held, 0::BIGINT AS hits, 0::BIGINT AS evicted FROM events
         UNION ALL
         SELECT user_id, i, CASE WHEN goes THEN held[2:] ELSE held END, hits + CASE WHEN hit THEN 1 ELSE 0 END, evicted + CASE WHEN goes THEN 1 ELSE 0 END FROM (
           SELECT *, NOT hit AND len(held) > 5 AND held[1].used + 5 < i AS goes FROM (
             SELECT e.user_id, e.i, list_append(list_filter(r.held, lambda x: x.d <> e.d), {'d': e.d, 'used': e.i}) AS held, len(list_filter(r.held, lambda x: x.d = e.d)) > 0 AS hit, r.hits, r.evicted
             FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)))
       SELECT user_id, i AS uses, hits, i - hits AS misses, evicted, len(held) AS held FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""",
)
def q_connection_cache(spark, sf_dir):
    """Each user's log of targets through a cache of five."""
    log = table(spark, sf_dir, "events").withColumn("target", F.pmod("event_id", F.lit(13)))
    return cache_use(log, "user_id", ["ts", "event_id"], "target", 5)
