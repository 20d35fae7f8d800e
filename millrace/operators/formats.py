"""Queries over formatting functions, filesets and benchmark post-processing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.functions import formats as fm
from millrace.operators.order import with_previous
from millrace.session import table


@query(
    "format_seconds",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'infinite' WHEN s = 0 THEN '0 s' WHEN s < 1e-6 THEN printf('%4.1f', s * 1e9) || ' ns'
         WHEN s < 1e-3 THEN printf('%4.1f', s * 1e6) || ' us' WHEN s < 1 THEN printf('%4.1f', s * 1e3) || ' ms' ELSE printf('%4.1f', s) || ' s' END AS said
       FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE (o_orderkey % 89 + 1) / pow(10, o_orderkey % 10) END AS s FROM orders)""",
)
def q_format_seconds(spark, sf_dir):
    k = F.col("o_orderkey")
    s = F.when(k % 11 == 0, float("inf")).when(k % 7 == 0, 0.0).otherwise((k % 89 + 1) / F.pow(F.lit(10.0), k % 10))
    return table(spark, sf_dir, "orders").select("o_orderkey", fm.format_seconds(s).alias("said"))


def _cubed(key: str) -> Column:
    """The cube of a bigint as a whole decimal; as a bigint it is too large from 2,097,152 on."""
    k = F.col(key).cast("decimal(19,0)")
    return (k * k * k).cast("decimal(38,0)")


@query(
    "format_bytes",
    """SELECT o_orderkey, CASE WHEN n < 1000 THEN n || ' B' WHEN n < 1000000 THEN (n + 999) // 1000 || ' kB' WHEN n < 1000000000 THEN (n + 999999) // 1000000 || ' MB'
         WHEN n < 1000000000000 THEN (n + 999999999) // 1000000000 || ' GB' ELSE (n + 999999999999) // 1000000000000 || ' TB' END AS said FROM (SELECT o_orderkey, o_orderkey * o_orderkey * o_orderkey AS n FROM orders)""",
)
def q_format_bytes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", fm.format_bytes(_cubed("o_orderkey")).alias("said"))


def _scaled_sql(base: int, units: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN n > {base**i} THEN printf('%.2f', round(n / {base**i}, 2)) || ' {units[i]}'" for i in range(len(units) - 1, 0, -1))
    return f"SELECT o_orderkey, CASE {cases} ELSE printf('%.2f', n::DOUBLE) || ' {units[0]}' END AS said FROM (SELECT o_orderkey, o_orderkey * o_orderkey * o_orderkey * 10 + 3 AS n FROM orders)"


@query("size_hr", _scaled_sql(1024, fm.SIZE_UNITS))
def q_size_hr(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", fm.size_hr(_cubed("o_orderkey") * 10 + 3).alias("said"))


@query("rate_hr", _scaled_sql(1000, fm.RATE_UNITS))
def q_rate_hr(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", fm.rate_hr(_cubed("o_orderkey") * 10 + 3).alias("said"))


@query("padded_name", "SELECT o_orderkey, 'frame-' || CASE WHEN length(o_orderkey::VARCHAR) < 4 THEN lpad(o_orderkey::VARCHAR, 4, '0') ELSE o_orderkey::VARCHAR END || '.raw' AS name FROM orders")
def q_padded_name(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", fm.padded_name("frame-", F.col("o_orderkey"), 4, ".raw").alias("name"))


@query("ids_to_string", "SELECT o_orderkey, ',' || o_custkey || ',' || o_orderkey AS said FROM orders")
def q_ids_to_string(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", fm.ids_to_string(F.array("o_custkey", "o_orderkey")).alias("said"))


@query("round_up_div", "SELECT o_orderkey, (o_orderkey + 6) // 7 AS blocks FROM orders")
def q_round_up_div(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", fm.round_up_div(F.col("o_orderkey"), F.lit(7)).alias("blocks"))


@query(
    "typed_options",
    """SELECT doc_id, lang, coalesce(TRY_CAST(split_part(source, 'src', 2) AS INT), -1) AS rank, coalesce(TRY_CAST(lang AS INT), 48) AS bits FROM documents""",
)
def q_typed_options(spark, sf_dir):
    """Options as text, read as numbers with a default where they aren't."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.coalesce(F.split_part("source", F.lit("src"), F.lit(2)).try_cast("int"), F.lit(-1)).alias("rank"), F.coalesce(F.col("lang").try_cast("int"), F.lit(48)).alias("bits")
    )


@query(
    "fileset_filter",
    """SELECT rank, count(*) AS files, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT o_orderkey, o_orderkey % 5 AS rank FROM orders) GROUP BY rank""",
)
def q_fileset_filter(spark, sf_dir):
    """Numbered files dealt to five readers by number; the filter on one rank is rank_filter()."""
    files = table(spark, sf_dir, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(5)).alias("rank"))
    return files.groupBy("rank").agg(F.count(F.lit(1)).alias("files"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


def rank_filter(files: DataFrame, number: str, size: int, rank: int) -> DataFrame:
    return files if size <= 0 else files.where(F.pmod(number, F.lit(size)) == rank)


def fileset_shape(files: DataFrame, owner: str, number: str) -> DataFrame:
    """start, end, stride and whether the numbers are continuous or evenly strided, per owner; -1 where uneven."""
    steps = with_previous(files, [owner], F.floor(F.col(number) / 4096), [number], number, "_before").withColumn("_step", F.col(number) - F.col("_before"))
    g = steps.groupBy(owner).agg(F.count(F.lit(1)).alias("files"), F.min(number).alias("start"), F.max(number).alias("last"), F.min("_step").alias("lo"), F.max("_step").alias("hi"))
    stride = F.when(F.col("lo").isNull(), 1).when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(-1)
    return g.select(owner, "files", "start", "last", stride.cast("long").alias("stride"), (stride == 1).alias("continuous"))


@query(
    "fileset_shape",
    """WITH s AS (SELECT o_custkey, o_orderkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step FROM orders),
       g AS (SELECT o_custkey, count(*) AS files, min(o_orderkey) AS start, max(o_orderkey) AS last, min(step) AS lo, max(step) AS hi FROM s GROUP BY o_custkey)
       SELECT o_custkey, files, start, last, CASE WHEN lo IS NULL THEN 1 WHEN lo = hi THEN lo ELSE -1 END AS stride, CASE WHEN lo IS NULL THEN 1 WHEN lo = hi THEN lo ELSE -1 END = 1 AS continuous FROM g""",
)
def q_fileset_shape(spark, sf_dir):
    return fileset_shape(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


def placement_ok(replies: DataFrame, rank: str) -> DataFrame:
    """One row: do the nodes' listings (start, last, stride) make one fileset? Nodes are few, so one row each."""
    w = F.first_value
    first = Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = replies.withColumns({"n": F.count(F.lit(1)).over(first), "s0": w("start").over(first), "e0": w("last").over(first), "i": F.row_number().over(Window.orderBy(rank)) - 1})
    whole = (F.col("stride") == 1) & (F.col("start") == F.col("s0")) & (F.col("last") == F.col("e0"))
    dealt = (F.col("n") == F.col("stride")) & (F.col("start") == F.col("s0") + F.col("i")) & F.col("last").isin(F.col("e0") + F.col("i"), F.col("e0") - F.col("stride") + F.col("i"))
    return marked.agg(F.coalesce(F.min(whole) | F.min(dealt), F.lit(False)).alias("ok"), F.count(F.lit(1)).alias("replies"))


@query(
    "fileset_placement",
    """WITH s AS (SELECT o_orderkey % 5 AS rank, o_orderkey AS n, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_orderkey % 5 ORDER BY o_orderkey) AS step FROM orders),
       g AS (SELECT rank, min(n) AS start, max(n) AS last, CASE WHEN min(step) IS NULL THEN 1 WHEN min(step) = max(step) THEN min(step) ELSE -1 END AS stride FROM s GROUP BY rank),
       m AS (SELECT *, row_number() OVER (ORDER BY rank) - 1 AS i, count(*) OVER () AS n, first_value(start) OVER (ORDER BY rank) AS s0, first_value(last) OVER (ORDER BY rank) AS e0 FROM g)
       SELECT coalesce(bool_and(stride = 1 AND start = s0 AND last = e0) OR bool_and(n = stride AND start = s0 + i AND (last = e0 + i OR last = e0 - stride + i)), false) AS ok, count(*) AS replies FROM m""",
)
def q_fileset_placement(spark, sf_dir):
    dealt = table(spark, sf_dir, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(5)).alias("rank"))
    return placement_ok(fileset_shape(dealt, "rank", "o_orderkey"), "rank")


# Benchmark post-processing: rows as recorded logs give them.
_RUNS = ((1, 2000, (382_950_000_000, 382_940_000_000)), (20, 2000, (486_530_000_000, None, 486_550_000_000)), (80, 2000, (728_950_000_000,)), (64, 100, (None,)))
_COUNTS = ((0, (2008, 2010, 2003, 2000, 2001)), (1, (1500, 2600, 1999, 2001, 1990)), (2, (2100, 1400, 2050, 2000, 1980)), (3, (2000, 2004, 2006, 1999, 2002)))
_LEARN = ((4, 266.07, 32.08), (16, 282.33, 39.76), (64, 313.14, 61.04))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in rows)


_DUR = [(n, f, d) for n, f, ds in _RUNS for d in ds]


@query(
    "bench_avg_duration",
    f"""SELECT nodes, frames, count(d) AS runs, round(CAST(sum(d) // count(d) AS DOUBLE) * CAST(1e-9 AS DOUBLE), 6) AS seconds, round(CAST(sum(d) // count(d) AS DOUBLE) * CAST(1e-9 AS DOUBLE) / frames, 8) AS per_frame
        FROM (VALUES {_values(_DUR)}) t(nodes, frames, d) GROUP BY nodes, frames HAVING count(d) >= 1""",
)
def q_bench_avg_duration(spark, sf_dir):
    runs = spark.createDataFrame(_DUR, "nodes int, frames int, d long")
    mean = F.call_function("div", F.sum("d"), F.count("d"))
    g = runs.groupBy("nodes", "frames").agg(F.count("d").alias("runs"), F.when(F.count("d") > 0, mean).alias("m")).where("runs >= 1")
    seconds = F.col("m").cast("double") * 1e-9
    return g.select("nodes", "frames", "runs", F.round(seconds, 6).alias("seconds"), F.round(seconds / F.col("frames"), 8).alias("per_frame"))


_LOG = [
    (node, i, line)
    for node, counts in enumerate([(7, 5, 9), (4, 8, 2)])
    for i, line in enumerate([f"stage {k}" if j == 0 else f"executed {c} jobs" for k, c in zip(("generate", "scale", "sharpen"), counts, strict=True) for j in (0, 1)])
]


@query(
    "bench_job_counts",
    f"""WITH l AS (SELECT node, i, line, lag(line) OVER (PARTITION BY node ORDER BY i) AS before FROM (VALUES {_values(_LOG)}) t(node, i, line)),
        c AS (SELECT node, regexp_extract(before, 'stage ([a-z]+)', 1) AS stage, CAST(regexp_extract(line, 'executed ([0-9]+)', 1) AS INT) AS n FROM l WHERE line LIKE 'executed%')
        SELECT node, max(n) FILTER (stage = 'generate') AS generate, max(n) FILTER (stage = 'scale') AS scale, max(n) FILTER (stage = 'sharpen') AS sharpen FROM c GROUP BY node""",
)
def q_bench_job_counts(spark, sf_dir):
    log = spark.createDataFrame(_LOG, "node int, i int, line string")
    paired = log.withColumn("before", F.lag("line").over(Window.partitionBy("node").orderBy("i"))).where("line LIKE 'executed%'")
    counts = paired.select("node", F.regexp_extract("before", "stage ([a-z]+)", 1).alias("stage"), F.regexp_extract("line", "executed ([0-9]+)", 1).cast("int").alias("n"))
    return counts.groupBy("node").pivot("stage", ["generate", "scale", "sharpen"]).agg(F.max("n"))


_FLAT = [(r, *c) for r, c in _COUNTS]


@query(
    "bench_variation",
    f"""SELECT rank, c1, round(v, 4) AS variation, row_number() OVER (ORDER BY c1 // 500, v) - 1 AS place FROM (SELECT rank, c1,
        abs(c0 - m) + abs(c1 - m) + abs(c2 - m) + abs(c3 - m) + abs(c4 - m) AS v FROM (SELECT *, CAST(c0 + c1 + c2 + c3 + c4 AS DOUBLE) / 5 AS m FROM (VALUES {_values(_FLAT)}) t(rank, c0, c1, c2, c3, c4)))""",
)
def q_bench_variation(spark, sf_dir):
    counts = spark.createDataFrame([(r, list(c)) for r, c in _COUNTS], "rank int, c array<int>")
    mean = F.aggregate("c", F.lit(0), lambda a, x: a + x) / F.size("c")
    v = F.aggregate("c", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("m")))
    w = Window.orderBy(F.call_function("div", F.col("c1"), F.lit(500)), "v")
    return counts.withColumn("m", mean).select("rank", F.col("c")[1].alias("c1"), v.alias("v")).select("rank", "c1", F.round("v", 4).alias("variation"), (F.row_number().over(w) - 1).alias("place"))


@query("bench_subtract", f"SELECT nodes, round(full_s::DOUBLE - learn_s::DOUBLE, 4) AS net_s FROM (VALUES {_values(_LEARN)}) t(nodes, full_s, learn_s)")
def q_bench_subtract(spark, sf_dir):
    rows = spark.createDataFrame(_LEARN, "nodes int, full_s double, learn_s double")
    both = rows.select("nodes", "full_s").join(rows.select("nodes", "learn_s"), "nodes")
    return both.select("nodes", F.round(F.col("full_s") - F.col("learn_s"), 4).alias("net_s"))


@query("ideal_fault", "SELECT f::INT AS faulted, round(CAST(289.83 AS DOUBLE) / (1 - f / 30), 6) AS seconds FROM (VALUES (0), (5), (11), (17), (23)) t(f)")
def q_ideal_fault(spark, sf_dir):
    return spark.createDataFrame([(0,), (5,), (11,), (17,), (23,)], "faulted int").select("faulted", F.round(289.83 / (1 - F.col("faulted") / 30), 6).alias("seconds"))


@query(
    "runtime_budget",
    "SELECT jobs::INT AS jobs, greatest(300, jobs)::INT AS budget, greatest(300, trunc(CAST(0.7 AS DOUBLE) * trunc(2000 / (1 - f))))::INT AS fault_budget FROM (VALUES (100, CAST(0.0 AS DOUBLE)), (1000, CAST(0.5 AS DOUBLE)), (2000, CAST(0.8 AS DOUBLE))) t(jobs, f)",
)
def q_runtime_budget(spark, sf_dir):
    rows = spark.createDataFrame([(100, 0.0), (1000, 0.5), (2000, 0.8)], "jobs int, f double")
    fault = F.greatest(F.lit(300), (0.7 * (2000 / (1 - F.col("f"))).cast("int")).cast("int"))
    return rows.select("jobs", F.greatest(F.lit(300), F.col("jobs")).alias("budget"), fault.alias("fault_budget"))


_VARIANTS = ("plain", "parallel", "onejob", "no", "slow", "oneslow")
_ARGS = {"parallel": "-parallelscaling", "onejob": "-onejob", "no": "-oddnoscale -evennosharpen", "slow": "-oddslowscale -evenslowsharpen", "oneslow": "-onejob -oddslowscale -evenslowsharpen"}


@query(
    "experiment_plan",
    "SELECT v AS variant, n::INT AS nodes, trim(a || ' -frames ' || n * 2000) AS args FROM (VALUES "
    + ", ".join(f"('{v}', '{_ARGS.get(v, '')}')" for v in _VARIANTS)
    + ") t(v, a), (VALUES (1), (20), (80)) s(n)",
)
def q_experiment_plan(spark, sf_dir):
    variants = spark.createDataFrame([(v, _ARGS.get(v, "")) for v in _VARIANTS], "variant string, a string")
    return variants.withColumn("nodes", F.explode(F.array(F.lit(1), F.lit(20), F.lit(80)))).select(
        "variant", "nodes", F.trim(F.concat("a", F.lit(" -frames "), (F.col("nodes") * 2000).cast("string"))).alias("args")
    )
