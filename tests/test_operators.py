from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace import catalog
from millrace.functions import formats as fm
from millrace.operators import formats, labels, sched, stats
from millrace.operators.order import day_bucket, indexed, with_previous, with_running_sum


def test_label_log(spark):
    def state(issued, returned):
        i = spark.createDataFrame([(x,) for x in issued], "label long")
        r = spark.createDataFrame([(x,) for x in returned], "label long")
        return labels.label_state(i, r).first()

    log = [((), (), 0, 0, True), ((0,), (), 1, 0, False), ((0,), (0, 0), 1, 1, True), ((0, 1, 2, 3), (0, 3, 1), 4, 3, False), ((0, 1, 2, 3), (0, 3, 1, 2, 2), 4, 4, True)]
    for issued, returned, a, b, done in log:
        s = state(issued, returned)
        assert (s["issued"], s["returned"], s["all_returned"]) == (a, b, done) and s["issued"] == s["returned"] + s["outstanding"]
    assert state((0, 1, 2, 3), (0, 3, 1))["first_gap"] == 2 and state((0, 1), (0, 1, 1))["first_gap"] == 2
    assert state((0, 1), (0, 1, 1))["duplicates"] == 1


def test_golden_component_statistics(spark):
    df = spark.createDataFrame([("gen", 1, 1777, 893, 49_766_400, 0)] * 9 + [("gen", 1, 1785, 899, 49_766_400, 0)], "c string, one int, total int, busy int, i long, o long")
    r = stats.throughput(df, ["c"], "one", "total", "busy", "i", "o").first()
    assert (r["images"], r["total_ms"], r["busy_ms"], r["idle_ms"], r["idle_percent"], r["ms_per_image"]) == (10, 17_778, 8_936, 8_842, 49, 893)
    said = spark.range(1).select(fm.size_hr(F.lit(497_664_000)), fm.rate_hr(F.lit(r["rate"])), fm.rate_hr(F.lit(r["busy_rate"]))).first()
    assert tuple(said) == ("474.61 MB", "223.95 MBit/s", "445.54 MBit/s")


def test_golden_frame_rate(spark):
    gaps = [9747, 1969, 1896, 1917, 1971, 1552, 2179, 1816, 1679, 1624]
    at = datetime(2024, 1, 1, 23, 59, 50)
    rows = []
    for i, g in enumerate(gaps):
        at += timedelta(milliseconds=g)
        rows.append(("k", at, i))
    df = spark.createDataFrame(rows, "k string, ts timestamp, n long")
    r = stats.frame_rate(df, ["k"], "ts", "n").first()
    # Rates go over the gaps between frames; the first frame has none.
    assert r["fps"] == pytest.approx(9000 / sum(gaps[1:])) and r["out_of_order"] == 0


def test_gossip_and_remaining_time(spark):
    known = spark.createDataFrame([("a", 5, 1), ("b", 2, 1)], "node string, ts int, v int")
    heard = spark.createDataFrame([("a", 5, 9), ("b", 3, 9), ("c", 1, 9)], "node string, ts int, v int")
    assert {(r["node"], r["v"]) for r in sched.gossip_merge(known, heard, "node", ["ts"]).collect()} == {("a", 1), ("b", 9), ("c", 9)}
    stages = spark.createDataFrame([("t", i, x + (1 + q) * d + e) for i, (x, q, d, e) in enumerate([(0.4, 1, 0.1, 1.0), (0.3, 2, 0.2, 2.0), (0.2, 3, 0.3, 3.0)])], "k string, stage int, s double")
    assert [round(r["remaining_s"], 6) for r in sched.remaining_time(stages, "k", "stage", "s", 0.2).orderBy("stage").collect()] == [9.5, 7.7, 4.6]


def test_queue_order_and_estimates(spark):
    df = spark.createDataFrame([([1, 0],), ([0, 1],), ([0],), ([2],)], "ids array<long>")
    assert [r["ids"] for r in df.orderBy("ids").collect()] == [[0], [0, 1], [1, 0], [2]]
    est = spark.createDataFrame([("j", "b", 1.0), ("j", "a", 1.0), ("j", "c", None), ("k", "a", None)], "job string, node string, e double")
    assert [tuple(r) for r in sched.best_worker(est, ["job"], "node", "e").collect()] == [("j", "a", 1.0)]


@pytest.mark.parametrize("n", [0, 1, 50])
def test_indexing_and_look_back(spark, n):
    rows = [(i % 3, (i * 7) % 11, i) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, v int, id int")
    got = sorted((r["v"], r["id"], r["ix"]) for r in indexed(df, "v", "id", buckets=4).collect())
    assert [g[2] for g in got] == list(range(n))
    run = with_running_sum(df, ["k"], F.floor(F.col("id") / 7), ["id"], "v", "s")
    run = with_previous(run, ["k"], F.floor(F.col("id") / 7), ["id"], "v", "p")
    seen: dict = {}
    total: dict = {}
    for r in sorted(run.collect(), key=lambda r: r["id"]):
        assert r["p"] == seen.get(r["k"])
        total[r["k"]] = total.get(r["k"], 0) + r["v"]
        assert r["s"] == total[r["k"]]
        seen[r["k"]] = r["v"]
    dealt = stats.rr_merge(stats.rr_split(df, 4, "v", "id"), 4)
    assert all(r["merged"] == r["seq"] for r in dealt.collect())


def test_formats(spark):
    row = spark.range(1).select(
        fm.format_seconds(F.lit(0.0)), fm.format_seconds(F.lit(float("inf"))), fm.format_seconds(F.lit(2.5e-7)), fm.format_seconds(F.lit(0.0123)), fm.format_bytes(F.lit(1001)), fm.padded_name("f", F.lit(12345), 3, ".x"), fm.ids_to_string(F.array(F.lit(1), F.lit(2))),
    ).first()
    assert tuple(row) == ("0 s", "infinite", "250.0 ns", "12.3 ms", "2 kB", "f12345.x", ",1,2")


def test_fileset_checks(spark):
    whole = spark.createDataFrame([(r, i) for r in range(2) for i in range(5)], "rank int, n int")
    dealt = spark.createDataFrame([(i % 3, i) for i in range(10)], "rank int, n int")
    broken = spark.createDataFrame([(i % 3, i) for i in range(10) if i != 4], "rank int, n int")
    results = [formats.placement_ok(formats.fileset_shape(d, "rank", "n"), "rank").first()["ok"] for d in (whole, dealt, broken, whole.limit(0))]
    assert results == [True, True, False, False]


def test_late_and_orphaned_jobs(spark):
    jobs = spark.createDataFrame([(1, "a", datetime(2024, 1, 1)), (2, "b", datetime(2024, 1, 2))], "id int, node string, ts timestamp")
    dead = spark.createDataFrame([("b",)], "node string")
    assert [r["id"] for r in labels.orphans(jobs, dead, "node").collect()] == [2]
    assert [r["id"] for r in labels.eligible(jobs, dead, ["node"]).collect()] == [1]
    assert [r["id"] for r in labels.late_job(jobs, "ts", "id", datetime(2024, 1, 3), 0.3).collect()] == [1]
    assert labels.late_job(jobs, "ts", "id", datetime(2023, 1, 3), 0.3).collect() == []
    assert [r["id"] for r in labels.exactly_once(jobs.unionByName(jobs), "id").orderBy("id").collect()] == [1, 2]
    assert jobs.select(day_bucket("ts")).distinct().count() == 2


def big_orders(spark, tmp_path):
    keys = [0, 1, 10, 899_999, 2_097_151, 2_097_152, 8_999_999, 1_000_000_007]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    return keys


def test_format_bytes_of_large_keys(spark, tmp_path):
    keys = big_orders(spark, tmp_path)
    units = [(10**3, 1, "B"), (10**6, 10**3, "kB"), (10**9, 10**6, "MB"), (10**12, 10**9, "GB"), (10**99, 10**12, "TB")]
    said = {k: next(f"{-(-(k**3) // by)} {unit}" for top, by, unit in units if k**3 < top) for k in keys}
    assert {r["o_orderkey"]: r["said"] for r in formats.q_format_bytes(spark, str(tmp_path)).collect()} == said


def scaled(n, base, units):
    i = next((i for i in range(len(units) - 1, 0, -1) if n > base**i), 0)
    return f"{n / base**i:.2f} {units[i]}"


def test_rate_hr_of_large_keys(spark, tmp_path):
    said = {k: scaled(k**3 * 10 + 3, 1000, fm.RATE_UNITS) for k in big_orders(spark, tmp_path)}
    assert {r["o_orderkey"]: r["said"] for r in formats.q_rate_hr(spark, str(tmp_path)).collect()} == said


def test_size_hr_of_large_keys(spark, tmp_path):
    said = {k: scaled(k**3 * 10 + 3, 1024, fm.SIZE_UNITS) for k in big_orders(spark, tmp_path)}
    assert {r["o_orderkey"]: r["said"] for r in formats.q_size_hr(spark, str(tmp_path)).collect()} == said


def test_ew_estimator_of_samples_without_a_logarithm(spark, tmp_path):
    at = datetime(2024, 1, 1)
    odd = {0: {}, 1: {2: 0.0}, 2: {0: None}, 3: {i: None for i in range(5)}, 4: {i: 0.0 for i in range(5)}, 5: {1: -2.0}, 6: {1: float("inf")}, 7: {1: float("inf"), 3: 0.0}, 8: {4: 0.0}, 9: {2: float("nan")}}
    rows = [(k * 10 + i, k, at + timedelta(hours=9 * i), values.get(i, 1.5 + i)) for k, values in odd.items() for i in range(5)]
    # So many samples after it that a zero's weight is 0, within a day and over several.
    rows += [(1000 + i, 10 + k, at + timedelta(seconds=i * step), 0.0 if i == 0 else 2.0) for k, step in enumerate((1, 60)) for i in range(3500)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, value double")
    events.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    said = {r[0]: r for r in con.execute(catalog.oracle_sql()["ew_estimator"]).fetchall()}
    got = {r["user_id"]: tuple(r[c] for c in ("user_id", "samples", "log_mean", "likely")) for r in catalog.queries()["ew_estimator"](spark, str(tmp_path)).collect()}
    assert len(got) == 12 and {k: str(r) for k, r in got.items()} == {k: str(r) for k, r in said.items()}


def test_dispatch_scan_takes_the_fronts_of_queues(spark, monkeypatch):
    """Long, short, far-off and empty queues; ids that begin alike; more free workers than jobs."""
    queues = {"a": [[i // 3, i % 3] for i in range(3000)], "b": [[5, i] for i in range(40)] + [[10**9, 0]], "c": [[10**12 + i] for i in range(5)], "d": [[-7, 1]], "f": [[None, 1], [4], [9]]}
    workers = {"a": 70, "b": 12, "c": 9, "d": 0, "e": 4, "f": 2}
    queue = spark.createDataFrame([(k, i) for k, jobs in queues.items() for i in jobs], "k string, ids array<long>")
    free = spark.createDataFrame(list(workers.items()), "k string, free long")
    low = lambda ids: [(i is not None, i or 0) for i in ids]
    goes = [(k, i) for k, jobs in queues.items() for i in sorted(jobs, key=low)[: workers[k]]]
    got = sched.dispatch_scan(queue, free, "k", "ids").orderBy("turn").collect()
    assert [r["turn"] for r in got] == list(range(1, len(goes) + 1))
    assert [(r["k"], r["ids"]) for r in got] == sorted(goes, key=lambda g: low(g[1]))
    front = sched.queue_fronts(queue, free, "k", "ids")
    assert front.where("k = 'a'").count() < 300 and front.where("k = 'c'").count() == 5
    assert sched.dispatch_scan(queue.limit(0), free, "k", "ids").count() == 0


def test_dispatch_of_one_step(spark):
    queues = {"a": [[3, 1], [3], [2, 9], [2, 8, 1], [2, 8]], "b": [[1], []], "c": [[1], [None, 2], [None, 1]], "d": [None, [7]], "e": [None], "f": [[1]], "g": [[-5, 2], [-5, 1]]}
    queue = spark.createDataFrame([(k, i) for k, jobs in queues.items() for i in jobs] * 2, "k string, ids array<long>")
    free = spark.createDataFrame([(k, 0 if k == "f" else 1) for k in queues], "k string, free long")
    got = {r["k"]: r["ids"] for r in sched.dispatch(queue, free, "k", "ids").collect()}
    assert got == {"a": [2, 8], "b": [], "c": [None, 1], "d": [7], "e": None, "g": [-5, 1]}


def test_dispatch_sorts_only_what_begins_alike(spark, tmp_path):
    spark.range(20_000).selectExpr("'A' AS l_returnflag", "id AS l_orderkey", "id % 50 AS l_suppkey").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    df = catalog.queries()["dispatch_step"](spark, str(tmp_path))
    assert [tuple(r) for r in df.collect()] == [("A", 0)]
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # Least first ids by hash aggregation; what is sorted has met them in a broadcast join before.
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
    assert "HashAggregate(keys=[l_returnflag" in plan and plan.index("SortAggregate") < plan.index("BroadcastHashJoin")
