import math

import pytest
from pyspark.sql import functions as F

from millrace.plans import dsl
from millrace.plans.jobs import Alternatives, Atomic, Catalog, Parallel, Series
from millrace.sources import queries as _kinds  # noqa: F401  registers stage kinds


def step(name="", **more):
    return Atomic(lambda d: d, name, **more)


def test_registration_is_dense_idempotent_and_flattens():
    j1, j11, j2, new = step("j1"), step("j11"), step("j2"), step("new")
    s = Series(j1, j11, j2)
    s2 = Series(j1, j1, j2, s)
    s3 = Series(new, new, new, s2)
    c = Catalog()
    sizes = []
    for job in (j1, j1, j11, j2, s, s2, s3):
        c.register(job)
        sizes.append(len(c))
    assert sizes == [1, 1, 2, 3, 4, 5, 7]
    assert [len(c.todo[c.register(j).index]) for j in (j1, s, s2, s3)] == [1, 3, 6, 9]
    assert c.stage(s, 1) == c.register(j11).index
    assert sorted(t.index for t in c.types.values()) == list(range(7))
    assert len(s3.steps()) == sum(len(j.steps()) for j in (new, new, new, s2))


def test_costs_and_support():
    able = step("able", seconds=2.0)
    unable = step("unable", seconds=1.0, on=lambda node: node == "b")
    assert unable.cost("a") == math.inf and unable.cost("b") == 1.0
    assert Series(able, unable).cost("a") == 2.0
    assert Series(able, unable).supported("a") and not Series(unable, able).supported("a")
    assert Series().supported() and Series().cost() == 0
    both = Alternatives(able, unable)
    assert both.cost("b") == 1.0 and both.choose("b") is unable and both.choose("a") is able
    assert Alternatives(unable).cost("a") == math.inf
    with pytest.raises(ValueError):
        Alternatives(unable).choose("a")


def test_series_and_unpredictable_run(spark):
    double = Atomic(lambda d: d.withColumn("id", F.col("id") * 2), unpredictable=True)
    assert sorted(r["id"] for r in Series(double, double).run(spark.range(4)).collect()) == [0, 4, 8, 12]
    assert Catalog().register(double).unpredictable


def test_split_merge_gives_the_input_back(spark):
    df = spark.createDataFrame([(1, "abcdef"), (2, "xy"), (3, "")], "k int, t string")
    job = Parallel(
        "k", lambda d: F.split("t", ""), step(), lambda: [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_ix", "part"))), lambda x: x["part"]), "").alias("t")]
    )
    assert {(r["k"], r["t"]) for r in job.run(df).collect()} == {(1, "abcdef"), (2, "xy"), (3, "")}


GOOD = """
component gen generate  # source
component small scale
component deep torgb48
component count count
options small width=4 height=3
pipeline p 1 gen:2 2 3:small 2 deep 1 count
deploy p
"""


def test_pipeline_compiles():
    components, queues = dsl.compile_pipeline(dsl.parse(GOOD))
    assert [c.rank for c in components] == [0, 0, 1, 0, 1, 0]
    assert [(q.kind, q.length) for q in queues] == [("split", 3), ("simple", 1), ("simple", 1), ("merge", 1)]
    assert queues[0].get == ("get.1.0", "get.1.1") and queues[-1].put == ("put.2.0", "put.2.1")


@pytest.mark.parametrize(
    "change",
    [
        ("component gen generate", "part gen generate"),
        ("component small scale", "component gen scale"),
        ("1 count\n", "1 nothing\n"),
        ("2 deep", "3 deep"),
        ("2 3:small 2 deep", "2 deep 2 small"),
        ("width=4 height=3", "width=4 width=3"),
        ("deploy p", "deploy q"),
        ("component count count", "component count whatever"),
        ("2 3:small", "0 3:small"),
    ],
)
def test_pipeline_errors(change):
    with pytest.raises(dsl.PipelineError):
        dsl.compile_pipeline(dsl.parse(GOOD.replace(*change, 1)))


def test_options_and_filesets(spark):
    o = dsl.Options({"n": "3", "f": "x", "b": "Yes"})
    assert o.typed("n", int) == 3 and o.typed("b", bool) is True and o.typed("m", float, 1.5) == 1.5
    for bad in (lambda: o.typed("f", int), lambda: o.typed("q", int, required=True)):
        with pytest.raises(dsl.PipelineError):
            bad()
    assert dsl.parse_fileset("/data/waag%%%.raw") == dsl.Fileset(False, "/data", "waag", ".raw", 3)
    with pytest.raises(dsl.PipelineError):
        dsl.parse_fileset("nothing.raw")


def test_pipeline_runs(spark):
    from millrace.operators.pixels import gradient_frames

    out = dsl.run_pipeline(dsl.parse(GOOD), gradient_frames(spark).withColumnRenamed("frameno", "number")).collect()
    assert len(out) == 4 and all(len(r["data"]) == 4 * 3 * 3 and max(r["data"]) <= 255 * 255 for r in out)


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    """Only a local session may fall back on a temporary folder; scratch tables go when they are asked to."""
    import millrace.session as session

    path = session.scratch(spark, "t")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3 and session.tidy(spark) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session)


def test_plans_cut_before_they_shuffle(spark):
    """The rank of a search is limited before the exchange; a queue's places don't come from a window on its bare key."""
    from millrace.operators import sched, search

    hits = spark.createDataFrame([("q", "n", 1)], "query string, name string, score long")
    plan = search.top_k(hits, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("WindowGroupLimit") > plan.rindex("Exchange")
    jobs = spark.range(1000).selectExpr("id % 3 AS queue", "array(id, 0L) AS ids")
    plan = sched.in_queue_order(jobs, ["queue"], "ids")._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(queue" in plan and "_b#" in plan.split("windowspecdefinition(queue")[1].split(",")[1]


def test_parallel_in_a_row_moves_nothing(spark):
    """The same as the shuffled form, without an exchange; rows without parts stay."""
    from millrace.plans.jobs import ParallelInRow

    df = spark.createDataFrame([(1, [3, 4]), (2, []), (3, [5])], "id int, xs array<int>")
    job = ParallelInRow(lambda d: F.col("xs"), lambda x, i: x * 10 + i, lambda r: [F.aggregate(r, F.lit(0), lambda a, v: a + v).alias("total"), F.size(r).alias("n")])
    out = job.run(df)
    assert sorted((r["id"], r["total"], r["n"]) for r in out.collect()) == [(1, 71, 2), (2, 0, 0), (3, 50, 1)]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    merged = Parallel("id", lambda d: F.col("xs"), Atomic(lambda d: d.withColumn("v", F.col("part") * 10 + F.col("part_ix"))), lambda: [F.sum("v").alias("total"), F.count("v").alias("n")])
    assert sorted((r["id"], r["total"], r["n"]) for r in merged.run(df).collect()) == [(1, 71, 2), (3, 50, 1)]

