"""Cases in which an operator once did less than the whole job."""

import corpus_pipeline as cp
from millrace.llm import op03_decontaminate as op3


def test_decontamination_in_slices_keeps_rows_apart(spark):
    """Equal doc_ids, null ones and equal numbers of words, with the benchmark in one automaton and in several."""
    a, b = (" ".join(f"{c}{i}" for i in range(20)) for c in "ab")
    rows = [(1, a), (1, b), (None, a), (None, b), (None, "x " * 20), (1, a), (2, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(1, a), (2, b), (3, b)], "item_id long, text string")
    said = lambda limit: sorted(str((r["doc_id"], r["n_words"], r["n_hit"], r["items"])) for r in op3.find_contamination(docs, bench, limit).collect())
    none, one, two = (20, 0, []), (20, 20, ["1"]), (20, 20, ["2", "3"])
    expected = [(1, *one), (1, *two), (None, *one), (None, *two), (None, *none), (1, *one), (2, 0, 0, []), (None, 0, 0, [])]
    assert said(op3.STATES) == said(200) == said(300) == said(600) == sorted(map(str, expected))


def test_decontamination_of_nameless_items_and_clashing_columns(spark):
    """A null item_id is one item, left out of the joined ids; drop_contaminated leaves other columns as they are."""
    a, b = (" ".join(f"{c}{i}" for i in range(20)) for c in "ab")
    docs = spark.createDataFrame([(1, f"{a} {b}", "x", "y"), (2, a, "x", "y"), (3, "clean words", "x", "y"), (4, None, "x", "y")], "doc_id long, text string, _doc string, items string")
    bench = spark.createDataFrame([(None, a), (7, b), (8, None), (9, "")], "item_id long, text string")
    for limit in (op3.STATES, 192):
        got = {r["doc_id"]: r["items"] for r in op3.find_contamination(docs, bench, limit).collect()}
        assert got == {1: ["7", None], 2: [None], 3: [], 4: []}
        left = op3.drop_contaminated(docs, bench, limit)
        assert left.columns == docs.columns and sorted(tuple(r) for r in left.collect()) == [(3, "clean words", "x", "y"), (4, None, "x", "y")]


def rows_of(spark, pairs):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in pairs], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_dedup_stage_links_at_80_percent(spark):
    """Two words of 120 changed far apart: 106 of 126 shingles are common. Three: 101 of 131."""
    w = [f"w{i}" for i in range(120)]
    changed = lambda at: " ".join(f"n{i}" if i in at else x for i, x in enumerate(w))
    docs = rows_of(spark, [(1, " ".join(w)), (2, changed((30, 60))), (3, changed((20, 50, 80)))])
    assert sorted(r["doc_id"] for r in cp.near_dedup(spark, docs, "").collect()) == [1, 3]


def test_stages_decide_by_row(spark, tmp_path):
    """Null and repeated doc_ids: one row of a group of copies stays, each text is judged on its own."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    pairs = [(None, a), (None, a), (3, a), (3, a), (5, b), (5, c), (7, c), (None, d), (None, d), (8, "alone"), (9, b), (10, None)]
    left = cp.near_dedup(spark, rows_of(spark, pairs), "").collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in left) == sorted(map(str, [(3, a), (5, b), (5, c), (None, d), (8, "alone"), (10, None)]))

    spark.createDataFrame([(1, d)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = cp.decontaminate(spark, rows_of(spark, [(None, d), (None, a), (4, d), (4, b), (None, None)]), str(tmp_path)).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in clean) == sorted(map(str, [(None, a), (4, b), (None, None)]))


def test_one_short_item_is_no_leak(spark, tmp_path):
    """Items under eight words count by two; one window of eight is enough, in one automaton or several."""
    long = "one two three four five six seven eight nine"
    items = [(1, "paris"), (2, "forty two"), (3, long)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = rows_of(spark, [(1, "spring in Paris"), (2, "Paris, forty two"), (3, f"so {long}"), (4, "two three four five six seven eight"), (5, "two three four five six seven eight nine")])
    assert sorted(r["doc_id"] for r in cp.decontaminate(spark, docs, str(tmp_path)).collect()) == [1, 4]
    for limit in (op3.STATES, 192, 300):
        assert {r["doc_id"] for r in op3.find_contamination(docs, bench, limit).where("whole").collect()} == {3, 5}
