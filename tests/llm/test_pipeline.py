from collections import Counter

import brute

import corpus_pipeline as cp
from millrace.llm import op02_mixing, op07_quality


def test_stages_follow_the_contract():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "mix_sources", "shard"]


def test_pipeline_against_plain_stages(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    text = {r[0]: r[1] for r in rows}
    good = {r["doc_id"] for r in op07_quality.quality(docs).where("kept").collect()}
    pairs = [(d, t) for d, t in text.items() if d in good]
    groups = brute.near_groups(pairs)
    pairs = [(d, t) for d, t in pairs if groups[d][2]]
    leaked = next(t for _, t in pairs if len(t.split()) > 30)
    items = [(1, " ".join(leaked.split()[5:20])), (2, "nothing like it")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [tuple(r) for r in cp.run(spark, str(tmp_path)).collect()]

    dirty = brute.contamination(pairs, items)
    assert any(v[2] for v in dirty.values())
    left = [(d, t) for d, t in pairs if not dirty[d][2]]
    source = {r[0]: r[3] for r in rows}
    names = sorted({source[d] for d, _ in left if source[d]}) + [None] * any(source[d] is None for d, _ in left)
    sizes = [sum(len(brute.words(t)) for d, t in left if source[d] == s) for s in names]
    copies = Counter(r[0] for r in got)
    assert set(copies) <= {d for d, _ in left} and max(copies.values()) <= 2
    for s, target in zip(names, op02_mixing.targets_of(sizes), strict=True):
        mine = [(d, len(brute.words(t))) for d, t in left if source[d] == s]
        assert abs(sum(n * copies[d] for d, n in mine) - target) <= max(n for _, n in mine)
    assert sorted(got) == sorted(brute.shards([(d, text[d]) for d in copies.elements()]))


def test_stages_take_an_empty_table(spark, empty, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for i, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, empty, str(tmp_path))
        assert out.collect() == []
        if i < len(cp.STAGES) - 1:
            assert tuple(out.columns) == cp.COLUMNS


def test_stages_take_edge_rows_and_clashing_columns(spark, tmp_path):
    """Null ids, sources and texts, repeated rows, a very long text, and columns named like those the operators add."""
    from conftest import SCHEMA, clashing

    good = "This text has enough words. It goes on for a while, and then it ends, as texts do. "
    long = " ".join(f"{good}{i}" for i in range(3000))
    texts = [good * 2, None, "", " \n\t", long, good * 2 + "more of it", "short one"]
    rows = [(d, t, "en", s, len(t or "")) for i, t in enumerate(texts) for d, s in ((None, None), (i, "a"), (i, "a"), (i, "b"))]
    spark.createDataFrame([(1, "none of this occurs in there at all, not a word"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = clashing(spark.createDataFrame(rows, SCHEMA))
    for name in ("_row", "_doc", "_text", "_unit", "_group", "_stays"):
        docs = docs.withColumn(name, docs["lang"])
    given = {tuple(r) for r in rows}
    for i, (name, stage) in enumerate(cp.STAGES):
        df = stage(spark, docs, str(tmp_path))
        out = df.collect()
        if i == len(cp.STAGES) - 1:
            assert len(out) == len(rows) and {r["shard"] for r in out} <= set(range(cp.SHARDS))
        else:
            assert {tuple(r) for r in out} <= given and tuple(df.columns) == cp.COLUMNS
            if name == "decontaminate":
                assert len(out) == len(rows)
            if name == "near_dedup":
                kept = [r["text"] for r in out]
                assert kept.count(long) == 1 and kept.count(good * 2) + kept.count(good * 2 + "more of it") == 1
