"""Each operator against a plain version, and its edges."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import clashing
from pyspark.sql import functions as F

from millrace.llm import op01_sharding as op1
from millrace.llm import op02_mixing as op2
from millrace.llm import op03_decontaminate as op3
from millrace.llm import op04_suffix_dedup as op4
from millrace.llm import op05_line_templates as op5
from millrace.llm import op06_token_counts as op6
from millrace.llm import op07_quality as op7
from millrace.llm import op08_minhash as op8
from millrace.llm import op10_secrets as op10
from millrace.llm._common import scratch
from millrace.llm._graph import components


def test_sharding(docs, pairs, empty):
    got = sorted(tuple(r) for r in op1.shard(clashing(docs), 8, partitions=3).collect())
    assert got == sorted(brute.shards(pairs))
    assert op1.shard(empty, 8).collect() == []
    one = op1.shard(docs.where("doc_id = 0"), 8).collect()
    assert len(one) == 1 and one[0]["slot"] == 0
    twice = op1.shard(docs.unionByName(docs), 8).groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.countDistinct("slot").alias("d")).collect()
    assert all(r["lo"] == 0 and r["hi"] == r["n"] - 1 == r["d"] - 1 for r in twice)


def test_sharding_keeps_rows_of_null_and_repeated_ids(spark):
    rows = [(None, "a"), (None, "a"), (None, "bb"), (1, "ccc"), (1, "d"), (1, None), (2, "e" * 5000)]
    got = op1.shard(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(d), len(t or "") + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_mixing_targets():
    assert op2.targets_of([100, 100, 100], share=1.5) == pytest.approx([200, 166.66666, 83.33333])
    assert op2.targets_of([10, 1000], share=1.5) == pytest.approx([20, 1495])
    assert op2.targets_of([0, 0]) == [0, 0] and op2.targets_of([]) == []
    assert sum(op2.targets_of([5, 50, 500, 1, 7])) == pytest.approx(1.5 * 563)


def test_mixing(docs, rows, empty):
    out = op2.mix(clashing(docs)).collect()
    assert len(out) == len(rows)
    again = {r["doc_id"]: r["copies"] for r in op2.mix(docs.repartition(2)).collect()}
    taken, source, most = Counter(), {}, Counter()
    for r in out:
        n = len(brute.words(r["text"]))
        assert r["size"] == n and 0 <= r["copies"] <= 2 and again[r["doc_id"]] == r["copies"]
        taken[r["source"]] += n * r["copies"]
        source[r["source"]] = (r["source_size"], r["target"])
        most[r["source"]] = max(most[r["source"]], n)
    names = sorted(k for k in source if k is not None) + [None]
    expected = op2.targets_of([source[k][0] for k in names])
    assert [source[k][1] for k in names] == pytest.approx(expected)
    assert all(abs(taken[k] - source[k][1]) <= most[k] for k in names)
    assert op2.mix(empty).collect() == []
    both = op2.mix(docs.unionByName(docs)).groupBy("doc_id").agg(F.countDistinct("copies").alias("n")).where("n > 1").count()
    assert both == 0


def test_pivotal_rounding_keeps_words_and_expectations():
    rng = np.random.default_rng(0)
    w = np.sort(rng.integers(1, 500, 300))[::-1].copy()
    hits, totals = np.zeros(300), []
    for i in range(200):
        p = op2.round_block(np.arange(300) + 1000 * i, w, np.full(300, 0.3), rng.random(300), False)
        assert ((p == 0) | (p == 1)).sum() >= 299 and (p * w).sum() == pytest.approx(0.3 * w.sum())
        q = op2.round_block(np.arange(300) + 1000 * i, w, np.full(300, 0.3), rng.random(300), True)
        assert set(q) <= {0.0, 1.0}
        hits += q
        totals.append((q * w).sum())
    assert abs(hits.mean() / 200 - 0.3) < 0.01 and np.abs(hits / 200 - 0.3).max() < 0.15


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Raise one water level by bisection until the capped targets add up."""
    w = [weights[i % 3] for i in range(len(sizes))]
    lo, hi = 0.0, 4.0 * sum(sizes) + 1
    for _ in range(200):
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(min(most * s, level * x) for s, x in zip(sizes, w, strict=True)) < share * sum(sizes) else (lo, level)
    return [min(most * s, lo * x) for s, x in zip(sizes, w, strict=True)]


def test_mixing_targets_against_bisection():
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 7, 40):
        sizes = [int(x) for x in rng.pareto(1.1, n) * 100 + 1]
        assert op2.targets_of(sizes) == pytest.approx(plain_targets(sizes), rel=1e-6)


def test_pivotal_rounding_ends_on_a_small_document():
    """A few documents hold most of the words: the miss is no more than a small one."""
    rng = np.random.default_rng(9)
    w = np.sort((rng.pareto(1.2, 800) * 50 + 20).astype(np.int64))[::-1].copy()
    small = np.quantile(w, 0.25)
    hits = np.zeros(800)
    for i in range(300):
        q = op2.round_block(np.arange(800) + 1000 * i, w, np.full(800, 0.37), rng.random(800), True)
        assert abs((q * w).sum() - 0.37 * w.sum()) <= small
        hits += q
    assert abs(hits.mean() / 300 - 0.37) < 0.01 and np.abs(hits[:20].mean() / 300 - 0.37) < 0.05 and np.abs(hits[-200:].mean() / 300 - 0.37) < 0.02


def test_mixing_keeps_rows_of_null_and_repeated_ids(spark):
    rows = [(None, "a b c", "s"), (None, "a b c", "s"), (None, "d e", None), (1, "a b", "s"), (1, "c d e f", "s"), (1, None, "s"), (2, "", "s"), (3, " \t\n", None)]
    out = op2.mix(clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()
    assert sorted((str(r["doc_id"]), str(r["text"]), str(r["source"]), r["size"]) for r in out) == sorted((str(d), str(t), str(s), len((t or "").split())) for d, t, s in rows)


def test_mixing_tree_leaves_nothing(docs, monkeypatch):
    monkeypatch.setattr(op2, "FAN_IN", 2)
    out = op2.copies(docs, block_rows=3).collect()
    assert all(float(r["copies"]).is_integer() for r in out)
    by = defaultdict(list)
    for r in out:
        by[r["source_size"], r["target"]].append(r["size"] * r["copies"])
    assert len(out) <= docs.count()


def test_decontamination(docs, pairs, spark, empty):
    texts = {d: t for d, t in pairs}
    long = texts[90].split("\n")[1]
    items = [(1, long), (2, " ".join(long.split()[3:20]).upper()), (3, "one"), (4, None), (5, " ,, "), (6, "zzz yyy"), (10, long), (7, texts[0])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    expected = brute.contamination(pairs, items)
    for limit in (op3.STATES, 1200, 300):
        got = op3.find_contamination(clashing(docs), bench, limit)
        found = {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), len(r["items"]) >= 2) for r in got.collect()}
        assert found == expected
    assert any(v[4] for v in expected.values())
    spans = {limit: {r["doc_id"]: r["spans"] for r in op3.find_contamination(docs, bench, limit).collect()} for limit in (op3.STATES, 300)}
    assert spans[op3.STATES] == spans[300]
    for r in op3.find_contamination(docs, bench).collect():
        text = texts[r["doc_id"]]
        words = [w for s in r["spans"] for w in op3.words_of(text[s["start"] : s["end"]].encode())]
        assert len(words) == r["n_hit"]
    assert op3.find_contamination(empty, bench).collect() == []
    assert {r["n_hit"] for r in op3.find_contamination(docs, bench.limit(0)).collect()} == {0}


@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 18), (3000, 64)])
def test_suffix_dedup(docs, pairs, sizes):
    got = op4.remove_repeats(clashing(docs), texts=True, block_bytes=sizes[0], bucket_samples=sizes[1]).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute.repeats(pairs)
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got)


def test_suffix_dedup_deals_hot_samples(spark, monkeypatch):
    """A 20-byte string in every document with other surroundings in each, some of them repeated, and a periodic text."""
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz "
    around = lambda n: "".join(rng.choices(letters, k=n))
    shared = [around(60) for _ in range(4)]
    rows = []
    for i in range(120):
        before, after = (rng.choice(shared) if rng.random() < 0.3 else around(40) for _ in range(2))
        rows.append((i, f"{before}COMMON-STRING-OF-20B{after}" + (f" {before[-20:]}COMMON-STRING-OF-20B" if i % 5 == 0 else "")))
    rows += [(200 + i, "xy" * (30 + i)) for i in range(6)]
    monkeypatch.setattr(op4, "HOT_RUNS", 2)
    monkeypatch.setattr(op4, "TOLD_RUNS", 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = op4.remove_repeats(docs, block_bytes=800, bucket_samples=64).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute.repeats(rows)
    low = min((around(20) for _ in range(3000)), key=lambda x: op4.hashes(np.frombuffer(x.encode(), np.uint8))[2][0])  # a sample wherever it stands
    texts = [f"{around(45)}{low}{around(45)}" for _ in range(400)]
    block = op4.Block(pa.table({"doc_id": pa.array(range(400)), "text": pa.array([t.encode() for t in texts])}))
    block.runs(64)
    windows = (block.last - block.first + 1).sum()
    name, n = np.unique(op4._name(block.bucket, block.key), return_counts=True)
    assert n.max() > 300
    block.deal(name[n > 20], 64)
    # No window is lost, and what went to one bucket goes to many.
    assert block.dealt.any() and (block.last - block.first + 1).sum() == windows
    assert np.unique(op4._name(block.bucket, block.key)[block.dealt], return_counts=True)[1].max() < 5


def test_suffix_dedup_edges(docs, empty, spark):
    assert op4.remove_repeats(empty).collect() == []
    same = spark.createDataFrame([(1, "y" * 60), (1, "y" * 60), (None, "y" * 60), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in op4.remove_repeats(same).collect()) == [(-1, 0), (-1, 60), (1, 0), (1, 0)]


def test_suffix_ranks_fall_back_on_doubling(monkeypatch):
    text, starts = b"abcabcabcx" * 30, np.arange(0, 240, 3)
    good = op4.rank(text, starts)
    monkeypatch.setattr(op4, "_join", lambda a, b, odd: a * 0)
    bad = op4.rank(text, starts)
    assert [x == y for x in good for y in good] == [x == y for x in bad for y in bad]


def test_line_templates(docs, rows, empty):
    out = {r["doc_id"]: r for r in op5.drop_templates(clashing(docs)).collect()}
    assert len(out) == len(rows)
    for d, t, *_ in rows:
        if t is None:
            assert out[d]["text"] is None
        elif t.startswith("GET "):
            assert out[d]["n_dropped"] == 1 and out[d]["text"] == ""
        elif out[d]["n_dropped"] == 0:
            assert out[d]["text"] == t
        else:
            kept = out[d]["text"].split("\n")
            assert [x for x in t.split("\n") if x in kept] == [x for x in kept if x]
    assert sum(r["n_dropped"] for r in out.values()) >= 14
    assert op5.drop_templates(empty).collect() == []
    plan = op5.drop_templates(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_line_templates_do_not_fade_with_size(spark):
    """Lines of one template with names, days and numbers as variables: all go at every size; so do short repeats."""
    rng = random.Random(3)
    names = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(500)]
    for n in (100, 1000, 20_000):
        rows = [(i, f"Posted by {rng.choice(names)} on day{i % 365} at {i % 1440}:{i % 60} from {rng.choice(names)} views {i * 7}\nown {'x' * (i % 50)} prose {i} of {rng.choice(names)} {rng.choice(names)}\nAll rights reserved.") for i in range(n)]
        out = op5.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.sum("n_dropped").alias("d"), F.sum(F.col("text").contains("Posted").cast("int")).alias("p"), F.sum(F.col("text").contains("reserved").cast("int")).alias("r")).first()
        assert (out["p"], out["r"]) == (0, 0) and out["d"] >= 2 * n


def test_line_templates_keep_rows_apart(spark):
    """Equal rows count as one document; rows that share a doc_id or have none go by their texts."""
    line = "the same words in every one of them"
    rows = [(1, line), (1, line), (1, line), (None, f"{line}\nmore"), (None, "alone here in this table"), (2, None), (3, " \n\t"), (4, "")]
    said = lambda rows: sorted(str((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"])) for r in op5.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    kept = [(1, line, 1, 0)] * 3 + [(None, f"{line}\nmore", 2, 0), (None, "alone here in this table", 1, 0), (2, None, 0, 0), (3, " \n\t", 0, 0), (4, "", 0, 0)]
    assert said(rows) == sorted(map(str, kept))
    gone = [(1, "", 1, 1)] * 3 + [(None, "more", 2, 1), (None, "alone here in this table", 1, 0), (2, None, 0, 0), (3, " \n\t", 0, 0), (4, "", 0, 0), (4, "y", 2, 1)]
    assert said([*rows, (4, f"y\n{line}")]) == sorted(map(str, gone))


def test_line_templates_take_hot_lines_apart(spark, monkeypatch):
    """Every key hot, and every leaf salted: the same rows."""
    rows = [(i, "\n".join([f"GET /item/{i} took {i} ms from cache", "license text that all have", f"user {chr(97 + i % 26)}{chr(97 + i % 7)} logged in from home", f"line {i} only here {i}"])) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, op5.drop_templates(docs).collect()))
    monkeypatch.setattr(op5, "HOT", 1 << 30)
    monkeypatch.setattr(op5, "SALT_KINDS", 2)
    assert sorted(map(tuple, op5.drop_templates(docs).collect())) == plain
    assert sum(r[-1] for r in plain) >= 240


def test_line_templates_oracle(docs, spark):
    import duckdb

    con = duckdb.connect()
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841
    con.register("documents", documents)
    got = op5.drop_templates(docs).select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5")).collect()
    rel = con.sql(op5.ORACLE)
    assert sorted(tuple(r[c] for c in rel.columns) for r in got) == sorted(rel.fetchall())


def test_token_rollup(docs, rows, spark, empty):
    counts = op6.counted(docs)
    got = {r["doc_id"]: (r["bpe"], r["words"]) for r in counts.collect()}
    import public_tokenizers

    enc = op6._encoder(op6.VOCABULARY, public_tokenizers.PATTERN)
    assert got == {d: (len(enc.encode_ordinary(t or "")), len(brute.words(t))) for d, t, *_ in rows}
    assert all(enc.decode(enc.encode_ordinary(t or "")) == (t or "") for _, t, *_ in rows[:20])

    assert op6.counted(clashing(empty)).collect() == [] and op6.counted(clashing(docs.unionByName(docs))).count() == 2 * len(rows)


@pytest.mark.parametrize("fold_at", [2, 16])
def test_token_rollup_totals(docs, rows, spark, empty, fold_at):
    roll = op6.TokenRollup(spark, scratch(spark, "rollup"), fold_at)
    assert roll.totals().collect() == []
    one = lambda n, d=docs: clashing(d).select("source", "lang", F.lit("v1").alias("tokenizer"), F.lit(n).alias("tokens"), "docs" if "docs" in d.columns else F.lit("x").alias("docs"))
    n = Counter(r[3] for r in rows)
    total = lambda: {r["source"]: (r["docs"], r["tokens"]) for r in roll.totals().collect()}
    assert roll.commit("a", op6.inserts(one(5)))
    assert not roll.commit("a", op6.inserts(one(5)))
    assert total() == {k: (v, 5 * v) for k, v in n.items()}
    assert roll.commit("b", op6.revisions(one(5), one(7)))
    assert total() == {k: (v, 7 * v) for k, v in n.items()}
    assert roll.commit("c", op6.deletes(one(7, docs.where("source = 's1'"))))
    assert roll.commit("d", op6.inserts(one(7, empty)))
    assert roll.commit("e", op6.inserts(one(None, docs.where("source = 's2'")))) and not roll.commit("b", op6.inserts(one(1)))
    expected = {k: (v * (2 if k == "s2" else 1), 7 * v) for k, v in n.items() if k != "s1"}
    assert total() == expected
    assert bool(roll._stored()) == (fold_at == 2) and len(roll._names("batches")) == (1 if fold_at == 2 else 5)
    roll.fold()
    roll.fold()
    assert total() == expected and roll._names("batches") == [] and not roll.commit("c", op6.inserts(one(1)))
    for name in ("../x", "_x", ".x", ""):
        with pytest.raises(ValueError):
            roll.commit(name, op6.inserts(one(1)))


def test_token_rollup_survives_a_crash_anywhere(docs, rows, spark, monkeypatch):
    """Fail at each step that touches the folder; the next run commits the same batches again."""
    one = docs.select("source", "lang", F.lit("v1").alias("tokenizer"), F.lit(3).alias("tokens"))
    n = len(rows)
    for crash in range(12):
        roll = op6.TokenRollup(spark, scratch(spark, "rollup"), fold_at=2)
        steps = iter(range(1000))
        doing = {"_settle": op6.TokenRollup._settle, "_tidy": op6.TokenRollup._tidy, "fold": op6.TokenRollup.fold, "_aside": op6.TokenRollup._aside}

        def failing(name, steps=steps, crash=crash, doing=doing):
            def run(self, *args):
                if next(steps) == crash:
                    raise OSError("lost")
                return doing[name](self, *args)

            return run

        ended = False
        with monkeypatch.context() as m:
            for name in doing:
                m.setattr(op6.TokenRollup, name, failing(name))
            try:
                for batch in ("a", "b", "c"):
                    roll.commit(batch, op6.inserts(one))
                ended = True
            except OSError:
                pass
        assert roll.totals().agg(F.sum("docs")).first()[0] in (None, n, 2 * n, 3 * n)
        for batch in ("a", "b", "c"):
            roll.commit(batch, op6.inserts(one))
        assert roll.totals().agg(F.sum("docs"), F.sum("tokens")).first() == (3 * n, 9 * n)
        if ended:
            break
    assert ended and crash > 5


def test_token_rollup_query_against_plain_version(spark, docs, rows, tmp_path):
    import public_tokenizers

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    enc = op6._encoder(op6.VOCABULARY, public_tokenizers.PATTERN)
    expected = defaultdict(lambda: [0, 0])
    for _, t, lang, source, _ in rows:
        words, bpe = len(brute.words(t)), len(enc.encode_ordinary(t or ""))
        for tokenizer, tokens in (("words-2", words + 1), *([(op6.BPE, bpe)] if bpe >= 16 else [])):
            expected[source, lang, tokenizer][0] += 1
            expected[source, lang, tokenizer][1] += tokens
    got = {(r["source"], r["lang"], r["tokenizer"]): [r["docs"], r["tokens"]] for r in op6.op6_token_rollup(spark, str(tmp_path)).collect()}
    assert got == dict(expected)


def test_quality(docs, pairs, empty, rows):
    got = {r["doc_id"]: r for r in op7.quality(clashing(docs)).collect()}
    for d, t in pairs:
        r, counts = got[d], brute.quality_counts(t)
        assert tuple(r[c] for c in op7.FEATURES[:5]) == counts
        assert r["base_failed"] == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert not (r["base_failed"] and r["kept"])
    assert op7.quality(empty).collect() == []
    kept = op7.reject(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d in got if got[d]["kept"]}


def test_quality_verdict_against_plain_version(docs, pairs):
    got = {r["doc_id"]: r for r in op7.quality(docs).collect()}
    votes = [brute.quality_votes(t) for _, t in pairs]
    for (d, t), v, p in zip(pairs, votes, brute.good_probabilities(votes), strict=True):
        n, *_, repeated = brute.quality_counts(t)
        failed = n < 10 or 100 * repeated > 20 * n
        assert (got[d]["votes"], got[d]["base_failed"]) == (v, failed)
        assert got[d]["posterior"] == pytest.approx(p, abs=1e-9) and got[d]["kept"] == (not failed and p >= 0.05)
    assert any("b" in v for v in votes) and 5 < sum(r["kept"] for r in got.values()) < len(got)


def test_quality_keeps_rows_apart(spark):
    good = ("this text has words. it goes on for some time, and then it ends. " * 2).strip()
    rows = [(None, good), (None, good), (None, "### ### ###"), (1, good), (1, "x"), (1, None), (2, "")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("_row", F.lit("y")).withColumn("_text", F.lit("z"))
    got = op7.quality(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in got) == sorted((str(d), len((t or "").split())) for d, t in rows)
    left = op7.reject(docs)
    assert left.columns == docs.columns and {(r["_row"], r["_text"], r["size"]) for r in left.collect()} <= {("y", "z", "x")}
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == [("1", good), ("None", good), ("None", good)] or left.count() == 0


def test_quality_em_finds_bad_kinds():
    patterns = {"gggggggggg": 900, "gggggg-ggg": 60, "bbbggggggg": 30, "gggbbggggg": 25, "bggggggggg": 8, "g" * 9 + "-": 10}
    post, _ = op7.estimate(patterns)
    assert post["gggggggggg"] > 0.99 and post["bbbggggggg"] < 0.01 and post["gggbbggggg"] < 0.01 and post["bggggggggg"] > op7.KEEP_AT
    assert op7.estimate({})[0] == {}


def test_near_groups(docs, pairs, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in op8.groups(clashing(docs)).collect()}
    assert got == brute.near_groups(pairs)
    assert sum(not v[2] for v in got.values()) >= 6
    assert op8.groups(empty).collect() == []
    left = op8.dedup(docs)
    assert left.columns == docs.columns and left.count() == sum(v[2] for v in got.values())


def test_near_groups_of_drifting_copies(spark):
    """A chain of copies, each two words from the last: one component, found through links that no centre has."""
    w = [f"v{i}" for i in range(150)]
    rows = []
    for i in range(40):
        rows.append((1000 - i, " ".join(w)))
        w = list(w)
        w[(i * 7) % 150] = f"n{i}"
    rows += [(2000 + i, " ".join([*(f"v{j}" for j in range(110)), *(f"q{i}-{j}" for j in range(40))])) for i in range(25)]
    rows.append((None, "a b c d e f"))
    got = op8.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = brute.near_groups(rows[:-1])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None} == expected
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]


def test_near_groups_compare_rows_not_ids(spark):
    """Rows that share a doc_id and differ in their texts, in both orders; equal rows; an element that all sets have."""
    w = [f"u{i}" for i in range(100)]
    near = lambda *at: " ".join(f"z{i}" if i in at else x for i, x in enumerate(w))
    rows = [(1, "one of a kind " * 5), (1, near()), (5, near(50)), (7, near(50, 51)), (7, near(50, 51)), (3, "a b c d e f g"), (3, "a b c d e f h"), (9, near(2, 30, 60, 90)), (None, near())]
    rows += [(100 + i, "the very same start of " + " ".join(f"{i}-{j}" for j in range(6))) for i in range(40)]
    named = [(i, t) for i, (d, t) in enumerate(rows) if d is not None]
    by_row = brute.near_groups(named)
    least = {}
    for i, _ in named:
        least[by_row[i][1]] = min(least.get(by_row[i][1], 1 << 60), rows[i][0])
    expected = sorted((rows[i][0], by_row[i][0], least[by_row[i][1]], rows[i][0] == least[by_row[i][1]]) for i, _ in named)
    for order in (rows, rows[::-1]):
        got = op8.groups(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect()
        assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == expected


def test_across_pairs_hot_elements(spark, monkeypatch):
    """Sets whose common elements are in all of them, dealt to several tasks: the same pairs."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(60):
        words = [f"c{j}" for j in range(40)]
        for j in rng.integers(0, 40, 1 + i % 3):
            words[int(j)] = f"x{i}-{j}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(op8, "SALT_SETS", 4)
    monkeypatch.setattr(op8, "HOT", 1 << 20)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in op8.groups(spark.createDataFrame(rows, "doc_id long, text string"), 70).collect()}
    assert got == brute.near_groups(rows, 70)


def test_superminhash_estimates():
    rng = np.random.default_rng(1)
    est = []
    for _ in range(60):
        e = rng.integers(0, 2**63, 300).astype(np.uint64)
        sig = op8.superminhash(np.r_[e[:270], e[30:]], np.repeat([0, 1], [270, 270]), 2)
        est.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(est) - 0.8) < 0.02 and np.std(est) < 0.035  # plain MinHash would have 0.035
    assert (op8.superminhash(np.empty(0, np.uint64), np.empty(0, np.int64), 1) == np.iinfo(np.uint64).max).all()


def test_memory_of_signatures_and_fronts_is_bounded(spark, docs, monkeypatch):
    """Sets of any length are worked on in parts of CHUNK elements, with the signatures they have as a whole."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (3, 0, 700, 64, 65, 1, 128)]
    whole = np.concatenate([op8.superminhash(s, np.zeros(len(s), np.int64), 1) for s in sets])
    seen, plain = [], op8.superminhash
    monkeypatch.setattr(op8, "CHUNK", 64)
    monkeypatch.setattr(op8, "superminhash", lambda e, owner, n: seen.append(len(e)) or plain(e, owner, n))
    assert (op8.signatures(sets) == whole).all()
    assert sum(seen) == sum(map(len, sets)) and max(seen) <= 64
    assert op8.signatures([]).shape == (0, op8.SLOTS)

    held = pa.RecordBatch.from_pydict({"node": list(range(7)), "n_shingles": [len(s) for s in sets], "component": [9] * 7, "shingles": [s.tobytes() for s in sets]})
    out = list(op8.spread([held]))
    assert max(b.num_rows for b in out) <= 64
    assert [r["element"] for b in out for r in b.to_pylist()] == [int(x) for s in sets for x in s.view(np.int64)]

    op8.sign(docs)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 2 << 20


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_secrets(docs, pairs, empty):
    got = {r["doc_id"]: r for r in op10.scan(clashing(docs)).collect()}
    for d, t in pairs:
        said = ",".join(f"{op10.KINDS[m['kind']]}:{m['start']}:{m['end']}" for m in got[d]["base"])
        assert said == brute.secrets(t)[4]
    assert sum(len(r["base"]) for r in got.values()) >= 5
    assert op10.scan(empty).collect() == []
    twice = op10.scan(docs.unionByName(docs)).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct(F.to_json(F.struct("base", "learned"))).alias("kinds")).collect()
    assert {(r["n"], r["kinds"]) for r in twice} == {(2, 1)}


def test_automata_learn_formats():
    rng = np.random.default_rng(3)
    key = lambda: b"AKIA" + bytes(rng.choice(list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 16).tolist())
    hexed = lambda n: bytes(rng.choice(list(b"0123456789abcdef"), n).tolist())
    a, h = op10.Automaton([key() for _ in range(400)]), op10.Automaton([hexed(20) for _ in range(400)])
    held = [key() for _ in range(200)], [hexed(20) for _ in range(200)]
    assert np.mean([a.accepts(x) for x in held[0]]) > 0.95 and np.mean([h.accepts(x) for x in held[1]]) > 0.95
    clean = [b"www-example-site1", b"version2-release-notes", b"chapter12section"]
    assert not any(a.accepts(x) or h.accepts(x) for x in clean)
    assert 1 <= a.states < 100


def credentials(rng):
    """Three formats, none of which a base pattern finds without its keyword."""
    pick = lambda letters, n: "".join(rng.choices(letters, k=n))
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    return rng.choice((lambda: "ghx_" + pick(upper + lower + digits, 36), lambda: "sk-live-" + pick(upper + lower + digits, 24), lambda: f"{pick(upper + digits, 8)}-{pick(upper + digits, 8)}-{pick(upper + digits, 8)}"))()


def test_learned_formats_are_found_without_keyword(spark):
    """Half of the table names its credentials, half doesn't: the second half is found by what the first one taught."""
    rng = random.Random(8)
    plain = ["www.example.org/index.html", "version-2.10.4", "anna.maria.schmidt", "internationalization", "2024-03-17", "+49-170-1234567", "IMG_20240317.jpeg", "self-contained", "Geschwindigkeit", "UNITED-STATES", "x86_64-linux"]
    prose = lambda n: " ".join(rng.choice(plain) if rng.random() < 0.1 else "".join(rng.choices("etaoinshrdlu", k=rng.randrange(1, 14))) for _ in range(n))
    rows, held = [], {}
    for i in range(400):
        secret = credentials(rng)
        if i % 2:
            rows.append((i, f"{prose(30)} api_key = {secret} {prose(10)}"))
        else:
            before = f"é {prose(30)} "
            rows.append((i, f"{before}{secret}. {prose(10)}"))
            held[i] = (len(before), len(before) + len(secret))
    rows += [(1000 + i, prose(60)) for i in range(300)]
    got = {r["doc_id"]: [(m["start"], m["end"]) for m in r["learned"]] for r in op10.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = sum(span in got[d] for d, span in held.items())
    alarms = sum(len([s for s in spans if s != held.get(d)]) for d, spans in got.items())
    print(f"recall {caught / len(held):.3f}, false alarms {alarms} in {sum(len(t.split()) for _, t in rows)} tokens")
    assert caught >= 0.9 * len(held) and alarms <= 5


def test_learned_spans_join_base_ones(spark):
    rng = np.random.default_rng(4)
    hexed = lambda n: bytes(rng.choice(list(b"0123456789abcdef"), n).tolist()).decode()
    long = hexed(24)
    rows = [(i, f"some words {hexed(24)} and more of these ordinary tokens, number-{i}, wonderful landscapes") for i in range(60)]
    rows += [(100, "id a1b2c3d4e5f6a7 end"), (101, "plain text only"), (102, f"é x {long}.{long} y")]
    got = {r["doc_id"]: r for r in op10.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(m["start"], m["end"]) for m in got[100]["learned"]] == [(3, 17)]
    assert got[101]["base"] == [] and got[101]["learned"] == []
    assert [(m["start"], m["end"]) for m in got[102]["base"]] == [(4, 28), (29, 53)]
    assert all(m["score"] > -5 for m in got[102]["base"])


def test_secret_candidates_against_plain_version(pairs):
    for _, t in pairs:
        b = (t or "").encode()
        base = op10.base_matches(b)
        plain = []
        for m in re.finditer(rb"[A-Za-z0-9+/_.=-]{8,}", b):
            token = m[0].strip(b".")
            s = m.start() + len(m[0]) - len(m[0].lstrip(b"."))
            if len(token) >= 8 and not any(x <= s and s + len(token) <= e for x, _, e, _ in base):
                plain.append((s, token))
        assert list(op10.candidates(b, base)) == plain


def test_secret_scan_of_a_long_text_is_linear():
    text = ("é some text with deadbeefdeadbeef12 and wonderful landscapes " * 100_000).encode()
    began = time.perf_counter()
    base = op10.base_matches(text)
    found = list(op10.candidates(text, base))
    at = op10.characters(text, {s for s, *_ in base} | {s for s, _ in found})
    assert len(base) == 100_000 and len(found) == 200_000 and at[base[1][0]] == len(text[: base[1][0]].decode())
    assert time.perf_counter() - began < 20
