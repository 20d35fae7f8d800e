"""Mixing sources to target weights by pivotal dependent rounding.

A source whose target is r times its size gives every document floor(r) copies and a fractional claim on one more.
Two documents with fractional claims are paired: mass (in words) moves from one to the other, the direction drawn
with the probability that keeps each claim's expectation, until one claim is 0 or 1. The words claimed stay the same
at every step, so a whole block ends with one fractional claim at most. So that this is the claim of a small document,
large ones are each paired with all smaller ones as one bundle. Blocks are worked through side by side, and
what they leave over is paired again in a tree with a fixed fan-in, until each source has one claim, drawn at last.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import U64, cut, splitmix, unit

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
BLOCK_ROWS = 2048
FAN_IN = 512
SEED = 20240601
#: A mixture is set per source, so sources are few; more than this is an error, not a silent cap.
MAX_SOURCES = 100_000


def word_count(text="text"):
    """Runs of anything but ASCII white space; one pass over the text."""
    said = F.btrim(F.regexp_replace(F.col(text), r"[\x20\x09-\x0D]+", " "))
    spaces = F.octet_length(said) - F.octet_length(F.replace(said, F.lit(" "), F.lit("")))
    return F.coalesce(F.when(said != "", spaces + 1), F.lit(0)).cast("long")


def targets_of(sizes: list[int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Water-filling: share * total by weight; what lies above `most` times a size goes to the others by weight."""
    n = len(sizes)
    w = [float(weights[i % len(weights)]) for i in range(n)]
    caps = [most * s for s in sizes]
    target, free = [0.0] * n, set(range(n))
    left = share * sum(sizes)
    while free:
        total = sum(w[i] for i in free)
        full = [i for i in free if left * w[i] / total >= caps[i]]
        if not full:
            for i in free:
                target[i] = left * w[i] / total
            break
        for i in full:
            target[i] = caps[i]
            free.discard(i)
        left -= sum(caps[i] for i in full)
    return target


EPS = 1e-9


def _pair(p: list, w: list, u: list, places) -> int:
    """Pair the open claims at the places given, in their order; the place whose claim stays open, or -1."""
    held = -1
    for j in places:
        if not EPS < p[j] < 1 - EPS:
            continue
        if held < 0:
            held = j
            continue
        i = held
        up = min((1 - p[i]) * w[i], p[j] * w[j])  # words that can go from j to i
        down = min(p[i] * w[i], (1 - p[j]) * w[j])
        if u[j] * (up + down) < down:
            p[i] += up / w[i]
            p[j] -= up / w[j]
        else:
            p[i] -= down / w[i]
            p[j] += down / w[j]
        held = -1
        for k in (i, j):
            if EPS < p[k] < 1 - EPS:
                held = k
            else:
                p[k] = float(round(p[k]))
    return held


def _against_many(p: np.ndarray, w: np.ndarray, i: int, first: int, draws) -> None:
    """Pair the claim at i with all open ones from `first` on as one bundle, until it is 0 or 1.

    Words go to or come from all of the bundle in the same proportions, so every claim keeps its expectation. One draw
    is enough if the bundle can take what the claim has; where it is too light the claim goes as far as it can, a few times.
    """
    pm, wm = p[first:], w[first:]
    for u in draws:
        if not EPS < p[i] < 1 - EPS:
            break
        part = pm * (1 - pm) * wm
        total = part.sum()
        if total <= EPS:
            break
        # In these proportions the bundle gives until its claim with most room is 0, and takes until the first is 1.
        live = (pm > EPS) & (pm < 1 - EPS) & (wm > 0)
        up = min((1 - p[i]) * w[i], total / float(np.max(1 - pm[live])))
        down = min(p[i] * w[i], total / float(np.max(pm[live])))
        moved = up if u * (up + down) < down else -down
        p[i] += moved / w[i]
        pm[live] -= moved * (pm * (1 - pm))[live] / total
        pm[pm < EPS] = 0.0
        pm[pm > 1 - EPS] = 1.0
    if not EPS < p[i] < 1 - EPS:
        p[i] = round(p[i])


def round_block(key: np.ndarray, size: np.ndarray, claim: np.ndarray, draws: np.ndarray, last: bool) -> np.ndarray:
    """Claims after pairing in the order given, largest first: 0 or 1, except one at most (none if `last`).

    Each claim of the largest quarter is paired with all smaller ones as one bundle; then claims are paired one by one, and
    what the middle leaves open meets the smallest quarter as a bundle before that is paired. So the claim left at the
    end, and drawn if `last`, is one of a small document.
    """
    p, w = claim.astype(np.float64), size.astype(np.float64)
    is_open = (p > EPS) & (p < 1 - EPS)
    # An empty document moves no words; its claim is drawn alone.
    p = np.where(is_open & (w > 0), p, np.where(is_open, draws < p, np.round(p)).astype(np.float64))
    still = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    q, v, u = p[still], w[still], draws[still]
    n, quarter = len(still), len(still) // 4
    more = lambda i: unit(splitmix(splitmix(U64(int(key[still[i]]) & (2**64 - 1))) ^ np.arange(2, 34, dtype=U64))).tolist()
    for i in range(quarter):
        _against_many(q, v, i, i + 1, more(i))

    def paired(places) -> int:
        nonlocal q
        as_list = q.tolist()
        held = _pair(as_list, v.tolist(), u.tolist(), places)
        q = np.array(as_list)
        return held

    held = paired(range(n - quarter))
    if held >= 0 and quarter:
        _against_many(q, v, held, n - quarter, more(held))
    held = paired([*([held] if held >= 0 else []), *range(n - quarter, n)])
    if last and held >= 0:
        q[held] = float(unit(splitmix(splitmix(int(key[still[held]]) & (2**64 - 1)) ^ U64(1)))[()] < q[held])
    p[still] = q
    return p


def _rounder(level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # Large ones first: what is left over at the end is then a small one.
        pdf = pdf.sort_values(["weight", "unit"], ascending=[False, True], kind="stable").reset_index(drop=True)
        key = pdf["unit"].to_numpy(np.int64)
        draws = unit(splitmix(key.astype(np.uint64) ^ splitmix(np.uint64(SEED + level))))
        pdf["claim"] = round_block(key, pdf["weight"].to_numpy(np.int64), pdf["claim"].to_numpy(), draws, bool(pdf["blocks"].iat[0] <= 1))
        return pdf

    return run


def source_plan(units: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> list[tuple]:
    """(source, rows, size, target) in code point order, null last."""
    per = units.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("size"))
    found = per.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; a mixture is set per source")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    targets = targets_of([r["size"] for r in found], weights, share, most)
    return [(r["source"], r["n"], r["size"], t) for r, t in zip(found, targets, strict=True)]


def copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """unit, size, source_size, target and copies of every distinct row of docs.

    unit is a hash of doc_id, source and text. Rows that are equal in all of them are one unit and get the same
    number of copies, their words counted once for each. Null sources are one source, last in order. A text of no
    words has weight 0, its claim is drawn alone. Draws depend on the unit only, so reruns agree on any cluster.
    """
    spark = docs.sparkSession
    rows = docs.select(F.xxhash64("doc_id", "source", "text").alias("unit"), "source", word_count().alias("size"))
    units = cut(rows.groupBy("unit", "source", "size").agg(F.count(F.lit(1)).alias("m")).withColumn("weight", F.col("size") * F.col("m")))
    plan = source_plan(units, weights, share, most)
    table = [
        (s, int(size), float(t), int(np.floor(t / size + 1e-12)) if size else 1, float(max(0.0, t / size - np.floor(t / size + 1e-12))) if size else 0.0, max(1, -(-n // block_rows)))
        for s, n, size, t in plan
    ]
    sources = spark.createDataFrame(table, "source string, source_size long, target double, base int, frac double, blocks long")
    # One row for each source; their number was checked against MAX_SOURCES.
    at = units.alias("u").join(F.broadcast(sources.alias("s")), F.col("u.source").eqNullSafe(F.col("s.source"))).select(
        "u.unit", "u.source", "u.size", "u.weight", "s.source_size", "s.target", "s.base", F.col("s.frac").alias("claim"), "s.blocks",
        F.pmod(F.xxhash64("u.unit"), F.col("s.blocks")).alias("block"),
    )
    schema = at.schema
    settled = None
    level, most_blocks = 0, max([x[-1] for x in table], default=1)
    while True:
        # A block's rows come from one source; a hot source has more blocks, not larger ones.
        done = cut(at.groupBy("source", "block").applyInPandas(_rounder(level), schema))
        whole = F.col("claim").isin(0.0, 1.0)
        settled = done.where(whole) if settled is None else settled.unionByName(done.where(whole))
        if most_blocks <= 1:
            break
        most_blocks = -(-most_blocks // FAN_IN)
        level += 1
        at = done.where(~whole).withColumns({"block": F.floor(F.col("block") / FAN_IN).cast("long"), "blocks": F.ceil(F.col("blocks") / FAN_IN).cast("long")})
    return settled.select("unit", "size", "source_size", "target", (F.col("base") + F.col("claim").cast("int")).alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """docs with `size`, `source_size`, `target` and `copies`: how often the mix takes each row (0 or more).

    Columns of these names in docs are replaced, all others stay. Rows are matched by a hash of doc_id, source and text,
    so null ids and ids with several texts are fine; a text may be of any length. An empty table gives no rows.
    """
    plan = copies(docs, weights, share, most)
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    keyed = docs.select(*kept).withColumn("_unit", F.xxhash64("doc_id", "source", "text"))
    return keyed.join(plan.withColumnRenamed("unit", "_unit"), "_unit").select(*kept, "size", "source_size", "target", "copies")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
