"""Scored search of sequences against a database, with the best k for each query."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.functions.align import ALGORITHMS, Scheme, align, basic_scheme, column_maxima, lz78_count, matrix_scheme, scores
from millrace.session import table

#: Bytes of queries that go to the executors at once; larger query sets go block by block.
QUERY_BLOCK_BYTES = 8 << 20
#: Cells of one array operation.
CELLS = 1 << 22


def query_blocks(queries: DataFrame, limit: int = QUERY_BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """(name, body) in blocks of bounded size, read row by row."""
    held, size = [], 0
    for name, body in queries.select("name", "body").toLocalIterator():
        if held and size + len(body) > limit:
            yield held
            held, size = [], 0
        held.append((name, body))
        size += len(body)
    if held:
        yield held


def top_k(hits: DataFrame, k: int) -> DataFrame:
    """The best k of each query: score, then name, both descending; equal pairs count once; k = 0 gives none.

    Equal pairs have one dense rank, so the rank filter can be applied before the shuffle too (WindowGroupLimit) and
    copies go afterwards, where only the best are left.
    """
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("name").desc())
    return hits.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).dropDuplicates(["query", "rank"])


def merge_top_k(parts: list[DataFrame], k: int) -> DataFrame:
    """The best k of the union of partial results."""
    whole = parts[0].drop("rank")
    for p in parts[1:]:
        whole = whole.unionByName(p.drop("rank"))
    return top_k(whole, k)


def all_pairs(queries: DataFrame, database: DataFrame, algorithm: str, scheme: Scheme, above: float | None = 0, limit: int = QUERY_BLOCK_BYTES, best: int | None = None) -> DataFrame:
    """query, name, score of every query with every database row, where the score is over `above`.

    The database stays where it lies; queries go to it in blocks of checked size, and each block is one pass. Bodies
    that the scheme can't score give a null score with `above` None, and no row otherwise. With `best` only the best
    that many different (score, name) of each query leave a batch.
    """
    local = ALGORITHMS[algorithm]

    def score_with(shared):
        def run(batches):
            for batch in batches:
                names, bodies = batch.column("name").to_pylist(), batch.column("body").to_pylist()
                # Like lengths together: little padding.
                order = sorted(range(len(bodies)), key=lambda i: len(bodies[i] or ""))
                for q, text in shared.value:
                    out: list = [[], [], []]
                    i = 0
                    while i < len(order):
                        j, wide = i, 1
                        while j < len(order) and (j == i or (j - i + 1) * (wide := len(bodies[order[j]] or "") + 1) <= CELLS):
                            j += 1
                        part = order[i:j]
                        i = j
                        try:
                            got = scores(text, [bodies[x] or "" for x in part], scheme, local).tolist()
                        except ValueError:
                            got = []
                            for x in part:
                                try:
                                    got.append(int(scores(text, [bodies[x] or ""], scheme, local)[0]))
                                except ValueError:
                                    got.append(None)
                        for x, s in zip(part, got, strict=True):
                            if above is None or s is not None and s > above:
                                out[0].append(q), out[1].append(names[x]), out[2].append(s)
                    if best is not None:
                        # Nulls last, as in a descending sort.
                        kept = sorted(set(zip(out[1], out[2], strict=True)), key=lambda h: (h[1] is not None, h[1] or 0, h[0]), reverse=True)[:best]
                        out = [[q] * len(kept), [n for n, _ in kept], [x for _, x in kept]]
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["query", "name", "score"])

        return run

    spark = database.sparkSession
    found = None
    for block in query_blocks(queries, limit):
        part = database.select("name", "body").mapInArrow(score_with(spark.sparkContext.broadcast(block)), "query string, name string, score long")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "query string, name string, score long")


def search(queries: DataFrame, database: DataFrame, algorithm: str, scheme: Scheme, k: int, above: float | None = 0, limit: int = QUERY_BLOCK_BYTES) -> DataFrame:
    return top_k(all_pairs(queries, database, algorithm, scheme, above, limit, k), k)


def with_alignments(hits: DataFrame, queries: DataFrame, database: DataFrame, algorithm: str, scheme: Scheme) -> DataFrame:
    """hits with the alignment of each; joins bring in the two bodies."""
    local = ALGORITHMS[algorithm]
    both = hits.join(queries.select(F.col("name").alias("query"), F.col("body").alias("qbody")), "query").join(database.select("name", "body"), "name")
    kinds = "query string, name string, rank int, score long, gapped1 string, tag string, gapped2 string"

    def run(batches):
        for batch in batches:
            got = [align(a, b, scheme, local) for a, b in zip(batch.column("qbody").to_pylist(), batch.column("body").to_pylist(), strict=True)]
            score = pa.array([g["score"] for g in got], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("query", "name", "rank")), score, *(pa.array([g[c] for g in got], pa.string()) for c in ("gapped1", "tag", "gapped2"))], names=[x.split()[0] for x in kinds.split(", ")])

    return both.select("query", "name", "rank", "score", "qbody", "body").mapInArrow(run, kinds)


def formatted(hits: DataFrame) -> DataFrame:
    """One line a hit: [rank] : score : name."""
    return hits.select("query", "rank", F.format_string("[%d] : %d : %s", "rank", "score", "name").alias("line"))


def tiles(queries: int, database: int, threshold: int):
    """Number of tiles of a query x database plan with sides of at most `threshold`."""
    return -(-queries // threshold) * -(-database // threshold)


EDIT = basic_scheme(0, -1, -1)


def _names(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lower("n_name").alias("body"))
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_name").alias("body")).distinct()
    return nations, parts


_PAIRS = "pairs AS (SELECT n_name AS query, p.name, -levenshtein(lower(n_name), p.name) AS score FROM nation, (SELECT DISTINCT p_name AS name FROM part) p)"
_RANKED = "SELECT query, name, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, name DESC) AS rank FROM pairs QUALIFY rank <= 5"


@query("all_pairs_nw", f"WITH {_PAIRS} SELECT query, name, score FROM pairs")
def q_all_pairs_nw(spark, sf_dir):
    """Global alignment with match 0, mismatch and gap -1 is the edit distance with its sign turned."""
    return all_pairs(*_names(spark, sf_dir), "nw", EDIT, above=None)


@query("topk_per_query", f"WITH {_PAIRS} {_RANKED}")
def q_topk_per_query(spark, sf_dir):
    return search(*_names(spark, sf_dir), "nw", EDIT, 5, above=None)


@query("topk_merge", f"WITH {_PAIRS} {_RANKED}")
def q_topk_merge(spark, sf_dir):
    """Two halves of the database searched apart and merged: the same best k."""
    queries, parts = _names(spark, sf_dir)
    halves = [parts.where(F.pmod(F.xxhash64("name"), F.lit(2)) == i) for i in (0, 1)]
    return merge_top_k([search(queries, h, "nw", EDIT, 5, above=None) for h in halves], 5)


@query(
    "search_variants_agree",
    f"WITH {_PAIRS}, r AS ({_RANKED}) SELECT v AS variant, count(*) AS hits, CAST(sum(score * rank) AS BIGINT) AS digest FROM r, (VALUES ('broadcast'), ('halves'), ('tiles')) t(v) GROUP BY v",
)
def q_search_variants_agree(spark, sf_dir):
    """The three decompositions give the same result: whole query set at once, database halves, tiles of queries."""
    queries, parts = _names(spark, sf_dir)
    variants = {
        "broadcast": search(queries, parts, "nw", EDIT, 5, above=None),
        "halves": merge_top_k([search(queries, parts.where(F.pmod(F.xxhash64("name"), F.lit(2)) == i), "nw", EDIT, 5, above=None) for i in (0, 1)], 5),
        "tiles": search(queries, parts, "nw", EDIT, 5, above=None, limit=64),
    }
    out = None
    for name, hits in variants.items():
        one = hits.agg(F.count(F.lit(1)).alias("hits"), F.sum(F.col("score") * F.col("rank")).alias("digest")).select(F.lit(name).alias("variant"), "hits", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def _dynamic_sql(bodies: str, pair: str, gap: int, local: bool) -> str:
    """Alignment scores row by row: a row is a list, worked out from left to right from the one before.

    bodies: a query giving name, body; pair: the score of the letters x and y.
    """
    x, y = "substr(a.body, (r.i + 1)::INT, 1)", "substr(b.body, c[1]::INT, 1)"
    first = "0" if local else f"{gap} * (r.i + 1)"
    floor = "0, " if local else ""
    score = pair.format(x=x, y=y)
    cell = f"greatest({floor}r.line[c[1]] + {score}, r.line[c[1] + 1] + {gap}, acc[-1] + {gap})"
    step = f"list_reduce(list_prepend([{first}], list_transform(range(1, length(b.body) + 1), lambda j: [j])), lambda acc, c: list_append(acc, {cell}))"
    start = "0" if local else f"{gap} * j"
    ended = "max(best)" if local else "max(line[-1]) FILTER (i = n)"
    return f"""WITH RECURSIVE s AS ({bodies}), r AS (
      SELECT a.name AS query, b.name AS name, 0::BIGINT AS i, length(a.body) AS n, list_transform(range(0, length(b.body) + 1), lambda j: {start}) AS line, 0::BIGINT AS best FROM s a, s b
      UNION ALL
      SELECT query, name, i + 1, n, line, greatest(best, list_max(line)) FROM (
        SELECT r.query, r.name, r.i, r.n, r.best, {step} AS line FROM r JOIN s a ON a.name = r.query JOIN s b ON b.name = r.name WHERE r.i < r.n))
    SELECT query, name, CAST({ended} AS BIGINT) AS score FROM r GROUP BY query, name"""


@query("sw_score", "SELECT * FROM (" + _dynamic_sql("SELECT DISTINCT p_name AS name, p_name AS body FROM part", "(CASE WHEN {x} = {y} THEN 5 ELSE -4 END)", -4, True) + ") WHERE score > 0")
def q_sw_score(spark, sf_dir):
    """Local scores of part names among themselves, with the usual 5 / -4 / -4."""
    _, parts = _names(spark, sf_dir)
    return all_pairs(parts, parts, "sw", basic_scheme(5, -4, -4), above=0)


@query(
    "align_text",
    """SELECT * FROM (VALUES ('nw', 'kitten', 'sitting', -3::BIGINT, 'kitten-', ' ||| | ', 'sitting'), ('nw', 'abc', 'abc', 0, 'abc', '|||', 'abc'), ('nw', 'ab', 'b', -1, 'ab', ' |', '-b'),
       ('sw', 'xxabcxx', 'yabcy', 15, 'abc', '|||', 'abc'), ('sw', 'aaa', 'bbb', 0, '', '', '')) t(algorithm, a, b, score, gapped1, tag, gapped2)""",
)
def q_align_text(spark, sf_dir):
    """Known pairs aligned by the executors, the way the alignments of hits are."""
    pairs = [("nw", "kitten", "sitting"), ("nw", "abc", "abc"), ("nw", "ab", "b"), ("sw", "xxabcxx", "yabcy"), ("sw", "aaa", "bbb")]
    out = None
    for kind, scheme in (("nw", EDIT), ("sw", basic_scheme(5, -4, -4))):
        own = [p for p in pairs if p[0] == kind]
        hits = spark.createDataFrame([(a, b, 1, None) for _, a, b in own], "query string, name string, rank int, score long")
        queries = spark.createDataFrame([(a, a) for _, a, _ in own], "name string, body string")
        database = spark.createDataFrame([(b, b) for _, _, b in own], "name string, body string")
        got = with_alignments(hits, queries, database, kind, scheme).select(F.lit(kind).alias("algorithm"), F.col("query").alias("a"), F.col("name").alias("b"), "score", "gapped1", "tag", "gapped2")
        out = got if out is None else out.unionByName(got)
    return out


@query("tile_plan", "SELECT o_orderkey // 1000 AS q_tile, o_custkey // 100 AS d_tile, count(*) AS pairs FROM orders GROUP BY ALL")
def q_tile_plan(spark, sf_dir):
    div = lambda c, n: F.call_function("div", F.col(c), F.lit(n))
    return table(spark, sf_dir, "orders").groupBy(div("o_orderkey", 1000).alias("q_tile"), div("o_custkey", 100).alias("d_tile")).agg(F.count(F.lit(1)).alias("pairs"))


_MATRIX = "# scores\n   a  b  c  *\na  4 -1 -2 -8\nb -1  5 -3 -8\nc -2 -3  6 -8\n* -8 -8 -8  1\n"


def matrix_table(spark: SparkSession, text: str) -> DataFrame:
    """(a, b, score) of a scoring matrix text."""
    from millrace.sources.files import parse_matrix

    return spark.createDataFrame([(a, b, s) for (a, b), s in parse_matrix(text).items()], "a string, b string, score int")


@query(
    "matrix_scores",
    """WITH m(a, b, score) AS (VALUES ('a','a',4),('a','b',-1),('a','c',-2),('b','a',-1),('b','b',5),('b','c',-3),('c','a',-2),('c','b',-3),('c','c',6)),
       p AS (SELECT DISTINCT p_name FROM part), l AS (SELECT p_name, i, substr(p_name, i, 1) AS a, substr(reverse(p_name), i, 1) AS b FROM p, range(1, 1 + length(p_name)) r(i))
       SELECT p_name, count(*) AS letters, CAST(coalesce(sum(score), 0) AS BIGINT) AS score FROM l LEFT JOIN m USING (a, b) GROUP BY p_name""",
)
def q_matrix_scores(spark, sf_dir):
    """Letters of each name against its reverse, scored by a join with the matrix."""
    # A scoring matrix has at most 256 x 256 entries.
    m = matrix_table(spark, _MATRIX).where("a != '*' AND b != '*'")
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    letters = names.select("p_name", F.posexplode(F.arrays_zip(F.split("p_name", "").alias("a"), F.split(F.reverse("p_name"), "").alias("b")))).select("p_name", "col.a", "col.b")
    return letters.join(F.broadcast(m), ["a", "b"], "left").groupBy("p_name").agg(F.count(F.lit(1)).alias("letters"), F.coalesce(F.sum("score"), F.lit(0)).alias("score"))


def _letter_matrix(letters: str, same: int, vowels: int, other: int, gap: int) -> dict[tuple[str, str], int]:
    """A scoring matrix by rule: equal letters, two vowels, any other two, and a gap."""
    score = lambda a, b: same if a == b else vowels if a in "aeiou" and b in "aeiou" else other
    return {(a, b): score(a, b) for a in letters for b in letters} | {(a, "*"): gap for a in letters} | {("*", a): gap for a in letters} | {("*", "*"): 1}


_LETTERS = " abcdefghiklmnopqrstuvwxyz"  # without j
_MATRIX_BODIES = "SELECT name, body FROM (SELECT DISTINCT p_name AS name, CASE WHEN p_size % 10 = 0 THEN p_name || ' jade' ELSE p_name END AS body FROM part) QUALIFY row_number() OVER (PARTITION BY name ORDER BY body) = 1"


@query(
    "matrix_search",
    f"""WITH d AS ({_dynamic_sql(_MATRIX_BODIES, "(CASE WHEN {x} = {y} THEN 6 WHEN {x} IN ('a', 'e', 'i', 'o', 'u') AND {y} IN ('a', 'e', 'i', 'o', 'u') THEN 1 ELSE -2 END)", -3, False)}), k AS ({_MATRIX_BODIES})
    SELECT d.query, d.name, CASE WHEN contains(a.body, 'j') OR contains(b.body, 'j') THEN NULL ELSE score END AS score FROM d JOIN k a ON a.name = d.query JOIN k b ON b.name = d.name""",
)
def q_matrix_search(spark, sf_dir):
    """Whole part names under a matrix scheme that has all letters but one; names with that one have a null score."""
    body = F.when(F.pmod("p_size", F.lit(10)) == 0, F.concat("p_name", F.lit(" jade"))).otherwise(F.col("p_name"))
    named = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min(body).alias("body"))
    return all_pairs(named, named, "nw", matrix_scheme(_letter_matrix(_LETTERS, 6, 1, -2, -3)), above=None)


def lz78(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, letters and phrases of each whole text."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array([sum(map(str.isalpha, t)) for t in texts], pa.int64()), pa.array([lz78_count(t) for t in texts], pa.int64())], names=[key, "letters", "phrases"]
            )

    return df.select(key, F.col(text).alias("t")).mapInArrow(run, f"`{key}` {kind}, letters long, phrases long")


@query("lz78_phrases")
def q_lz78(spark, sf_dir):
    return lz78(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("column_maxima", "SELECT label, vec_id AS row, round(v, 6) AS most FROM (SELECT label, vec_id, embedding[1]::DOUBLE AS v FROM embeddings) QUALIFY row_number() OVER (PARTITION BY label ORDER BY v DESC, vec_id) = 1")
def q_column_maxima(spark, sf_dir):
    """The first row with the largest value of each column."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("v"))
    best = e.groupBy("label").agg(F.max(F.struct("v", (-F.col("vec_id")).alias("n"))).alias("b"))
    return best.select("label", (-F.col("b.n")).alias("row"), F.round("b.v", 6).alias("most"))


def nearest_components(df: DataFrame, key: str, vector: str, points: list[float]) -> DataFrame:
    """key and, for each point, the nearest component of the row's vector (the smaller of two).

    Minus the squared distances of sorted components and sorted points are a totally monotone matrix, so a row costs as
    much as its components and the points, not their product. Rows stay where they are.
    """
    kind = dict(df.dtypes)[key]
    at = sorted(points)

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column("v").to_pylist():
                own = sorted(x for x in v or [] if x is not None)
                found = column_maxima(len(own), len(at), lambda r, c, own=own: -((own[r] - at[c]) ** 2)) if own else []
                out.append([own[r] for r in found])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.list_(pa.float64()))], names=[key, "nearest"])

    return df.select(key, F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"`{key}` {kind}, nearest array<double>")


@query(
    "monotone_maxima",
    """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), p AS (SELECT i::INT AS place, CAST((i - 8) AS DOUBLE) / 4 AS y FROM range(17) r(i))
       SELECT vec_id, place, round(x, 9) AS nearest FROM v, p QUALIFY row_number() OVER (PARTITION BY vec_id, place ORDER BY (x - y) * (x - y), x) = 1""",
)
def q_monotone_maxima(spark, sf_dir):
    found = nearest_components(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", [(i - 8) / 4 for i in range(17)])
    return found.select("vec_id", F.posexplode("nearest").alias("place", "x")).select("vec_id", "place", F.round("x", 9).alias("nearest"))
