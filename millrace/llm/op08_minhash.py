"""Near-duplicate groups by SuperMinHash.

A document is the set of its five-word shingles. Documents with equal sets are one class. Each class gets a
SuperMinHash signature: an element visits the slots in the order of a random permutation, writing step number plus a
random fraction where that is smaller; elements stop as soon as no later step can win. Bands of the signature are
the buckets. In each bucket all classes are first compared with one of them, then a few times with another one drawn at
random, and links are joined into components by union-find. Where a bucket still holds several components, its classes
are compared across them, except for pairs that can't be alike by the rare shingles they have in common. Every link is
confirmed on full sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import U64, cut, hot_join, small_batches, splitmix, stash
from millrace.llm._graph import components

WORDS = 5
PERCENT = 85
#: 26 bands of 5: a pair at a similarity of 0.85 shares no band with probability 2.4e-7.
BANDS, ROWS = 26, 5
SLOTS = BANDS * ROWS
#: Rounds in which what is apart in a bucket meets a centre drawn at random, before the exact comparison.
DRAWS = 3
#: An element with a 256th of all front rows is hot; there are 256 at most.
HOT = 256
#: Sets of one element that are paired in one task.
SALT_SETS = 500
#: Elements worked on at once: bounds the permutation matrix at this many times SLOTS bytes.
CHUNK = 1 << 16
#: Bytes of one Arrow batch. The JVM holds a batch outside its heap, in doubling buffers that malloc keeps for each thread.
BATCH = 2 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Hashes(dict):
    """Word -> 64-bit hash, remembered for a while."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of one text."""
    got = (text or b"").translate(_FOLD).split()
    if not got:
        return np.empty(0, U64)
    h = np.fromiter(map(_hashes.__getitem__, got), U64, len(got))
    with np.errstate(over="ignore"):
        k = min(words, len(h))
        s = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            s *= U64(0x9E3779B97F4A7C15)
            s += h[i : len(h) - k + 1 + i]
            s ^= s >> U64(29)
        if len(h) < words:
            s += U64(len(h))
    return np.unique(splitmix(s))


def superminhash(elements: np.ndarray, owner: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures of n sets as an n x slots array; owner gives the set of each element.

    A value is step << 32 | fraction. Sets without elements keep the largest value everywhere.
    """
    full = np.iinfo(np.uint64).max
    sig = np.full(n * slots, full, U64)
    perm = None
    base = owner.astype(np.int64) * slots
    for j in range(slots):
        r = splitmix(elements ^ splitmix(U64(j + 1)))
        k = j + ((r & U64(0xFFFFFFFF)) * U64(slots - j) >> U64(32)).astype(np.int64)
        if perm is None:
            slot = k
        else:
            at = np.arange(len(k))
            slot = perm[at, k].astype(np.int64)
            perm[at, k] = perm[:, j]
        np.minimum.at(sig, base + slot, (U64(j) << U64(32)) | (r >> U64(32)))
        # A set is settled once every slot holds a step up to this one.
        open_sets = sig.reshape(n, slots).max(axis=1) >= U64((j + 1) << 32)
        left = open_sets[owner]
        if not left.any():
            break
        elements, owner, base = elements[left], owner[left], base[left]
        if perm is None:
            perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(elements), 1))
            perm[np.arange(len(elements)), k[left]] = 0
        else:
            perm = perm[left]
    return sig.reshape(n, slots)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures of sets, from at most CHUNK elements at once.

    A larger set is taken in parts: each element writes by itself, so the smallest values of the parts are the set's.
    """
    sig = np.full((len(sets), SLOTS), np.iinfo(np.uint64).max, U64)
    parts = [(i, s[k : k + CHUNK]) for i, s in enumerate(sets) for k in range(0, len(s), CHUNK)]
    i = 0
    while i < len(parts):
        j, held = i, 0
        while j < len(parts) and held + len(parts[j][1]) <= CHUNK:
            held += len(parts[j][1])
            j += 1
        at, some = map(list, zip(*parts[i:j], strict=True))
        # Two parts of one set are over CHUNK together, so no set is in here twice.
        sig[at] = np.minimum(sig[at], superminhash(np.concatenate(some), np.repeat(np.arange(j - i), [len(x) for x in some]), j - i))
        i = j
    return sig


def bands_of(sig: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each band, the band's number included."""
    n = len(sig)
    parts = sig.reshape(n, BANDS, ROWS)
    h = np.broadcast_to(splitmix(np.arange(BANDS, dtype=U64)), (n, BANDS)).copy()
    for i in range(ROWS):
        h = splitmix(h ^ parts[:, :, i])
    return h.view(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set (two longs) and band hashes of each row."""
    small_batches(docs.sparkSession, BATCH)

    def run(batches):
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            sizes = [len(s) for s in sets]
            digest = np.frombuffer(b"".join(map(digest_of, sets)), np.int64).reshape(-1, 2)
            bands = bands_of(signatures(sets))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(digest[:, 0]),
                    pa.array(digest[:, 1]),
                    pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), BANDS).cast(pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "bands"],
            )

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def digest_of(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def sets_of(docs: DataFrame) -> DataFrame:
    """d1, d2 (digest) and elements of the set of each row."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            digest = np.frombuffer(b"".join(map(digest_of, sets)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([s.tobytes() for s in sets], pa.binary())], names=["d1", "d2", "shingles"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "d1 long, d2 long, shingles binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            got = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"])
            yield got.filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def spread(batches):
    """node, n, component and element of each element of the sets, in batches of CHUNK rows at most."""
    for batch in batches:
        elements = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
        sizes = [len(x) for x in elements]
        ids = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False), sizes) for c in ("node", "n_shingles", "component")]
        rows = pa.RecordBatch.from_arrays([*map(pa.array, ids), pa.array(np.concatenate(elements))], names=["node", "n", "component", "element"])
        for i in range(0, rows.num_rows, CHUNK):
            yield rows.slice(i, CHUNK)


def across(still: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that can reach the similarity; none that does is missing.

    Elements are put in one order, rarest first. Two sets that are alike enough have their first common element near
    the front of both, so only the fronts are joined, and a pair is left out if too few elements follow. Copies that
    went apart by edits of their own have those edits in front and don't meet. Of the components that hold an element
    the one with most sets isn't joined with itself.
    """
    rows = still.join(sets, "node")
    spread_rows = rows.select("node", "n_shingles", "component", "shingles").mapInArrow(spread, "node long, n long, component long, element long")
    # Elements that one component alone has can't be common to two; they count as the front of their sets.
    shared = spread_rows.groupBy("element").agg(F.count(F.lit(1)).alias("sets"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("element", "sets")
    front = (
        spread_rows.join(shared, "element")
        .groupBy("node", "n", "component")
        .agg(F.sort_array(F.collect_list(F.struct("sets", "element"))).alias("common"))
        .withColumn("own", F.col("n") - F.size("common"))
        .withColumn("length", F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1 - F.col("own"))
        .where("length > 0")
        .select("node", "n", "component", "own", F.posexplode(F.slice("common", F.lit(1), F.col("length").cast("int"))).alias("i", "e"))
        .select(F.col("e.element").alias("element"), "node", "n", "component", (F.col("n") - F.col("own") - F.col("i")).alias("rest"))
    )
    front = stash(front, "fronts")
    held = front.groupBy("element", "component").agg(F.count(F.lit(1)).alias("sets"))
    main = held.groupBy("element").agg(F.max(F.struct("sets", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("components"), F.sum("sets").alias("sets"))
    main = stash(main.where("components > 1").select("element", "main", "sets"), "elements")
    # An element that very many sets have is dealt to several tasks, both here and in the pairing.
    met = hot_join(front, main, "element", main.where(F.col("sets") * HOT >= front.count()))
    salts = F.ceil(F.col("sets") / SALT_SETS).cast("int")
    x = met.where("component != main").select("element", F.pmod("node", salts).cast("int").alias("salt"), F.col("node").alias("p"), F.col("n").alias("np"), F.col("component").alias("cp"), F.col("rest").alias("rp"))
    y = met.select("element", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("node").alias("q"), F.col("n").alias("nq"), F.col("component").alias("cq"), F.col("rest").alias("rq"))
    enough = F.least("rp", "rq") * (100 + percent) >= (F.col("np") + F.col("nq")) * percent
    sized = F.least("np", "nq") * 100 >= F.greatest("np", "nq") * percent
    pairs = x.join(y, ["element", "salt"]).where((F.col("cp") != F.col("cq")) & enough & sized)
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def apart_in(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """band, node, n_shingles and component of the buckets that hold more than one component."""
    placed = buckets.join(found, "node", "left").select("band", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    return placed.join(mixed, "band", "left_semi")


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs.

    A text without words, or a null one, has an empty set and is alone; so is a row with a null doc_id (its
    component_id is null, and it is kept). Rows are compared by their own texts: rows that repeat a doc_id with another
    text are links of their own, those that repeat the text too are one. component_id is the smallest doc_id of a row's
    component, kept says that it is the row's own. Texts may be of any length; those under five words are one shingle. An
    empty table gives no rows; other columns aren't read.
    """
    signed = cut(sign(docs)).withColumn("node", F.monotonically_increasing_id())  # stable: the rows have been written
    apart = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    alone = signed.where(apart).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    rest = signed.where(~apart)

    # Classes of equal sets; a row's number stands for the class, so nothing depends on doc_ids being distinct.
    classes = cut(rest.groupBy("d1", "d2", "n_shingles").agg(F.min("node").alias("node"), F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")))
    banded = classes.select("node", "n_shingles", F.explode("bands").alias("band"))
    crowded = banded.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("z")).where(F.col("a") < F.col("z")).select("band", "a")
    buckets = cut(banded.join(crowded, "band"))
    sized = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent

    # First links: each class of a bucket with the bucket's smallest.
    centre = classes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"))
    star = buckets.where(F.col("a") < F.col("node")).select("a", F.col("node").alias("b"), F.col("n_shingles").alias("nb")).distinct()
    star = cut(star.join(centre, "a").where(sized(F.col("na"), F.col("nb"))).select("a", "b"))
    involved = classes.join(buckets.select("node").distinct(), "node", "left_semi").select("d1", "d2", "node", "doc_id")
    # One document of each class is read again; other texts of its doc_id fall out by their digest.
    texts = docs.select("doc_id", "text").join(involved.select("doc_id").distinct(), "doc_id", "left_semi")
    # Grouped by the digest too, which is how the rows lie after the join.
    sets = cut(sets_of(texts).join(involved, ["d1", "d2"]).groupBy("d1", "d2", "node").agg(F.first("shingles").alias("shingles")).select("node", "shingles"))
    links, tested = cut(confirm(star, sets, percent)), star
    found = components(links)

    # What is still apart in a bucket meets other centres of it, drawn anew each round: a class that is like some of a
    # component finds one of them in one of its buckets mostly, and need not be compared with all.
    for draw in range(DRAWS):
        placed = cut(apart_in(buckets, found))
        centres = placed.groupBy("band").agg(F.min(F.struct(F.xxhash64("node", F.lit(draw)), F.col("node").alias("a"), F.col("component").alias("ca"), F.col("n_shingles").alias("na"))).alias("c")).select("band", "c.*")
        drawn = placed.join(centres, "band").where((F.col("component") != F.col("ca")) & sized(F.col("na"), F.col("n_shingles")))
        drawn = drawn.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        drawn = cut(drawn)
        more = cut(confirm(drawn, sets, percent))
        tested = tested.unionByName(drawn)
        if not more.limit(1).collect():
            break
        links = links.unionByName(more)
        found = components(links)

    # The rest, exactly.
    still = apart_in(buckets, found).select("node", "n_shingles", "component").distinct()
    late = cut(confirm(across(still, sets, percent).join(tested, ["a", "b"], "left_anti"), sets, percent))
    if late.limit(1).collect():
        found = components(links.unionByName(late))

    classed = classes.select("d1", "d2", "node", "doc_id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classed = stash(classed, "classed")
    named = stash(classed.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("classes")), "components")
    classed = hot_join(classed, named, "component", named.where(F.col("classes") * HOT >= classed.count())).select("d1", "d2", "component_id")
    grouped = rest.select("doc_id", "n_shingles", "d1", "d2").join(classed, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    return grouped.unionByName(alone)


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group, all columns as they were.

    A document is a row's doc_id and text, so rows that share a doc_id or have none are compared by their own texts. Of a
    group the smallest doc_id stays, null after all others; of equal documents one row stays, texts without words too.
    """
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    grouped = groups(keyed.select(F.col("_row").alias("doc_id"), "text"), percent)
    member = cut(grouped.groupBy(F.col("doc_id").alias("_row")).agg(F.min("component_id").alias("_group"), F.count(F.lit(1)).alias("_rows")))
    named = member.select("_row", "_group").join(keyed.select("_row", "doc_id").distinct(), "_row")
    stays = named.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("_stays"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    stays = stash(stays.select("_group", F.col("_stays._row").alias("_stays"), "_n"), "stays")
    gone = hot_join(named, stays, "_group", stays.where(F.col("_n") * HOT >= member.count())).where(F.col("_row") != F.col("_stays")).select("_row")
    left = keyed.join(gone, "_row", "left_anti")
    again = member.where("_rows > 1").select("_row")
    if again.limit(1).collect():
        left = left.join(again, "_row", "left_anti").unionByName(left.join(again, "_row", "left_semi").dropDuplicates(["_row"]))
    return left.select(*docs.columns)


def op8_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d, range(1, greatest(len(w) - 4, 1) + 1) AS r(i) WHERE len(w) > 0
), n AS (
  SELECT d.doc_id, count(s) AS n FROM d LEFT JOIN sh ON sh.doc_id = d.doc_id GROUP BY d.doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
), link AS (
  SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT b, seen FROM reach JOIN edge ON a = reach.doc_id
)
SELECT n.doc_id, n.n AS n_shingles, min(seen) AS component_id, n.doc_id = min(seen) AS kept FROM n JOIN reach ON reach.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
