"""Benchmark decontamination by one Aho-Corasick automaton.

Every window of eight consecutive words of a benchmark item (or the whole of a shorter one) becomes a pattern over
normalised text: ASCII letters lowered, words being runs of letters, digits and non-ASCII characters. The automaton's
symbols are words, written as one to three characters each. A document is normalised the same way and run
through the automaton once. Normalising keeps one byte for one byte, so matches are mapped back to places in the original.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import cut, small_batches, stash

WINDOW = 8
#: States of one automaton, about 55 bytes each; a benchmark of more than 170,000 words is scanned for in several passes.
STATES = 1 << 22
#: A word is written as so many characters at most, each with BASE values: the automaton looks its branches through one by one.
DIGITS, BASE = 3, 128
MIN_ITEMS = 2

#: Byte map: A-Z to a-z, other ASCII except digits and letters to a space; bytes of other characters stay.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile(rb"[^ ]+")
#: Ranges of words, and of code points in the original text.
RANGE = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
FOUND = "n_words long, items array<string>, whole boolean, ranges array<struct<first:int,last:int,start:int,end:int>>"
Item = tuple[str | None, list[bytes]]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def patterns_of(items: list[Item], width: int = WINDOW) -> dict[tuple[bytes, ...], list[str | None]]:
    """Windows of words, each with the items it comes from."""
    found: dict[tuple[bytes, ...], list[str | None]] = {}
    for item, words in items:
        for i in range(max(1, len(words) - width + 1) if words else 0):
            owners = found.setdefault(tuple(words[i : i + width]), [])
            if item not in owners:
                owners.append(item)
    return found


def slices_of(benchmark: DataFrame, states: int) -> Iterator[list[Item]]:
    """The benchmark in slices of at most `states` states; read row by row, so the driver holds one slice.

    An item that is larger than what is left of a slice goes on in the next one, seven words earlier, so no window is lost.
    """
    most = max(WINDOW, states // (WINDOW * DIGITS))  # words
    held: list[Item] = []
    left = most
    for item, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).toLocalIterator():
        words = words_of(bytes(text)) if text is not None else []
        at = 0
        while at < len(words) and (at == 0 or at + WINDOW - 1 < len(words)):
            if left < min(WINDOW, len(words) - at):
                yield held
                held, left = [], most
            held.append((item, words[at : at + left]))
            taken = len(held[-1][1])
            left -= taken
            at += taken if at + taken >= len(words) else taken - WINDOW + 1
    if held:
        yield held


class Scanner:
    """The automaton of one slice."""

    def __init__(self, items: list[Item]):
        import ahocorasick

        found = patterns_of(items)
        vocabulary = sorted({w for p in found for w in p})
        self.digits = next((k for k in range(1, DIGITS + 1) if BASE**k >= len(vocabulary)), DIGITS)
        # A digit's place shows in its character, so a match starts and ends with whole words. The last place has no bound.
        place = lambda i, d: chr(256 + BASE * d + (i // BASE**d % BASE if d < self.digits - 1 else i // BASE**d))
        self.code = {w: "".join(place(i, d) for d in range(self.digits)) for i, w in enumerate(vocabulary)}
        self.unknown = "\x00" * self.digits
        self.automaton = ahocorasick.Automaton()
        for pattern, owners in found.items():
            self.automaton.add_word("".join(map(self.code.__getitem__, pattern)), (len(pattern), owners))
        if found:
            self.automaton.make_automaton()

    def inspect(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None], bool]:
        """Merged word ranges inside occurrences, items with occurrences, whether a window had WINDOW words."""
        ranges: list[tuple[int, int]] = []
        items: set[str | None] = set()
        whole = False
        if not words or not self.code:
            return ranges, items, whole
        code, unknown, k = self.code.get, self.unknown, self.digits
        for end, (count, owners) in self.automaton.iter("".join([code(w, unknown) for w in words])):
            last = (end + 1) // k
            ranges.append((last - count, last))
            items.update(owners)
            whole = whole or count >= WINDOW
        ranges.sort()
        merged: list[tuple[int, int]] = []
        for a, b in ranges:
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, items, whole


_built: dict = {}


def _scanner(shared) -> Scanner:
    """Built once in each Python worker for the slice at hand."""
    if shared.id not in _built:
        _built.clear()
        _built[shared.id] = Scanner(shared.value)
    return _built[shared.id]


def places(text: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Word ranges with their offsets (code points) in the original text; one walk over it."""
    if not ranges:
        return []
    at = [m.span() for m in _WORD.finditer(text.translate(FOLD))]
    out, done, n = [], 0, 0

    def upto(b: int) -> int:
        nonlocal done, n
        n += len(text[done:b].decode("utf-8", "replace"))
        done = b
        return n

    for a, b in ranges:
        out.append({"first": a, "last": b, "start": upto(at[a][0]), "end": upto(at[b - 1][1])})
    return out


class _Shared:
    """A broadcast that knows its own number, by which workers keep what they build from it."""

    def __init__(self, spark, items: list[Item]):
        self._broadcast = spark.sparkContext.broadcast(items)
        self.id = self._broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"_broadcast": self._broadcast, "id": self.id}

    @property
    def value(self) -> list[Item]:
        return self._broadcast.value


def _scan(shared: _Shared, keep: tuple[str, ...]):
    def run(batches):
        scanner = _scanner(shared)
        for batch in batches:
            out = []
            for text in batch.column("_text").to_pylist():
                words = words_of(text)
                ranges, items, whole = scanner.inspect(words)
                named = sorted(items, key=lambda x: (x is None, x))
                out.append((len(words), named, whole, places(text, ranges)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = (pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.list_(RANGE))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[*keep, "n_words", "items", "whole", "ranges"])

    return run


def _scanned(docs: DataFrame, items: list[Item], *keep: str) -> DataFrame:
    """The columns named in keep and what the scan finds in the text of each row."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), FOUND])
    return docs.select(*keep, F.col("text").cast("binary").alias("_text")).mapInArrow(_scan(_Shared(docs.sparkSession, items), keep), schema)


def _slices(benchmark: DataFrame, states: int) -> tuple[list[Item], Iterator[list[Item]] | None]:
    """The first slice, and all of them if there are more."""
    slices = slices_of(benchmark, states)
    first, second = next(slices, []), next(slices, None)
    return first, None if second is None else chain([first, second], slices)


def _merged(numbered: DataFrame, slices: Iterator[list[Item]], *keep: str) -> DataFrame:
    """What all slices find in each row; rows are told apart by their column _row."""
    whole = None
    for items in slices:
        part = _scanned(numbered, items, "_row", *keep)
        whole = part if whole is None else whole.unionByName(part)
    together = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    meet = whole.groupBy("_row", *keep, "n_words").agg(together("items"), together("ranges"), F.bool_or("whole").alias("whole"))
    return meet.withColumn("ranges", _union("ranges"))


def _union(column: str):
    """Sorted ranges that neither overlap nor touch from sorted ranges."""
    nothing = F.slice(F.col(column), 1, 0)

    def grow(done, r):
        end = F.element_at(done, -1)
        longer = F.struct(end["first"].alias("first"), F.greatest(end["last"], r["last"]).alias("last"), end["start"].alias("start"), F.greatest(end["end"], r["end"]).alias("end"))
        return F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))

    return F.aggregate(column, nothing, lambda done, r: F.when((F.size(done) > 0) & (r["first"] <= F.try_element_at(done, F.lit(-1))["last"]), grow(done, r)).otherwise(F.concat(done, F.array(r))))


def find_contamination(docs: DataFrame, benchmark: DataFrame, states: int = STATES) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit, items (sorted ids), spans (offsets in the original text),
    whole (a window of the full WINDOW words occurs; an item of fewer words has none).

    A null or empty text has no words, one of any length is scanned whole; an item without words has no window; repeated
    items share patterns; a null item_id is one item, last among the ids. Rows stay apart even if they repeat a doc_id or
    have none, and an empty table gives no rows. A benchmark that needs more than `states` is scanned for slice by slice;
    the rows are numbered and written once before, and the passes are merged by that number. Other columns aren't read.
    """
    small_batches(docs.sparkSession)
    first, slices = _slices(benchmark, states)
    narrow = docs.select("doc_id", "text")
    if slices is None:
        found = _scanned(narrow, first, "doc_id")
    else:
        found = _merged(cut(narrow.withColumn("_row", F.monotonically_increasing_id())), slices, "doc_id")
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    spans = F.transform("ranges", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", spans.alias("spans"), "whole")


def leaks(found: DataFrame):
    """Of what was found in a row: a window of eight words of any item, or two shorter items."""
    return F.col("whole") | (F.size("items") >= MIN_ITEMS)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, states: int = STATES) -> DataFrame:
    """docs without the rows that leak, all columns as they were, whatever they are called.

    Rows are judged where they lie. Only a benchmark of several slices numbers and joins them.
    """
    small_batches(docs.sparkSession)
    first, slices = _slices(benchmark, states)
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), "text")
    if slices is None:
        found = _scanned(packed, first, "_doc")
        return found.where(~leaks(found)).select("_doc.*")
    numbered = stash(packed.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = _merged(numbered, slices)
    return numbered.join(found.where(leaks(found)).select("_row"), "_row", "left_anti").select("_doc.*")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= MIN_ITEMS).alias("contaminated"),
    )


_FOLDED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_FOLDED} FROM documents), b AS (SELECT item_id, {_FOLDED} FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT *, least(8, len(w)) AS k FROM b WHERE len(w) > 0), range(1, len(w) - k + 2) AS r(i)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM d, (SELECT DISTINCT k FROM bw), range(1, len(w) - k + 2) AS r(i)),
hit AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, s)),
pos AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM hit, range(k) AS r(j) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(it.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""
