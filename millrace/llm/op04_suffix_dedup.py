"""Removal of repeated 50-byte strings by blockwise suffix sorting.

Sorting every suffix of the corpus would move 50 bytes for each byte of text. Here a cover sample is ranked first and
suffixes are sorted one bucket at a time, only where a sample says that there is something to tie with:

1. The cover sample: among the hashes of the 20-byte strings inside a 50-byte window, the smallest. Equal windows
   have equal samples wherever they stand, which is what a difference cover guarantees for two positions; this
   sample is a third of the size (one in 16 positions, not one in 5).
2. Samples that only one document has can't be part of a repeat. Blocks of documents send the distinct samples they
   hold to buckets, a few bytes each, and get back those that are shared.
3. Windows with a shared sample go to the sample's bucket, runs of them as one stretch of text. A bucket at a time is
   sorted: suffixes by their first bytes, long ties by names worked out beforehand for all places, so a tie costs a
   look-up, not a comparison of 50 bytes. The smallest doc_id of each 50-byte string goes back to the blocks.
4. Blocks remove what starts in a document with a smaller id.

A sample that very many texts hold would put all its surroundings into one bucket. Its windows are dealt on by what
stands next to the sample: the 15 bytes after it where it lies in the front half of the window, the 16 before it otherwise.
Equal windows have equal neighbours, so they still meet.

Texts are shuffled once, into blocks; what else moves is samples, shared stretches and ranks. A string that a third
of all documents share counts once for each block in any bucket. The numbers of blocks, buckets and partitions follow the
bytes of the input, so a task's share doesn't.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import U64, splitmix
from millrace.session import importable

LENGTH = 50
GRAM = 20
SPAN = LENGTH - GRAM + 1
BLOCK_BYTES = 2 << 20
#: Samples of one bucket, on average.
BUCKET_SAMPLES = 1 << 18
#: A sample with more runs of windows than this is hot: about 45 MB of text around it. Cutting its runs up moves up to twice
#: their bytes, so it is done only where one bucket would have to hold them all.
HOT_RUNS = 1 << 19
#: Runs of one sample in one block from which on a block tells their number; fewer count as one.
TOLD_RUNS = 16
#: Blocks and buckets of one partition.
PART_BLOCKS, PART_BUCKETS = 8, 4
#: Offsets of a sample in a window up to which the bytes after it deal the window on.
FRONT = (LENGTH - GRAM) // 2
LAST = np.iinfo(np.int64).max

_BYTE = splitmix(np.arange(256, dtype=U64))


def _join(left: np.ndarray, right: np.ndarray, odd: int) -> np.ndarray:
    x = left * U64(odd)
    x += right
    x ^= x >> U64(31)
    x *= U64(0x9E3779B97F4A7C15)
    return x


def hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the 8-, 16- and 20-byte strings at all places."""
    h1 = _BYTE[buf]
    h2 = _join(h1[:-1], h1[1:], 0xBF58476D1CE4E5B9)
    h4 = _join(h2[:-2], h2[2:], 0x94D049BB133111EB)
    h8 = _join(h4[:-4], h4[4:], 0xD6E8FEB86659FD93)
    h16 = _join(h8[:-8], h8[8:], 0xA0761D6478BD642F)
    n = len(buf) - GRAM + 1
    h = _join(h16[:n], h4[16 : 16 + n], 0xE7037ED1A0B428DB)
    h ^= h >> U64(32)
    return h8, h16, h


def samples(h: np.ndarray) -> np.ndarray:
    """For each 50-byte window the smallest hash of its 20-byte strings."""
    for step in (1, 2, 4, 8):
        h = np.minimum(h[:-step], h[step:])
    return np.minimum(h[: len(h) - (SPAN - 16)], h[SPAN - 16 :])


class Block:
    """Texts of one block side by side, and the runs of windows that have the same sample."""

    def __init__(self, table: pa.Table):
        # The order within a block is fixed by content, so that every pass numbers stretches alike.
        texts = table.column("text").to_pylist()
        ids = [LAST if d is None else d for d in table.column("doc_id").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.raw_ids = [table.column("doc_id")[i].as_py() for i in order]
        self.ids = np.array([ids[i] for i in order], dtype=np.int64)
        self.text = b"".join(texts[i] for i in order)
        self.buf = np.frombuffer(self.text, np.uint8)
        self.ends = np.cumsum([len(texts[i]) for i in order], dtype=np.int64)
        self.starts = self.ends - np.array([len(texts[i]) for i in order], dtype=np.int64)

    def runs(self, buckets: int) -> None:
        """self.first, self.last (windows of a run), self.doc, self.key, self.bucket; runs in the order of the text."""
        n = len(self.buf) - LENGTH + 1
        self.dealt = np.empty(0, bool)
        if n <= 0:
            self.first = self.last = self.doc = self.bucket = np.empty(0, np.int64)
            self.key = np.empty(0, U64)
            return
        self._h8, self._h16, self._h20 = hashes(self.buf)
        self._m = m = samples(self._h20)
        fresh = np.ones(n, bool)
        fresh[1:] = m[1:] != m[:-1]
        valid = np.zeros(n, bool)
        for s, e in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            if e - s >= LENGTH:
                valid[s : e - LENGTH + 1] = True
                fresh[s] = True
                if e - LENGTH + 1 < n:
                    fresh[e - LENGTH + 1] = True
        first = np.flatnonzero(fresh)
        last = np.r_[first[1:], n] - 1
        real = valid[first]
        self.first, self.last = first[real], last[real]
        self.doc = np.searchsorted(self.ends, self.first, side="right")
        self.key = splitmix(m[self.first])
        self.bucket = _bucket(self.key, buckets)
        self.dealt = np.zeros(len(self.first), bool)

    def deal(self, hot: np.ndarray, buckets: int) -> None:
        """Runs of hot samples cut up by what stands next to the sample; they go to buckets of their own."""
        mask = np.isin(_name(self.bucket, self.key), hot)
        if not mask.any():
            return
        count = self.last[mask] - self.first[mask] + 1
        w = _ranges(self.first[mask], count)
        least = self._m[w]
        # The first place in each window where the sample stands.
        offset = np.full(len(w), -1)
        for o in range(SPAN):
            here = (offset < 0) & (self._h20[np.minimum(w + o, len(self._h20) - 1)] == least)
            offset[here] = o
        front = offset <= FRONT
        at = w + offset
        near = np.empty(len(w), U64)
        near[front] = _join(self._h8[at[front] + GRAM], self._h8[at[front] + GRAM + FRONT - 8], 0x8EBC6AF09C88C6E3)
        near[~front] = self._h16[at[~front] - 16]
        key = splitmix(splitmix(least) ^ near ^ front.astype(U64))
        fresh = np.r_[True, key[1:] != key[:-1]]
        fresh[np.cumsum(count) - count] = True
        head = np.flatnonzero(fresh)
        size = np.diff(np.r_[head, len(w)])
        first = np.r_[self.first[~mask], w[head]]
        order = np.argsort(first, kind="stable")
        self.first = first[order]
        self.last = np.r_[self.last[~mask], w[head] + size - 1][order]
        self.key = np.r_[self.key[~mask], key[head]][order]
        self.dealt = np.r_[np.zeros(int((~mask).sum()), bool), np.ones(len(head), bool)][order]
        self.doc = np.searchsorted(self.ends, self.first, side="right")
        self.bucket = np.where(self.dealt, buckets, 0) + _bucket(self.key, buckets)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> U64(32)) % U64(buckets)).astype(np.int64)


def _low(key: np.ndarray) -> np.ndarray:
    return (key & U64(0xFFFFFFFF)).astype(np.uint32)


def _name(bucket: np.ndarray, key: np.ndarray) -> np.ndarray:
    """What a sample is known by: its bucket and the lower half of its key."""
    return (bucket.astype(U64) << U64(32)) | _low(key).astype(U64)


def _split(bucket: np.ndarray):
    """(bucket, indices) for each bucket that occurs, indices in their order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


def _stretches(block: Block, shared: np.ndarray):
    """Shared runs of a block, equal stretches taken together: (runs kept, stretch of each, first run of each)."""
    kept = np.flatnonzero(block.dealt | np.isin(_name(block.bucket, block.key), shared))
    if not len(kept):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    seen: dict[bytes, int] = {}
    of = np.empty(len(kept), np.int64)
    heads = []
    text = block.text
    for i, (a, b) in enumerate(zip(block.first[kept].tolist(), (block.last[kept] + LENGTH).tolist(), strict=True)):
        s = text[a:b]
        g = seen.get(s)
        if g is None:
            g = seen[s] = len(heads)
            heads.append(kept[i])
        of[i] = g
    return kept, of, np.array(heads, dtype=np.int64)


SAMPLES = "bucket long, block long, low binary, many binary, told binary"
SHARED = "block long, bucket long, low binary, hot binary"
STRETCHES = "bucket long, block long, low binary, bytes binary, sizes binary, docs binary, hot binary"
RANKS = "block long, bucket long, low binary, counts binary, lengths binary, owners binary, hot binary"


def _table(schema: str, columns: list[list]) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    names = [x.strip().split() for x in schema.split(",")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def _gather(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        block = Block(table)
        block.runs(buckets)
        out: list[list] = [[], [], [], [], []]
        if len(block.key):
            order = np.argsort(block.key, kind="stable")
            key, doc = block.key[order], block.doc[order]
            head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            many = np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head)
            times = np.diff(np.r_[head, len(key)]).astype(np.uint32)
            key = key[head]
            name = table.column("block")[0].as_py()
            for b, part in _split(_bucket(key, buckets)):
                often = np.flatnonzero(times[part] >= TOLD_RUNS).astype(np.uint32)
                told = np.stack([often, times[part][often]]).tobytes()
                for column, x in zip(out, (b, name, _low(key[part]).tobytes(), np.packbits(many[part]).tobytes(), told), strict=True):
                    column.append(x)
        return _table(SAMPLES, out)

    return run


def _share(table: pa.Table) -> pa.Table:
    lows = [np.frombuffer(x, np.uint32) for x in table.column("low").to_pylist()]
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(y)) for x, y in zip(table.column("many").to_pylist(), lows, strict=True)])
    low = np.concatenate(lows)
    times = np.ones(len(low), np.int64)
    for at, told in zip(np.cumsum([0, *map(len, lows)]).tolist(), table.column("told").to_pylist(), strict=False):
        index, n = np.frombuffer(told, np.uint32).reshape(2, -1)
        times[at + index.astype(np.int64)] = n
    source = np.repeat(np.arange(len(lows)), [len(x) for x in lows])
    order = np.argsort(low, kind="stable")
    head = np.flatnonzero(np.r_[True, low[order][1:] != low[order][:-1]])
    sizes = np.diff(np.r_[head, len(low)])
    keep = (sizes > 1) | (np.maximum.reduceat(many[order], head) > 0)
    hit = order[np.repeat(keep, sizes)]
    hot = np.repeat(np.add.reduceat(times[order], head) > HOT_RUNS, sizes)[np.repeat(keep, sizes)]
    blocks, bucket = table.column("block").to_pylist(), table.column("bucket")[0].as_py()
    out: list[list] = [[], [], [], []]
    for s, part in _split(source[hit]):
        names, at = np.unique(low[hit[part]], return_index=True)
        for column, x in zip(out, (blocks[s], bucket, names.tobytes(), np.packbits(hot[part][at]).tobytes()), strict=True):
            column.append(x)
    return _table(SHARED, out)


def _names_of(replies: pa.Table) -> list[np.ndarray]:
    return [(U64(b) << U64(32)) | np.frombuffer(x, np.uint32).astype(U64) for b, x in zip(replies.column("bucket").to_pylist(), replies.column("low").to_pylist(), strict=True)]


def _union(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, U64)


def _send(buckets: int):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(7)]
        if table.num_rows and replies.num_rows:
            block = Block(table)
            block.runs(buckets)
            names = _names_of(replies)
            hot = _union([n[np.unpackbits(np.frombuffer(x, np.uint8), count=len(n)) > 0] for n, x in zip(names, replies.column("hot").to_pylist(), strict=True)])
            block.deal(hot, buckets)
            kept, of, heads = _stretches(block, _union(names))
            if len(heads):
                owner = np.full(len(heads), LAST, np.int64)
                np.minimum.at(owner, of, block.ids[block.doc[kept]])
                name = table.column("block")[0].as_py()
                a, b = block.first[heads], block.last[heads] + LENGTH
                for bucket, part in _split(block.bucket[heads]):
                    row = (
                        bucket,
                        name,
                        _low(block.key[heads[part]]).tobytes(),
                        b"".join(block.text[x:y] for x, y in zip(a[part].tolist(), b[part].tolist(), strict=True)),
                        (b[part] - a[part]).astype(np.uint32).tobytes(),
                        owner[part].tobytes(),
                        # By these the block cuts its runs in the same way when the ranks come back.
                        hot.tobytes() if bucket >= buckets else b"",
                    )
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
        return _table(STRETCHES, out)

    return run


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + count[0] - 1, start[1] .. and so on."""
    at = np.cumsum(count) - count
    return np.repeat(start - at, count) + np.arange(int(count.sum()))


def doubled(w: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ranks of the 50-byte strings at starts from the 8-byte words at all places: 8, 16, 32, 50 bytes."""
    name = np.unique(w, return_inverse=True)[1].astype(U64)
    for step in (8, 16):
        name = np.unique((name[:-step] << U64(32)) | name[step:], return_inverse=True)[1].astype(U64)
    return np.unique((name[starts] << U64(32)) | name[starts + LENGTH - 32], return_inverse=True)[1]


def rank(text: bytes, starts: np.ndarray) -> np.ndarray:
    """Numbers of the 50-byte strings at starts, ordered by their first 8 bytes; equal strings have equal numbers.

    Ties in the first bytes are resolved by names that are worked out once for all places of the bucket. Neighbours of
    one name are compared byte by byte; should two strings share a name, ranks are doubled exactly instead.
    """
    buf = np.frombuffer(text + bytes(64), np.uint8)
    w = buf.astype(U64)
    for step in (1, 2, 4):
        w = (w[:-step] << U64(8 * step)) | w[step:]
    h2 = _join(_BYTE[buf[:-1]], _BYTE[buf[1:]], 0xBF58476D1CE4E5B9)
    h16 = h2
    for step, odd in ((2, 0x94D049BB133111EB), (4, 0xD6E8FEB86659FD93), (8, 0xA0761D6478BD642F)):
        h16 = _join(h16[:-step], h16[step:], odd)
    h32 = _join(h16[:-16], h16[16:], 0x8EBC6AF09C88C6E3)
    name = _join(_join(h32[starts], h16[starts + 32], 0x589965CC75374CC3), h2[starts + 48], 0x1D8E4E27C47D124F)
    order = np.lexsort((name, w[starts]))
    name, at = name[order], starts[order]
    same = np.r_[False, (name[1:] == name[:-1]) & (w[at[1:]] == w[at[:-1]])]
    tied = np.flatnonzero(same)
    if any((w[at[tied] + o] != w[at[tied - 1] + o]).any() for o in (8, 16, 24, 32, 40, LENGTH - 8)):
        return doubled(w, starts)
    out = np.empty(len(starts), np.int64)
    out[order] = np.cumsum(~same) - 1
    return out


def owners(stretches: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smallest doc that has the 50-byte string at each window of each stretch, as runs of windows.

    (number of runs of each stretch, windows of each run, doc of each run), in the order of stretches.
    """
    seen: dict[bytes, int] = {}
    of = np.fromiter((seen.setdefault(s, len(seen)) for s in stretches), np.int64, len(stretches))
    own = np.full(len(seen), LAST, np.int64)
    np.minimum.at(own, of, docs)
    sizes = np.fromiter(map(len, seen), np.int64, len(seen))
    windows = sizes - LENGTH + 1
    first = np.cumsum(windows) - windows
    starts = _ranges(np.cumsum(sizes) - sizes, windows)
    ranks = rank(b"".join(seen), starts)
    least = np.full(int(ranks.max()) + 1, LAST, np.int64)
    np.minimum.at(least, ranks, np.repeat(own, windows))
    found = least[ranks]
    fresh = np.r_[True, found[1:] != found[:-1]]
    fresh[first] = True
    head = np.flatnonzero(fresh)
    lengths = np.diff(np.r_[head, len(found)])
    counts = np.add.reduceat(fresh.astype(np.int64), first)
    pick = _ranges((np.cumsum(counts) - counts)[of], counts[of])
    return counts[of], lengths[pick], found[head][pick]


def _sort(table: pa.Table) -> pa.Table:
    stretches, docs, sizes = [], [], []
    for text, size, doc in zip(*(table.column(c).to_pylist() for c in ("bytes", "sizes", "docs")), strict=True):
        ends = np.cumsum(np.frombuffer(size, np.uint32).astype(np.int64)).tolist()
        stretches += [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        docs.append(np.frombuffer(doc, np.int64))
        sizes.append(len(ends))
    counts, lengths, values = owners(stretches, np.concatenate(docs))
    runs = np.r_[0, np.cumsum(counts)]
    out: list[list] = [[] for _ in range(7)]
    i = 0
    for n, block, bucket, low, hot in zip(sizes, *(table.column(c).to_pylist() for c in ("block", "bucket", "low", "hot")), strict=True):
        a, b = runs[i], runs[i + n]
        row = (block, bucket, low, counts[i : i + n].astype(np.uint32).tobytes(), lengths[a:b].astype(np.uint32).tobytes(), values[a:b].tobytes(), hot)
        i += n
        for column, x in zip(out, row, strict=True):
            column.append(x)
    return _table(RANKS, out)


def removed(block: Block, replies: pa.Table, buckets: int) -> np.ndarray:
    """Mask of the bytes of a block that go."""
    n = len(block.buf)
    if not replies.num_rows or n < LENGTH:
        return np.zeros(n, bool)
    block.runs(buckets)
    block.deal(_union([np.frombuffer(x, U64) for x in replies.column("hot").to_pylist() if x]), buckets)
    kept, of, heads = _stretches(block, _union(_names_of(replies)))
    place = dict(_split(block.bucket[heads]))
    # Runs of windows of each stretch, stretches in the order of the replies.
    counts, lengths, values, order = [], [], [], []
    for bucket, count, length, owner in zip(*(replies.column(c).to_pylist() for c in ("bucket", "counts", "lengths", "owners")), strict=True):
        order.append(place[bucket])
        counts.append(np.frombuffer(count, np.uint32))
        lengths.append(np.frombuffer(length, np.uint32))
        values.append(np.frombuffer(owner, np.int64))
    count = np.empty(len(heads), np.int64)
    start = np.empty(len(heads), np.int64)
    each, order = np.concatenate(counts).astype(np.int64), np.concatenate(order)
    count[order], start[order] = each, np.cumsum(each) - each
    length, owner = np.concatenate(lengths).astype(np.int64), np.concatenate(values)
    # Each run of each occurrence: its first window in the block, its length, and whether it starts in a smaller doc.
    pick = _ranges(start[of], count[of])
    before = np.cumsum(length) - length
    offset = before[pick] - np.repeat(before[start[of]], count[of])
    first = np.repeat(block.first[kept], count[of]) + offset
    hit = owner[pick] < np.repeat(block.ids[block.doc[kept]], count[of])
    gone = np.bincount(first[hit], minlength=n + 1) - np.bincount(first[hit] + length[pick][hit] - 1 + LENGTH, minlength=n + 1)
    return np.cumsum(gone[:n]) > 0


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _apply(buckets: int, texts: bool):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(5 + texts)]
        if table.num_rows:
            block = Block(table)
            mask = removed(block, replies, buckets)
            for doc, s, e in zip(block.raw_ids, block.starts.tolist(), block.ends.tolist(), strict=True):
                part = mask[s:e]
                n = int(part.sum())
                text = block.buf[s:e][~part].tobytes() if n else block.text[s:e]
                spans = int(np.count_nonzero(np.diff(np.r_[False, part].view(np.int8)) == 1)) if n else 0
                row = (doc, e - s, n, spans, hashlib.sha256(text).hexdigest(), *([text] if texts else []))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
        return _table(RESULT + (", kept binary" if texts else ""), out)

    return run


def remove_repeats(docs: DataFrame, texts: bool = False, block_bytes: int = BLOCK_BYTES, bucket_samples: int = BUCKET_SAMPLES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row; with `texts` also the bytes that stay.

    Every byte goes that a 50-byte string covers which also starts in a row with a smaller doc_id, judged on the input.
    A null text is empty. Rows with the same doc_id don't take from each other; a null doc_id counts as the largest.
    Texts under 50 bytes stay whole. An empty table gives no rows; other columns aren't read.
    """
    spark = docs.sparkSession
    importable(spark)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    buckets = max(1, -(-total // 16 // bucket_samples))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts, bucket_parts = max(least, -(-blocks // PART_BLOCKS)), max(least, -(-buckets // PART_BUCKETS))
    narrow = docs.select("doc_id", text.alias("text"))
    # Used three times and shuffled once: the plan has one exchange of texts, which is reused.
    placed = narrow.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks))).repartition(parts, "block")
    gathered = placed.groupBy("block").applyInArrow(_gather(buckets), SAMPLES)
    shared = gathered.repartition(bucket_parts, "bucket").groupBy("bucket").applyInArrow(_share, SHARED)
    sent = placed.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_send(buckets), STRETCHES)
    ranked = sent.repartition(2 * bucket_parts, "bucket").groupBy("bucket").applyInArrow(_sort, RANKS)
    return placed.groupBy("block").cogroup(ranked.groupBy("block")).applyInArrow(_apply(buckets, texts), RESULT + (", kept binary" if texts else ""))


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every 50-byte string as hexadecimal digits, cut out of pieces of 1,000 bytes.
ORACLE = r"""
WITH h AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents
), part AS (
  SELECT doc_id, k * 1000 AS base, substr(x, k * 2000 + 1, 2098) AS p FROM h, range(0, (n + 999) // 1000) AS r(k)
), win AS (
  SELECT doc_id, base + i AS place, substr(p, 2 * i + 1, 100) AS s FROM part, range(0, 1000) AS r(i) WHERE length(p) >= 2 * i + 100
), least AS (
  SELECT s, min(doc_id) AS first FROM win GROUP BY s HAVING count(*) > 1
), hit AS (
  SELECT win.doc_id, place, lag(place) OVER (PARTITION BY win.doc_id ORDER BY place) AS before FROM win JOIN least USING (s) WHERE first < win.doc_id
), run AS (
  SELECT doc_id, place, sum(CASE WHEN before IS NULL OR place - before > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM hit
), span AS (
  SELECT doc_id, min(place) AS start, max(place) + 50 AS stop FROM run GROUP BY doc_id, run
), gap AS (
  SELECT doc_id, start, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS since FROM span
), cut AS (
  SELECT h.doc_id, sum(stop - start) AS n_removed, count(*) AS n_spans,
         string_agg(substr(x, 2 * since + 1, 2 * (start - since)), '' ORDER BY start) || substr(any_value(x), 2 * max(stop) + 1) AS kept
  FROM gap JOIN h USING (doc_id) GROUP BY h.doc_id
)
SELECT h.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM h LEFT JOIN cut USING (doc_id)
"""
