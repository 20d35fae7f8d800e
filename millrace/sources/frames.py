"""Frame files: PPM, raw frames, text dumps; codecs as Arrow functions, reading through Spark's own file source."""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from millrace.functions.pixels import bounded, raw_array, raw_bytes

FRAME = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("width", "height", "bits")] + [T.StructField("data", T.ArrayType(T.IntegerType()))]
)
#: Bytes that a worker gathers before it hands them back.
PIECE_BYTES = 4 << 20
_PPM = re.compile(rb"P6(?:\s+#[^\n]*)*\s+(\d+)(?:\s+#[^\n]*)*\s+(\d+)(?:\s+#[^\n]*)*\s+(\d+)\s")


def ppm_bytes(width: int, height: int, bits: int, data) -> bytes:
    """P6; two bytes a sample, high byte first, for 48 bits."""
    top, kind = (255, "u1") if bits == 24 else (65535, ">u2")
    return b"P6\n%d %d %d\n" % (width, height, top) + np.asarray(data).astype(kind).tobytes()


def ppm_frame(raw: bytes | None) -> tuple | None:
    """(width, height, bits, data), or None for anything malformed."""
    m = _PPM.match(raw or b"")
    if not m:
        return None
    w, h, top = int(m[1]), int(m[2]), int(m[3])
    if top not in (255, 65535):
        return None
    size = w * h * 3 * (1 if top == 255 else 2)
    body = raw[m.end() : m.end() + size]
    if len(body) < size:
        return None
    return w, h, 24 if top == 255 else 48, np.frombuffer(body, "u1" if top == 255 else ">u2").astype(np.int32)


def raw_frame(raw: bytes | None) -> tuple | None:
    a = raw_array(raw)
    return None if a is None else (a.shape[1], a.shape[0], 24 if a.itemsize == 1 else 48, a.reshape(-1).astype(np.int32))


def png_frame(raw: bytes | None) -> tuple | None:
    """(width, height, bits, data) of an RGB or RGBA file of 8 or 16 bits, alpha dropped; None for anything else."""
    if not raw or not raw.startswith(b"\x89PNG\r\n\x1a\n"):
        return None
    at, head, packed = 8, None, []
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if head is None or head[2] not in (8, 16) or head[3] not in (2, 6) or head[6]:
        return None
    w, h, depth = head[:3]
    step = (3 if head[3] == 2 else 4) * depth // 8
    try:
        flat = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error:
        return None
    if len(flat) < h * (1 + w * step):
        return None
    rows = np.zeros((h + 1, w + 1, step), np.int64)  # a row and a pixel of zeros before the first
    for y, line in enumerate(flat[: h * (1 + w * step)].reshape(h, 1 + w * step), 1):
        filtered, kind = line[1:].reshape(w, step).astype(np.int64), int(line[0])
        up = rows[y - 1]
        if kind == 0:
            rows[y, 1:] = filtered
        elif kind == 1:
            rows[y, 1:] = np.cumsum(filtered, axis=0) & 255
        elif kind == 2:
            rows[y, 1:] = (filtered + up[1:]) & 255
        elif kind in (3, 4):
            for x in range(1, w + 1):
                a, b, c = rows[y, x - 1], up[x], up[x - 1]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
                rows[y, x] = (filtered[x - 1] + guess) & 255
        else:
            return None
    data = rows[1:, 1:]
    if depth == 16:
        data = data[:, :, 0::2] * 256 + data[:, :, 1::2]
    return w, h, 3 * depth, data[:, :, :3].reshape(-1).astype(np.int32)


def _decoder(fn):
    def decode(content: pd.Series) -> pd.DataFrame:
        rows = [fn(c) or (None, None, None, None) for c in content]
        frame = pd.DataFrame(rows, columns=["width", "height", "bits", "data"])
        return frame.astype({"width": "Int32", "height": "Int32", "bits": "Int32"})

    return F.pandas_udf(decode, FRAME)


def _encoder(fn):
    def encode(width: pd.Series, height: pd.Series, bits: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([fn(*row) for row in zip(width, height, bits, data, strict=True)])

    return F.pandas_udf(encode, T.BinaryType())


def decoded(content: Column, kind: str) -> Column:
    """struct of FRAME from file content; fields are null where it can't be read."""
    return _decoder({"ppm": ppm_frame, "raw": raw_frame, "png": png_frame}[kind])(content)


def encoded(width: Column, height: Column, bits: Column, data: Column, kind: str) -> Column:
    return _encoder({"ppm": ppm_bytes, "raw": raw_bytes}[kind])(width, height, bits, data)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """path and frame of image files by suffix (.ppm, .raw, .png); other files have a null frame, empty ones no row."""
    files = bounded(spark).read.format("binaryFile").load(path).select("path", "content")
    by_suffix = F.when(F.col("path").endswith(".ppm"), decoded(F.col("content"), "ppm")).when(F.col("path").endswith(".raw"), decoded(F.col("content"), "raw")).when(F.col("path").endswith(".png"), decoded(F.col("content"), "png"))
    return files.withColumn("frame", by_suffix).select("path", "frame.*")


def dump_lines(width: Column, height: Column, frameno: Column, bits: int, data: Column) -> Column:
    """array of text lines: a heading, then the samples of a pixel a line in hexadecimal."""
    digits = 2 if bits == 24 else 4
    hexed = F.transform(data, lambda v: F.lower(F.lpad(F.hex(v), digits, "0")))
    pixels = F.transform(F.sequence(F.lit(0), width * height - 1), lambda i: F.concat_ws(" ", F.slice(hexed, i * 3 + 1, F.lit(3))))
    return F.concat(F.array(F.format_string(f"RGB{bits} %dx%d frame %d", width, height, frameno)), pixels)


def hex_lines(content: Column, per_line: int = 16) -> Column:
    """Bytes in hexadecimal, 16 a line."""
    n = F.octet_length(content)
    return F.transform(
        F.when(n > 0, F.sequence(F.lit(0), F.call_function("div", n - 1, F.lit(per_line)).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda i: F.trim(F.regexp_replace(F.lower(F.hex(F.substring(content, i * per_line + 1, F.lit(per_line)))), "(..)", "$1 ")),
    )


def _readable(fn):
    """fn of one binary; null in gives null out, and so do bytes that it can't read."""

    def one(c):
        try:
            return None if c is None else fn(bytes(c))
        except (zlib.error, ValueError):
            return None

    return one


def _guarded(fn):
    """The same over a series of binaries."""
    one = _readable(fn)
    return lambda content: pd.Series([one(c) for c in content])


def run_lengths(b: bytes) -> bytes:
    """Pairs of count (1 to 255) and byte."""
    a = np.frombuffer(b, np.uint8)
    if not len(a):
        return b""
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    out = bytearray()
    for start, n in zip(starts.tolist(), np.diff(np.r_[starts, len(a)]).tolist(), strict=True):
        full, rest = divmod(n, 255)
        out += bytes((255, a[start])) * full + (bytes((rest, a[start])) if rest else b"")
    return bytes(out)


def from_run_lengths(b: bytes) -> bytes:
    if len(b) % 2:
        raise ValueError("half a pair")
    pairs = np.frombuffer(b, np.uint8).reshape(-1, 2)
    return np.repeat(pairs[:, 1], pairs[:, 0]).tobytes()


#: Codecs by name: how to pack and how to unpack. No image codec is at hand, so deflate stands in for them.
CODECS = {"deflate": (lambda b: zlib.compress(b, 6), zlib.decompress), "runs": (run_lengths, from_run_lengths), "null": (bytes, bytes)}


def codec(name: str):
    if name not in CODECS:
        raise ValueError(f"codec {name} is unknown; there are {', '.join(sorted(CODECS))}")
    return CODECS[name]


def pack(content, name: str = "deflate") -> Column:
    return F.pandas_udf(_guarded(codec(name)[0]), T.BinaryType())(content)


def unpack(content, name: str = "deflate") -> Column:
    """The other way; null for bytes that weren't packed so."""
    return F.pandas_udf(_guarded(codec(name)[1]), T.BinaryType())(content)


def unpack_tagged(content: Column, tag: Column) -> Column:
    """Each binary by the codec that its tag names; null for unknown tags and for bytes that weren't packed so."""

    def decode(content: pd.Series, tag: pd.Series) -> pd.Series:
        by_name = {name: _guarded(fns[1]) for name, fns in CODECS.items()}
        return pd.Series([by_name[t]([c])[0] if t in by_name else None for c, t in zip(content, tag, strict=True)])

    return F.pandas_udf(decode, T.BinaryType())(content, tag)


def _added(df: DataFrame, name: str, fn, *columns: str) -> DataFrame:
    """df with a binary column: what fn makes of a row's columns.

    Batches go to Python bounded by bytes and come back in pieces of PIECE_BYTES or one row, so that a worker never holds
    more than a batch, a piece and a row, whatever the rows unpack to. A column function gives back a whole batch at once.
    """
    bounded(df.sparkSession)

    def run(batches):
        for batch in batches:
            at, made, size = 0, [], 0
            for i, row in enumerate(zip(*(batch.column(c) for c in columns), strict=True), 1):
                made.append(fn(*(v.as_py() for v in row)))
                size += len(made[-1] or b"")
                if size >= PIECE_BYTES or i == batch.num_rows:
                    piece = batch.slice(at, i - at)
                    yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(made, pa.binary())], [*piece.schema.names, name])
                    at, made, size = i, [], 0

    return df.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in df.schema), T.StructField(name, T.BinaryType())]))


def with_packed(df: DataFrame, content: str, tag: str, name: str) -> DataFrame:
    """df with each binary packed by the codec that its tag names; as it is for unknown tags."""
    by_name = {n: _readable(fns[0]) for n, fns in CODECS.items()}
    return _added(df, name, lambda c, t: by_name[t](c) if t in by_name else c, content, tag)


def with_unpacked(df: DataFrame, content: str, name: str, tag: str | None = None, of: str = "deflate") -> DataFrame:
    """df with each binary unpacked by the codec that its tag names, or all by one; null as in unpack_tagged and unpack."""
    if tag is None:
        return _added(df, name, _readable(codec(of)[1]), content)
    by_name = {n: _readable(fns[1]) for n, fns in CODECS.items()}
    return _added(df, name, lambda c, t: by_name[t](c) if t in by_name else None, content, tag)


def packed_blocks(items: DataFrame, number: str, content: str, per_block: int, name: str = "deflate") -> DataFrame:
    """One packed block for per_block items in the order of their numbers: block, first, items, size_in, packed.

    A stateful encoder takes items and gives a block now and then; the rest comes out when it is flushed. By number a
    block is a group, its size bounded by per_block items, and the shorter last one is what the flush gives.
    """
    encode = codec(name)[0]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(number)
        raw = [c or b"" for c in table.column(content).to_pylist()]
        numbers = table.column(number).to_pylist()
        whole = b"".join(raw)
        return pa.table({"block": pa.array([numbers[0] // per_block], pa.int64()), "first": pa.array([numbers[0]], pa.int64()), "items": pa.array([len(raw)], pa.int64()), "size_in": pa.array([len(whole)], pa.int64()), "packed": pa.array([encode(whole)], pa.binary())})

    keyed = items.select(F.col(number).cast("long").alias(number), content, F.call_function("div", F.col(number), F.lit(per_block)).alias("_block"))
    return keyed.groupBy("_block").applyInArrow(run, "block long, first long, items long, size_in long, packed binary")


def repeated(items: DataFrame, times: int, name: str = "pass") -> DataFrame:
    """The items `times` times over, once at least; `name` counts the passes from 0."""
    return items.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(max(1, times) - 1))))


def paced(number: Column, rank: Column, per_second: float) -> Column:
    """Milliseconds from the start at which a source of a rank hands out an item: a frame's time for each number, and as
    much for each rank before the first."""
    return F.floor((number + rank) * 1000 / F.lit(float(per_second))).cast("long")


class _Done(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class FileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows):
        names = []
        os.makedirs(self.path, exist_ok=True)
        for row in rows:
            to = os.path.join(self.path, os.path.basename(row["name"]))
            # Written under another name first: a task that is tried again or killed leaves no half file.
            part = f"{to}.{os.getpid()}.part"
            with open(part, "wb") as f:
                f.write(row["content"])
            os.replace(part, to)
            names.append(to)
        return _Done(names)


class FileSink(DataSource):
    """df.write.format("namedfiles"): one file for each row (name, content) in a folder mounted on all executors."""

    @classmethod
    def name(cls):
        return "namedfiles"

    def schema(self):
        return "name string, content binary"

    def writer(self, schema, overwrite):
        return FileWriter(self.options["path"].removeprefix("file://"))


def write_files(df: DataFrame, path: str, name: Column, content: Column) -> None:
    df.sparkSession.dataSource.register(FileSink)
    df.select(name.alias("name"), content.alias("content")).write.format("namedfiles").mode("append").save(path)
