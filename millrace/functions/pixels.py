"""Pixel kernels over one frame a row.

A frame is width, height and data, an array of unsigned samples in rows of interleaved bands, or one binary in the raw
frame format (see raw_bytes). Kernels stay inside the row, so frames are worked on where they lie: no shuffle, whatever
the kernel's reach. Each kernel is a function on a height x width x bands array; Arrow carries whole frames to it. `chain`
runs several kernels on packed frames in one go, so that a frame crosses to Python and back once, at a byte a sample.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BANDS = 3
SHARPEN = ((-1, -1, -1), (-1, 9, -1), (-1, -1, -1))
BLUR = ((1, 1, 1), (1, 1, 1), (1, 1, 1))
#: Bytes of frames that go to a Python worker at once.
BATCH_BYTES = 16 << 20

Kernel = Callable[[np.ndarray], np.ndarray | None]


def bounded(spark: SparkSession) -> SparkSession:
    """Frames are large, so a batch is bounded by bytes; a smaller bound of the caller's stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


# Kernels on arrays.


def convolved(a: np.ndarray, kernel, weight: int, top: int = 255) -> np.ndarray:
    out = a.copy()
    if a.shape[0] < 3 or a.shape[1] < 3:
        return out
    reach = sum(abs(k) for row in kernel for k in row) * top + weight
    kind = np.int16 if reach < 1 << 15 else np.int64
    h, w = a.shape[0] - 2, a.shape[1] - 2
    wide = a.astype(kind)
    total = np.full((h, w, a.shape[2]), weight // 2, kind)
    for k in sorted({k for row in kernel for k in row} - {0}):
        # Neighbours of one coefficient are added first and multiplied once.
        places = [(y, x) for y, row in enumerate(kernel) for x, v in enumerate(row) if v == k]
        same = np.zeros_like(total)
        for y, x in places:
            same += wide[y : y + h, x : x + w]
        if k != 1:
            same *= k
        total += same
    if weight != 1:
        # Below zero the cut makes up for the difference between whole division and rounding down.
        total //= weight
    out[1:-1, 1:-1] = np.clip(total, 0, top)
    return out


def boxed_down(a: np.ndarray, factor: int, rounded: bool = True) -> np.ndarray | None:
    h, w, bands = a.shape
    if h % factor or w % factor:
        return None
    half = factor * factor // 2 if rounded else 0
    return (a.reshape(h // factor, factor, w // factor, factor, bands).sum(axis=(1, 3), dtype=np.int64) + half) // (factor * factor)


def scaled_up(a: np.ndarray, factor: int, top: int = 255) -> np.ndarray:
    h, w, bands = a.shape
    kind = np.int32 if 2 * factor * factor * (top + 1) < 1 << 31 else np.int64
    a = a.astype(kind)
    right = np.concatenate([a[:, 1:], a[:, -1:]], axis=1)
    out = np.empty((h, factor, w, factor, bands), kind)
    half = factor * factor
    for dx in range(factor):
        row = a * (factor - dx) + right * dx if dx else a * factor
        below = np.concatenate([row[1:], row[-1:]], axis=0)
        for dy in range(factor):
            v = row * (2 * (factor - dy)) + below * (2 * dy) if dy else row * (2 * factor)
            v += half
            v //= 2 * half
            out[:, dy, :, dx] = v
    return np.minimum(out, top).reshape(h * factor, w * factor, bands)


def picked(a: np.ndarray, to_width: int, to_height: int) -> np.ndarray:
    h, w, _ = a.shape
    return a[np.arange(to_height) * h // to_height][:, np.arange(to_width) * w // to_width]


def mixed(a: np.ndarray, m, top: int = 255) -> np.ndarray:
    r, g, b = (a[:, :, i].astype(np.float64) for i in range(BANDS))
    return np.stack([np.clip(np.floor(float(x) * r + float(y) * g + float(z) * b + 0.5), 0, top) for x, y, z in m], axis=2).astype(np.int64)


def yuv420(a: np.ndarray) -> np.ndarray:
    """Planar Y, U, V in one dimension; dimensions are even."""
    whole = lambda r, g, b, p: (p[0] * r + p[1] * g + p[2] * b).astype(np.int64)
    wide = [a[:, :, i].astype(np.int64) for i in range(BANDS)]
    mean = [(c[0::2, 0::2] + c[0::2, 1::2] + c[1::2, 0::2] + c[1::2, 1::2]) // 4 for c in wide]
    return np.concatenate([(16 + whole(*wide, (0.257, 0.504, 0.098))).ravel(), (128 + whole(*mean, (-0.148, -0.291, 0.439))).ravel(), (128 + whole(*mean, (0.439, -0.368, -0.071))).ravel()])


# Kernels as columns over arrays of samples.


def _lists(values: list[np.ndarray | None]) -> pa.Array:
    flat = [v.reshape(-1).astype(np.int32) if v is not None else None for v in values]
    offsets = np.zeros(len(flat) + 1, np.int64)
    np.cumsum([0 if v is None else len(v) for v in flat], out=offsets[1:])
    if offsets[-1] >= 1 << 31:
        raise ValueError("a batch of frames has over 2^31 samples")
    kept = [v for v in flat if v is not None]
    body = pa.array(np.concatenate(kept) if kept else np.empty(0, np.int32), pa.int32())
    missing = pa.array([v is None for v in flat]) if len(kept) < len(flat) else None
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), body, mask=missing)


def _each(data: pa.Array):
    for v in data:
        yield v.values.to_numpy(zero_copy_only=False) if v.is_valid else None


def _over(kernel: Kernel, data: Column, width: Column, height: Column, bands: int = BANDS) -> Column:
    """data of the frame that kernel makes; null where it makes none, or data, width or height is null."""

    @F.arrow_udf("array<int>")
    def run(data: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        out = []
        for v, w, h in zip(_each(data), width.to_pylist(), height.to_pylist(), strict=True):
            out.append(None if v is None or w is None or h is None else v if not len(v) else kernel(v.reshape(h, w, bands)))
        return _lists(out)

    return run(data, width, height)


def _made(kernel, *columns: Column) -> Column:
    @F.arrow_udf("array<int>")
    def run(*columns: pa.Array) -> pa.Array:
        return _lists([None if None in row else kernel(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)])

    return run(*(c if isinstance(c, Column) else F.lit(c) for c in columns))


def _samples(kernel: Kernel, data: Column) -> Column:
    """The same for kernels that don't ask where a sample stands."""

    @F.arrow_udf("array<int>")
    def run(data: pa.Array) -> pa.Array:
        return _lists([None if v is None else kernel(v) for v in _each(data)])

    return run(data)


def gradient(width: int, height: int, r: Column, g: Column, b: Column) -> Column:
    """red grows with x, green with y, blue is flat; samples wrap at 256."""
    return _made(lambda r, g, b: gradient_frame(width, height, r, g, b), r, g, b)


def gradient_frame(width: int, height: int, r: int, g: int, b: int) -> np.ndarray:
    out = np.empty((height, width, BANDS), np.uint8)
    out[:, :, 0] = ((np.arange(width) + r) & 255)[None, :]
    out[:, :, 1] = ((np.arange(height) + g) & 255)[:, None]
    out[:, :, 2] = b & 255
    return out


def gradient48(width: int, height: int) -> Column:
    def frame(_):
        out = np.empty((height, width, BANDS), np.int64)
        out[:, :, 0] = (200 * np.arange(width) & 65535)[None, :]
        out[:, :, 1] = (200 * np.arange(height) & 65535)[:, None]
        out[:, :, 2] = 127 * 256
        return out

    return _made(frame, F.lit(0))


def constant(width: int, height: int, r: int, g: int, b: int) -> Column:
    return F.flatten(F.array_repeat(F.array(F.lit(r), F.lit(g), F.lit(b)), width * height))


def convolve(data: Column, width: Column, height: Column, kernel, weight: int, top: int = 255) -> Column:
    """3 x 3 convolution: whole division of the sum plus half the weight, cut to the range; the border is copied."""
    return _over(lambda a: convolved(a, kernel, weight, top), data, width, height)


def box_down(data: Column, width: Column, height: Column, factor: int, rounded: bool = True) -> Column:
    """Mean of factor x factor samples; null where a dimension isn't a multiple."""
    return _over(lambda a: boxed_down(a, factor, rounded), data, width, height)


def bilinear_up(data: Column, width: Column, height: Column, factor: int, top: int = 255) -> Column:
    """Weights by the place between neighbours; the last row and column repeat themselves; rounded half up."""
    return _over(lambda a: scaled_up(a, factor, top), data, width, height)


def nearest(data: Column, width: Column, height: Column, to_width: int, to_height: int) -> Column:
    return _over(lambda a: picked(a, to_width, to_height), data, width, height)


def replicate(data: Column, width: Column, height: Column, times: int = 2) -> Column:
    return _over(lambda a: a.repeat(times, axis=0).repeat(times, axis=1), data, width, height)


def colour_matrix(data: Column, width: Column, height: Column, m, top: int = 255) -> Column:
    return _over(lambda a: mixed(a, m, top), data, width, height)


def channel_gain(data: Column, gains, top: int = 255) -> Column:
    def gained(v):
        g = np.resize(np.asarray(gains, np.float64), len(v))
        return np.clip(np.floor(v * g), 0, top).astype(np.int64)

    return _samples(gained, data)


def depth_24_to_48(data: Column) -> Column:
    return _samples(lambda v: v.astype(np.int32) * 255, data)


def depth_48_to_24(data: Column) -> Column:
    return _samples(lambda v: v // 255 & 255, data)


def depth_reduce(data: Column) -> Column:
    """The high byte."""
    return _samples(lambda v: v >> 8, data)


def alpha_strip(data: Column) -> Column:
    """Every fourth sample goes."""
    return _samples(lambda v: v[np.arange(len(v)) % 4 < 3], data)


def slice_rows(data: Column, width: Column, start: Column, end: Column) -> Column:
    return F.slice(data, start * width * BANDS + 1, (end - start) * width * BANDS)


def checksum(data: Column) -> Column:
    """Sum of samples as signed bytes."""

    @F.arrow_udf("bigint")
    def run(data: pa.Array) -> pa.Array:
        return pa.array([None if v is None else int(v.astype(np.uint8).view(np.int8).sum(dtype=np.int64)) for v in _each(data)], pa.int64())

    return run(data)


def to_yuv420(data: Column, width: Column, height: Column) -> Column:
    """Planar Y, U, V: luma for each pixel, chroma from whole means of 2 x 2 pixels (even dimensions)."""
    return _over(yuv420, data, width, height)


# Packed frames: one binary each, big-endian bits, width and height before the samples.


def raw_bytes(width: int, height: int, bits: int, data) -> bytes:
    return struct.pack(">iii", bits, width, height) + np.asarray(data).astype("u1" if bits == 24 else ">u2").tobytes()


def raw_array(raw: bytes | None) -> np.ndarray | None:
    """The samples as height x width x 3 array; None for anything malformed."""
    if raw is None or len(raw) < 12:
        return None
    bits, w, h = struct.unpack(">iii", raw[:12])
    if bits not in (24, 48) or w < 0 or h < 0 or len(raw) < 12 + w * h * bits // 8:
        return None
    return np.frombuffer(raw, "u1" if bits == 24 else ">u2", w * h * BANDS, 12).reshape(h, w, BANDS)


def packed_gradient(width: int, height: int, r: Column, g: Column, b: Column) -> Column:
    @F.arrow_udf("binary")
    def run(r: pa.Array, g: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([raw_bytes(width, height, 24, gradient_frame(width, height, *x)) for x in zip(r.to_pylist(), g.to_pylist(), b.to_pylist(), strict=True)], pa.binary())

    return run(r, g, b)


def deflated(a: np.ndarray) -> bytes:
    """The stand-in for an image codec: the frame in raw format, deflated."""
    return zlib.compress(raw_bytes(a.shape[1], a.shape[0], 24, a), 1)


def chain(packed: Column, *steps: Kernel) -> Column:
    """A packed 24-bit frame through kernels, one after another; the last may make bytes of its own (deflated).

    Null for frames that can't be read and where a kernel makes none.
    """

    @F.arrow_udf("binary")
    def run(packed: pa.Array) -> pa.Array:
        out = []
        for raw in packed:
            a = raw_array(raw.as_py())
            for step in steps:
                a = None if a is None else step(a)
            out.append(a if a is None or isinstance(a, bytes) else raw_bytes(a.shape[1], a.shape[0], 24, a))
        return pa.array(out, pa.binary())

    return run(packed)


def packed_checksum(packed: Column) -> Column:
    """Sum of the samples of a packed 24-bit frame as signed bytes; null for frames that can't be read."""

    @F.arrow_udf("bigint")
    def run(packed: pa.Array) -> pa.Array:
        frames = (raw_array(x.as_py()) for x in packed)
        return pa.array([None if a is None else int(a.astype(np.uint8).view(np.int8).sum(dtype=np.int64)) for a in frames], pa.int64())

    return run(packed)
