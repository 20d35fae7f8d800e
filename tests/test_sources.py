import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace import catalog
from millrace.plans.dsl import parse_fileset
from millrace.sources import files, frames


def test_ppm_and_raw_codecs():
    data = np.arange(2 * 3 * 3)
    for bits in (24, 48):
        d = data if bits == 24 else data * 3000 % 65536
        for enc, dec in ((frames.ppm_bytes, frames.ppm_frame), (frames.raw_bytes, frames.raw_frame)):
            w, h, b, back = dec(enc(3, 2, bits, d))
            assert (w, h, b) == (3, 2, bits) and back.tolist() == d.tolist()
            assert dec(enc(3, 2, bits, d)[:-1]) is None and dec(b"junk") is None and dec(None) is None
    assert frames.ppm_bytes(1, 1, 48, [256, 1, 2]) == b"P6\n1 1 65535\n\x01\x00\x00\x01\x00\x02"
    assert frames.raw_bytes(1, 1, 24, [1, 2, 3]) == struct.pack(">iii", 24, 1, 1) + b"\x01\x02\x03"
    assert frames.ppm_frame(b"P6\n# made\n1 1 255\nabc")[3].tolist() == [97, 98, 99]


def png(img: np.ndarray, depth: int, filters) -> bytes:
    """A plain encoder with a given filter for each row."""
    h, w, bands = img.shape
    step = bands * depth // 8
    flat = img.astype(">u2" if depth == 16 else "u1").tobytes()
    rows = [flat[i * w * step : (i + 1) * w * step] for i in range(h)]
    out = b""
    for y, (row, f) in enumerate(zip(rows, filters, strict=True)):
        up = rows[y - 1] if y else bytes(w * step)
        line = []
        for i, v in enumerate(row):
            a, b, c = (row[i - step] if i >= step else 0), up[i], (up[i - step] if i >= step else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v - (0, a, b, (a + b) // 2, paeth)[f]) % 256)
        out += bytes([f]) + bytes(line)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + b"crc."
    z = zlib.compress(out)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, 2 if bands == 3 else 6, 0, 0, 0)) + chunk(b"IDAT", z[:9]) + chunk(b"IDAT", z[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("depth", [8, 16])
@pytest.mark.parametrize("bands", [3, 4])
def test_png(depth, bands):
    img = np.random.default_rng(depth + bands).integers(0, 2**depth, (5, 7, bands))
    raw = png(img, depth, [0, 1, 2, 3, 4])
    w, h, bits, data = frames.png_frame(raw)
    assert (w, h, bits) == (7, 5, 3 * depth) and data.tolist() == img[:, :, :3].ravel().tolist()
    assert frames.png_frame(raw[:40]) is None and frames.png_frame(b"GIF") is None and frames.png_frame(None) is None


def test_directories_and_texts(spark, tmp_path):
    (tmp_path / "a" / ".svn").mkdir(parents=True)
    (tmp_path / "a" / ".svn" / "x").write_text("no")
    (tmp_path / "a" / "f.pov").write_text("scene\ntwo")
    assert [bytes(r["content"]) for r in files.read_directory(spark, str(tmp_path)).collect()] == [b"scene\ntwo"]
    assert [r["value"] for r in files.read_texts(spark, str(tmp_path / "a" / "f.pov")).collect()] == ["scene\ntwo"]


def test_files_written_and_read_again(spark, tmp_path):
    df = spark.range(7).select(F.col("id").alias("n"), F.array(*(F.lit(i) for i in range(6))).alias("data"))
    frames.write_files(
        df, str(tmp_path / "set"), F.concat(F.lit("waag"), F.lpad(F.col("n").cast("string"), 3, "0"), F.lit(".raw")), frames.encoded(F.lit(2), F.lit(1), F.lit(24), F.col("data"), "raw")
    )
    spec = parse_fileset(f"{tmp_path}/set/waag%%%.raw")
    assert [r["number"] for r in files.read_fileset(spark, spec).orderBy("number").collect()] == list(range(7))
    assert [r["number"] for r in files.read_fileset(spark, spec, 3, 1).orderBy("number").collect()] == [1, 4]
    read = frames.read_frames(spark, str(tmp_path / "set")).collect()
    assert len(read) == 7 and all(r["width"] == 2 and r["data"] == list(range(6)) for r in read)


def test_bad_frames_are_null(spark, tmp_path):
    (tmp_path / "a.ppm").write_bytes(b"P5 nothing")
    (tmp_path / "b.txt").write_bytes(b"x")
    (tmp_path / "c.raw").write_bytes(b"\0")
    assert [r["width"] for r in frames.read_frames(spark, str(tmp_path)).collect()] == [None] * 3


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">one first\nACGT\nAC\n>two\n\n>three\nTT\r\nGG\n")
    expected = {(">one first", "ACGTAC"), (">two", ""), (">three", "TTGG")}
    assert {(r["name"], r["body"]) for r in files.read_fasta(spark, str(tmp_path / "x.fasta")).collect()} == expected
    text = spark.createDataFrame([((tmp_path / "x.fasta").read_text(),), ("no records",)], "t string")
    got = text.select(F.explode(files.fasta_records(F.col("t"))).alias("r")).select("r.*").collect()
    assert {(r["name"], r["body"]) for r in got} == expected


def test_sequence_text_params_and_logs(spark, tmp_path):
    df = spark.createDataFrame([("> c\nAC gt\n",), ("A1",), ("  \n",), (None,)], "t string")
    assert [r[0] for r in df.select(files.sequence_text(F.col("t"))).collect()] == ["ACgt", None, None, None]
    assert files.parse_params("A = B\n# no\nQueryFile = /X/y # c\nbad\n") == {"a": "b", "queryfile": "/X/y"}
    (tmp_path / "n1.log").write_text("DURATION 5\nx\nDURATION 7\n")
    (tmp_path / "n2.log").write_text("nothing\n")
    found = files.last_duration(spark, str(tmp_path)).collect()
    got = {r["path"][-6:]: r["duration_ns"] for r in found}
    assert len(found) == 2
    assert got == {"n1.log": 7, "n2.log": None}
    files.write_results(spark.createDataFrame([("a",)], "value string"), str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a"]
    assert any(p.name.endswith(".gz") for p in (tmp_path / "out").iterdir())


def test_hex_lines_and_codec(spark):
    df = spark.createDataFrame([(bytearray(range(18)),), (bytearray(),)], "b binary")
    got = [r[0] for r in df.select(frames.hex_lines(F.col("b"))).collect()]
    assert got == [["00 01 02 03 04 05 06 07 08 09 0a 0b 0c 0d 0e 0f", "10 11"], []]
    assert [r[0] for r in df.select(frames.unpack(frames.pack("b"))).collect()] == [bytearray(range(18)), bytearray()]
    assert [r[0] for r in df.select(frames.unpack("b")).collect()] == [None, None]


@pytest.mark.parametrize("width,height", [(4, 4), (5, 3)])
def test_kernels_against_numpy(spark, width, height):
    from millrace.functions import pixels as px

    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (height, width, 3))
    df = spark.createDataFrame([(width, height, [int(v) for v in img.ravel()])], "width int, height int, data array<int>")
    W, H, D = F.col("width"), F.col("height"), F.col("data")
    out = df.select(px.convolve(D, W, H, px.SHARPEN, 1).alias("s"), px.box_down(D, W, H, 2).alias("b"), px.replicate(D, W, H).alias("r"), px.checksum(D).alias("c")).first()
    sharp = img.copy()
    for y in range(1, height - 1):
        for x in range(1, width - 1):
            sharp[y, x] = np.clip(10 * img[y, x] - img[y - 1 : y + 2, x - 1 : x + 2].sum(axis=(0, 1)), 0, 255)
    assert out["s"] == sharp.ravel().tolist()
    assert out["r"] == img.repeat(2, axis=0).repeat(2, axis=1).ravel().tolist()
    assert out["c"] == int(img.astype(np.int8).sum())
    if width % 2 or height % 2:
        assert out["b"] is None
    else:
        assert out["b"] == ((img.reshape(height // 2, 2, width // 2, 2, 3).sum(axis=(1, 3)) + 2) // 4).ravel().tolist()


def test_packing_by_tag_hands_back_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(frames, "PIECE_BYTES", 1000)
    rows = [(i, t, c) for i, (t, c) in enumerate((t, c) for t in ("deflate", "runs", "null", "other", None) for c in (None, b"", b"a" * 700, bytes(range(256)) * 3, b"ab" * 900))]
    df = spark.createDataFrame(rows, "n int, t string, c binary").coalesce(1)
    packed = frames.with_packed(df, "c", "t", "p")
    got = {r["n"]: (r["p"], r["back"]) for r in frames.with_unpacked(packed, "p", "back", "t").collect()}
    assert len(got) == len(rows)
    for n, t, c in rows:
        p, back = got[n]
        assert back == (c if t in frames.CODECS else None)
        assert p == (None if c is None else frames.CODECS[t][0](c) if t in frames.CODECS else c)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 16 << 20


def test_codec_roundtrip_packs_a_text_once(spark):
    plan = catalog.queries()["codec_roundtrip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 2


def test_blocks_are_unpacked_in_small_pieces(spark):
    plan = catalog.queries()["compressed_block_sizes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" in plan


def test_unpacked_batches_are_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(frames, "PIECE_BYTES", 1 << 20)
    monkeypatch.setattr(frames, "bounded", lambda spark: spark)

    class Held:
        sparkSession, schema = None, ()

        def mapInArrow(self, run, schema):
            return run

    run = frames.with_unpacked(Held(), "p", "back")
    batch = pa.RecordBatch.from_pydict({"n": list(range(100)), "p": [zlib.compress(bytes(400_000))] * 100})
    pieces = list(run([batch]))
    assert [n for p in pieces for n in p.column("n").to_pylist()] == list(range(100))
    assert {p.num_rows for p in pieces} <= {3, 1} and all(len(b) == 400_000 for p in pieces for b in p.column("back").to_pylist())
