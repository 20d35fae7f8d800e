"""Queries over the sources: parsers and round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.functions import pixels as px
from millrace.operators.pixels import HEIGHT, WIDTH, gradient_frames
from millrace.plans import dsl
from millrace.session import table
from millrace.sources import frames as fr
from millrace.sources.files import fasta_records, parse_params, sequence_text


@query(
    "fasta_parse",
    """SELECT doc_id, '>' || source AS name, length(replace(text, chr(10), '')) AS letters, md5(replace(text, chr(10), '')) AS body_md5 FROM documents""",
)
def q_fasta_parse(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(">"), "source", F.lit("\n"), "text", F.lit("\n")).alias("t"))
    records = docs.select("doc_id", F.explode(fasta_records(F.col("t"))).alias("r"))
    return records.select("doc_id", "r.name", F.length("r.body").alias("letters"), F.md5(F.col("r.body").cast("binary")).alias("body_md5"))


@query(
    "sequence_clean",
    r"SELECT p_partkey, CASE WHEN regexp_full_match(replace(p_name, ' ', ''), '[A-Za-z]+') AND p_size > 3 THEN replace(p_name, ' ', '') END AS body FROM part",
)
def q_sequence_clean(spark, sf_dir):
    """White space goes; a body with anything but letters is null."""
    said = F.when(F.col("p_size") > 3, F.col("p_name")).otherwise(F.concat("p_name", F.lit("1")))
    return table(spark, sf_dir, "part").select("p_partkey", sequence_text(said).alias("body"))


_PARAMS = "# search\nAlgorithm = SW   # local\nDatabaseFile = /Data/Set02DB.fasta\nmode=2\n"


@query(
    "params_parse",
    """SELECT s_suppkey, key, value FROM supplier, (VALUES ('algorithm', 'sw'), ('top.scores', NULL), ('databasefile', '/Data/Set02DB.fasta'), ('mode', '2'), ('name', '')) t(key, v),
       LATERAL (SELECT CASE key WHEN 'top.scores' THEN CAST(20 + s_suppkey AS VARCHAR) WHEN 'name' THEN lower(trim(split_part(s_name, '#', 1))) ELSE v END AS value)""",
)
def q_params_parse(spark, sf_dir):
    """A parameter file for each supplier, read where it lies."""
    text = F.concat(F.lit(_PARAMS), F.lit("Top.Scores = "), (20 + F.col("s_suppkey")).cast("string"), F.lit("  # of each\nNAME="), "s_name", F.lit("\n"))
    parsed = F.pandas_udf(lambda texts: texts.map(parse_params), "map<string,string>")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(parsed(text)).alias("key", "value"))


_G = f"""SELECT n::INT AS frameno, {WIDTH} AS width, {HEIGHT} AS height, {{bits}} AS bits, CAST(sum({{v}} * ((y * {WIDTH} + x) * 3 + band + 1)) AS BIGINT) AS digest
  FROM (SELECT n, y, x, band, CASE band WHEN 0 THEN n * 37 + x WHEN 1 THEN n * 101 // 10 + y ELSE n * 5 END % 256 AS v
        FROM range(4) a(n), range({HEIGHT}) b(y), range({WIDTH}) c(x), range(3) d(band)) GROUP BY n"""


def _round_trip(spark, kind: str, bits: int):
    frames = gradient_frames(spark)
    data = F.col("data") if bits == 24 else px.depth_24_to_48(F.col("data"))
    files = frames.select("frameno", fr.encoded(F.col("width"), F.col("height"), F.lit(bits), data, kind).alias("content"))
    back = files.select("frameno", fr.decoded(F.col("content"), kind).alias("f")).select("frameno", "f.*")
    digest = F.aggregate(F.transform("data", lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    return back.select("frameno", "width", "height", "bits", digest.alias("digest"))


@query("ppm_roundtrip", _G.format(bits=48, v="v * 255"))
def q_ppm(spark, sf_dir):
    return _round_trip(spark, "ppm", 48)


@query("rawframe_roundtrip", _G.format(bits=24, v="v"))
def q_raw(spark, sf_dir):
    return _round_trip(spark, "raw", 24)


@query(
    "frame_dump",
    """SELECT n::INT AS frameno, i::INT AS line, CASE i WHEN 0 THEN 'RGB24 4x2 frame ' || n ELSE printf('%02x %02x %02x', CAST((n * 37 + (i - 1) % 4) % 256 AS INT), CAST((n * 101 // 10 + (i - 1) // 4) % 256 AS INT), CAST(n * 5 % 256 AS INT)) END AS said
       FROM range(4) a(n), range(9) b(i)""",
)
def q_dump(spark, sf_dir):
    f = gradient_frames(spark, width=4, height=2)
    return f.select("frameno", F.posexplode(fr.dump_lines(F.col("width"), F.col("height"), F.col("frameno"), 24, F.col("data"))).alias("line", "said"))


@query(
    "compressed_block_sizes",
    """SELECT doc_id // 30 AS block, min(doc_id) AS first, count(*) AS items, CAST(sum(strlen(text)) AS BIGINT) AS size_in, true AS smaller, md5(string_agg(text, '' ORDER BY doc_id)) AS content_md5
       FROM documents GROUP BY block""",
)
def q_blocks(spark, sf_dir):
    """Blocks of 30 texts through the stateful encoder, the last one flushed; what comes back is compared."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    blocks = fr.with_unpacked(fr.packed_blocks(docs, "doc_id", "raw", 30), "packed", "back")
    return blocks.select("block", "first", "items", "size_in", (F.octet_length("packed") < F.col("size_in")).alias("smaller"), F.md5("back").alias("content_md5"))


@query(
    "codec_roundtrip",
    """SELECT source, CASE doc_id % 4 WHEN 0 THEN 'deflate' WHEN 1 THEN 'runs' WHEN 2 THEN 'null' ELSE 'other' END AS codec, count(*) AS items,
              count(*) FILTER (doc_id % 4 < 3) AS same, count(*) FILTER (doc_id % 4 = 3) AS dropped,
              CAST(sum(CASE WHEN doc_id % 4 = 2 THEN strlen(text) ELSE 0 END) AS BIGINT) AS null_size FROM documents GROUP BY ALL""",
)
def q_codec(spark, sf_dir):
    """Texts packed by the codec of their tag and unpacked by it; items of an unknown tag are dropped."""
    tag = F.element_at(F.array(*(F.lit(t) for t in ("deflate", "runs", "null", "other"))), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("source", tag.alias("codec"), F.col("text").cast("binary").alias("raw"))
    back = fr.with_unpacked(fr.with_packed(docs, "raw", "codec", "packed"), "packed", "back", "codec")
    return back.groupBy("source", "codec").agg(
        F.count(F.lit(1)).alias("items"), F.count(F.when(F.col("back") == F.col("raw"), 1)).alias("same"), F.count(F.when(F.col("back").isNull(), 1)).alias("dropped"),
        F.sum(F.when(F.col("codec") == "null", F.octet_length("packed")).otherwise(0)).alias("null_size"),
    )


@query(
    "source_options",
    """SELECT o_orderkey, r::INT AS rank, p::INT AS pass, CAST(floor((o_orderkey + r) * 1000 / CAST(25 AS DOUBLE)) AS BIGINT) AS at_ms FROM orders, range(2) a(r), range(3) b(p)""",
)
def q_source_options(spark, sf_dir):
    """Two sources of 25 frames a second, the second a frame later, each read three times over."""
    ranked = fr.repeated(fr.repeated(table(spark, sf_dir, "orders").select("o_orderkey"), 3), 2, "rank")
    return ranked.select("o_orderkey", "rank", "pass", fr.paced(F.col("o_orderkey"), F.col("rank"), 25).alias("at_ms"))


# Stage kinds of the pipeline language.
dsl.stage_kind("generate", None, "rgb24")(None)
dsl.stage_kind("discard", "image", None)(lambda df, o: df)


@dsl.stage_kind("gain", "rgb24", "rgb24")
def _gain(df, options):
    return df.withColumn("data", px.channel_gain(F.col("data"), [options.typed(c, float, 1.0) for c in ("red", "green", "blue")]))


@dsl.stage_kind("scale", "rgb24", "rgb24")
def _scale(df, options):
    w, h, bits = options.typed("width", int, required=True), options.typed("height", int, required=True), options.typed("bits", int, 0)
    if bits not in (0, 24):
        raise dsl.PipelineError(f"option bits={bits}: frames of 24 bits stay so; torgb48 makes others")
    return df.withColumn("data", px.nearest(F.col("data"), F.col("width"), F.col("height"), w, h)).withColumns({"width": F.lit(w), "height": F.lit(h)})


@dsl.stage_kind("torgb48", "rgb24", "rgb48")
def _deepen(df, options):
    return df.withColumn("data", px.depth_24_to_48(F.col("data")))


@dsl.stage_kind("torgb24", "rgb48", "rgb24")
def _flatten(df, options):
    return df.withColumn("data", px.depth_48_to_24(F.col("data")))


@dsl.stage_kind("compress", "image", "compressed")
def _compress(df, options):
    """Each frame by itself; a stage that packs blocks of frames is packed_blocks."""
    raw = fr.encoded(F.col("width"), F.col("height"), F.lit(48), F.col("data"), "raw")
    return df.withColumn("packed", fr.pack(raw, options.typed("codec", str, "deflate")))


@dsl.stage_kind("count", "image", None)
def _count(df, options):
    return df


_TEXT = """
# frames are made, brightened by two, packed by four, counted
component gen generate
component bright gain
component pack compress
component counter count
options bright red=1.5 blue=0.5
pipeline small 1 gen:5 2 bright 4 5:pack 1 counter
deploy small
"""


@query(
    "pipeline_compile",
    """SELECT * FROM (VALUES (0,'gen',0,0,1,NULL,'put.0.0'),(1,'bright',1,0,2,'get.1.0','put.1.0'),(2,'bright',1,1,2,'get.1.1','put.1.1'),
       (3,'pack',2,0,4,'get.2.0','put.2.0'),(4,'pack',2,1,4,'get.2.1','put.2.1'),(5,'pack',2,2,4,'get.2.2','put.2.2'),(6,'pack',2,3,4,'get.2.3','put.2.3'),
       (7,'counter',3,0,1,'get.3.0',NULL)) t(number, name, stage, rank, size, get_name, put_name)""",
)
def q_pipeline_compile(spark, sf_dir):
    return dsl.as_frames(spark, dsl.parse(_TEXT))[0]


@query(
    "pipeline_queues",
    """SELECT * FROM (VALUES ('q.0.0','split','put.0.0','get.1.0,get.1.1',5),('q.1.0','split','put.1.0','get.2.0,get.2.2',5),('q.1.1','split','put.1.1','get.2.1,get.2.3',5),
       ('q.2.0','merge','put.2.0,put.2.1,put.2.2,put.2.3','get.3.0',1)) t(name, type, put, get, length)""",
)
def q_pipeline_queues(spark, sf_dir):
    queues = dsl.as_frames(spark, dsl.parse(_TEXT))[1]
    return queues.select("name", "type", F.array_join("put", ",").alias("put"), F.array_join("get", ",").alias("get"), "length")


@query(
    "pipeline_run",
    f"""SELECT n::INT AS number, CAST(sum(least(255, floor(v * CASE band WHEN 0 THEN CAST(1.5 AS DOUBLE) WHEN 1 THEN 1 ELSE CAST(0.5 AS DOUBLE) END))) AS BIGINT) AS total
        FROM (SELECT n, band, CASE band WHEN 0 THEN n * 37 + x WHEN 1 THEN n * 101 // 10 + y ELSE n * 5 END % 256 AS v
              FROM range(4) a(n), range({HEIGHT}) b(y), range({WIDTH}) c(x), range(3) d(band)) GROUP BY n""",
)
def q_pipeline_run(spark, sf_dir):
    """The compiled pipeline on gradient frames; the sum of the samples that come out."""
    out = dsl.run_pipeline(dsl.parse(_TEXT), gradient_frames(spark).withColumnRenamed("frameno", "number"))
    return out.select("number", F.aggregate("data", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))
