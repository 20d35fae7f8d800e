"""Text and fileset sources: FASTA, scoring matrices, parameter files, numbered filesets, logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.dsl import Fileset


def fasta_records(text: Column) -> Column:
    """array<struct<name, body>> of a FASTA text: a line with > is a name (kept with it), the lines after it are joined."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), text), "\n>"), lambda p, i: i > 0)
    return F.transform(
        parts, lambda p: F.struct(F.concat(F.lit(">"), F.rtrim(F.substring_index(p, "\n", 1))).alias("name"), F.regexp_replace(F.concat(F.when(F.instr(p, "\n") > 0, F.substr(p, F.instr(p, "\n"))).otherwise("")), r"[\r\n]", "").alias("body"))
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name and body of each record; files are split at records, so large ones are read in parallel."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.concat(F.lit(">"), F.regexp_replace("value", "^>", "")).alias("t")).where("length(t) > 1")
    return raw.select(F.explode(fasta_records(F.col("t"))).alias("r")).select("r.name", "r.body")


def sequence_text(text: Column) -> Column:
    """Letters of a sequence text without white space and comment lines; null where anything else occurs or none is left."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?m)^>.*$", ""), r"\s+", "")
    return F.when(bare.rlike("^[A-Za-z]+$"), bare)


def parse_matrix(text: str) -> dict[tuple[str, str], int]:
    """(row, column) -> score; # starts a comment line; codes must be distinct and have * in rows and columns."""
    lines = [x for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    if not lines:
        raise ValueError("no columns")
    columns = lines[0].split()
    rows = [x.split() for x in lines[1:]]
    for codes in (columns, [r[0] for r in rows]):
        if len(set(codes)) != len(codes) or any(len(c) != 1 for c in codes):
            raise ValueError("codes must be single and distinct")
        if "*" not in codes:
            raise ValueError("the row or column * is missing")
    if {r[0] for r in rows} != set(columns) or any(len(r) != len(columns) + 1 for r in rows):
        raise ValueError("rows and columns don't fit")
    return {(r[0], c): int(v) for r in rows for c, v in zip(columns, r[1:], strict=True)}


def parse_params(text: str) -> dict[str, str]:
    """key = value lines; # starts a comment; keys in lower case, values too unless the key ends in file."""
    out = {}
    for line in text.splitlines():
        line = line.split("#", 1)[0]
        if "=" in line:
            key, value = (x.strip() for x in line.split("=", 1))
            out[key.lower()] = value if key.lower().endswith("file") else value.lower()
    return out


def read_fileset(spark: SparkSession, fileset: Fileset, size: int = 0, rank: int = 0) -> DataFrame:
    """path, number and content of a numbered fileset, those of one rank only if size is over 0; order by number."""
    pattern = rf"{re.escape(fileset.prefix)}(\d{{{fileset.positions},}}){re.escape(fileset.postfix)}$"
    files = spark.read.format("binaryFile").load(f"{fileset.directory}/{fileset.prefix}*{fileset.postfix}")
    numbered = files.select("path", "content", F.regexp_extract("path", pattern, 1).alias("n")).where("n != ''").withColumn("number", F.col("n").cast("long")).drop("n")
    return numbered if size <= 0 else numbered.where(F.pmod("number", F.lit(size)) == rank)


def last_duration(spark: SparkSession, path: str) -> DataFrame:
    """path and the last DURATION value (ns) of each log file, null if there is none."""
    logs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    every = F.regexp_extract_all("value", F.lit(r"(?m)^DURATION (\d+)"), F.lit(1))
    return logs.select("path", F.get(every, F.size(every) - 1).cast("long").alias("duration_ns"))


def write_results(lines: DataFrame, path: str) -> None:
    """One gzip-compressed text line a row."""
    lines.write.mode("overwrite").option("compression", "gzip").text(path)


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """path and content of every file below a folder, version control's own left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.where(~F.col("path").contains("/.svn/"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and whole text of each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
