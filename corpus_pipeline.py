"""The corpus pipeline: from raw documents to shards, each stage written and read again before the next.

What holds for every stage: an empty table gives an empty one. A text may be null, empty or of any length and is worked
on whole. Decisions are made for each row by its own text, so a doc_id may be null or repeated. The five columns of
documents come out as they went in (the last stage has its own); further columns don't, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _common, op01_sharding, op02_mixing, op03_decontaminate, op07_quality, op08_minhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHARDS = 8
#: Documents as alike as this, in percent, are near-duplicates.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    A null text, or one under ten words, fails the base rules. Equal rows are judged alike and all stay or go.
    """
    return op07_quality.reject(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, one row of it.

    An id of null counts as the largest; of equal ids the smallest hash of the text stays. Texts without words are like no
    other, but of equal rows only one stays.
    """
    return op08_minhash.dedup(docs, NEAR_PERCENT).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of eight words of any benchmark item go, and those with two shorter items.

    A null text, and an item without words, has no window. Equal rows all stay or go.
    """
    return op03_decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mixture takes it.

    Null sources are one source. Texts without words move no words and are drawn by themselves. Equal rows are taken
    equally often.
    """
    mixed = op02_mixing.mix(docs).where(F.col("copies") > 0)
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of the mixture.

    Rows that are equal in all three are interchangeable; null ids come first. A null text has a size of 1.
    """
    return op01_sharding.shard(docs, SHARDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: Expectation-maximisation and rounding by hashed draws aren't SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = _common.scratch(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
