"""Token counts as delta-maintained rollups.

Documents come in batches of signed changes: an insert adds its count, a delete subtracts it, a revised count does
both. A batch is summed by source, language and tokenizer version and added under its name. Totals are a stored table
and the few batches since; after a fixed number of batches these are folded into a new stored table, so reading costs the
same however many batches there have been.

A folder per batch and per stored table is written aside and then renamed, and a rename is the only thing that makes it
count. So a job that ends anywhere leaves either all of a batch or nothing of it, and a batch that comes again is
recognised by its name, in the stored table's list of names if it has been folded.
"""

from __future__ import annotations

import base64
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._common import cut, scratch, small_batches
from millrace.session import importable

KEYS = ("source", "lang", "tokenizer")
SUMS = "source string, lang string, tokenizer string, docs long, tokens long"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BPE, WORDS = "byte-bpe-50k", "words-1"
#: Batches that wait until they are folded into the stored table.
FOLD_AT = 16


class TokenRollup:
    """Totals under a folder that all executors share and whose renames are atomic; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, fold_at: int = FOLD_AT):
        self.spark, self.path, self.fold_at = spark, path.rstrip("/"), fold_at
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _settle(self, aside: str, to: str) -> None:
        """Let what has been written aside count."""
        target = self._path(f"{self.path}/{to}")
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(self._path(aside), target):
            raise RuntimeError(f"{target} is there already: another writer is at work")

    def _aside(self) -> str:
        return f"{self.path}/aside/{uuid.uuid4().hex}"

    def _stored(self) -> str | None:
        found = self._names("stored")
        return f"{self.path}/stored/{found[-1]}" if found else None

    def _folded(self, names: list[str]) -> set[str]:
        """Those of the names that the stored table has."""
        stored = self._stored()
        return {r["name"] for r in self.spark.read.parquet(f"{stored}/names").where(F.col("name").isin(names)).collect()} if stored and names else set()

    def _waiting(self) -> list[str]:
        names = self._names("batches")
        return sorted(set(names) - self._folded(names))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """changes: source, lang, tokenizer, sign (1 or -1) and tokens of each change; False if the batch is there already.

        Null counts are 0, null keys are keys like others. Repeated rows are changes of their own, other columns aren't
        read. One partial and one final aggregation; a hot source is summed up before the shuffle. An empty batch is
        committed as such.
        """
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
            raise ValueError(f"batch name {batch!r}")
        if batch in self._names("batches") or self._folded([batch]):
            return False
        signed = changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"))
        aside = self._aside()
        signed.write.parquet(aside)
        self._settle(aside, f"batches/{batch}")
        if len(self._waiting()) >= self.fold_at:
            self.fold()
        return True

    def fold(self) -> None:
        """Add the waiting batches to the stored table; the old table and the batches then go."""
        waiting, stored = self._waiting(), self._stored()
        if not waiting:
            return
        aside = self._aside()
        self.totals().coalesce(1).write.parquet(f"{aside}/totals")
        names = self.spark.createDataFrame([(n,) for n in waiting], "name string")
        if stored:
            names = names.unionByName(self.spark.read.parquet(f"{stored}/names"))
        names.coalesce(1).write.parquet(f"{aside}/names")
        number = int(stored.rsplit("/", 1)[1]) + 1 if stored else 0
        self._settle(aside, f"stored/{number:08d}")
        # What follows only tidies up: names in the stored table aren't read as batches any more.
        self._tidy()

    def _tidy(self) -> None:
        for name in self._names("stored")[:-1]:
            self._fs.delete(self._path(f"{self.path}/stored/{name}"), True)
        for name in self._folded(self._names("batches")):
            self._fs.delete(self._path(f"{self.path}/batches/{name}"), True)
        self._fs.delete(self._path(f"{self.path}/aside"), True)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs and tokens; keys whose documents have all been deleted are left out.

        The rows are those of now: a later commit may fold the files that this reads.
        """
        stored = self._stored()
        paths = [f"{self.path}/batches/{n}" for n in self._waiting()] + ([f"{stored}/totals"] if stored else [])
        parts = self.spark.read.schema(SUMS).parquet(*paths) if paths else self.spark.createDataFrame([], SUMS)
        return parts.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 OR tokens != 0")


def inserts(counted: DataFrame) -> DataFrame:
    return counted.withColumn("sign", F.lit(1))


def deletes(counted: DataFrame) -> DataFrame:
    return counted.withColumn("sign", F.lit(-1))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed changes that replace the counts in old by those in new."""
    return deletes(old).unionByName(inserts(new))


_encoders: dict = {}


def _encoder(vocabulary: str, pattern: str):
    if vocabulary not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[vocabulary] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def counted(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, lang and the counts of each row: `bpe` by the vocabulary file, `words` by white space.

    Every worker reads the vocabulary from a path that is part of its image. Null and empty texts count 0, whole texts of
    any length are counted. Repeated rows count each, an empty table gives no rows, other columns aren't read.
    """
    import public_tokenizers

    small_batches(docs.sparkSession)
    pattern = public_tokenizers.PATTERN

    def run(batches):
        encoder = _encoder(vocabulary, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "source", "lang")), pa.array([len(encoder.encode_ordinary(t)) for t in texts], pa.int64()), pa.array([len(t.encode().split()) for t in texts], pa.int64())],
                names=["doc_id", "source", "lang", "bpe", "words"],
            )

    return docs.select("doc_id", "source", "lang", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, source string, lang string, bpe long, words long")


def op6_token_rollup(spark, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """All documents inserted under two tokenizers, a batch committed twice, word counts revised, short ones deleted."""
    importable(spark)
    counts = cut(counted(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary))
    rollup = TokenRollup(spark, scratch(spark, "token-rollup"), fold_at=2)
    by = lambda name, tokens: counts.select("source", "lang", F.lit(name).alias("tokenizer"), tokens.alias("tokens"))
    first = inserts(by(BPE, F.col("bpe")).unionByName(by(WORDS, F.col("words"))))
    rollup.commit("load", first)
    rollup.commit("load", first)
    rollup.commit("words-2", revisions(by(WORDS, F.col("words")), by("words-2", F.col("words") + 1)))
    rollup.commit("withdraw", deletes(by(BPE, F.col("bpe")).where(F.col("tokens") < 16)))
    return rollup.totals()
