"""Quality rules by weak supervision.

Each rule looks at counts of a text and votes good, bad or abstains. The votes of all documents are summed up as a
histogram of vote patterns (at most 3 ** rules rows). Expectation-maximisation on the histogram estimates how often
each rule is right on good and on bad documents and the share of good documents; no label is used. A document is
rejected only if the posterior probability of its being bad is high.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import cut, small_batches, stash

MIN_WORDS = 10
REPEAT_PERCENT = 20
#: Rejected only if bad with a probability over 0.95.
KEEP_AT = 0.05
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs", "n_distinct", "n_stops", "n_marked", "n_other")

_SPACE = b" \t\n\x0b\x0c\r"
_CONT = bytes(range(0x80, 0xC0))
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_SYMBOLS = b"#*$%&|<>"
_NOT_OTHER = _UPPER + _LOWER + b"0123456789" + _SPACE + bytes(range(0x80, 0x100))


def features(text: bytes | None) -> tuple[int, ...]:
    """Counts of one text; words are runs of anything but ASCII white space, characters are code points."""
    b = text or b""
    words = b.split()
    n = len(words)
    repeated = 0
    if n >= 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(set(windows)) < len(windows):
            times = Counter(windows)
            end = 0
            for i, w in enumerate(windows):
                if times[w] > 1:
                    repeated += i + 5 - max(end, i)
                    end = i + 5
    seen: set[bytes] = set()
    lines = dup = 0
    for line in b.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    upper = len(b) - len(b.translate(None, _UPPER))
    symbols = len(b) - len(b.translate(None, _SYMBOLS))
    return (
        n,
        len(b.translate(None, _SPACE + _CONT)),
        symbols,
        dup,
        repeated,
        lines,
        upper,
        upper + len(b) - len(b.translate(None, _LOWER)),
        b.count(b"!!"),
        len(set(words)),
        b.count(b".") + b.count(b"?"),
        sum(len(w) != len(w.translate(None, _SYMBOLS)) for w in words) if symbols else 0,
        len(b.translate(None, _NOT_OTHER)),
    )


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _rule(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit("b")).when(good, F.lit("g")).otherwise(F.lit("-"))


#: name -> vote column over FEATURES: b(ad), g(ood) or - (abstains).
RULES: dict[str, Column] = {}


def rules() -> dict[str, Column]:
    # Made on first use: columns need a running session.
    if not RULES:
        mean = _ratio("word_chars", "n_words")
        RULES.update(
            symbols=_rule(_ratio("n_symbols", "word_chars") > 0.08, F.col("n_symbols") * 100 < F.col("word_chars")),
            marked=_rule(_ratio("n_marked", "n_words") > 0.2, F.col("n_marked") * 100 < F.col("n_words")),
            marks=_rule(_ratio("n_other", "word_chars") > 0.1, _ratio("n_other", "word_chars") < 0.06),
            capitals=_rule(_ratio("n_upper", "n_letters") > 0.3, _ratio("n_upper", "n_letters") < 0.1),
            shouting=_rule(_ratio("n_bangs", "n_words") > 0.1, F.col("n_bangs") == 0),
            repeats=_rule(_ratio("n_repeat_words", "n_words") > 0.15, _ratio("n_repeat_words", "n_words") < 0.02),
            lines=_rule(_ratio("n_dup_lines", "n_lines") > 0.3, (F.col("n_lines") > 1) & (F.col("n_dup_lines") == 0)),
            word_length=_rule((mean < 2.5) | (mean > 14), (mean > 3) & (mean < 10)),
            variety=_rule((F.col("n_words") >= 20) & (_ratio("n_distinct", "n_words") < 0.15), (F.col("n_words") < 400) & (_ratio("n_distinct", "n_words") > 0.5)),
            stops=_rule((F.col("n_words") >= 40) & (F.col("n_stops") == 0), _ratio("n_stops", "n_words") > 0.02),
        )
    return RULES


def estimate(patterns: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], dict]:
    """Posterior probability of good for each vote pattern, by EM over the histogram.

    Bad texts are of several kinds that different rules see, so there is one class of good documents and one class of
    bad ones for each rule, in which that rule is held to be right mostly; rules are independent given the class and
    an abstention says nothing. The bounds keep classes from trading places. Rates carry pseudo-counts, so a rule
    that never votes stays where it starts.
    """
    keys = sorted(patterns)
    if not keys:
        return {}, {"priors": [], "bad_rate": []}
    n = np.array([patterns[k] for k in keys], dtype=np.float64)
    good = np.array([[c == "g" for c in k] for k in keys], dtype=np.float64)
    bad = np.array([[c == "b" for c in k] for k in keys], dtype=np.float64)
    m = good.shape[1]
    # bad_rate[c, j]: probability that rule j, if it votes, votes bad on class c; class 0 is good, class j + 1 is rule j's.
    low, high = np.full((m + 1, m), 0.005), np.full((m + 1, m), 0.995)
    start = np.full((m + 1, m), 0.2)
    low[0], high[0], start[0] = 0.0005, 0.1, 0.03
    own = (np.arange(1, m + 1), np.arange(m))
    low[own], start[own] = 0.7, 0.9
    rate, prior = start.copy(), np.r_[0.85, np.full(m, 0.15 / m)]
    post = np.zeros((len(keys), m + 1))
    for _ in range(rounds):
        logs = np.log(prior) + bad @ np.log(rate).T + good @ np.log1p(-rate).T
        logs -= logs.max(axis=1, keepdims=True)
        post = np.exp(logs)
        post /= post.sum(axis=1, keepdims=True)
        w = (post * n[:, None]).T
        rate = np.clip((w @ bad + 2 * start) / (w @ (good + bad) + 2), low, high)
        prior = (w.sum(axis=1) + np.r_[8.5, np.full(m, 1.5 / m)]) / (n.sum() + 10)
    return dict(zip(keys, post[:, 0].tolist(), strict=True)), {"priors": prior.tolist(), "bad_rate": rate.tolist()}


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns named in keep and FEATURES of each row; one pass over the texts."""
    small_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)

    def run(batches):
        for batch in batches:
            found = [features(t) for t in batch.column("_text").to_pylist()]
            cols = list(zip(*found, strict=True)) if found else [[]] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(c, pa.int64()) for c in cols)], names=[*keep, *FEATURES])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), *(f"{f} long" for f in FEATURES)])
    return docs.select(*keep, F.col("text").cast("binary").alias("_text")).mapInArrow(run, schema)


def judge(measured: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """measured with votes, posterior, base_failed and kept. measured is read twice; pass a cut."""
    voted = measured.withColumns(
        {
            "votes": F.concat(*rules().values()),
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
        }
    )
    # At most 3 ** len(RULES) = 59,049 patterns, whatever the input.
    patterns = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    posterior, _ = estimate(patterns)
    table = measured.sparkSession.createDataFrame(sorted(posterior.items()), "votes string, posterior double")
    return voted.join(F.broadcast(table), "votes").withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_at))


def quality(docs: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, FEATURES, votes, posterior, base_failed and kept of each row.

    A null or empty text has no words and fails the base rules. Texts may be of any length. Repeated rows are judged
    alike, each in its row, and so are rows without a doc_id; an empty table gives no rows. Only doc_id and text are read.
    """
    return judge(cut(measure(docs, "doc_id")), keep_at)


def reject(docs: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """docs without the rows that aren't kept, all columns as they were, whatever they are called.

    Rows are written with their counts and judged where they lie, so no text is shuffled.
    """
    packed = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    measured = stash(measure(packed, "_row"), "measured")
    return judge(measured, keep_at).where("kept").select("_row.*")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs).select("doc_id", *FEATURES[:5], "base_failed", "kept", "votes", F.round("posterior", 6).alias("posterior"))
