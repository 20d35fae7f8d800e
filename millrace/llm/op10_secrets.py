"""Secret scans: fixed patterns, and automata inferred from the credentials they label.

Values that the fixed patterns find are labelled credentials. From a bounded sample of them a prefix tree over
character classes is built for each kind; states whose next-symbol frequencies don't differ significantly (Hoeffding
bound) are merged, leaving a probabilistic automaton. One more automaton is inferred from a bounded sample of the tokens
that no pattern touches. Then every token of every text that could be a credential is scored by all of them: it is
reported if a credential automaton finds it as likely, character for character, as its own labelled values, and far more
likely than the automaton of ordinary tokens does. The samples only fit the models; base matches and scores cover all texts.
"""

from __future__ import annotations

import math
import re
from heapq import nsmallest

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import small_batches

KINDS = ("assign", "access", "hex")
LEARNED = "learned"
#: Values taken for learning, at most, of each kind and of ordinary tokens: one for each remainder of their hashes.
SAMPLE = 2000
#: A kind with fewer labelled values teaches nothing.
LEAST_VALUES = 20
#: Longer values aren't learnt from (a prefix tree has a state for each of their characters); they are scored like others.
LEARN_LENGTH = 256
ALPHA = 0.05
#: The least length of a candidate.
MIN_LENGTH = 8
#: A credential is so many bits more likely than an ordinary token, that is, its prior odds are one in a million.
MARGIN = 20.0
#: Bits of a step that the sample never took.
UNSEEN = 20.0
#: Ordinary tokens that one batch offers for learning, those with the smallest marks.
OFFERED = 64
_ORDINARY = len(KINDS)

#: The base patterns and the least length of what counts.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_.=-]{%d,}" % MIN_LENGTH)


def base_matches(b: bytes) -> list[tuple[int, int, int, bytes]]:
    """(start, kind index, end, value) in bytes, by start and kind."""
    found = []
    if b"=" in b or b":" in b:
        found += [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(b) if len(m[1]) >= 12]
    if b"AKIA" in b:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(b) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(b)]
    return sorted(found)


def candidates(b: bytes, base: list[tuple[int, int, int, bytes]]):
    """(start, token) of every token, less full stops around it, that doesn't lie inside one base match; by start.

    Tokens that reach beyond a base match are among them.
    """
    i, covered = 0, 0
    for m in CANDIDATE.finditer(b):
        token = m[0]
        start = m.start()
        if token[0] == 46 or token[-1] == 46:
            start += len(token) - len(token.lstrip(b"."))
            token = token.strip(b".")
            if len(token) < MIN_LENGTH:
                continue
        while i < len(base) and base[i][0] <= start:
            covered = max(covered, base[i][2])
            i += 1
        if start + len(token) > covered:
            yield start, token


#: Character classes: digits, a to f, other small letters, capitals; every other character is a class of its own.
_CLASS = bytes(100 if 48 <= c <= 57 else 104 if 97 <= c <= 102 else 108 if 103 <= c <= 122 else 85 if 65 <= c <= 90 else c for c in range(256))
_SIZES = {ord("d"): 10, ord("h"): 6, ord("l"): 20, ord("U"): 26}


class Automaton:
    """A probabilistic automaton learnt by merging compatible states of a prefix tree (red-blue order)."""

    def __init__(self, strings: list[bytes], alpha: float = ALPHA):
        self.next: list[dict[int, int]] = [{}]
        self.count: list[dict[int, int]] = [{}]
        self.stop = [0]
        for s in strings:
            at = 0
            for k in s.translate(_CLASS):
                self.count[at][k] = self.count[at].get(k, 0) + 1
                if k not in self.next[at]:
                    self.next[at][k] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.stop.append(0)
                at = self.next[at][k]
            self.stop[at] += 1
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self._weigh()
        # The threshold: what nearly all labelled strings reach.
        scores = sorted(self.score(s) for s in strings)
        self.least = scores[len(scores) // 50] - 0.25 if scores else math.inf

    def _n(self, q: int) -> int:
        return self.stop[q] + sum(self.count[q].values())

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self._n(a), self._n(b)
            if not n or not m:
                continue
            most = self._bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.stop[a] / n - self.stop[b] / m) > most:
                return False
            for k in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a].get(k, 0) / n - self.count[b].get(k, 0) / m) > most:
                    return False
                if k in self.next[a] and k in self.next[b] and self.next[a][k] != self.next[b][k]:
                    # Below a blue state there is still a tree, so this ends.
                    todo.append((self.next[a][k], self.next[b][k]))
        return True

    def _fold(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.stop[a] += self.stop[b]
            for k, n in self.count[b].items():
                self.count[a][k] = self.count[a].get(k, 0) + n
                if k in self.next[a]:
                    todo.append((self.next[a][k], self.next[b][k]))
                else:
                    self.next[a][k] = self.next[b][k]

    def _merge(self) -> None:
        red = [0]
        blue = [(0, k) for k in sorted(self.next[0])]
        while blue:
            q, k = blue.pop(0)
            b = self.next[q][k]
            if b in red:
                continue
            for r in red:
                if self._compatible(r, b):
                    self.next[q][k] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)
            blue = [(q, k) for q in red for k in sorted(self.next[q]) if self.next[q][k] not in red]
        self.states = len(red)

    def _weigh(self) -> None:
        """Steps and stops as log2 probabilities; the characters of a class are equally likely."""
        self.steps: list[dict[int, tuple[int, float]]] = []
        self.ends: list[float] = []
        for q in range(len(self.next)):
            n = self._n(q)
            self.steps.append({k: (self.next[q][k], math.log2(c / n / _SIZES.get(k, 1))) for k, c in self.count[q].items()})
            self.ends.append(math.log2(self.stop[q] / n) if self.stop[q] else -UNSEEN)

    def bits(self, s: bytes, least: float = -math.inf) -> float:
        """Log2 likelihood of a token; minus infinity as soon as it falls below `least`. Unseen steps cost UNSEEN bits."""
        at, total = 0, 0.0
        for k in s.translate(_CLASS):
            step = self.steps[at].get(k)
            if step is None:
                total -= UNSEEN
                at = 0
            else:
                at = step[0]
                total += step[1]
            if total < least:
                return -math.inf
        return total + self.ends[at]

    def score(self, s: bytes) -> float:
        """Log2 likelihood a character."""
        return self.bits(s) / max(1, len(s))

    def accepts(self, s: bytes) -> bool:
        least = self.least * max(1, len(s))
        return self.bits(s, least) >= least


class Formats:
    """The automata of credentials and the one of ordinary tokens (None if there were none to learn from)."""

    def __init__(self, credentials: list[Automaton], ordinary: Automaton | None):
        self.credentials, self.ordinary = credentials, ordinary
        self._seen: dict[bytes, float | None] = {}

    def margin(self, token: bytes) -> float | None:
        """By how many bits a token is likelier as a credential; None if it isn't one."""
        fits = [a.bits(token) for a in self.credentials if a.accepts(token)]
        if not fits:
            return None
        more = max(fits) - (self.ordinary.bits(token) if self.ordinary else -math.inf)
        return more if more >= MARGIN else None

    def judge(self, token: bytes) -> float | None:
        """margin, remembered for a while: most tokens of a text are ordinary words that come again."""
        if len(token) > 64:
            return self.margin(token)
        if token not in self._seen:
            if len(self._seen) > 200_000:
                self._seen.clear()
            self._seen[token] = self.margin(token)
        return self._seen[token]


def characters(b: bytes, places: set[int]) -> dict[int, int]:
    """Code points before each of the byte offsets given; one walk over the text."""
    if b.isascii():
        return {p: p for p in places}
    out, last, n = {}, 0, 0
    for p in sorted(places):
        n += len(b[last:p].decode("utf-8", "replace"))
        out[p], last = n, p
    return out


def samples(docs: DataFrame) -> DataFrame:
    """kind, value and mark of what can be learnt from: values of base matches, and ordinary tokens as often as they occur.

    A text offers two of its tokens, a batch OFFERED of what its texts do. mark is a hash of the value, for ordinary tokens
    one of the text and the token's place, so a word that is common is drawn more often.
    """

    def run(batches):
        for batch in batches:
            values, plain = set(), []
            for text in batch.column("text").to_pylist():
                b = text or b""
                base = base_matches(b)
                values.update((k, v, xxhash.xxh3_64_intdigest(v) >> 1) for _, k, _, v in base if len(v) <= LEARN_LENGTH)
                tokens = [t for _, t in candidates(b, base)]
                if tokens:
                    mark = xxhash.xxh3_64_intdigest(b)
                    plain += [(_ORDINARY, t, m >> 1) for m in (mark, xxhash.xxh3_64_intdigest(b, 1)) if len(t := tokens[m % len(tokens)]) <= LEARN_LENGTH]
            chosen = sorted(values) + nsmallest(OFFERED, plain, key=lambda x: x[2])
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in chosen], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.int64()))], names=["kind", "value", "mark"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "kind int, value binary, mark long")


def learn(docs: DataFrame, sample: int = SAMPLE) -> Formats:
    """Automata from at most `sample` different values of each kind; one pass over the texts."""
    small_batches(docs.sparkSession)
    # One value for each remainder survives in every task, so little is shuffled however many values there are.
    kept = samples(docs).groupBy("kind", F.pmod("mark", F.lit(sample)).alias("slot")).agg(F.min(F.struct("mark", "value")).alias("least"))
    values: dict[int, list[bytes]] = {}
    for r in kept.select("kind", "least.value").collect():  # at most (kinds + 1) * sample rows
        values.setdefault(r["kind"], []).append(bytes(r["value"]))
    credentials = [Automaton(sorted(values[k])) for k in range(len(KINDS)) if len(values.get(k, ())) >= LEAST_VALUES]
    ordinary = sorted(values.get(_ORDINARY, ()))
    return Formats(credentials, Automaton(ordinary) if len(ordinary) >= LEAST_VALUES else None)


BASE = "array<struct<kind:int,start:int,end:int,value:string,score:double>>"
MORE = "array<struct<start:int,end:int,value:string,score:double>>"


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, base (kind, start, end, value, score) and learned (start, end, value, score) of each row.

    Offsets are in code points. The score of a base match is the best log2 likelihood a character of its value (null
    where nothing was learnt), that of a learned span the bits by which it is likelier as a credential. Null and empty
    texts have no matches. A text is scanned whole whatever its length, in time linear in it; repeated rows give the same
    matches each, rows without a doc_id too. An empty table gives no rows. With fewer than LEAST_VALUES labelled values
    of a kind nothing is learnt from it. Other columns aren't read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(learn(docs, sample))

    def run(batches):
        formats = shared.value
        for batch in batches:
            base_col, more_col = [], []
            for text in batch.column("text").to_pylist():
                b = text or b""
                base = base_matches(b)
                more = [(s, s + len(t), t, x) for s, t in candidates(b, base) if (x := formats.judge(t)) is not None] if formats.credentials else []
                at = characters(b, {p for s, _, e, _ in base for p in (s, e)} | {p for s, e, _, _ in more for p in (s, e)})
                best = lambda v: max((a.score(v) for a in formats.credentials), default=None)
                base_col.append([{"kind": k, "start": at[s], "end": at[e], "value": v.decode(), "score": best(v)} for s, k, e, v in base])
                more_col.append([{"start": at[s], "end": at[e], "value": v.decode(), "score": x} for s, e, v, x in more])
            i, s, d = pa.int32(), pa.string(), pa.float64()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(base_col, pa.list_(pa.struct([("kind", i), ("start", i), ("end", i), ("value", s), ("score", d)]))),
                    pa.array(more_col, pa.list_(pa.struct([("start", i), ("end", i), ("value", s), ("score", d)]))),
                ],
                names=["doc_id", "base", "learned"],
            )

    small_batches(spark)
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, base {BASE}, learned {MORE}")


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    names = F.array(*(F.lit(k) for k in KINDS))
    entry = lambda at, start, end, name: F.struct(start.alias("start"), at.alias("at"), F.concat_ws(":", name, start, end).alias("said"))
    base = F.transform("base", lambda m: entry(m["kind"], m["start"], m["end"], F.element_at(names, m["kind"] + 1)))
    more = F.transform("learned", lambda m: entry(F.lit(len(KINDS)), m["start"], m["end"], F.lit(LEARNED)))
    said = lambda entries: F.array_join(F.transform(F.array_sort(entries), lambda m: m["said"]), ",")
    count = lambda k: F.size(F.filter("base", lambda m: m["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(said(base), 256).alias("base_sha256"),
        said(F.concat(base, more)).alias("spans"),
    )
