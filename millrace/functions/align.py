"""Pairwise alignment: scoring schemes and dynamic programming kernels.

One query is scored against many sequences at once. Along a row of the table the best gap is a running maximum of
score minus the gaps' prefix sums, so a row of all sequences is a few array operations.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

GAP = "-"
INDEL = "*"


@dataclass(frozen=True)
class Scheme:
    """Substitution table over code points below 256, and the cost of a gap against each."""

    table: np.ndarray = field(repr=False)
    gap: np.ndarray = field(repr=False)
    letters: bool = False  # tag line: letters for matches
    known: frozenset | None = None

    def codes(self, s: str) -> np.ndarray:
        """Code points; raises where the scheme has no score for one."""
        if self.known is not None and (bad := set(s) - self.known):
            raise ValueError(f"no score for {sorted(bad)}")
        return np.frombuffer(s.encode("latin-1"), np.uint8)


def basic_scheme(match: int, mismatch: int, gap: int, ignore_case: bool = False) -> Scheme:
    table = np.full((256, 256), mismatch, np.int32)
    np.fill_diagonal(table, match)
    if ignore_case:
        for c in range(65, 91):
            table[c, c + 32] = table[c + 32, c] = match
    return Scheme(table, np.full(256, gap, np.int32))


def matrix_scheme(scores: dict[tuple[str, str], int]) -> Scheme:
    """From (row, column) -> score, the gap being the row or column `*`."""
    table, gap = np.zeros((256, 256), np.int32), np.zeros(256, np.int32)
    for (a, b), s in scores.items():
        if a == INDEL and b != INDEL:
            gap[ord(b)] = s
        elif b != INDEL:
            table[ord(a), ord(b)] = s
    return Scheme(table, gap, True, frozenset(a for a, _ in scores if a != INDEL))


def scores(query: str, others: list[str], scheme: Scheme, local: bool) -> np.ndarray:
    """Best score of the query with each of the others; linear space a sequence."""
    n = len(others)
    lengths = np.array([len(o) for o in others], dtype=np.int64)
    wide = int(lengths.max(initial=0))
    codes = np.zeros((n, wide), np.uint8)
    for i, o in enumerate(others):
        codes[i, : len(o)] = scheme.codes(o)
    inside = np.arange(wide) < lengths[:, None]
    ahead = np.zeros((n, wide + 1), np.int64)
    np.cumsum(np.where(inside, scheme.gap[codes], 0), axis=1, out=ahead[:, 1:])
    row = np.zeros((n, wide + 1), np.int64) if local else ahead.copy()
    best = np.zeros(n, np.int64)
    for c in scheme.codes(query):
        drop = int(scheme.gap[c])
        now = row + drop
        np.maximum(now[:, 1:], row[:, :-1] + scheme.table[c][codes], out=now[:, 1:])
        if local:
            np.maximum(now, 0, out=now)
        row = ahead + np.maximum.accumulate(now - ahead, axis=1)
        if local:
            best = np.maximum(best, np.where(np.arange(wide + 1) <= lengths[:, None], row, 0).max(axis=1))
    return best if local else row[np.arange(n), lengths]


def align(a: str, b: str, scheme: Scheme, local: bool = False) -> dict:
    """{score, gapped1, tag, gapped2} of one best alignment; going back, gap in a, then pair, then gap in b."""
    x, y = scheme.codes(a), scheme.codes(b)
    ahead = np.r_[0, np.cumsum(scheme.gap[y])].astype(np.int64)
    rows = [np.zeros(len(y) + 1, np.int64) if local else ahead]
    for c in x:
        now = rows[-1] + scheme.gap[c]
        np.maximum(now[1:], rows[-1][:-1] + scheme.table[c][y], out=now[1:])
        if local:
            np.maximum(now, 0, out=now)
        rows.append(ahead + np.maximum.accumulate(now - ahead))
    m = np.stack(rows)
    i, j = divmod(int(m.argmax()), len(y) + 1) if local else (len(x), len(y))
    score, g1, tag, g2 = int(m[i, j]), [], [], []
    while (i or j) and not (local and m[i, j] == 0):
        if j and m[i, j] == m[i, j - 1] + scheme.gap[y[j - 1]]:
            j -= 1
            g1.append(GAP), tag.append(" "), g2.append(b[j])
        elif i and j and m[i, j] == m[i - 1, j - 1] + scheme.table[x[i - 1], y[j - 1]]:
            i, j = i - 1, j - 1
            s = scheme.table[x[i], y[j]]
            same = a[i] == b[j]
            tag.append((a[i] if scheme.letters else "|") if same else "+" if s > 0 else " ")
            g1.append(a[i]), g2.append(b[j])
        else:
            i -= 1
            g1.append(a[i]), tag.append(" "), g2.append(GAP)
    return {"score": score, "gapped1": "".join(g1[::-1]), "tag": "".join(tag[::-1]), "gapped2": "".join(g2[::-1])}


#: Names of the algorithms; the block forms give the same scores as the plain ones and are served by their kernels.
ALGORITHMS = {"nw": False, "sw": True, "cg": False, "cl": True}


def lz78_phrases(s: str) -> list[str]:
    """The LZ78 phrases of the letters of s; the last one may have occurred before."""
    seen: set[str] = set()
    out, at = [], ""
    for c in s:
        if not c.isalpha():
            continue
        at += c
        if at not in seen:
            seen.add(at)
            out.append(at)
            at = ""
    return out + [at] if at else out


def lz78_count(s: str) -> int:
    """Number of phrases, by a walk down the trie."""
    trie: dict[tuple[int, str], int] = {}
    node = n = 0
    for c in s:
        if not c.isalpha():
            continue
        down = trie.get((node, c))
        if down is None:
            n += 1
            trie[node, c] = n
            node = 0
        else:
            node = down
    return n + (node != 0)


def column_maxima(rows: int, columns: int, value) -> list[int]:
    """For each column the first row with its largest value, of a totally monotone matrix: the row never moves back from
    column to column.

    Only as many rows as there are columns can win, which one pass over a stack finds; every other column is solved by the
    same means, and the ones between look only at the rows between their neighbours'. Linear in rows and columns.
    """
    best = [0] * columns

    def solve(rs: list[int], cs: range) -> None:
        if not cs:
            return
        kept: list[int] = []
        for r in rs:
            while kept and value(kept[-1], cs[len(kept) - 1]) < value(r, cs[len(kept) - 1]):
                kept.pop()
            if len(kept) < len(cs):
                kept.append(r)
        solve(kept, cs[1::2])
        at = 0
        for i in range(0, len(cs), 2):
            last = kept[-1] if i + 1 >= len(cs) else best[cs[i + 1]]
            best[cs[i]] = kept[at]
            while kept[at] != last:
                at += 1
                if value(kept[at], cs[i]) > value(best[cs[i]], cs[i]):
                    best[cs[i]] = kept[at]

    if rows:
        solve(list(range(rows)), range(columns))
    return best
