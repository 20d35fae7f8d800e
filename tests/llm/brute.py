"""Plain versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACE = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(SPACE, text or "")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contamination(docs, items):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = defaultdict(set)
    for item, text in items:
        w = re.findall(word, fold(text))
        for i in range(max(1, len(w) - 7) if w else 0):
            windows[tuple(w[i : i + 8])].add(str(item))
    lengths = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w = re.findall(word, fold(text))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[key]
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)
    return out


def repeats(docs, length=50):
    first = {}
    rows = [(d, (t or "").encode()) for d, t in docs]
    for d, b in rows:
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if first.get(s, d) >= d:
                first[s] = d
    out = {}
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def near_groups(docs, percent=85):
    sets = {}
    for d, t in docs:
        w = words(fold(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    common = Counter()
    for ids in holders.values():
        ids = sorted(ids)
        common.update((a, b) for i, a in enumerate(ids) for b in ids[i + 1 :])
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def quality_counts(text):
    w = words(text)
    times = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = set()
    for i in range(len(w) - 4):
        if times[tuple(w[i : i + 5])] > 1:
            again.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again)


def secrets(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    either = re.compile(assign.pattern.replace("(password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))"), re.ASCII)
    found = [(m.start(), 0, m.end()) for m in either.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    found.sort()
    said = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in found)
    n = Counter(k for _, k, _ in found)
    return n[0], n[1], n[2], hashlib.sha256(said.encode()).hexdigest(), said


def shards(docs, n=8):
    rows = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs), key=lambda r: (r[0], r[2], r[1]))
    total, at, count, out = sum(r[1] for r in rows), 0, Counter(), []
    for d, size, crc in rows:
        s = (2 * at + size) * n // (2 * total)
        out.append((d, size, crc, s, count[s]))
        count[s] += 1
        at += size
    return out


def good_probabilities(votes, rounds=100):
    """Posterior of the good class for each document's votes (b, g or -), by EM over documents one by one.

    Class 0 is good, class j + 1 is the bad kind that rule j sees. A rule that votes says bad with a class's own rate.
    """
    import math

    m = len(votes[0]) if votes else 0
    bounds = [[(0.0005, 0.1)] * m] + [[(0.7, 0.995) if j == c else (0.005, 0.995) for j in range(m)] for c in range(m)]
    start = [[0.03] * m] + [[0.9 if j == c else 0.2 for j in range(m)] for c in range(m)]
    rate, prior = [list(r) for r in start], [0.85] + [0.15 / m] * m
    post = []
    for _ in range(rounds):
        post = []
        for v in votes:
            logs = []
            for c in range(m + 1):
                x = math.log(prior[c])
                for j, vote in enumerate(v):
                    if vote == "b":
                        x += math.log(rate[c][j])
                    elif vote == "g":
                        x += math.log(1 - rate[c][j])
                logs.append(x)
            most = max(logs)
            e = [math.exp(x - most) for x in logs]
            post.append([x / sum(e) for x in e])
        for c in range(m + 1):
            for j in range(m):
                bad = sum(p[c] for p, v in zip(post, votes, strict=True) if v[j] == "b")
                said = sum(p[c] for p, v in zip(post, votes, strict=True) if v[j] != "-")
                low, high = bounds[c][j]
                rate[c][j] = min(high, max(low, (bad + 2 * start[c][j]) / (said + 2)))
            prior[c] = (sum(p[c] for p in post) + (8.5 if c == 0 else 1.5 / m)) / (len(votes) + 10)
    return [p[0] for p in post]


def quality_votes(text):
    """One letter for each rule, from plain counts of a text."""
    w = words(text)
    text = text or ""
    n, chars = len(w), sum(map(len, w))
    lines = [x for x in text.split("\n") if words(x)]
    _, _, symbols, dup, repeated = quality_counts(text)
    upper, letters = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
    other = len(re.findall(r"[!-/:-@\[-`{-~\x00-\x08\x0E-\x1F\x7F]", text))
    marked = sum(bool(re.search(r"[#*$%&|<>]", x)) for x in w)
    bangs, stops = text.count("!!"), text.count(".") + text.count("?")
    per = lambda a, b: a / max(b, 1)
    rules = [
        (per(symbols, chars) > 0.08, symbols * 100 < chars),
        (per(marked, n) > 0.2, marked * 100 < n),
        (per(other, chars) > 0.1, per(other, chars) < 0.06),
        (per(upper, letters) > 0.3, per(upper, letters) < 0.1),
        (per(bangs, n) > 0.1, bangs == 0),
        (per(repeated, n) > 0.15, per(repeated, n) < 0.02),
        (per(dup, len(lines)) > 0.3, len(lines) > 1 and dup == 0),
        (per(chars, n) < 2.5 or per(chars, n) > 14, 3 < per(chars, n) < 10),
        (n >= 20 and per(len(set(w)), n) < 0.15, n < 400 and per(len(set(w)), n) > 0.5),
        (n >= 40 and stops == 0, per(stops, n) > 0.02),
    ]
    return "".join("b" if bad else "g" if good else "-" for bad, good in rules)
