"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def top(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


def shingle_set(t, k):
    w = WORD.findall(low(t)) if t else []
    return {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()


def near(docs, k, percent=80):
    """docs: [(id, text)] with distinct ids -> {id: (n, component, kept)}."""
    sets = {i: shingle_set(t, k) for i, t in docs}
    u, ids = Union(sets), sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * len(sets[a] | sets[b]):
                u.join(a, b)
    return {i: (len(sets[i]), u.top(i), u.top(i) == i) for i in ids}


def substrings(docs, width=50):
    first = {}
    own = sorted((i, (t or "").encode()) for i, t in docs)
    for i, b in own:
        for j in range(len(b) - width + 1):
            first.setdefault(b[j : j + width], i)
    out = []
    for i, b in own:
        m = np.zeros(len(b), bool)
        for j in range(len(b) - width + 1):
            if first[b[j : j + width]] < i:
                m[j : j + width] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~m])
        out.append((i, len(b), int(m.sum()), int((np.diff(np.r_[0, m, 0]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def leaks(docs, items, n=10):
    windows = defaultdict(set)
    for i, t in items:
        w = PLAIN.findall(low(t)) if t else []
        for j in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[j : j + n])].add(i)
    out = {}
    for i, t in docs:
        w = PLAIN.findall(low(t)) if t else []
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if (own := tuple(w[j : j + k])) in windows:
                    hit.update(range(j, j + k))
                    found |= windows[own]
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


def base(t):
    t = t or ""
    w = WORD.findall(t)
    at = defaultdict(list)
    for j in range(len(w) - 2):
        at[tuple(w[j : j + 3])].append(j)
    twice = {j + d for own in at.values() if len(own) > 1 for j in own for d in range(3)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(twice), len(w) < 50 or 100 * len(twice) > 50 * len(w)


def line_sets(t):
    t = t.strip(" \t\n\x0b\x0c\r").lower()
    return {t[i : i + 5] for i in range(len(t) - 4)} if len(t) >= 5 else {t}


def lines(docs, short, percent=80):
    """{id: text left} for docs in the order of distinct ids; assumes all similar lines are found."""
    rows = [(i, k, x) for i, t in sorted(docs) for k, x in enumerate((t or "").split("\n")) if len(x.strip(" \t\n\x0b\x0c\r")) > short]
    sets = [line_sets(x) for _, _, x in rows]
    u = Union(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                u.join(a, b)
    gone = {(rows[a][0], rows[a][1]) for a in range(len(rows)) if u.top(a) != a}
    return {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone) for i, t in docs}
