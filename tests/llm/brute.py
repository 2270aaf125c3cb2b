"""The operators' results computed plainly, on lists of (doc_id, text)."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def split(text):
    return WORD.findall(text or "")


def base_counts(text, size=8):
    w, seen, again = split(text), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    runs = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
    n = Counter(runs)
    busy = {j for i, r in enumerate(runs) if n[r] > 1 for j in range(i, i + size)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), again, len(busy),
            len(w) < 20 or 100 * len(busy) > 30 * len(w))


def shingles(text, size):
    w = split((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def near_groups(rows, size=3, percent=85):
    """[(doc_id, number of shingles, least doc_id reachable)], in the order of the rows."""
    sets, by = [shingles(t, size) for _, t in rows], defaultdict(list)
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, s in enumerate(sets):
        near = {j for x in s for j in by[x]}
        for j in near:
            common = len(s & sets[j])
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                group[find(i)] = find(j)
        for x in s:
            by[x].append(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [(d, len(sets[i]), low.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def substrings(rows, size=35):
    texts = [split(t) for _, t in rows]
    n = Counter(tuple(w[i : i + size]) for w in texts for i in range(len(w) - size + 1))
    out = []
    for (d, _), w in zip(rows, texts):
        gone = {j for i in range(len(w) - size + 1) if n[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
