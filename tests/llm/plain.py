"""Brute-force versions of what the operators compute."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def words(text):
    return WORD.findall((text or "").lower())


def shingles(text, k=5):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 0.0


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def links(sets, threshold=0.8):
    """All pairs of non-empty sets with the similarity, through the elements they share."""
    where, common = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for at in where.values():
        common.update((a, b) for k, a in enumerate(at) for b in at[k + 1 :])
    return [p for p, c in common.items() if c >= threshold * (len(sets[p[0]]) + len(sets[p[1]]) - c) - 1e-9]


def lines(text):
    """Number and compared form of each line that is not blank."""
    out = []
    for i, x in enumerate((text or "").split("\n")):
        low = x.lower().strip("".join(map(chr, range(33))))
        if low:
            out.append((i, low))
    return out


def chars(line, k=8):
    return {line} if len(line) < k else {line[i : i + k] for i in range(len(line) - k + 1)}
