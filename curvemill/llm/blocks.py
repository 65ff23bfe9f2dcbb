"""Pairs inside groups of any size, without a group in one task and without a row for each pair.

``deal`` cuts groups beyond a block into blocks and sends each member to every pair of blocks that its own block is part of; a task compares
the members of one pair of blocks at a time. What a task returns are ``linked`` rows: one for each member that has a link there, with what its partners
weigh and the root of the task's own union-find. Summed weights count every link once, since a pair of members meets in one pair of blocks;
the roots are the edges for the distributed union-find.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvemill.llm.graph import roots

LINKED = "cid long, add long, root long"
# rows of a group that is compared along with others; elements of sets that are looked at together
SMALL, MOST = 32, 1_000_000


def deal(members: DataFrame, keys: list[str], blocks: Column) -> DataFrame:
    """Members (``cid`` and others) of groups ``keys``, sorted and partitioned by ``keys, x, y``: a row for each pair of blocks; ``side`` is its own block."""
    m = members.withColumn("blocks", F.greatest(F.lit(1), F.ceil(blocks)).cast("int"))
    m = m.withColumn("side", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.withColumns({"x": F.least("side", "other"), "y": F.greatest("side", "other")}).drop("other", "blocks")
    return m.repartition(*keys, "x", "y").sortWithinPartitions(*keys, "x", "y")


def linked(cid: np.ndarray, i: np.ndarray, j: np.ndarray, add: np.ndarray | None = None) -> pd.DataFrame:
    """LINKED rows for local edges ``i - j`` and the weight ``add`` of each member (none: 0; the rows of ``cid`` may repeat then)."""
    nodes, root = roots(cid[i], cid[j])
    if add is None:
        return pd.DataFrame({"cid": nodes, "add": 0, "root": root})
    order = np.argsort(cid, kind="stable")
    return pd.DataFrame({"cid": nodes, "add": add[order][np.searchsorted(cid[order], nodes)], "root": root})


@cache
def least_matches(size: int, step: int, threshold: float, tolerance: float) -> tuple[tuple[int, int], ...]:
    """``(compared, matches)``: after so many compared MinHash values a pair needs so many equal ones.

    With a uniform prior the similarity after m of j equal values is Beta(m + 1, j - m + 1), and the chance that it reaches the
    threshold t is that of at most m successes in j + 1 trials of chance t. The pair goes once that falls below the tolerance.
    """
    out = []
    for j in [*range(step, size, step), size]:
        p, total = (1 - threshold) ** (j + 1), 0.0
        m = 0
        while True:
            total += p
            if total >= tolerance:
                break
            m += 1
            p *= (j + 2 - m) / m * threshold / (1 - threshold)
        out.append((j, m))
    return tuple(out)


def pairs_within(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs ``i > j`` of rows of a group, for groups ``[at[k], at[k + 1])``; for small groups."""
    size = np.diff(at)
    start = np.repeat(at[:-1], size)
    behind = np.arange(at[0], at[-1]) - start
    i = np.repeat(np.arange(at[0], at[-1]), behind)
    j = np.repeat(start, behind) + np.arange(len(i)) - np.repeat(np.cumsum(behind) - behind, behind)
    return i, j


def surviving(sig: np.ndarray, i: np.ndarray, j: np.ndarray, step: int, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no comparison of ``step`` more values has dropped."""
    done, m = 0, np.zeros(len(i), np.int64)
    for upto, need in least_matches(sig.shape[1], step, threshold, tolerance):
        m = m + np.count_nonzero(sig[i, done:upto] == sig[j, done:upto], axis=1)
        keep = m >= need
        i, j, m, done = i[keep], j[keep], m[keep], upto
    return i, j


def survivors(sig: np.ndarray, rows: slice, allowed: np.ndarray, step: int, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(i, j)`` of ``rows`` with all members (where ``allowed``) that no comparison of ``step`` more values has dropped."""
    at, done = rows.start, 0
    i = j = m = None
    for upto, need in least_matches(sig.shape[1], step, threshold, tolerance):
        if i is None:
            same = np.zeros(allowed.shape, np.int16)
            for k in range(upto):
                same += sig[rows, k][:, None] == sig[None, :, k]
            i, j = np.nonzero(allowed & (same >= need))
            m = same[i, j]
        else:
            m = m + np.count_nonzero(sig[i + at, done:upto] == sig[j, done:upto], axis=1)
            keep = m >= need
            i, j, m = i[keep], j[keep], m[keep]
        done = upto
    return i + at, j


def pairs_allowed(rows: slice, side: np.ndarray, cross: bool) -> np.ndarray:
    """Each pair once: of different blocks if the task has two, else the later member with the earlier."""
    n = len(side)
    r = np.arange(rows.start, min(rows.stop, n))
    below = r[:, None] > np.arange(n)[None, :]
    return below & (side[r][:, None] != side[None, :]) if cross else below


def group_pairs(at: np.ndarray, cross: np.ndarray, small: Callable, large: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of the groups ``[at[k], at[k + 1])`` of a frame, as row numbers.

    Groups up to SMALL rows are compared together: ``small(i, j)`` keeps some of their pairs. ``large(a, z, cross)`` finds the pairs of a larger group, or of two blocks.
    """
    size = np.diff(at)
    alone = (size > SMALL) | cross[at[:-1]]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, z in zip(at[:-1][alone], at[1:][alone]):
        i, j = large(a, z, bool(cross[a]))
        left.append(i + a), right.append(j + a)
    rows = np.flatnonzero(np.repeat(~alone, size))
    bounds = np.concatenate(([0], np.cumsum(size[~alone])))
    for s in range(0, len(bounds) - 1, 1000):
        i, j = pairs_within(bounds[s : s + 1001])
        i, j = small(rows[i], rows[j])
        left.append(i), right.append(j)
    return np.concatenate(left), np.concatenate(right)


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose sets have a Jaccard similarity of ``threshold`` or more."""
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    size = np.array([len(s) for s in sets])
    both = np.zeros(len(i), np.int64)
    a = 0
    while a < len(i):  # pairs near each other in the frame, with not too many different rows
        z = min(len(i), a + 20_000)
        used, place = np.unique(np.concatenate([i[a:z], j[a:z]]), return_inverse=True)
        while z > a + 1 and size[used].sum() > MOST:
            z = a + max(1, (z - a) // 2)
            used, place = np.unique(np.concatenate([i[a:z], j[a:z]]), return_inverse=True)
        x, y = np.split(place.reshape(-1), 2)
        both[a:z] = overlaps([sets[u] for u in used], x, y)
        a = z
    real = both >= threshold * (size[i] + size[j] - both) - 1e-9
    return i[real], j[real]


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Size of the intersection of sets ``i`` and ``j`` for each pair; ``i`` is sorted."""
    out = np.zeros(len(i), np.int64)
    if not len(i):
        return out
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    flat = flat.reshape(-1)
    start = np.cumsum(sizes) - sizes
    flag = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
    cut = np.flatnonzero(np.diff(i, prepend=-1))
    for a, z in zip(cut, [*cut[1:], len(i)]):
        own = flat[start[i[a]] : start[i[a]] + sizes[i[a]]]
        flag[own] = True
        for s in range(a, z, 256):
            js = j[s : min(s + 256, z)]
            n = sizes[js]
            at = np.repeat(start[js], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[s : s + len(js)] = np.add.reduceat(flag[flat[at]].astype(np.int64), np.cumsum(n) - n)
        flag[own] = False
    return out
