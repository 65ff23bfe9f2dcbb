"""Connected components by distributed union-find: every node gets the smallest node that links reach.

Each task first joins what it holds in a local union-find, chunk by chunk, which leaves at most one edge for each node of a chunk. Then
alternating stars (large star: hang larger neighbours below the smallest one; small star: hang smaller ones) run until no edge changes;
the number of rounds follows the logarithm of the longest path. Once the counted edges are FEW (4 MB), one task joins them at once instead. A hub's edges combine before the shuffle, and joins on a hub are split
by AQE. Every round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill.llm.flow import materialize

# edges that a task joins at once; edges in all, counted after the first joining, that one task finishes without rounds
CHUNK, FEW = 1_000_000, 250_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges ``a - b`` and the smallest node of the component of each."""
    nodes, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, (x, y) = np.arange(len(nodes)), np.split(ids.reshape(-1), 2)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:  # follow pointers to the root
            far = new[new]
            if np.array_equal(far, new):
                break
            new = far
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def star(held):
        nodes, root = roots(np.concatenate([f["a"].to_numpy() for f in held]), np.concatenate([f["b"].to_numpy() for f in held]))
        off = nodes != root
        return pd.DataFrame({"a": nodes[off], "b": root[off]})

    held, n = [], 0
    for f in frames:
        held.append(f)
        n += len(f)
        if n > CHUNK:
            yield star(held)
            held, n = [], 0
    if held:
        yield star(held)


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node with an edge in ``edges(a, b)``, two longs. Loops and nulls are ignored; no edges, no rows."""
    e = edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    e = materialize(e.mapInPandas(_contract, "a long, b long"))

    def mark(df):
        r = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        return r[0], r[1]

    before = mark(e)
    while before[0] > FEW:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = materialize(small.where("a <> b").distinct())
        now = mark(e)
        if now == before:
            break
        before = now
    if 0 < before[0] <= FEW:
        e = materialize(e.coalesce(1).mapInPandas(_contract, "a long, b long"))
    top = e.select(F.col("b").alias("a"), "b").distinct()
    return e.unionByName(top).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
