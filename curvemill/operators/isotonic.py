"""Isotonic regression by pooled blocks that merge.

A block is a run of neighbouring scores with one mean: its first and last score, the sum of outcomes and their number. Pooling neighbours that fall (pool adjacent violators) gives the same
blocks whether it starts from single scores or from blocks pooled before. So scores are range-partitioned, each task pools its own range, and neighbouring ranges are pooled together, FAN at a time, until
one is left. Equal scores are one block from the start.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvemill.operators.skew import task_count
from curvemill.session import materialize

FAN = 32
BLOCK = "part int, low double, high double, total double, n double"


def pooled(low: np.ndarray, high: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks in order of their scores, pooled until their means rise."""
    first, at = np.zeros(len(n), np.int64), -1
    t, m = total.astype(float).copy(), n.astype(float).copy()
    for i in range(len(n)):
        at += 1
        first[at], t[at], m[at] = i, total[i], n[i]
        while at and t[at - 1] * m[at] >= t[at] * m[at - 1]:
            t[at - 1] += t[at]
            m[at - 1] += m[at]
            at -= 1
    first = first[: at + 1]
    last = np.append(first[1:], len(n)) - 1
    return low[first], high[last], t[: at + 1], m[: at + 1]


def _pool(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The blocks of a task's range; what is held is one pooled list and a batch."""
    held = None
    for f in frames:
        if not len(f):
            continue
        held = f if held is None else pd.concat([held, f], ignore_index=True)
        part = int(held["part"].iloc[0])
        low, high, total, n = pooled(*[held[c].to_numpy(float) for c in ("low", "high", "total", "n")])
        held = pd.DataFrame({"part": part, "low": low, "high": high, "total": total, "n": n})
    if held is not None:
        yield held


def fit(scored: DataFrame) -> DataFrame:
    """Blocks ``low, high, mean, n`` of ``scored(x, z)``, rows without either left out; their means rise."""
    one = scored.where("x is not null and z is not null and not isnan(x)").groupBy("x").agg(F.sum("z").alias("total"), F.count(F.lit(1)).cast("double").alias("n"))
    one = materialize(one)
    parts = task_count(scored.sparkSession, one.count())
    ranged = one.repartitionByRange(parts, "x").sortWithinPartitions("x")
    blocks = ranged.select(F.spark_partition_id().alias("part"), F.col("x").alias("low"), F.col("x").alias("high"), "total", "n").mapInPandas(_pool, BLOCK)
    while True:
        blocks = materialize(blocks)
        if parts == 1:
            return blocks.select("low", "high", (F.col("total") / F.col("n")).alias("mean"), "n")
        parts = -(-parts // FAN)
        blocks = blocks.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).repartitionByRange(parts, "part") \
            .sortWithinPartitions("part", "low").mapInPandas(_by_part, BLOCK)


def _by_part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """`_pool` for each part of a task."""
    held: list[pd.DataFrame] = []
    for f in frames:
        for part, g in f.groupby("part", sort=False):
            if held and held[-1]["part"].iloc[0] != part:
                yield from _pool(iter(held))
                held = []
            held.append(g)
    if held:
        yield from _pool(iter(held))


def knots(blocks: DataFrame) -> tuple[list[float], list[float]]:
    """Where the fitted line bends: both ends of every block, and its mean there."""
    rows = blocks.orderBy("low").collect()
    x, v = [], []
    for r in rows:
        for at in sorted({r["low"], r["high"]}):
            x.append(at), v.append(r["mean"])
    return x, v


def interpolate(score: Column, x: list[float], v: list[float]) -> Column:
    """The line through the knots, level beyond its ends; 0 without knots."""
    if not x:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def line(s: pd.Series) -> pd.Series:
        return pd.Series(np.interp(s.to_numpy(float), x, v))

    return line(score)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
