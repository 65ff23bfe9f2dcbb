"""Sums over a fixed grid of parameters or frequencies, without a row for each sample and grid point. `array_sums` keeps them as arrays, one row for each target.

Samples are dealt by (target, slice), with as many slices as a target has SLICE_ROWS; a task adds the samples of one slice into an array of grid x sums,
a block of samples at a time, and returns one row per grid point. So what is shuffled follows (target, slice) x grid, not samples x grid, a hot
target is many slices, and memory is a block.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill.operators.skew import GROUP_ROWS, Census, attach

SLICE_ROWS = 20_000
# samples x grid points that a task works on at once
BLOCK = 1_000_000

# given the samples of one block of a target: one array over the grid for each sum
Kernel = Callable[[pd.DataFrame], Sequence[np.ndarray]]


def grid_sums(x: DataFrame, kernel: Kernel, grid: int, names: Sequence[str], cen: Census, carry: Sequence[str] = ()) -> DataFrame:
    """``target, k, names..., n, carry...``: the sums of ``kernel`` and the number of samples for each target and grid point.

    ``carry``: double columns that are the same in all rows of a target.
    """
    sizes = x.groupBy("target").agg(F.count(F.lit(1)).alias("_rows"))
    y = attach(x, sizes, ["target"], cen)
    y = y.withColumn("_slice", F.pmod(F.xxhash64("t", "flux"), F.ceil(F.col("_rows") / SLICE_ROWS)).cast("int")).drop("_rows")
    step = max(1, BLOCK // grid)

    def add(g: pd.DataFrame, total: list | None) -> list:
        for a in range(0, len(g), step):
            part = [np.asarray(v, np.float64) for v in kernel(g.iloc[a : a + step])]
            total = part if total is None else [s + v for s, v in zip(total, part)]
        return total

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row(target, first, total, n):
            return pd.DataFrame({"target": target, "k": np.arange(grid, dtype=np.int32), **dict(zip(names, total)), "n": n, **{c: first[c] for c in carry}})

        now, first, total, n = None, None, None, 0
        for f in frames:
            new = (f["target"] != f["target"].shift()) | (f["_slice"] != f["_slice"].shift())
            at = [*np.flatnonzero(new), len(f)]
            for a, z in zip(at, at[1:]):
                g = f.iloc[a:z]
                key = (g["target"].iloc[0], g["_slice"].iloc[0])
                if key != now:
                    if now is not None:
                        yield row(now[0], first, total, n)
                    now, first, total, n = key, g.iloc[0], None, 0
                total, n = add(g, total), n + len(g)
        if now is not None:
            yield row(now[0], first, total, n)

    fields = ", ".join(["target string", "k int", *[f"{c} double" for c in names], "n long", *[f"{c} double" for c in carry]])
    part = y.repartition("target", "_slice").sortWithinPartitions("target", "_slice").mapInPandas(run, fields)
    return part.groupBy("target", "k", *carry).agg(*[F.sum(c).alias(c) for c in names], F.sum("n").alias("n"))


class Sums(Protocol):
    """Adds up blocks of samples of one target; ``arrays`` are sums that add over parts of a curve."""

    def add(self, block: pd.DataFrame) -> None: ...

    def arrays(self) -> Sequence[np.ndarray]: ...


def array_sums(x: DataFrame, make: Callable[[], Sums], names: Sequence[str], cen: Census, carry: Sequence[str] = ()) -> DataFrame:
    """``target, n, names... (arrays), carry...``: the sums of each target. ``carry``: double columns that are the same in all rows of a target.

    A target of up to GROUP_ROWS samples, as the census tells, is finished by the task that reads it. Larger ones are dealt in slices of
    that size, and only their arrays meet again.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, first, held, n = None, None, None, 0

        def row():
            return pd.DataFrame([{"target": now[0], "n": n, **dict(zip(names, held.arrays())), **{c: first[c] for c in carry}}])

        for f in frames:
            new = (f["target"] != f["target"].shift()) | (f["_slice"] != f["_slice"].shift())
            at = [*np.flatnonzero(new), len(f)]
            for a, z in zip(at, at[1:]):
                g = f.iloc[a:z]
                key = (g["target"].iloc[0], g["_slice"].iloc[0])
                if key != now:
                    if now is not None:
                        yield row()
                    now, first, held, n = key, g.iloc[0], make(), 0
                held.add(g)
                n += len(g)
        if now is not None:
            yield row()

    def together(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for f in frames:
            for r in f.to_dict("records"):
                if now is None or r["target"] != now["target"]:
                    if now is not None:
                        yield pd.DataFrame([now])
                    now = r
                else:
                    now = {**now, "n": now["n"] + r["n"], **{c: now[c] + r[c] for c in names}}
        if now is not None:
            yield pd.DataFrame([now])

    fields = ", ".join(["target string", "n long", *[f"{c} array<double>" for c in names], *[f"{c} double" for c in carry]])
    if not cen.heavy:
        y = x.withColumn("_slice", F.lit(0))
    else:
        sizes = x.groupBy("target").agg(F.count(F.lit(1)).alias("_rows"))
        y = attach(x, sizes, ["target"], cen).withColumn("_slice", F.pmod(F.xxhash64("t", "flux"), F.ceil(F.col("_rows") / GROUP_ROWS)).cast("int")).drop("_rows")
    part = y.repartition("target", "_slice").sortWithinPartitions("target", "_slice").mapInPandas(run, fields)
    return part.repartition("target").sortWithinPartitions("target").mapInPandas(together, fields) if cen.heavy else part


cloudpickle.register_pickle_by_value(sys.modules[__name__])
