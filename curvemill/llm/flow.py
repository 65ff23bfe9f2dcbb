"""Helpers shared by the operators: stages, groups in a stream of batches, sizes that prove a broadcast."""

from __future__ import annotations

import atexit
import contextlib
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pandas as pd
from pyarrow import ArrowException
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvemill.session import scratch_path

# bytes that a table may have to be broadcast
BROADCAST_BYTES = 8 << 20
# a key is hot with more than this share of all rows, and this many
HOT_SHARE, HOT_LEAST = 10_000, 1000
# rows of an Arrow batch, bytes of a Parquet row group: what a task buffers of long texts
BATCH_ROWS, ROW_GROUP = 1000, 16 << 20
# folders of the stages written so far; they go when the process ends, unless deleted before
WRITTEN: list[str] = []
_OPEN: ContextVar[list[str] | None] = ContextVar("_OPEN", default=None)


def small_batches(spark: SparkSession) -> str:
    """Let this session hand Python at most BATCH_ROWS rows at a time; returns what was set before."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return before


def restore_batches(spark: SparkSession, before: str) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def stage(df: DataFrame, codec: str | None = None) -> tuple[DataFrame, str]:
    """Cut lineage: write to the shared folder and read back, which outlives executors; returns the folder too."""
    spark = df.sparkSession
    path = scratch_path(spark, "llm")
    (WRITTEN if _OPEN.get() is None else _OPEN.get()).append(path)
    before = small_batches(spark)
    try:
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path, compression=codec)
    finally:
        restore_batches(spark, before)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, codec: str | None = None) -> DataFrame:
    return stage(df, codec)[0]


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Stages written inside are deleted at the end. Yields ``keep``, which writes a frame that stays: it must be all that is read afterwards."""
    own: list[str] = []
    outer, kept = _OPEN.get(), []
    token = _OPEN.set(own)

    def keep(df: DataFrame) -> DataFrame:
        df, path = stage(df)
        kept.append(path)
        return df

    try:
        yield keep
    finally:
        _OPEN.reset(token)
        (WRITTEN if outer is None else outer).extend(kept)
        delete([p for p in own if p not in kept])


def delete(paths: list[str]) -> None:
    """Delete written stages that no pending result reads any more."""
    for path in paths:
        with contextlib.suppress(OSError, ArrowException):  # a store that only Spark deletes from keeps them
            system, inside = FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
            system.delete_dir(inside)
        if path in WRITTEN:
            WRITTEN.remove(path)


atexit.register(lambda: delete(list(WRITTEN)))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that other columns of the input can clash with nothing."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def small(df: DataFrame, row_bytes: int, items: Column | None = None) -> DataFrame:
    """Mark a written table for broadcast if its counted rows times ``row_bytes``, and 16 bytes for each of ``items`` in a row (the lengths of arrays and texts), stay
    within BROADCAST_BYTES; else leave it. ``row_bytes`` is what Spark's hash table takes for a row: 8 bytes a column, and 32 for its key and place."""
    n, held = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(items if items is not None else F.lit(0)), F.lit(0))).first()
    return F.broadcast(df) if n * (row_bytes + 32) + 16 * held <= BROADCAST_BYTES else df


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Left join on ``keys`` (null equals null), unique in ``right``, whose ``count`` says how many of the ``total`` rows of ``left`` a key has.

    At most HOT_SHARE keys can have more than a HOT_SHARE-th of all rows: these are broadcast. What is shuffled for the others has no hot key. Both sides
    are read twice, so they should be written tables.
    """
    new = [c for c in right.columns if c not in keys]
    right = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *new)
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    bound = max(HOT_LEAST, total // HOT_SHARE)
    heavy, rest = right.where(F.col(count) > bound), right.where(F.col(count) <= bound)
    out = left.join(F.broadcast(heavy), same).unionByName(left.join(F.broadcast(heavy), same, "left_anti").join(rest, same, "left"))
    return out.select(*left.columns, *new)


def offsets(f: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where the groups of a sorted frame begin, and its length."""
    change = np.zeros(len(f), bool)
    change[:1] = True
    for k in keys:
        v = f[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), len(f))


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of complete groups from a partition sorted by ``keys``, each with the offsets of its groups and its length; holds a batch and a group."""
    held: list[pd.DataFrame] = []

    for f in frames:
        if not len(f):
            continue
        # only if a group ends in this batch is what is held put together
        if held and len(offsets(f, keys)) == 2 and all(f[k].iloc[0] == held[-1][k].iloc[-1] for k in keys):
            held.append(f)
            continue
        f = pd.concat([*held, f], ignore_index=True) if held else f.reset_index(drop=True)
        at = offsets(f, keys)
        if len(at) > 2:
            yield f.iloc[: at[-2]], at[:-1]
        held = [f.iloc[at[-2] :]]
    if held:
        f = pd.concat(held, ignore_index=True)
        yield f, np.array([0, len(f)])


def groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The same, one group at a time."""
    for f, at in whole_groups(frames, keys):
        for a, z in zip(at[:-1], at[1:]):
            yield f.iloc[a:z].reset_index(drop=True)
