"""Ordered work along a curve, cut into row-bounded pieces.

A window over a whole target would put a hot target into one task. Targets the census calls heavy are
range-partitioned on (target, t) and each partition becomes a cell; all others are one cell. Windows run
per (target, cell) and what crosses a cell border is carried by a small per-cell table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvemill.operators.skew import (GROUP_ROWS, Census, attach, census, grouped_quantiles, range_frozen,
                                      split_heavy)

KEY = ["target"]
CELL = ["target", "_cell"]


def row_cells(lc: DataFrame, cen: Census, limit: int = GROUP_ROWS) -> DataFrame:
    """Add ``_cell``: contiguous in time per target, none much larger than ``limit`` rows."""
    if not cen.heavy:
        return lc.withColumn("_cell", F.lit(0))
    small, big = split_heavy(lc, KEY, cen)
    # the running id only lets identical samples be cut apart; materialising fixes it
    frozen = range_frozen(big.withColumn("_uid", F.monotonically_increasing_id()), ["target", "t", "_uid"],
                          cen.n_rows, limit)
    return small.withColumn("_cell", F.lit(0)).unionByName(
        frozen.withColumnRenamed("_pid", "_cell").drop("_uid"))


def sample_gaps(lc: DataFrame, cen: Census | None = None, limit: int = GROUP_ROWS) -> DataFrame:
    """``(target, dt)``: spacing of consecutive samples."""
    cen = census(lc, KEY, limit) if cen is None else cen
    x = row_cells(lc.select("target", "t"), cen, limit)
    inner = x.select("target", (F.col("t") - F.lag("t").over(Window.partitionBy(*CELL).orderBy("t"))).alias("dt"))
    if cen.heavy:
        ends = x.groupBy(*CELL).agg(F.min("t").alias("a"), F.max("t").alias("b"))
        prev = F.lag("b").over(Window.partitionBy("target").orderBy("_cell"))
        inner = inner.unionByName(ends.select("target", (F.col("a") - prev).alias("dt")))
    return inner.where(F.col("dt").isNotNull())


def cadence(lc: DataFrame, cen: Census | None = None, limit: int = GROUP_ROWS) -> DataFrame:
    """Median sample spacing per target."""
    cen = census(lc, KEY, limit) if cen is None else cen
    return grouped_quantiles(sample_gaps(lc, cen, limit), KEY, {"cadence": ("dt", 0.5)}, cen, limit)


def time_rank(lc: DataFrame, cen: Census, name: str = "rn", limit: int = GROUP_ROWS) -> DataFrame:
    """1-based position of every sample along its curve."""
    x = row_cells(lc, cen, limit)
    out = x.withColumn("_r", F.row_number().over(Window.partitionBy(*CELL).orderBy("t")))
    if not cen.heavy:
        return out.withColumnRenamed("_r", name).drop("_cell")
    upto = Window.partitionBy("target").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    below = x.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_c")).withColumn(
        "_below", F.coalesce(F.sum("_c").over(upto), F.lit(0))).drop("_c")
    return out.join(below, CELL).withColumn(name, F.col("_r") + F.col("_below")).drop("_r", "_below", "_cell")


def interpolate(lc: DataFrame, column: str = "trend", cen: Census | None = None, limit: int = GROUP_ROWS) -> DataFrame:
    """Fill NULLs of ``column`` linearly in time between the nearest values, flat beyond the ends.

    Left as they are when a target has fewer than three values.
    """
    cen = census(lc, KEY, limit) if cen is None else cen
    x = row_cells(lc, cen, limit)
    point = F.when(F.col(column).isNotNull(), F.struct(F.col("t").alias("t"), F.col(column).alias("v")))
    # both directions as growing frames, which are linear; a shrinking frame would be quadratic
    sofar = (Window.unboundedPreceding, 0)
    x = x.withColumn("_p", F.last(point, ignorenulls=True).over(Window.partitionBy(*CELL).orderBy("t").rowsBetween(*sofar)))
    x = x.withColumn("_n", F.last(point, ignorenulls=True).over(Window.partitionBy(*CELL).orderBy(F.col("t").desc()).rowsBetween(*sofar)))
    have = F.col(column).isNotNull()
    if cen.heavy:
        ends = x.groupBy(*CELL).agg(
            F.max_by(point, F.when(have, F.col("t"))).alias("_l"), F.min_by(point, F.when(have, F.col("t"))).alias("_f"),
            F.count(column).alias("_c"))
        before = (Window.unboundedPreceding, -1)
        carry = ends.select(
            *CELL, F.last("_l", ignorenulls=True).over(Window.partitionBy("target").orderBy("_cell").rowsBetween(*before)).alias("_lp"),
            F.last("_f", ignorenulls=True).over(Window.partitionBy("target").orderBy(F.col("_cell").desc()).rowsBetween(*before)).alias("_nf"),
            F.sum("_c").over(Window.partitionBy("target")).alias("_k"))
        x = x.join(carry, CELL).withColumn("_p", F.coalesce("_p", "_lp")).withColumn("_n", F.coalesce("_n", "_nf")).drop("_lp", "_nf")
    else:
        x = attach(x, lc.groupBy("target").agg(F.count(column).alias("_k")), KEY, cen)
    a, b = F.col("_p.t"), F.col("_n.t")
    line = F.col("_p.v") + F.coalesce(F.try_divide(F.col("t") - a, b - a), F.lit(0.0)) * (F.col("_n.v") - F.col("_p.v"))
    filled = (F.when(F.col(column).isNotNull() | (F.col("_k") <= 2), F.col(column))
              .when(F.col("_p").isNull(), F.col("_n.v")).when(F.col("_n").isNull(), F.col("_p.v")).otherwise(line))
    return x.withColumn(column, filled).drop("_p", "_n", "_k", "_cell")
