"""Per-group statistics that hold when one group owns a large share of all rows.

Sums, counts and moments combine before the shuffle, so a hot group costs nothing extra. Order
statistics and ranks do not combine; for them a census counts every group first. Groups up to
``limit`` rows use Spark's own ``percentile`` / ``row_number``. Groups beyond it are range-partitioned
on (group, value): the range partitioner cuts a hot group into many tasks, the partition number is
frozen by writing it to the shared folder, and exact ranks follow from per-partition counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvemill.session import materialize

# rows of one group that a single task may hold
GROUP_ROWS = 1_000_000
# rows and bytes of a per-group table that may be broadcast
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


# stands for "treat every group as heavy": there are too many heavy ones to name
EVERY = [("*",)]


class Census(NamedTuple):
    n_groups: int
    n_rows: int
    heavy: list[tuple]


def census(df: DataFrame, keys: Sequence[str], limit: int = GROUP_ROWS) -> Census:
    """Count rows per group and name the groups beyond ``limit`` rows.

    At most BROADCAST_ROWS names come to the driver; with more heavy groups than that all rows take the
    range-partitioned path, which is right for groups of any size.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    top = sizes.agg(
        F.count(F.lit(1)).alias("groups"), F.sum("_n").alias("rows"), F.count_if(F.col("_n") > limit).alias("heavy")
    ).first()
    heavy = []
    if top["heavy"] > BROADCAST_ROWS:
        heavy = EVERY
    elif top["heavy"]:
        heavy = [tuple(r) for r in sizes.where(F.col("_n") > limit).select(*keys).collect()]
    return Census(top["groups"], top["rows"] or 0, heavy)


def row_bytes(df: DataFrame) -> int | None:
    """Width of a row: 8 bytes a number, 64 a text; None if it holds arrays or maps, whose length nothing bounds."""
    def width(kind) -> int | None:
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return None
        if isinstance(kind, T.StructType):
            parts = [width(f.dataType) for f in kind.fields]
            return None if None in parts else sum(parts)
        return 64 if isinstance(kind, (T.StringType, T.BinaryType)) else 8

    return width(df.schema)


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], cen: Census, how: str = "inner") -> DataFrame:
    """Join a one-row-per-group table: broadcast if census and row width prove it small, else AQE's skew join."""
    width = row_bytes(stats)
    if width is not None and cen.n_groups <= min(BROADCAST_ROWS, BROADCAST_BYTES // width):
        stats = F.broadcast(stats)
    return df.join(stats, list(keys), how)


def task_count(spark, n_rows: int, per_task: int = 1_000_000) -> int:
    """Tasks for a step whose cost per row is high: at least two per core, more for more rows."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-n_rows // per_task))


def split_heavy(df: DataFrame, keys: Sequence[str], cen: Census) -> tuple[DataFrame, DataFrame]:
    """(light rows, heavy rows)."""
    if cen.heavy is EVERY:
        return df.where(F.lit(False)), df
    schema = df.select(*keys).schema
    names = F.broadcast(df.sparkSession.createDataFrame(cen.heavy, schema))
    return df.join(names, list(keys), "left_anti"), df.join(names, list(keys), "left_semi")


def range_frozen(df: DataFrame, order: Sequence[str], n_rows: int, limit: int) -> DataFrame:
    """Totally ordered partitions with their number in ``_pid``, fixed by materialising it."""
    parts = max(2, -(-n_rows // limit) * 2)
    return materialize(df.repartitionByRange(parts, *order).withColumn("_pid", F.spark_partition_id()))


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: dict[str, tuple[Column | str, float | Sequence[float]]],
    cen: Census | None = None,
    limit: int = GROUP_ROWS,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Exact, linearly interpolated quantiles: one row per group, one column per entry of ``wanted``.

    A single probability gives a double, a list gives an array. NULLs are skipped; a group with no
    value gives NULL. ``extra`` holds further (combining) aggregates to take in the same pass.
    """
    keys = list(keys)
    cols = {n: (F.col(c) if isinstance(c, str) else c, p) for n, (c, p) in wanted.items()}
    cen = census(df, keys, limit) if cen is None else cen

    def light(part: DataFrame) -> DataFrame:
        return part.groupBy(*keys).agg(*[
            F.percentile(c, [float(x) for x in p] if isinstance(p, (list, tuple)) else float(p)).alias(n)
            for n, (c, p) in cols.items()
        ], *extra)

    if not cen.heavy:
        return light(df)
    small, big = split_heavy(df, keys, cen)
    hot = _heavy_quantiles(big, keys, cols, cen, limit)
    if extra:
        hot = hot.join(big.groupBy(*keys).agg(*extra), keys)
    return light(small).unionByName(hot)


def _heavy_quantiles(df, keys, cols, cen, limit) -> DataFrame:
    spark = df.sparkSession
    long = df.select(
        *keys,
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("stat"), c.cast("double").alias("value")) for n, (c, _) in cols.items()
        ])).alias("_e"),
    ).select(*keys, "_e.stat", "_e.value")
    groups = long.select(*keys, "stat").distinct()
    by = [*keys, "stat"]
    # copies of one value collapse before they travel
    counted = long.where(F.col("value").isNotNull()).groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))
    frozen = range_frozen(counted, [*by, "value"], cen.n_rows * len(cols), limit)
    chunks = frozen.groupBy(*by, "_pid").agg(F.sum("n").alias("c"))
    upto = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("below", F.coalesce(F.sum("c").over(upto), F.lit(0))).withColumn(
        "total", F.sum("c").over(Window.partitionBy(*by)))
    probs = spark.createDataFrame(
        [(n, i, float(p)) for n, (_, ps) in cols.items()
         for i, p in enumerate(ps if isinstance(ps, (list, tuple)) else [ps])],
        "stat string, idx int, p double")
    pos = F.col("p") * (F.col("total") - 1)
    ranks = (
        chunks.join(F.broadcast(probs), "stat")
        .select(*by, "_pid", "c", "below", "idx", pos.alias("pos"),
                F.explode(F.array(F.floor(pos), F.ceil(pos))).alias("rank"))
        .where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("c")))
        .distinct()
    )
    holders = ranks.select(*by, "_pid").distinct()
    run = Window.partitionBy(*by, "_pid").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = frozen.join(holders, [*by, "_pid"], "left_semi").withColumn("cum", F.sum("n").over(run))
    hit = placed.join(ranks, [*by, "_pid"]).where(
        (F.col("rank") < F.col("below") + F.col("cum"))
        & (F.col("rank") >= F.col("below") + F.col("cum") - F.col("n")))
    per = hit.groupBy(*by, "idx").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.first("pos").alias("pos"))
    per = per.withColumn("q", F.col("lo") + (F.col("pos") - F.floor("pos")) * (F.col("hi") - F.col("lo")))
    full = groups.select(*keys).distinct().join(per, keys, "left")
    out = []
    for n, (_, ps) in cols.items():
        def pick(i, n=n):
            return F.max(F.when((F.col("stat") == n) & (F.col("idx") == i), F.col("q")))
        if isinstance(ps, (list, tuple)):
            arr = F.array(*[pick(i) for i in range(len(ps))])
            out.append(F.when(pick(0).isNotNull(), arr).alias(n))
        else:
            out.append(pick(0).alias(n))
    return full.groupBy(*keys).agg(*out)


def grouped_row_number(
    df: DataFrame,
    keys: Sequence[str],
    order: dict[str, Column],
    cen: Census | None = None,
    name: str = "rn",
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """Exact 1-based rank inside each group. ``order`` maps helper names to ascending sort columns and
    must be a total order."""
    keys = list(keys)
    temp = {f"_o_{n}": c for n, c in order.items()}
    df = df.withColumns(temp)
    cen = census(df, keys, limit) if cen is None else cen
    win = Window.partitionBy(*keys).orderBy(*temp)
    if not cen.heavy:
        return df.withColumn(name, F.row_number().over(win)).drop(*temp)
    small, big = split_heavy(df, keys, cen)
    frozen = range_frozen(big, [*keys, *temp], cen.n_rows, limit)
    upto = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    below = frozen.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_c")).withColumn(
        "_below", F.coalesce(F.sum("_c").over(upto), F.lit(0))).drop("_c")
    local = Window.partitionBy(*keys, "_pid").orderBy(*temp)
    ranked = frozen.withColumn("_r", F.row_number().over(local)).join(below, [*keys, "_pid"])
    ranked = ranked.withColumn(name, (F.col("_r") + F.col("_below")).cast("int")).drop("_r", "_below", "_pid")
    return small.withColumn(name, F.row_number().over(win)).unionByName(ranked).drop(*temp)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the smallest in ``order``; combines before the shuffle, unlike a window."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest]).select(*df.columns)
