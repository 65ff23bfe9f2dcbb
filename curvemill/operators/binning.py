"""Time bins, phase bins, folds and display decimation. All are combining aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill import constants as K
from curvemill.functions import columns as C
from curvemill.operators.skew import Census, attach, census, grouped_quantiles

KEY = ["target"]


def time_bin(lc: DataFrame, minutes: float = K.SEARCH_BIN_MINUTES, cen: Census | None = None) -> DataFrame:
    """Mean time and flux per non-empty bin: ``(target, bin, t, flux, n)``.

    The result is bounded by span / bin width per target, whatever the number of samples.
    """
    cen = census(lc, KEY) if cen is None else cen
    start = lc.groupBy("target").agg(F.min("t").alias("_t0"))
    x = attach(lc, start, KEY, cen).withColumn("bin", ((F.col("t") - F.col("_t0")) / (minutes / 1440.0)).cast("bigint"))
    return x.groupBy("target", "bin").agg(
        F.avg("t").alias("t"), F.avg("flux").alias("flux"), F.count(F.lit(1)).alias("n"))


def time_bin_error(lc: DataFrame, binned: DataFrame, cen: Census | None = None) -> DataFrame:
    """One error per curve: median error / sqrt(max(median bin count, 1)); NULL without errors."""
    cen = census(lc, KEY) if cen is None else cen
    err = grouped_quantiles(lc, KEY, {"_e": ("flux_err", 0.5)}, cen)
    cnt = grouped_quantiles(binned, KEY, {"_c": (F.col("n").cast("double"), 0.5)}, cen)
    return attach(err, cnt, KEY, cen).select(
        "target", (F.col("_e") / F.sqrt(F.greatest(F.col("_c"), F.lit(1.0)))).alias("bin_err"))


def packed_curve(lc: DataFrame, minutes: float = K.SEARCH_BIN_MINUTES, cen: Census | None = None) -> DataFrame:
    """One row per target for the search: ``(target, tmin, span, c)`` with ``c`` the time-sorted array of
    ``(t, flux, w)`` bins, w = 1/err^2 or 1.

    The array is bounded by span / bin width. Two passes over the samples: per-target numbers, then bins.
    """
    cen = census(lc, KEY) if cen is None else cen
    span = [F.min("t").alias("tmin"), (F.max("t") - F.min("t")).alias("span")]
    stats = grouped_quantiles(lc, KEY, {"_e": ("flux_err", 0.5)}, cen, extra=span)
    x = attach(lc, stats, KEY, cen).withColumn("bin", ((F.col("t") - F.col("tmin")) / (minutes / 1440.0)).cast("bigint"))
    b = x.groupBy("target", "tmin", "span", "_e", "bin").agg(
        F.avg("t").alias("t"), F.avg("flux").alias("flux"), F.count(F.lit(1)).alias("n"))
    p = b.groupBy("target", "tmin", "span", "_e").agg(
        F.sort_array(F.collect_list(F.struct("t", "flux"))).alias("c"), F.percentile(F.col("n").cast("double"), 0.5).alias("_n"))
    err = F.col("_e") / F.sqrt(F.greatest(F.col("_n"), F.lit(1.0)))
    p = p.withColumn("_w", F.when(err > 0, F.lit(1.0) / (err * err)).otherwise(F.lit(1.0)))
    return p.select("target", "tmin", "span", F.transform(
        "c", lambda s: F.struct(s["t"].alias("t"), s["flux"].alias("flux"), F.col("_w").alias("w"))).alias("c"))


def fold(lc: DataFrame, det: DataFrame, cen: Census | None = None, harmonic: float = 1.0) -> DataFrame:
    """Add ``phase`` in [-0.5, 0.5) at ``harmonic`` x period."""
    cen = census(lc, KEY) if cen is None else cen
    return attach(lc, det, KEY, cen).withColumn("phase", C.phase("t", "t0", F.col("period") * harmonic))


def phase_bin(folded: DataFrame, n_bins: int, keep_empty: bool = True, x: str = "phase",
              keys: tuple[str, ...] = ("target",)) -> DataFrame:
    """Equal bins on [-0.5, 0.5): centre, mean, error on the mean (NULL for one sample), count."""
    keys = list(keys)
    got = (folded.withColumn("bin", F.floor((F.col(x) + 0.5) * n_bins).cast("int"))
           .where(F.col("bin").between(0, n_bins - 1)).groupBy(*keys, "bin")
           .agg(F.avg("flux").alias("mean"), F.stddev_pop("flux").alias("_sd"), F.count("flux").alias("n")))
    if keep_empty:
        grid = folded.select(*keys).distinct().withColumn(
            "bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
        got = grid.join(got, [*keys, "bin"], "left")
    return got.select(
        *keys, "bin", ((F.col("bin") + 0.5) / n_bins - 0.5).alias("centre"), "mean",
        F.when(F.col("n") > 1, F.col("_sd") / F.sqrt("n")).alias("err"), F.coalesce("n", F.lit(0)).alias("n"))


def odd_even_curves(lc: DataFrame, det: DataFrame, n_bins: int = 40, min_samples: int = 6,
                    cen: Census | None = None) -> DataFrame:
    """Stacked events per parity, x in hours from mid-event; a parity needs ``min_samples`` samples."""
    cen = census(lc, KEY) if cen is None else cen
    x = (attach(lc, det, KEY, cen)
         .withColumn("parity", C.parity(C.epoch())).withColumn("_dt", C.from_mid_event())
         .where(F.abs("_dt") < F.col("duration") * 3.0)
         .withColumn("_x", F.col("_dt") / (F.col("duration") * 6.0)))
    kept = x.groupBy("target", "parity").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_samples)
    binned = phase_bin(x, n_bins, keep_empty=False, x="_x", keys=("target", "parity", "duration"))
    return (binned.join(kept.drop("_n"), ["target", "parity"], "left_semi")
            .select("target", "parity", "bin", (F.col("centre") * F.col("duration") * 6.0 * 24.0).alias("hours"), "mean"))


def decimate(df: DataFrame, n: int, x: str = "t", y: str = "flux", cen: Census | None = None) -> DataFrame:
    """At most ``n`` points per target: bin means over the x range, or the curve itself if small enough."""
    cen = census(df, KEY) if cen is None else cen
    good = df.where(C.is_finite(x) & C.is_finite(y))
    rng = good.groupBy("target").agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    z = attach(good, rng, KEY, cen)
    part = F.coalesce(F.try_divide(F.col(x) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    slot = F.least(F.floor(part * n), F.lit(n - 1))
    binned = (z.where(F.col("_n") > n).withColumn("slot", slot.cast("bigint")).groupBy("target", "slot")
              .agg(F.avg(x).alias("x"), F.avg(y).alias("y")).select("target", "x", "y"))
    return z.where(F.col("_n") <= n).select("target", F.col(x).alias("x"), F.col(y).alias("y")).unionByName(binned)


def curve_summary(lc: DataFrame) -> DataFrame:
    return lc.groupBy("target").agg(
        F.count(F.lit(1)).alias("n_points"), (F.max("t") - F.min("t")).alias("baseline_days"))


def trend_amplitude(lc: DataFrame, value: str = "flux", cen: Census | None = None) -> DataFrame:
    """2nd to 98th percentile spread over the absolute median (over 1 when the median is 0)."""
    q = grouped_quantiles(lc, KEY, {"_q": (C.finite_or_null(value), [0.02, 0.5, 0.98])}, cen)
    lo, med, hi = (F.col("_q")[i] for i in range(3))
    return q.select("target", ((hi - lo) / F.when(med == 0, 1.0).otherwise(F.abs(med))).alias("amplitude"))
