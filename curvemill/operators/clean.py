"""Filters and normalisation of curves ``(target, t, flux, flux_err, quality)``.

Per-target numbers come from one aggregate and are joined back, never from a window over a whole
target, so a target with a third of all samples stays spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill import constants as K
from curvemill.functions import columns as C
from curvemill.operators.skew import Census, attach, census, grouped_quantiles
from curvemill.session import materialize

KEY = ["target"]


def quality_filter(lc: DataFrame, mask: int = K.QUALITY_MASK) -> DataFrame:
    """Samples finite in time, flux and error with none of the mask's bits set."""
    good = C.is_finite("t") & C.is_finite("flux") & C.is_finite("flux_err")
    return lc.where(good & (F.col("quality").bitwiseAND(F.lit(mask)) == 0))


def finite_filter(lc: DataFrame) -> DataFrame:
    return lc.where(C.is_finite("t") & C.is_finite("flux"))


def normalize(lc: DataFrame, cen: Census | None = None) -> DataFrame:
    """Divide flux and error by the target's median flux; an unusable median divides by 1."""
    cen = census(lc, KEY) if cen is None else cen
    med = grouped_quantiles(lc, KEY, {"_med": (C.finite_or_null("flux"), 0.5)}, cen)
    div = F.when(C.is_finite("_med") & (F.col("_med") != 0), F.col("_med")).otherwise(F.lit(1.0))
    out = attach(lc, med, KEY, cen).withColumn("flux", F.col("flux") / div)
    if "flux_err" in lc.columns:
        out = out.withColumn("flux_err", F.col("flux_err") / div)
    return out.drop("_med")


def robust_scatter(lc: DataFrame, value: str = "flux", cen: Census | None = None) -> DataFrame:
    """Per target: ``med`` and ``sigma`` = 1.4826 x median absolute deviation."""
    cen = census(lc, KEY) if cen is None else cen
    x = C.finite_or_null(value)
    med = grouped_quantiles(lc, KEY, {"med": (x, 0.5)}, cen)
    dev = grouped_quantiles(attach(lc, med, KEY, cen), KEY, {"_mad": (F.abs(x - F.col("med")), 0.5)}, cen)
    both = attach(med, dev, KEY, cen)
    return both.select("target", "med", (F.col("_mad") * K.MAD_TO_SIGMA).alias("sigma"))


def clip_outliers(lc: DataFrame, upper: float = K.CLIP_UPPER, lower: float | None = None,
                  cen: Census | None = None) -> DataFrame:
    """Drop samples above median + upper x sigma. Dips are kept unless ``lower`` is given."""
    cen = census(lc, KEY) if cen is None else cen
    stats = robust_scatter(lc, "flux", cen)
    keep = F.col("flux") < F.col("med") + F.col("sigma") * upper
    if lower is not None:
        keep = keep & (F.col("flux") > F.col("med") - F.col("sigma") * lower)
    flat = F.col("sigma").isNull() | (F.col("sigma") <= 0)
    return attach(lc, stats, KEY, cen).where(C.is_finite("flux") & (flat | keep)).drop("med", "sigma")


def normalize_and_clip(lc: DataFrame, upper: float = K.CLIP_UPPER, cen: Census | None = None) -> DataFrame:
    """``clip_outliers`` of ``normalize``, with the limits from the raw flux: dividing by the median divides median and deviation too.

    So the curve is read twice for its median and deviation and once for the rows, instead of once more for each of the two steps' own statistics.
    """
    cen = census(lc, KEY) if cen is None else cen
    stats = materialize(robust_scatter(lc, "flux", cen).withColumnsRenamed({"med": "_med", "sigma": "_sigma"}))
    div = F.when(C.is_finite("_med") & (F.col("_med") != 0), F.col("_med")).otherwise(F.lit(1.0))
    out = attach(lc, stats, KEY, cen).withColumn("_div", div).withColumn("flux", F.col("flux") / F.col("_div"))
    if "flux_err" in lc.columns:
        out = out.withColumn("flux_err", F.col("flux_err") / F.col("_div"))
    sigma = F.col("_sigma") / F.abs("_div")
    keep = F.col("flux") < F.col("_med") / F.col("_div") + sigma * upper
    return out.where(C.is_finite("flux") & (sigma.isNull() | (sigma <= 0) | keep)).drop("_med", "_sigma", "_div")


def trim_baseline(lc: DataFrame, max_days: float, cen: Census | None = None) -> DataFrame:
    """First ``max_days`` of every curve."""
    cen = census(lc, KEY) if cen is None else cen
    span = lc.groupBy("target").agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    keep = (F.col("_hi") - F.col("_lo") <= max_days) | (F.col("t") <= F.col("_lo") + max_days)
    return attach(lc, span, KEY, cen).where(keep).drop("_lo", "_hi")


def min_points(lc: DataFrame, n: int, cen: Census | None = None) -> DataFrame:
    """Curves with at least ``n`` samples."""
    cen = census(lc, KEY) if cen is None else cen
    big = lc.groupBy("target").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).select("target")
    return attach(lc, big, KEY, cen, "left_semi")


def event_window(lc: DataFrame, det: DataFrame, n_dur: float = 4.0, minimum: int = 30,
                 cen: Census | None = None) -> DataFrame:
    """Samples near an event; a curve with fewer than ``minimum`` of them is kept whole."""
    cen = census(lc, KEY) if cen is None else cen
    x = attach(lc, det, KEY, cen).withColumn(
        "_near", F.abs(C.phase_time()) < F.col("duration") * n_dur / 2.0)
    hits = x.groupBy("target").agg(F.count_if("_near").alias("_hits"))
    return attach(x, hits, KEY, cen).where(F.col("_near") | (F.col("_hits") < minimum)).drop("_near", "_hits")


def inf_to_null(df: DataFrame, names) -> DataFrame:
    return df.withColumns({c: F.when(F.abs(F.col(c)) == float("inf"), None).otherwise(F.col(c)) for c in names})


def usable_rows(df: DataFrame, labels=None) -> DataFrame:
    out = df.where(F.col("error").isNull())
    return out.where(F.col("label").isin(list(labels))) if labels is not None else out
