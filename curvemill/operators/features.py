"""Vetting diagnostics per target and the 23-column feature vector.

Every diagnostic is a conditional aggregate over samples that know their target's ephemeris. Counts,
means, spreads and third moments for all of them come from one combining pass; all medians from one
order-statistics pass. "Unmeasurable" stays NULL where it must not be read as zero.
"""

from __future__ import annotations

import math
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvemill import constants as K
from curvemill.functions import columns as C
from curvemill.operators.binning import trend_amplitude
from curvemill.operators.kernels import array_sums
from curvemill.operators.nufft import Grid
from curvemill.operators.skew import Census, attach, census, grouped_quantiles
from curvemill.session import materialize

KEY = ["target"]
DEPTH_FLOOR = 1e-7


def with_phase(lc: DataFrame, det: DataFrame, cen: Census) -> DataFrame:
    """Samples with epoch and time from mid-event at P (``e1``, ``d1``) and at 2P (``e2``, ``d2``)."""
    x = attach(lc, det, KEY, cen).where(C.is_finite("t") & C.is_finite("flux"))
    p2 = F.col("period") * 2.0
    return x.withColumns({
        "e1": C.epoch().cast("bigint"), "d1": C.from_mid_event(),
        "e2": C.epoch("t", "t0", p2).cast("bigint"), "d2": C.from_mid_event("t", "t0", p2),
        "h1": C.phase_time(), "h2": C.phase_time("t", "t0", p2)})


class Regions:
    """The sample selections of every test, for one folding (P or 2P)."""

    def __init__(self, d: str, h: str, period: Column):
        x, dur = F.abs(F.col(d)), F.col("duration")
        ph, dp = F.abs(F.col(h) / period), dur / period
        self.inside = x < dur / 2.0
        self.near = (x > dur) & (x < dur * 2.5)
        self.near3 = (x > dur) & (x < dur * 3.0)
        self.far15 = x > dur * 1.5
        self.far25 = x > dur * 2.5
        self.second = F.abs(ph - 0.5) < dp / 2.0
        self.first = ph < dp / 2.0
        self.quiet = (ph > dp * 2.0) & (F.abs(ph - 0.5) > dp * 2.0)


def regions() -> tuple[Regions, Regions]:
    p = F.col("period")
    return Regions("d1", "h1", p), Regions("d2", "h2", p * 2.0)


def _part(name: str, sel: Column, spread: bool = False) -> list[Column]:
    v = F.when(sel, F.col("flux"))
    out = [F.count(v).alias(f"n_{name}"), F.avg(v).alias(f"m_{name}")]
    return out + ([F.stddev_pop(v).alias(f"s_{name}")] if spread else [])


def sample_stats(x: DataFrame, cen: Census) -> DataFrame:
    """One row per target with every count, mean, spread and median the tests use."""
    r1, r2 = regions()
    even1, odd1 = (C.parity(F.col("e1")) == v for v in (0, 1))
    even2, odd2 = (C.parity(F.col("e2")) == v for v in (0, 1))
    sums = [
        *_part("near1", r1.near), *_part("near2", r2.near), *_part("near31", r1.near3),
        *_part("even1", r1.inside & even1, True), *_part("odd1", r1.inside & odd1, True),
        *_part("even2", r2.inside & even2, True), *_part("odd2", r2.inside & odd2, True),
        *_part("sec1", r1.second), *_part("quiet1", r1.quiet, True),
        *_part("sec2", r2.second), *_part("quiet2", r2.quiet, True),
        *_part("first2", r2.first), *_part("first1", r1.first),
        *_part("far", r1.far25, True), F.skewness(F.when(r1.far25, F.col("flux"))).alias("skew_far"),
        (F.max("t") - F.min("t")).alias("span"),
    ]
    meds = {"b_near1": r1.near, "b_near2": r2.near, "b_near31": r1.near3, "b_quiet1": r1.quiet, "b_quiet2": r2.quiet}
    wanted = {n: (F.when(sel, F.col("flux")), 0.5) for n, sel in meds.items()}
    return grouped_quantiles(x, KEY, wanted, cen, extra=sums)


# -- the tests, as expressions over one row of sample_stats joined to its detection --------------------------

def odd_even(n: int) -> tuple[Column, Column]:
    """Significance and fraction of the depth difference of alternating events; 0, 0 when undersized."""
    d = {p: F.col(f"b_near{n}") - F.col(f"m_{p}{n}") for p in ("even", "odd")}
    e = {p: F.col(f"s_{p}{n}") / F.sqrt(F.when(F.col(f"n_{p}{n}") > 0, F.col(f"n_{p}{n}"))) for p in d}
    ok = (F.col(f"n_near{n}") >= 10) & (F.col(f"n_even{n}") >= 5) & (F.col(f"n_odd{n}") >= 5)
    diff, err = F.abs(d["even"] - d["odd"]), F.sqrt(e["even"] * e["even"] + e["odd"] * e["odd"])
    mean = F.abs((d["even"] + d["odd"]) * 0.5)
    zero = F.lit(0.0)
    sigma = F.when(ok, F.coalesce(F.try_divide(diff, F.when(err > 0, err)), zero)).otherwise(zero)
    frac = F.when(ok, F.coalesce(F.try_divide(diff, F.when(mean != 0, mean)), zero)).otherwise(zero)
    return C.clamp(sigma, 0, 200), C.clamp(frac, 0, 10)


def secondary(n: int, primary: Column) -> tuple[Column, Column]:
    """Significance and relative depth of a dip half a period away; NULL, NULL when unmeasurable."""
    ok = (F.col(f"n_sec{n}") >= 5) & (F.col(f"n_quiet{n}") >= 20)
    depth = F.when(ok, F.col(f"b_quiet{n}") - F.col(f"m_sec{n}"))
    err = F.col(f"s_quiet{n}") / F.sqrt(F.when(F.col(f"n_sec{n}") > 0, F.col(f"n_sec{n}")))
    zero = F.lit(0.0)
    sigma = F.when(ok, F.when(err > 0, depth / F.when(err > 0, err)).otherwise(zero))
    ratio = F.when(ok, F.when(primary > 0, depth / F.when(primary > 0, primary)).otherwise(zero))
    return C.clamp(sigma, -50, 200), C.clamp(ratio, -2, 5)


def fold_depth(n: int) -> Column:
    """Depth of the events at phase 0; the floor when undersized."""
    ok = (F.col(f"n_first{n}") >= 3) & (F.col(f"n_quiet{n}") >= 10)
    return F.when(ok, F.greatest(F.col(f"b_quiet{n}") - F.col(f"m_first{n}"), F.lit(DEPTH_FLOOR))).otherwise(F.lit(DEPTH_FLOOR))


def harmonic() -> tuple[Column, Column, Column]:
    """The tests at twice the period; all NULL when the span holds less than 1.5 of its cycles."""
    fits = F.col("span") >= F.col("period") * 2.0 * 1.5
    sig, ratio = secondary(2, fold_depth(2))
    return F.when(fits, sig), F.when(fits, ratio), F.when(fits, odd_even(2)[0])


def oot_skew() -> Column:
    ok = (F.col("n_far") > 30) & (F.col("s_far") > 0)
    return C.clamp(F.when(ok, F.col("skew_far")).otherwise(F.lit(0.0)), -10, 10)


def depth_consistency(x: DataFrame, base: DataFrame, cen: Census) -> DataFrame:
    """Spread of the per-event depths over their mean; ``base`` brings n_near31 and b_near31."""
    r1, _ = regions()
    per = x.where(r1.inside).groupBy("target", "e1").agg(F.avg("flux").alias("m"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= 3)
    g = per.groupBy("target").agg(F.count(F.lit(1)).alias("_k"), F.avg("m").alias("_m"), F.stddev_pop("m").alias("_s"))
    y = attach(base.select("target", "n_near31", "b_near31"), g, KEY, cen, "left")
    mean = F.abs(F.col("b_near31") - F.col("_m"))
    ok = (F.col("n_near31") >= 10) & (F.col("_k") >= 2) & (mean != 0)
    val = F.when(F.coalesce(ok, F.lit(False)), F.col("_s") / F.when(mean != 0, mean)).otherwise(F.lit(0.0))
    return y.select("target", C.clamp(val, 0, 10).alias("depth_consistency"))


def oot_variability(x: DataFrame, cen: Census, trend: str | None = None) -> DataFrame:
    """log10 of variability over depth. With a trend column: its 2..98 % spread; else the robust scatter of
    samples away from events. 0 when undersized."""
    depth = F.greatest(F.col("depth"), F.lit(DEPTH_FLOOR))
    if trend:
        v = C.finite_or_null(trend)
        amp = trend_amplitude(x.withColumn("_tr", v), "_tr", cen)
        n = x.groupBy("target", "depth", "period", "duration").agg(F.count(v).alias("_n"))
        y = attach(n, amp, KEY, cen, "left")
    else:
        r1, _ = regions()
        v = F.when(r1.far15, F.col("flux"))
        med = grouped_quantiles(x, KEY, {"_m": (v, 0.5)}, cen)
        dev = grouped_quantiles(attach(x, med, KEY, cen), KEY, {"_mad": (F.abs(v - F.col("_m")), 0.5)}, cen)
        n = x.groupBy("target", "depth", "period", "duration").agg(F.count(v).alias("_n"))
        y = attach(n, dev, KEY, cen, "left").withColumn("amplitude", F.col("_mad") * K.MAD_TO_SIGMA)
    ok = (F.col("_n") >= 50) & (F.col("amplitude") > 0) & (F.col("duration") > 0) & (F.col("period") > 0)
    ratio = F.when(F.coalesce(ok, F.lit(False)), F.col("amplitude") / depth)
    return y.select("target", F.coalesce(F.log10(C.clamp(ratio, 1e-4, 1e4)), F.lit(0.0)).alias("log_oot_var_to_depth"))


def ls_grid(spark, n_freq: int) -> DataFrame:
    step = (K.LS_FREQ_MAX - K.LS_FREQ_MIN) / (n_freq - 1)
    return spark.range(n_freq).select(F.col("id").cast("int").alias("k"), (F.col("id") * step + K.LS_FREQ_MIN).alias("f"))


class TrigSums:
    """Sums of cosines and sines of a curve's times, of their squares and products, and of their products with the centred flux."""

    def __init__(self, n_freq: int):
        step = (K.LS_FREQ_MAX - K.LS_FREQ_MIN) / (n_freq - 1)
        self.once, self.twice = Grid(K.LS_FREQ_MIN, step, n_freq), Grid(2 * K.LS_FREQ_MIN, 2 * step, n_freq)
        self.flux, self.n = Grid(K.LS_FREQ_MIN, step, n_freq), 0

    def add(self, block) -> None:
        t = block["t"].to_numpy()
        self.once.add(t), self.twice.add(t), self.flux.add(t, block["flux"].to_numpy() - block["_y"].to_numpy())
        self.n += len(t)

    def arrays(self):
        w, w2, y = self.once.sums(), self.twice.sums(), self.flux.sums()
        return w.real, w.imag, (self.n + w2.real) / 2, w2.imag / 2, y.real, y.imag


def lomb_scargle(lc: DataFrame, n_freq: int = K.LS_FREQ_COUNT, cen: Census | None = None) -> DataFrame:
    """Power on a linear frequency grid, floating mean, standard normalisation: ``(target, k, f, power)``.

    Six sums for each frequency come as arrays from non-uniform transforms (`nufft`): work follows samples plus frequencies, not their product.
    """
    cen = census(lc, KEY) if cen is None else cen
    mid = lc.groupBy("target").agg(F.avg("flux").alias("_y"), F.var_pop("flux").alias("yy"))
    step = (K.LS_FREQ_MAX - K.LS_FREQ_MIN) / (n_freq - 1)
    x = attach(lc.select("target", "t", "flux").where("t is not null and flux is not null"), mid, KEY, cen)
    names = ["mc", "ms", "cc", "cs", "yc", "ys"]
    g = array_sums(x, lambda: TrigSums(n_freq), names, cen, ["yy"])
    g = g.select("target", "n", "yy", F.posexplode(F.arrays_zip(*names)).alias("k", "_s")).select("target", "n", "yy", "k", "_s.*")
    g = g.withColumn("f", F.col("k") * step + K.LS_FREQ_MIN)
    g = g.withColumns({c: F.col(c) / F.col("n") for c in names})
    cc = F.col("cc") - F.col("mc") * F.col("mc")
    ss = (1.0 - F.col("cc")) - F.col("ms") * F.col("ms")
    cs = F.col("cs") - F.col("mc") * F.col("ms")
    det = cc * ss - cs * cs
    num = ss * F.col("yc") * F.col("yc") + cc * F.col("ys") * F.col("ys") - cs * F.col("yc") * F.col("ys") * 2.0
    power = num / F.when((F.col("yy") > 0) & (det > 1e-12), F.col("yy") * det)
    return g.select("target", "k", "f", power.alias("power"))


def ls_power_ratio(lc: DataFrame, det: DataFrame, n_freq: int = K.LS_FREQ_COUNT, cen: Census | None = None) -> DataFrame:
    """Power at 1/period, interpolated on the grid, over the mean power; 0 when it cannot be formed."""
    cen = census(lc, KEY) if cen is None else cen
    step = (K.LS_FREQ_MAX - K.LS_FREQ_MIN) / (n_freq - 1)
    x = attach(lomb_scargle(lc, n_freq, cen), det.select("target", "period"), KEY, cen)
    pos = C.clamp((F.lit(1.0) / F.col("period") - K.LS_FREQ_MIN) / step, 0, n_freq - 1)
    w = F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("k") - pos))
    g = x.groupBy("target").agg(F.sum(w * F.col("power")).alias("_at"), F.avg("power").alias("_m"))
    val = F.coalesce(F.when(F.col("_m") > 0, F.col("_at") / F.when(F.col("_m") > 0, F.col("_m"))), F.lit(0.0))
    return g.select("target", C.clamp(val, 0, 500).alias("ls_power_ratio"))


# -- assembly ------------------------------------------------------------------------------------------------

def feature_vector(lc: DataFrame, det: DataFrame, n_freq: int = K.LS_FREQ_COUNT, trend: str | None = None,
                   cen: Census | None = None) -> DataFrame:
    """The 23 columns per target in their fixed order.

    ``det`` brings period, t0, duration, depth, sde, snr and n_transits.
    """
    from curvemill.operators.fit import trapezoid_fit

    cen = census(lc, KEY) if cen is None else cen
    det = materialize(det.withColumn("depth", F.greatest(F.col("depth"), F.lit(DEPTH_FLOOR))))
    # written once: every part below reads the phased samples, none the source
    x = materialize(with_phase(lc, det.select("target", "period", "t0", "duration", "depth"), cen))
    own = x.select("target", "t", "flux")
    stats = materialize(sample_stats(x, cen))
    parts = [
        stats, depth_consistency(x, stats, cen), oot_variability(x, cen, trend),
        ls_power_ratio(own, det, n_freq, cen),
        trapezoid_fit(own, det, cen=cen).select("target", "trap_t23_t14", "trap_depth_ratio", "shape_resid_ratio"),
    ]
    y = det
    for p in parts:
        y = attach(y, p, KEY, cen, "left")
    oe = odd_even(1)
    sec = secondary(1, F.col("depth"))
    h = harmonic()
    rho = C.implied_density()
    cols = {
        "log_depth": F.log10("depth"),
        "log_duration_hr": C.clipped_log10(F.col("duration") * 24.0, 1e-3),
        "log_period": C.clipped_log10("period", 1e-3),
        "duration_phase_frac": F.try_divide(F.col("duration"), F.col("period")),
        "sde": F.col("sde"), "log_snr": C.clipped_log10("snr", 1e-3), "n_transits": F.col("n_transits").cast("double"),
        "odd_even_sigma": oe[0], "odd_even_frac": oe[1], "secondary_sigma": sec[0], "secondary_depth_ratio": sec[1],
        "sec_sigma_2p": h[0], "sec_ratio_2p": h[1], "sec_ratio_2p_dev": F.abs(h[1] - 1.0), "odd_even_sigma_2p": h[2],
        "trap_t23_t14": F.coalesce("trap_t23_t14", F.lit(0.5)), "trap_depth_ratio": F.coalesce("trap_depth_ratio", F.lit(1.0)),
        "shape_resid_ratio": F.coalesce("shape_resid_ratio", F.lit(1.0)),
        "log_rho_implied": F.coalesce(F.log10(C.clamp(rho, 1e-4, 1e6)), F.lit(0.0)),
        "depth_consistency": F.coalesce("depth_consistency", F.lit(0.0)), "ls_power_ratio": F.coalesce("ls_power_ratio", F.lit(0.0)),
        "oot_skew": F.coalesce(oot_skew(), F.lit(0.0)), "log_oot_var_to_depth": F.coalesce("log_oot_var_to_depth", F.lit(0.0)),
    }
    return y.select("target", *[cols[n].alias(n) for n in K.FEATURE_NAMES])


cloudpickle.register_pickle_by_value(sys.modules[__name__])
