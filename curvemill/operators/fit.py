"""Dip templates fitted by distributed grid search.

Samples meet a fixed-size parameter grid inside their own task, as arrays; the few sums per (target, grid point)
that determine the fit are all that is shuffled. Linear parameters (depth, base) are solved in closed
form from those sums, so only the shape parameters need a grid.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvemill import constants as K
from curvemill.functions import columns as C
from curvemill.operators import clean
from curvemill.operators.cells import cadence, time_rank
from curvemill.operators.kernels import grid_sums
from curvemill.operators.skew import Census, attach, census, grouped_quantiles
from curvemill.session import materialize

KEY = ["target"]
# trial T14 in units of the detected duration, and T23 in units of T14
T14_FACTORS = [0.2 + 0.2 * i for i in range(15)]
T23_RATIOS = [0.1 * i for i in range(11)]
SSE_STEP = 1e6


def _pick(values: list[float], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), index.cast("int") + 1)


def shape(dt: np.ndarray, h14: np.ndarray, h23: np.ndarray) -> np.ndarray:
    """``trapezoid_shape`` of samples (rows) for half-widths (columns)."""
    x = np.abs(dt)
    x = x[:, None] if x.ndim == 1 else x
    slope = np.where(h14 > h23, h14 - h23, 1.0)
    return np.where(x <= h23, 1.0, np.where((x < h14) & (h14 > h23), (h14 - x) / slope, 0.0))


def trapezoid_fit(lc: DataFrame, det: DataFrame, minimum: int = 20, cen: Census | None = None) -> DataFrame:
    """Best trapezoid near the events: shape ratio T23/T14, depth ratio and residual ratio.

    Depth stays in [0, 1] and the base within 0.1 of the local median. Targets with at most ``minimum``
    samples near events give no row.
    """
    cen = census(lc, KEY) if cen is None else cen
    x = attach(lc, det.select("target", "period", "t0", "duration", "depth"), KEY, cen).where(C.is_finite("t") & C.is_finite("flux"))
    x = x.withColumn("_dt", C.from_mid_event()).where(F.abs("_dt") < F.col("duration") * 2.5)
    outer = F.when(F.abs("_dt") > F.col("duration"), F.col("flux"))
    base = grouped_quantiles(x, KEY, {"_b0": (outer, 0.5)}, cen, extra=[F.count(F.lit(1)).alias("_near")])
    base = base.where(F.col("_near") > minimum).select("target", F.coalesce("_b0", F.lit(1.0)).alias("_b0"))
    y = attach(x, base, KEY, cen).select("target", "t", "flux", "_dt", (F.col("flux") - F.col("_b0")).alias("_g"), "depth", "duration", "_b0")
    m = len(T23_RATIOS)
    factors, ratios = np.repeat(T14_FACTORS, m), np.tile(T23_RATIOS, len(T14_FACTORS))

    def kernel(p):
        half = p["duration"].iloc[0] * factors / 2.0
        s, v = shape(p["_dt"].to_numpy(), half, half * ratios), p["_g"].to_numpy()
        one = np.ones(len(half))
        return s.sum(0), np.einsum("ij,ij->j", s, s), v.sum() * one, v @ s, (v * v).sum() * one

    g = grid_sums(y, kernel, len(factors), ["s", "ss", "g", "gs", "gg"], cen, ["depth", "duration", "_b0"])
    g = g.withColumnRenamed("k", "j").withColumn("n", F.col("n").cast("double"))
    n, s, ss, gv, gs, gg = (F.col(c) for c in ("n", "s", "ss", "g", "gs", "gg"))
    det2 = n * ss - s * s
    free = C.clamp(F.when(det2 > 1e-9, (s * gv - n * gs) / F.when(det2 > 1e-9, det2)).otherwise(F.lit(0.0)), 0, 1)
    g = g.withColumn("_f", free).withColumn("beta", C.clamp((gv + F.col("_f") * s) / n, -0.1, 0.1))
    again = C.clamp((F.col("beta") * s - gs) / F.when(ss > 0, ss), 0, 1)
    g = g.withColumn("d", F.coalesce(again, F.lit(0.0)))
    b, d = F.col("beta"), F.col("d")
    flat = gg - b * gv * 2.0 + n * b * b
    g = g.withColumn("flat", flat).withColumn("sse", F.col("flat") + d * gs * 2.0 - b * d * s * 2.0 + d * d * ss)
    best = g.groupBy("target", "depth", "duration", "_b0").agg(F.min_by(
        F.struct("j", "d", "beta", "sse", "flat"), F.struct(F.floor(F.col("sse") * SSE_STEP + 0.5), F.col("j"))).alias("_x"))
    jj = F.col("_x.j")
    ratio = F.when(F.col("_x.flat") > 0, F.col("_x.sse") / F.when(F.col("_x.flat") > 0, F.col("_x.flat"))).otherwise(F.lit(1.0))
    t14 = F.col("duration") * _pick(T14_FACTORS, F.floor(jj / m))
    return best.select(
        "target", t14.alias("t14"), (t14 * _pick(T23_RATIOS, jj % m)).alias("t23"), F.col("_x.d").alias("fit_depth"),
        (F.col("_b0") + F.col("_x.beta")).alias("base"), _pick(T23_RATIOS, jj % m).alias("trap_t23_t14"),
        C.clamp(F.col("_x.d") / F.when(F.col("depth") > 0, F.col("depth")), 0, 10).alias("trap_depth_ratio"),
        C.clamp(ratio, 0, 5).alias("shape_resid_ratio"))


# -- dip fit with uncertainties --------------------------------------------------------------------------

N_PARAMS = 5
MAX_DEPTH = 0.36
# chi-squares are compared in steps of this share of the target's plain sum: their own rounding grows with the samples
CHI2_STEPS = 1e10
# steps per axis: t0, period, T14, T23/T14
AXES = {"t": 9, "p": 9, "w": 5, "r": 3}


def _round(x: DataFrame, centre: DataFrame, cen: Census) -> DataFrame:
    """chi-square of every grid point around ``centre`` (centres ``c_*`` and half-widths ``h_*`` per axis)."""
    sizes = list(AXES.values())
    place = np.unravel_index(np.arange(int(np.prod(sizes))), sizes, order="F")  # the first axis runs fastest
    offset = {name: k / ((n - 1) / 2.0) - 1.0 for (name, n), k in zip(AXES.items(), place)}

    def kernel(p):
        one = p.iloc[0]
        v = {name: one[f"c_{name}"] + one[f"h_{name}"] * offset[name] for name in offset}
        t, w, drop = p["t"].to_numpy()[:, None], p["_w"].to_numpy(), 1.0 - p["flux"].to_numpy()
        dt = t - v["t"]
        dt -= np.rint(dt / v["p"]) * v["p"]
        half = v["w"] / 2.0  # no floor: a template without width holds no sample but one at its very middle
        s = shape(dt, half, half * np.clip(v["r"], 0, 1))
        return (w * drop) @ s, w @ (s * s), (w * drop * drop).sum() * np.ones(len(half))

    const = [f"{a}_{n}" for a in "ch" for n in AXES]
    g = grid_sums(attach(x, centre.select("target", *const), KEY, cen), kernel, len(place[0]), ["a", "b", "c"], cen, const).withColumnRenamed("k", "j")
    rest, vals = F.col("j"), {}
    for name, n in AXES.items():
        k = rest % n
        rest = F.floor(rest / n)
        vals[name] = F.col(f"c_{name}") + F.col(f"h_{name}") * (k / ((n - 1) / 2.0) - 1.0)
    vals["r"] = C.clamp(vals["r"], 0, 1)
    g = g.withColumns({f"v_{n}": v for n, v in vals.items()}).drop(*[f"c_{n}" for n in AXES])
    depth = C.clamp(F.coalesce(F.col("a") / F.when(F.col("b") > 0, F.col("b")), F.lit(0.0)), 0, MAX_DEPTH)
    g = g.withColumn("depth", depth)
    return g.withColumn("chi2", F.col("c") - F.col("depth") * F.col("a") * 2.0 + F.col("depth") * F.col("depth") * F.col("b"))


def _best(g: DataFrame) -> DataFrame:
    cols = ["j", "chi2", "depth", "n", *[f"v_{n}" for n in AXES], *[f"h_{n}" for n in AXES]]
    step = F.floor(F.coalesce(F.col("chi2") / F.when(F.col("c") > 0, F.col("c")), F.lit(0.0)) * CHI2_STEPS + 0.5)
    b = g.groupBy("target").agg(F.min_by(F.struct(*cols), F.struct(step, F.col("j"))).alias("_b"))
    return b.select("target", "_b.*")


def _posterior(grid: DataFrame, best: DataFrame, cen: Census) -> DataFrame:
    """Spread ``e_*`` of every axis and of the depth, weighted by exp(-dchi2 / 2); the depth adds its own variance."""
    ref = best.select("target", F.col("chi2").alias("_min"), *[F.col(f"v_{n}").alias(f"b_{n}") for n in AXES], F.col("depth").alias("b_d"))
    post = attach(grid, ref, KEY, cen).withColumn("_p", F.exp((F.col("_min") - F.col("chi2")) * 0.5))

    def spread(value: Column, centre: Column, own: Column = F.lit(0.0)) -> Column:
        dv = value - centre
        mean = F.sum(F.col("_p") * dv) / F.sum("_p")
        return F.sqrt(F.greatest(F.sum(F.col("_p") * (dv * dv + own)) / F.sum("_p") - mean * mean, F.lit(0.0)))

    own = F.coalesce(1.0 / F.when(F.col("b") > 0, F.col("b")), F.lit(0.0))
    return post.groupBy("target").agg(*[spread(F.col(f"v_{n}"), F.col(f"b_{n}")).alias(f"e_{n}") for n in AXES],
                                      spread(F.col("depth"), F.col("b_d"), own).alias("e_d"))


def dip_fit(lc: DataFrame, det: DataFrame, cen: Census | None = None) -> DataFrame:
    """Period, mid-time, depth and duration with errors, on samples near events.

    Three grids: t0 +- duration, period +- 2 %, T14 and T23; then one step around its best point; then
    three spreads and a step around the best of that, so a sharp minimum is resolved and a broad one is not
    cut short. Errors are the spreads over the last grid.
    """
    cen = census(lc, KEY) if cen is None else cen
    fallback = lc.groupBy("target").agg(F.stddev_pop("flux").alias("_sd"))
    x = clean.event_window(lc, det.select("target", "period", "t0", "duration"), cen=cen).select("target", "t", "flux", "flux_err")
    x = attach(x, fallback, KEY, cen)
    err = F.coalesce(F.when(F.col("flux_err") > 0, F.col("flux_err")), F.when(F.col("_sd") > 0, F.col("_sd")), F.lit(1.0))
    x = x.select("target", "t", "flux", (1.0 / (err * err)).alias("_w"))
    start = det.select(
        "target", F.col("t0").alias("c_t"), F.col("period").alias("c_p"), (F.col("duration") * 1.2).alias("c_w"), F.lit(0.5).alias("c_r"),
        F.col("duration").alias("h_t"), (F.col("period") * 0.02).alias("h_p"), (F.col("duration") * 0.8).alias("h_w"), F.lit(0.5).alias("h_r"))
    centre = [F.col(f"v_{n}").alias(f"c_{n}") for n in AXES]
    step = {n: F.col(f"h_{n}") / ((k - 1) / 2.0) for n, k in AXES.items()}
    # each round's best points are one row per target; cut there, the next round does not redo the last
    coarse = materialize(_best(_round(x, start, cen)))
    fine = materialize(_round(x, coarse.select("target", *centre, *[step[n].alias(f"h_{n}") for n in AXES]), cen))
    best = _best(fine)
    near = attach(best, _posterior(fine, best, cen), KEY, cen)
    last = materialize(_round(x, near.select("target", *centre, *[
        F.least(F.col(f"h_{n}"), F.col(f"e_{n}") * 3.0 + step[n]).alias(f"h_{n}") for n in AXES]), cen))
    best = _best(last)
    out = attach(best, _posterior(last, best, cen), KEY, cen)
    chi2_red = F.col("chi2") / F.greatest(F.col("n") - N_PARAMS, F.lit(1))
    return out.select(
        "target", F.col("v_p").alias("period"), F.col("e_p").alias("period_err"), F.col("v_t").alias("t0"), F.col("e_t").alias("t0_err"),
        "depth", F.col("e_d").alias("depth_err"), F.col("v_w").alias("duration"), F.col("e_w").alias("duration_err"),
        (F.col("v_w") * F.col("v_r")).alias("t23"), chi2_red.alias("chi2_red"), "n", C.is_finite(chi2_red).alias("converged"))


def residuals(lc: DataFrame, fit: DataFrame, cen: Census) -> DataFrame:
    """``(target, t, r)``: flux minus the fitted template with base 1."""
    f = fit.select("target", F.col("period").alias("_p"), F.col("t0").alias("_t"), F.col("depth").alias("_d"), F.col("duration").alias("_w"), F.col("t23").alias("_v"))
    x = attach(lc.select("target", "t", "flux"), f, KEY, cen)
    model = C.trapezoid(C.from_mid_event("t", "_t", "_p"), "_d", "_w", "_v", F.lit(1.0))
    return x.select("target", "t", (F.col("flux") - model).alias("r"), F.col("_w").alias("duration"))


def red_noise_beta(res: DataFrame, cen: Census | None = None, max_beta: float = 10.0) -> DataFrame:
    """How much more block means scatter than white noise would; blocks of a duration's samples.

    ``res`` is ``(target, t, r, duration)``. 1 for fewer than 20 residuals, fewer than 4 blocks or no cadence.
    """
    cen = census(res, KEY) if cen is None else cen
    x = res.where(C.is_finite("r"))
    size = x.groupBy("target", "duration").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("r").alias("sd"))
    p = attach(size, cadence(x, cen), KEY, cen, "left")
    ok = (F.col("n") >= 20) & (F.col("duration") > 0) & (F.col("cadence") > 0)
    per = F.greatest(F.lit(2.0), F.rint(F.col("duration") / F.when(F.col("cadence") > 0, F.col("cadence"))))
    p = p.withColumn("per", F.when(ok, per.cast("bigint"))).withColumn("blocks", F.floor(F.col("n") / F.col("per")))
    y = attach(time_rank(x, cen), p.where(F.col("blocks") >= 4).select("target", "per", "blocks"), KEY, cen)
    y = y.withColumn("blk", F.floor((F.col("rn") - 1) / F.col("per"))).where(F.col("blk") < F.col("blocks"))
    means = y.groupBy("target", "blk").agg(F.avg("r").alias("m")).groupBy("target").agg(F.stddev_pop("m").alias("obs"))
    z = attach(p, means, KEY, cen, "left")
    want = F.col("sd") / F.sqrt(F.col("per").cast("double"))
    beta = F.coalesce(F.col("obs") / F.when(want > 0, want), F.lit(1.0))
    return z.select("target", C.clamp(beta, 1.0, max_beta).alias("beta"))


def inflate(fit: DataFrame, beta: DataFrame, cen: Census) -> DataFrame:
    """Every error times beta; ``reliable`` = converged, finite and chi2_red below the threshold."""
    x = attach(fit, beta, KEY, cen, "left").withColumn("beta", F.coalesce("beta", F.lit(1.0)))
    names = [c for c in fit.columns if c.endswith("_err")]
    return x.withColumns({c: F.col(c) * F.col("beta") for c in names}).withColumn("reliable", C.fit_reliable())


def full_fit(lc: DataFrame, det: DataFrame, cen: Census | None = None) -> DataFrame:
    """Fit, red-noise factor on the samples near events, inflated errors, verdict."""
    cen = census(lc, KEY) if cen is None else cen
    fit = dip_fit(lc, det, cen)
    near = clean.event_window(lc, det.select("target", "period", "t0", "duration"), cen=cen).select("target", "t", "flux")
    return inflate(fit, red_noise_beta(residuals(near, fit, cen), cen), cen)


def observed_depth(fit: DataFrame, points: int = 401) -> DataFrame:
    """Largest decrement of the fitted template on a dense grid around mid-event."""
    x = fit.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    dt = F.col("duration") * (F.col("_k") / ((points - 1) / 2.0) - 1.0)
    model = C.trapezoid(dt, "depth", "duration", "t23", "base")
    return x.groupBy("target", "depth").agg(F.max(F.col("base") - model).alias("depth_observed"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
