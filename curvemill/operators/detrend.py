"""Sliding trends in a window centred in time.

Rows are dealt to time cells a few windows wide, with a half-window margin copied from the neighbours,
and shuffled by (target, cell), so a long or dense curve spreads over many tasks. Inside a task Spark's
sorted rows stream through NumPy in Arrow batches; what a task holds is a batch and a few windows, never a
whole cell or curve. Sliding medians of a few hundred samples per row are an order of magnitude slower as
array functions in the JVM, which is why this step leaves it. Windows of DENSE samples and more are taken
together (`windows`), at a cost that grows with the samples; smaller ones are rows of a matrix.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvemill import constants as K
from curvemill.functions import columns as C
from curvemill.operators import clean, windows
from curvemill.operators.cells import interpolate
from curvemill.operators.skew import Census, census, task_count

KEY = ["target"]
METHODS = ("biweight", "lowess", "median")
# values of one window matrix held at a time
BLOCK = 2_000_000
# samples from which on a window is dense
DENSE = 256


# -- estimates over a matrix of windows: one row per window, NaN where there is no sample ---------------------

def _row_median(sorted_rows, n):
    """Median of each row of a matrix sorted along its rows with the missing values last."""
    rows = np.arange(len(n))
    lo, hi = np.maximum((n - 1) // 2, 0), np.maximum(np.minimum(n // 2, sorted_rows.shape[1] - 1), 0)
    return np.where(n > 0, (sorted_rows[rows, lo] + sorted_rows[rows, hi]) / 2.0, np.nan)


def median_rows(x, d, half):
    return _row_median(np.sort(x, axis=1), np.isfinite(x).sum(axis=1))


def biweight_rows(x, d, half, c: float = 5.0):
    """One Tukey step from the median with the window's own median absolute deviation."""
    n = np.isfinite(x).sum(axis=1)
    m = _row_median(np.sort(x, axis=1), n)
    dev = x - m[:, None]
    s = c * _row_median(np.sort(np.abs(dev), axis=1), n)
    with np.errstate(invalid="ignore", divide="ignore"):
        u = dev / s[:, None]
        w = np.where(np.abs(u) < 1.0, (1.0 - u * u) ** 2, 0.0)
        step = np.nansum(w * np.nan_to_num(dev), axis=1) / w.sum(axis=1)
    return np.where(s > 0, m + step, m)


def lowess_rows(x, d, half):
    """Tricube-weighted straight line, read off at the window centre."""
    ok = np.isfinite(x)
    u = np.where(ok, np.abs(d) / half, 1.0)
    w = np.clip(1.0 - u ** 3, 0.0, None) ** 3
    y, d = np.where(ok, x, 0.0), np.where(ok, d, 0.0)
    s0, s1, s2 = w.sum(axis=1), (w * d).sum(axis=1), (w * d * d).sum(axis=1)
    y0, y1 = (w * y).sum(axis=1), (w * d * y).sum(axis=1)
    det = s0 * s2 - s1 * s1
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(det > 1e-12, (s2 * y0 - s1 * y1) / det, y0 / s0)


ESTIMATES = {"median": median_rows, "biweight": biweight_rows, "lowess": lowess_rows}


DENSE_ESTIMATES = {median_rows: windows.median_dense, biweight_rows: windows.biweight_dense, lowess_rows: windows.lowess_dense}


def trend_of(t, x, first, last, half, estimate, wanted=None):
    """Trend at the ``wanted`` positions of ``first..last`` of one time-sorted run of samples; NaN at the others."""
    out = np.full(last - first, np.nan)
    todo = np.arange(last - first) if wanted is None else np.flatnonzero(wanted)
    if not len(todo):
        return out
    # equal times have equal windows
    at, back = np.unique(t[first:last][todo], return_inverse=True)
    ok = np.isfinite(x)
    t, x = t[ok], x[ok]
    lo, hi = np.searchsorted(t, at - half, "left"), np.searchsorted(t, at + half, "right")
    got = np.full(len(at), np.nan)
    dense = np.flatnonzero(hi - lo >= DENSE) if estimate in DENSE_ESTIMATES else []
    if len(dense):
        got[dense] = DENSE_ESTIMATES[estimate](t, x, at[dense], lo[dense], hi[dense], half)
    # also what the sums of dense windows leave open
    rest = np.flatnonzero(np.isnan(got) & (hi > lo))
    i = 0
    while i < len(rest):
        # as many windows as fit into one block
        width = int((hi[rest[i:]] - lo[rest[i:]]).max())
        some = rest[i:i + max(1, BLOCK // width)]
        a, b = lo[some], hi[some]
        pos = a[:, None] + np.arange(int((b - a).max()))
        inside = pos < b[:, None]
        pos = np.minimum(pos, len(t) - 1)
        got[some] = estimate(np.where(inside, x[pos], np.nan), t[pos] - at[some, None], half)
        i += len(some)
    out[todo] = got[back]
    return out


def enlarged(batches, least):
    """Batches put together until they have ``least()`` rows, so that what is held from one to the next is not gone through too often."""
    parts, n = [], 0
    for pdf in batches:
        parts.append(pdf)
        n += len(pdf)
        if n >= least():
            yield pd.concat(parts, ignore_index=True) if len(parts) > 1 else pdf
            parts, n = [], 0
    if parts:
        yield pd.concat(parts, ignore_index=True)


def stream_trend(batches, half, estimate):
    """Add ``_trend`` to batches sorted by (target, _cell, t). A row waits until its window is complete; rows
    are let go once no waiting window reaches back to them. Rows copied from the neighbour (``_own`` is another cell)
    get none."""
    held, waiting = None, 0

    def runs(pdf):
        a, b = pdf["target"].to_numpy(), pdf["_cell"].to_numpy()
        cut = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
        return np.concatenate(([0], cut, [len(pdf)]))

    def done(pdf, upto, start):
        """Rows ``start..upto`` with their trend, runs taken one at a time."""
        edges = runs(pdf)
        t, x, out = pdf["t"].to_numpy(), pdf["_x"].to_numpy(dtype=float), np.full(len(pdf), np.nan)
        own = (pdf["_own"] == pdf["_cell"]).to_numpy() if "_own" in pdf else np.ones(len(pdf), bool)
        for s, e in zip(edges[:-1], edges[1:]):
            f, z = max(s, start), min(e, upto)
            if f < z:
                out[f:z] = trend_of(t[s:e], x[s:e], f - s, z - s, half, estimate, own[f:z])
        return pdf.iloc[start:upto].assign(_trend=out[start:upto])

    for pdf in enlarged(batches, lambda: 0 if held is None else len(held)):
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        s = runs(held)[-2]
        t = held["t"].to_numpy()
        ready = s + int(np.searchsorted(t[s:], t[-1] - half, "left"))
        ready = max(ready, waiting)
        if ready > waiting:
            yield done(held, ready, waiting)
        keep = s + int(np.searchsorted(t[s:], (t[ready] if ready < len(t) else t[-1]) - half, "left"))
        keep = min(keep, ready)
        held, waiting = held.iloc[keep:].reset_index(drop=True), ready - keep
    if held is not None and len(held) > waiting:
        yield done(held, len(held), waiting)


def _sliding(lc: DataFrame, method: str, window_days: float, cell_windows: float, cen: Census) -> DataFrame:
    """Add ``_trend``, the estimate over ``_x`` in the window around every sample."""
    half, width, estimate = window_days / 2.0, window_days * cell_windows, ESTIMATES[method]
    margin = half * (1.0 + 1e-9)
    dealt = lc.withColumn("_own", F.floor(F.col("t") / width)).withColumn("_cell", F.explode(F.sequence(
        F.floor((F.col("t") - margin) / width), F.floor((F.col("t") + margin) / width))))
    dealt = dealt.repartition(task_count(lc.sparkSession, cen.n_rows), "target", "_cell").sortWithinPartitions("target", "_cell", "t")

    def run(batches):
        for pdf in stream_trend(batches, half, estimate):
            yield pdf[pdf["_own"] == pdf["_cell"]]

    schema = T.StructType([*dealt.schema.fields, T.StructField("_trend", T.DoubleType())])
    return dealt.mapInPandas(run, schema).drop("_own", "_cell")


def detrend(lc: DataFrame, method: str = "biweight", window_days: float = K.DETREND_WINDOW_DAYS,
            mask: Column | None = None, cen: Census | None = None, bridge: bool = True) -> DataFrame:
    """Divide the flux by its sliding trend; adds ``trend``.

    Masked samples do not shape the trend: it is NULL there, bridged in time, and the original flux
    divided by the bridge. The error is left alone. Without a mask and with finite flux nothing can be
    missing, and ``bridge=False`` saves the pass.
    """
    cen = census(lc, KEY) if cen is None else cen
    x = C.finite_or_null("flux")
    work = lc.withColumn("_x", F.when(~F.coalesce(mask, F.lit(False)), x) if mask is not None else x)
    # narrower cells cut a dense curve into more tasks, at the price of a larger copied margin
    out = _sliding(work, method, window_days, 1.0 if cen.heavy else 4.0, cen)
    out = out.withColumn("trend", F.when(F.col("_x").isNotNull(), F.col("_trend"))).drop("_trend", "_x")
    if bridge:
        out = interpolate(out, "trend", cen)
    return out.withColumn("flux", F.try_divide(F.col("flux"), F.col("trend")))


def prepare(lc: DataFrame, method: str = "biweight", window_days: float = K.DETREND_WINDOW_DAYS,
            cen: Census | None = None) -> DataFrame:
    """Finite -> normalise -> clip -> detrend; keeps finite results. Adds ``trend``."""
    cen = census(lc, KEY) if cen is None else cen
    x = clean.normalize_and_clip(clean.finite_filter(lc), cen=cen)
    return detrend(x, method, window_days, cen=cen, bridge=False).where(C.is_finite("flux"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
