"""Box search for periodic dips over period x duration x phase.

Work on a curve is pre-aggregated to time bins first, so one target brings at most span / bin width
points to the search however many samples it has. Two forms of the same search:

``box_search``       relational, for bounded grids: phase-binned sums per (target, period), running box sums
                     as range frames over the occupied phase bins, best box by one ``max``.
``box_search_large`` full grids: the grid is cut into chunks, (target, chunk) is the unit of work, NumPy
                     inside the task (`boxscan`); chunk results are peaks and moments that merge exactly.

A phase bin is ``min(durations) / 10`` wide and phase 0 is the curve's first sample. A box of k bins is
periodic in phase and may start at any bin. Power is the log-likelihood gain r * depth^2 / 2 with
r = sum of weights in the box, depth = mean outside - mean inside, dips only. Powers are compared on a
1e-6 grid; ties go to the smaller period, duration and start.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvemill import constants as K
from curvemill.functions import columns as C
from curvemill.operators import binning
from curvemill.operators.boxscan import POWER_STEP, bin_width, box_sizes, scan_chunk, scan_frequencies
from curvemill.operators.skew import Census, attach, census

KEY = ["target"]
# points and phase bins that a work item goes through, at least (some seconds of a core) and at most; items of a job while a target can be cut that far;
# tasks
ITEM_WORK, MOST_WORK, ITEMS, MOST_TASKS = 100_000_000, 3_000_000_000, 2000, 20_000
# trial periods that a task holds at once
PIECE = 20_000


# -- trial grid ------------------------------------------------------------------------------------

def search_range(spans: DataFrame, min_period: float = K.MIN_PERIOD, max_period: float = K.MAX_PERIOD) -> DataFrame:
    """Add ``searchable`` (false if ``span`` is too short) and the frequency band ``fmin``, ``fmax``."""
    longest = F.least(F.lit(float(max_period)), F.col("span") / 2.0)
    ok = longest > min_period
    return spans.withColumns({"searchable": ok, "fmin": F.when(ok, F.lit(1.0) / F.when(ok, longest)),
                              "fmax": F.when(ok, F.lit(1.0 / min_period))})


def spans(lc: DataFrame) -> DataFrame:
    return lc.groupBy("target").agg(F.min("t").alias("tmin"), (F.max("t") - F.min("t")).alias("span"))


def short_curves(lc: DataFrame, min_period: float = K.MIN_PERIOD, max_period: float = K.MAX_PERIOD) -> DataFrame:
    """Targets that cannot be searched, with the reason."""
    r = search_range(spans(lc), min_period, max_period).where(~F.col("searchable"))
    return r.select("target", F.format_string("a span of %.2f d leaves no period to try", "span").alias("error"))


def with_grid(ranges: DataFrame, durations=K.DURATIONS, factor: float = 1.0 / K.OVERSAMPLE,
              n_periods: int | None = None) -> DataFrame:
    """Add the grid's size ``n`` and step ``df``, uniform in frequency from ``fmax`` down.

    ``n_periods`` fixes the size; otherwise the step follows the span and the shortest duration.
    """
    if n_periods is None:
        df = F.lit(factor * min(durations)) / (F.col("span") * F.col("span"))
        n = F.rint((F.col("fmax") - F.col("fmin")) / df).cast("bigint") + 1
    else:
        df = (F.col("fmax") - F.col("fmin")) / float(n_periods - 1)
        n = F.lit(n_periods).cast("bigint")
    return ranges.where("searchable").withColumn("df", df).withColumn("n", n)


def trial_period() -> Column:
    return F.lit(1.0) / (F.col("fmax") - F.col("i") * F.col("df"))


def period_grid(lc: DataFrame, min_period: float = K.MIN_PERIOD, max_period: float = K.MAX_PERIOD, **grid) -> DataFrame:
    """Trial periods per target: ``(target, i, period)``."""
    g = with_grid(search_range(spans(lc), min_period, max_period), **grid)
    g = g.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return g.select("target", "i", trial_period().alias("period"))


def work_items(lc: DataFrame, cen: Census, chunk: int | None, minutes: float, durations, factor: float,
               n_periods: int | None, min_period: float, max_period: float) -> DataFrame:
    """One row per (target, grid chunk starting at ``i0``), dealt over the cluster, each with its binned curve.

    A trial period costs its points and, for each duration, its mean number of phase bins. A target is cut into as many items as make ITEMS items of all targets, of
    ITEM_WORK at least and MOST_WORK at most. So with many targets a curve is shipped once, a long one becomes many items, and no item holds more than its curve.
    """
    def cut(ranges: DataFrame, points: Column) -> DataFrame:
        g = with_grid(search_range(ranges, min_period, max_period), durations, factor, n_periods)
        bins = F.log(F.col("fmax") / F.col("fmin")) / (F.col("fmax") - F.col("fmin")) / bin_width(durations)
        work = F.col("n") * (points + len(list(durations)) * bins)
        most = F.lit(-(-ITEMS // max(1, cen.n_groups)))
        wanted = F.greatest(F.ceil(work / MOST_WORK), F.least(F.ceil(work / ITEM_WORK), most), F.lit(1))
        return g.withColumn("work", work).withColumn("step", F.lit(chunk).cast("bigint") if chunk else F.ceil(F.col("n") / wanted).cast("bigint"))

    # items are few bytes and much work, so tasks are counted by work; points are those that the curve has at most, by its span and by its samples
    size = lc.groupBy("target").agg((F.max("t") - F.min("t")).alias("span"), F.count(F.lit(1)).alias("samples"))
    total = cut(size, F.least(F.col("span") * (1440.0 / minutes), F.col("samples"))).agg(F.sum("work"), F.sum(F.ceil(F.col("n") / F.col("step")))).first()
    tasks = max(1, min(2 * (total[1] or 0), MOST_TASKS, max(4 * lc.sparkSession.sparkContext.defaultParallelism, int((total[0] or 0) / ITEM_WORK))))
    g = cut(binning.packed_curve(lc, minutes, cen), F.size("c")).withColumn(
        "i0", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.col("step"))))
    return g.repartition(tasks, "target", "i0")


# -- relational search -------------------------------------------------------------------------------

def periodogram(lc: DataFrame, n_periods: int | None = None, chunk: int | None = None, minutes: float = K.SEARCH_BIN_MINUTES,
                durations=K.DURATIONS, min_period: float = K.MIN_PERIOD, max_period: float = K.MAX_PERIOD,
                cen: Census | None = None, factor: float = 1.0 / K.OVERSAMPLE) -> DataFrame:
    """Best box per trial period: ``(target, i, period, power, depth, duration, t0)``.

    Everything after ``work_items`` keeps its (target, chunk) partitioning, so phase bins, box sums and
    the best box need no further shuffle. Box sums are differences of running sums over growing frames,
    linear in the number of bins. A box's content only changes where a bin leaves or enters, so boxes
    that start just after an occupied bin or end on one are all there is to try.
    """
    cen = census(lc, KEY) if cen is None else cen
    width = bin_width(durations)
    sizes = [max(int(round(d / width)), 1) for d in durations]
    kmax = max(sizes)
    part = ["target", "i0", "i"]
    items = work_items(lc, cen, chunk, minutes, durations, factor, n_periods, min_period, max_period)
    last = F.least(F.col("n"), F.col("i0") + F.col("step")) - 1
    x = items.withColumn("all_w", F.aggregate("c", F.lit(0.0), lambda a, s: a + s["w"])).withColumn(
        "all_wy", F.aggregate("c", F.lit(0.0), lambda a, s: a + s["w"] * s["flux"]))
    x = x.withColumn("i", F.explode(F.sequence("i0", last))).withColumn("period", trial_period())
    x = x.withColumn("nb", F.ceil(F.col("period") / width).cast("int"))
    # an empty last bin opens the box that starts at phase 0
    point = F.transform("c", lambda s: F.struct(
        F.floor(((s["t"] - F.col("tmin")) % F.col("period")) / width).cast("int").alias("b"),
        s["w"].alias("w"), (s["w"] * s["flux"]).alias("wy"), F.lit(1).alias("n")))
    opener = F.array(F.struct((F.col("nb") - 1).alias("b"), F.lit(0.0).alias("w"), F.lit(0.0).alias("wy"), F.lit(0).alias("n")))
    const = ["period", "tmin", "nb", "all_w", "all_wy"]
    x = x.select(*part, *const, F.explode(F.concat(point, opener)).alias("p"))
    s = x.groupBy(*part, *const, F.col("p.b").alias("b")).agg(
        F.sum("p.w").alias("w"), F.sum("p.wy").alias("wy"), F.sum("p.n").alias("n"))
    # the first bins appear again past the end, which closes the circle
    s = s.withColumn("b", F.explode(F.when(F.col("b") < kmax, F.array("b", F.col("b") + F.col("nb"))).otherwise(F.array("b"))))
    exprs = [*part, *const, "b"]
    for tag, upto in [("h", "CURRENT ROW")] + [(f"{t}{j}", f"{k} {side}") for j, k in enumerate(sizes)
                                                for t, side in (("a", "FOLLOWING"), ("z", "PRECEDING"))]:
        over = f"OVER (PARTITION BY target, i0, i ORDER BY b RANGE BETWEEN UNBOUNDED PRECEDING AND {upto})"
        exprs += [f"coalesce(sum({c}) {over}, 0) AS {c}_{tag}" for c in ("w", "wy", "n")]
    boxes = s.selectExpr(*exprs)
    best = []
    for j, k in enumerate(sizes):
        for tag, start in (("a", F.col("b") + 1), ("z", F.col("b") - k + 1)):
            hi, lo = (f"{tag}{j}", "h") if tag == "a" else ("h", f"{tag}{j}")
            r, y, n = (F.col(f"{c}_{hi}") - F.col(f"{c}_{lo}") for c in ("w", "wy", "n"))
            inside = F.col("b") < F.col("nb") if tag == "a" else (start >= 0) & (start < F.col("nb"))
            start = start % F.col("nb") if tag == "a" else start
            ok = inside & (n > 0) & (F.col("all_w") - r > F.col("all_w") * 1e-12)
            depth = F.when(ok, (F.col("all_wy") - y) / (F.col("all_w") - r) - y / r)
            power = r * depth * depth * 0.5
            best.append(F.when(depth > 0, F.struct(
                F.floor(power * POWER_STEP + 0.5).alias("q"), F.lit(-j).alias("d"), (-start).alias("s"),
                power.alias("power"), depth.alias("depth"))))
    g = boxes.groupBy(*part, "period", "tmin").agg(F.max(F.greatest(*best)).alias("_b"))
    k = F.element_at(F.array(*[F.lit(v) for v in sizes]), F.lit(1) - F.col("_b.d"))
    dur = F.element_at(F.array(*[F.lit(float(v)) for v in durations]), F.lit(1) - F.col("_b.d"))
    mid = ((-F.col("_b.s")) + k * 0.5) * width
    return g.select("target", "i", "period", F.col("_b.power").alias("power"), F.col("_b.depth").alias("depth"),
                    dur.alias("duration"), (F.col("tmin") + mid % F.col("period")).alias("t0"))


def sde(power_max: Column, mean: Column, sd: Column, n: Column) -> Column:
    """Peak height above the mean in standard deviations; 0 for fewer than ten powers or no spread."""
    return F.when((n >= 10) & (sd > 0), (power_max - mean) / F.when(sd > 0, sd)).otherwise(F.lit(0.0))


def peaks(pg: DataFrame) -> DataFrame:
    """Strongest period per target with its significance: one combining aggregate over the periodogram."""
    key = F.struct(F.floor(F.col("power") * POWER_STEP + 0.5), -F.col("i"))
    g = pg.where(F.col("power").isNotNull()).groupBy("target").agg(
        F.max_by(F.struct("period", "t0", "duration", "depth", "power"), key).alias("_b"),
        F.avg("power").alias("_m"), F.stddev_pop("power").alias("_sd"), F.count("power").alias("n_periods"))
    out = g.select("target", "_b.*", sde(F.col("_b.power"), F.col("_m"), F.col("_sd"), F.col("n_periods")).alias("sde"), "n_periods")
    return out.withColumn("detected", F.col("sde") >= K.SDE_THRESHOLD)


def box_search(lc: DataFrame, n_periods: int | None = None, **options) -> DataFrame:
    """Detection per target, on the default grid or one of ``n_periods`` trial periods."""
    return box_search_large(lc, n_periods=n_periods, **options)


# -- full grids --------------------------------------------------------------------------------------

def box_search_large(lc: DataFrame, chunk: int | None = None, n_periods: int | None = None,
                     minutes: float = K.SEARCH_BIN_MINUTES, durations=K.DURATIONS, factor: float = 1.0 / K.OVERSAMPLE,
                     min_period: float = K.MIN_PERIOD, max_period: float = K.MAX_PERIOD,
                     cen: Census | None = None) -> DataFrame:
    """Same result as ``box_search`` on grids of any size.

    One work item is (target, chunk of the grid), so a single long curve spreads over the cluster.
    """
    cen = census(lc, KEY) if cen is None else cen
    durs, width, sizes = list(durations), bin_width(durations), box_sizes(durations)

    def peak(it) -> tuple | None:
        """Best period and moments of one item, a piece of its grid at a time."""
        t, y, w = np.asarray(it.t) - it.tmin, np.asarray(it.y), np.asarray(it.w)
        top, at, n, mean, m2 = -1.0, None, 0, 0.0, 0.0
        for a in range(it.i0, min(it.i0 + it.step, it.n), PIECE):
            i = np.arange(a, min(a + PIECE, it.i0 + it.step, it.n))
            power = scan_frequencies(t, y, w, it.fmax - i * it.df, durs, detail=False)[:, 0]
            ok = np.isfinite(power)
            if not ok.any():
                continue
            q = np.floor(np.where(ok, power, -1.0) * POWER_STEP + 0.5)
            if q.max() > top:
                top, at = q.max(), int(i[q.argmax()])
            k, own = int(ok.sum()), float(power[ok].mean())
            m2 += float(((power[ok] - own) ** 2).sum()) + (own - mean) ** 2 * n * k / (n + k)
            mean += (own - mean) * k / (n + k)
            n += k
        if at is None:
            return None
        period = 1.0 / (it.fmax - at * it.df)
        power, j, start, depth = scan_chunk(t, y, w, [period], durs)[0]
        if not np.isfinite(power):  # a dip within rounding
            return None
        return (it.target, at, period, it.tmin + ((start + sizes[int(j)] * 0.5) * width) % period, durs[int(j)], float(depth), float(power), n, mean, m2)

    def run(batches):
        for pdf in batches:
            rows = [r for r in map(peak, pdf.itertuples(index=False)) if r is not None]
            yield pd.DataFrame(rows, columns=["target", "i", "period", "t0", "duration", "depth", "power", "n", "mean", "m2"])

    items = _items(lc, cen, chunk, minutes, durations, factor, n_periods, min_period, max_period)
    part = items.mapInPandas(run, "target string, i long, period double, t0 double, duration double, depth double, "
                                  "power double, n long, mean double, m2 double")
    return merge_chunks(part)


def _items(lc, cen, *options) -> DataFrame:
    """`work_items` with the curve as arrays."""
    return work_items(lc, cen, *options).select(
        "target", "tmin", "fmax", "df", "n", "i0", "step", F.col("c.t").alias("t"), F.col("c.flux").alias("y"), F.col("c.w").alias("w"))


def periodogram_large(lc: DataFrame, chunk: int | None = None, n_periods: int | None = None, minutes: float = K.SEARCH_BIN_MINUTES,
                      durations=K.DURATIONS, factor: float = 1.0 / K.OVERSAMPLE, min_period: float = K.MIN_PERIOD,
                      max_period: float = K.MAX_PERIOD, cen: Census | None = None) -> DataFrame:
    """The rows of ``periodogram`` on grids of any size, by the kernels of ``box_search_large``; what a task holds is PIECE rows."""
    cen = census(lc, KEY) if cen is None else cen
    durs, width, sizes = np.array(list(durations)), bin_width(durations), np.array(box_sizes(durations))

    def run(batches):
        for pdf in batches:
            for it in pdf.itertuples(index=False):
                t, y, w = np.asarray(it.t) - it.tmin, np.asarray(it.y), np.asarray(it.w)
                for a in range(it.i0, min(it.i0 + it.step, it.n), PIECE):
                    i = np.arange(a, min(a + PIECE, it.i0 + it.step, it.n))
                    f = it.fmax - i * it.df
                    best = scan_frequencies(t, y, w, f, durs)
                    ok = np.isfinite(best[:, 0])
                    best, i, period = best[ok], i[ok], 1.0 / f[ok]
                    j = best[:, 1].astype(int)
                    yield pd.DataFrame({"target": it.target, "i": i, "period": period, "power": best[:, 0], "depth": best[:, 3], "duration": durs[j],
                                        "t0": it.tmin + ((best[:, 2] + sizes[j] * 0.5) * width) % period})

    items = _items(lc, cen, chunk, minutes, durations, factor, n_periods, min_period, max_period)
    return items.mapInPandas(run, "target string, i long, period double, power double, depth double, duration double, t0 double")


def merge_chunks(part: DataFrame) -> DataFrame:
    """Merge chunk peaks and moments; spread about the common mean, not differences of raw squares."""
    key = F.struct(F.floor(F.col("power") * POWER_STEP + 0.5), -F.col("i"))
    g = part.groupBy("target").agg(
        F.max_by(F.struct("period", "t0", "duration", "depth", "power"), key).alias("_b"), F.sum("n").alias("n_periods"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_m"), F.collect_list(F.struct("n", "mean", "m2")).alias("_c"))
    m2 = F.aggregate("_c", F.lit(0.0), lambda a, c: a + c["m2"] + c["n"] * (c["mean"] - F.col("_m")) * (c["mean"] - F.col("_m")))
    g = g.withColumn("_sd", F.sqrt(m2 / F.col("n_periods")))
    out = g.select("target", "_b.*", sde(F.col("_b.power"), F.col("_m"), F.col("_sd"), F.col("n_periods")).alias("sde"), "n_periods")
    return out.withColumn("detected", F.col("sde") >= K.SDE_THRESHOLD)


# -- statistics at the peak --------------------------------------------------------------------------

def peak_snr(lc: DataFrame, det: DataFrame, cen: Census | None = None) -> DataFrame:
    """Depth error sqrt(s2/n_in + s2/n_out) from the scatter around the box model, and depth / error.

    A missing or zero error gives SNR 0.
    """
    cen = census(lc, KEY) if cen is None else cen
    x = attach(lc, det, KEY, cen)
    inn = F.abs(C.phase_time()) < F.col("duration") * 0.5
    g = x.groupBy("target", "depth").agg(
        F.count_if(inn).alias("n_in"), F.count_if(~inn).alias("n_out"),
        F.var_pop(F.when(inn, F.col("flux"))).alias("_vi"), F.var_pop(F.when(~inn, F.col("flux"))).alias("_vo"))
    n = F.col("n_in") + F.col("n_out")
    s2 = (F.coalesce("_vi", F.lit(0.0)) * F.col("n_in") + F.coalesce("_vo", F.lit(0.0)) * F.col("n_out")) / n
    err = F.sqrt(s2 / F.when(F.col("n_in") > 0, F.col("n_in")) + s2 / F.when(F.col("n_out") > 0, F.col("n_out")))
    g = g.withColumn("depth_err", err)
    return g.select("target", "n_in", "n_out", "depth_err", F.when(F.col("depth_err") > 0, F.col("depth") / F.when(
        F.col("depth_err") > 0, F.col("depth_err"))).otherwise(F.lit(0.0)).alias("snr"))


def event_counts(lc: DataFrame, det: DataFrame, cen: Census | None = None) -> DataFrame:
    """Number of mid-event times t0 + kP inside the observed span."""
    cen = census(lc, KEY) if cen is None else cen
    span = lc.groupBy("target").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    t0, p = F.col("t0"), F.col("period")
    n = F.floor((F.col("b") - t0) / p) - F.ceil((F.col("a") - t0) / p) + 1
    return attach(det, span, KEY, cen).select("target", n.cast("bigint").alias("n_transits"))


def best_trial(trials: DataFrame) -> DataFrame:
    """Best of several detrended searches per target, first method on ties.

    ``trials`` is the union of detections with ``method`` and ``method_order``.
    """
    rest = [c for c in trials.columns if c not in ("target", "method_order")]
    g = trials.groupBy("target").agg(
        F.max_by(F.struct(*rest), F.struct("sde", -F.col("method_order"))).alias("_b"),
        F.count(F.lit(1)).cast("int").alias("n_trials"), F.max_by("method_order", F.struct("sde", -F.col("method_order"))).alias("_o"))
    return g.select("target", "_b.*", "n_trials", (F.col("_o") > 0).alias("is_fallback"))


def rank(det: DataFrame) -> DataFrame:
    """Strongest first; targets without a detection statistic last."""
    return det.orderBy(F.coalesce("sde", F.lit(-1.0)).desc(), "target")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
