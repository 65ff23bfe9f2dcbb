"""Curves to ranked catalogue, and one nested result document per target."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill import constants as K
from curvemill.functions import columns as C
from curvemill.functions.look_elsewhere import look_elsewhere_sde
from curvemill.operators import classify, clean, detrend, features, fit, search
from curvemill.operators.report import fit_warning, summary_line
from curvemill.operators.skew import Census, attach, census
from curvemill.session import materialize

KEY = ["target"]


def _search(curves: DataFrame, cen: Census, n_periods: int | None, threshold: float) -> DataFrame:
    det = search.box_search_large(curves, n_periods=n_periods, cen=cen)
    return det.withColumn("detected", F.col("sde") >= threshold)


def best_trials(lc: DataFrame, methods, cen: Census, n_periods, threshold, minimum: int) -> tuple[DataFrame, DataFrame]:
    """(best detection per target, prepared curves of the winning method)."""
    curves, dets = [], []
    for i, m in enumerate(methods):
        # each prepared curve is read by the search and by everything after it
        c = materialize(clean.min_points(detrend.prepare(lc, m, cen=cen), minimum, cen)).withColumn("method", F.lit(m))
        curves.append(c)
        dets.append(_search(c, cen, n_periods, threshold).withColumn("method", F.lit(m)).withColumn("method_order", F.lit(i)))
    trials = dets[0]
    for d in dets[1:]:
        trials = trials.unionByName(d)
    best = materialize(search.best_trial(trials))
    won = None
    for m, c in zip(methods, curves):
        mine = attach(c, best.where(F.col("method") == m).select("target"), KEY, cen, "left_semi")
        won = mine if won is None else won.unionByName(mine)
    return best, won


def refine(best: DataFrame, curves: DataFrame, methods, cen: Census, n_periods, threshold, minimum: int = 100,
           max_masked: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """Second pass for detected targets: detrend again with the found events masked, search again.

    Only where some but fewer than ``max_masked`` of the samples are masked and enough finite ones remain;
    every other target keeps its first result.
    """
    found = best.where("detected").select("target", "period", "t0", "duration")
    x = attach(curves, found, KEY, cen).withColumn("_in", C.in_event())
    share = x.groupBy("target").agg(F.avg(F.col("_in").cast("double")).alias("_f"))
    ok = share.where((F.col("_f") > 0) & (F.col("_f") < max_masked)).select("target")
    y = attach(x, ok, KEY, cen, "left_semi").withColumn("flux", F.col("flux") * F.col("trend")).drop("trend")
    again = None
    for m in methods:
        d = detrend.detrend(y.where(F.col("method") == m), m, mask=F.col("_in"), cen=cen)
        again = d if again is None else again.unionByName(d)
    again = again.where(C.is_finite("flux")).drop("period", "t0", "duration", "_in")
    again = materialize(clean.min_points(again, minimum + 1, cen))
    redone = materialize(_search(again, cen, n_periods, threshold))
    done = redone.select("target")
    old = [c for c in best.columns if c not in redone.columns]
    det = best.join(done, "target", "left_anti").unionByName(redone.join(best.select("target", *old), "target").select(*best.columns))
    rest = curves.join(done, "target", "left_anti")
    return det, rest.unionByName(again.join(done, "target", "left_semi").select(*rest.columns))


class Catalogue(NamedTuple):
    """``rows``, one for each target; ``curves``, detrended by the method that won; ``vectors``, the 23 features of detected targets."""
    rows: DataFrame
    curves: DataFrame
    vectors: DataFrame


def run_catalogue(lc: DataFrame, model: PipelineModel | None, classes: list[str], methods=("biweight", "lowess"),
                  n_periods: int | None = None, threshold: float = K.SDE_THRESHOLD, n_freq: int = K.LS_FREQ_COUNT,
                  minimum: int = K.MIN_POINTS_CLEAN, calibrator: classify.Calibrator | None = None) -> DataFrame:
    """The ranked catalogue. Every target keeps a row; what a target did not reach is NULL."""
    return search.rank(build_catalogue(lc, model, classes, methods, n_periods, threshold, n_freq, minimum, calibrator).rows)


def build_catalogue(lc: DataFrame, model: PipelineModel | None, classes: list[str], methods=("biweight", "lowess"),
                    n_periods: int | None = None, threshold: float = K.SDE_THRESHOLD, n_freq: int = K.LS_FREQ_COUNT,
                    minimum: int = K.MIN_POINTS_CLEAN, calibrator: classify.Calibrator | None = None) -> Catalogue:
    """Search, refine, describe, classify, explain and fit every target."""
    cen = census(lc, KEY)
    best, curves = best_trials(lc, methods, cen, n_periods, threshold, minimum)
    det, curves = refine(best, curves, methods, cen, n_periods, threshold)
    det = attach(det, search.peak_snr(curves, det, cen).select("target", "depth_err", "snr"), KEY, cen, "left")
    det = attach(det, search.event_counts(curves, det, cen), KEY, cen, "left")
    det = materialize(det.withColumn("sde_corrected", look_elsewhere_sde("sde", "n_trials")))
    curves = materialize(curves)
    hit = det.where("detected")
    vec = materialize(features.feature_vector(curves.join(hit.select("target"), "target", "left_semi"), hit, n_freq, "trend", cen))
    out = det
    if model is not None:
        scored = classify.apply_calibrator(calibrator, classify.score(model, vec, classes))
        scored = classify.ev.predict(scored.drop("label", "confidence", "probabilities", "y_pred"), classes)
        scored = materialize(scored)
        out = attach(out, scored.select("target", "label", "confidence", "probabilities"), KEY, cen, "left")
        out = attach(out, classify.drivers(model, vec, "target", classes), KEY, cen, "left")
        to_fit = hit.join(scored.where(F.col("label").isin(K.GEOMETRIC_CLASSES)).select("target"), "target", "left_semi")
    else:
        out = out.withColumns({"label": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "probabilities": F.lit(None).cast("map<string, double>"),
                               "drivers": F.lit(None).cast("array<struct<name: string, value: double>>")})
        to_fit = hit
    fits = materialize(fit.full_fit(curves.join(to_fit.select("target"), "target", "left_semi"), to_fit, cen))
    seen = fit.observed_depth(fits.withColumn("base", F.lit(1.0))).select("target", "depth_observed")
    fits = attach(fits, seen, KEY, cen, "left")
    # the template's dip scales with its depth, and so does the error
    seen_err = F.try_divide(F.col("depth_observed"), F.col("depth")) * F.col("depth_err")
    fits = fits.select("target", *[F.col(c).alias(f"fit_{c}") for c in ("period", "period_err", "t0", "depth", "depth_err", "duration", "duration_err", "t23")],
                       "depth_observed", seen_err.alias("depth_observed_err"), "chi2_red", "converged", "beta", "reliable")
    out = attach(out, fits, KEY, cen, "left")
    out = out.withColumn("caution", C.caution()).withColumn("caution_reason", C.caution_reason())
    out = out.withColumn("summary", summary_line()).withColumn("warning", fit_warning())
    every = lc.select("target").distinct()
    out = attach(every, out, KEY, cen, "left").withColumn(
        "message", F.when(F.col("sde").isNull(), "not enough samples left to search").when(~F.col("detected"), "peak below the limit"))
    return Catalogue(out, curves, vec)


# -- result documents -----------------------------------------------------------------------------------------------

MODEL_POINTS, PERIODOGRAM_POINTS = 900, 2000


def _slot(x, low, high, n: int):
    part = F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0))
    return F.least(F.floor(part * n), F.lit(n - 1)).cast("bigint")


def _point(name: str, slot, x, y, own=None):
    return F.struct(F.lit(name).alias("series"), slot.alias("slot"), x.alias("x"), y.alias("y"), (F.lit(False) if own is None else own).alias("own"))


def display_series(lc: DataFrame, det: DataFrame, points: int = 2500, cen: Census | None = None, periodogram: DataFrame | None = None) -> DataFrame:
    """``(target, series)``: a map from name to sorted points ``x, y, e``, at display resolution.

    Every sample is a point in each series that it belongs to, by (series, slot), and one aggregate makes the means of all of them; a series of at most ``points`` samples keeps
    them as they are. What leaves the aggregate is bounded by the slots, and it combines before the shuffle, whatever a curve's length. With ``trend``, the curve before
    detrending and the trend are series too; with ``periodogram(target, i, period, power)``, its powers.
    """
    cen = census(lc, KEY) if cen is None else cen
    good = lc.where(C.is_finite("t") & C.is_finite("flux"))
    size = good.groupBy("target").agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    x = attach(attach(good, size, KEY, cen), det.select("target", "period", "t0", "duration"), KEY, cen)
    x = x.withColumns({"_ph": C.phase("t", "t0", "period"), "_ph2": C.phase("t", "t0", F.col("period") * 2.0), "_dt": C.from_mid_event(), "_odd": C.parity(C.epoch()) == 1})
    few = F.col("_n") <= points
    own = F.when(few, F.xxhash64("t", "flux"))
    time = F.coalesce(own, _slot(F.col("t"), F.col("_lo"), F.col("_hi"), points))
    flux, width = F.col("flux"), F.col("duration") * 6.0

    def bins(name, at, n, scale=F.lit(1.0), where=F.lit(True)):
        b = F.floor((at + 0.5) * n)
        return F.when(where & (b >= 0) & (b < n), _point(name, b.cast("bigint"), ((b + 0.5) / n - 0.5) * scale, flux))

    near = F.abs("_dt") < F.col("duration") * 3.0
    parts = [
        _point("raw", time, F.col("t"), flux * F.col("trend") if "trend" in lc.columns else flux, few),
        _point("fold", F.coalesce(own, _slot(F.col("_ph"), F.lit(-0.5), F.lit(0.5), points)), F.col("_ph"), flux, few),
        bins("fold_binned", F.col("_ph"), 200), bins("fold_2p", F.col("_ph2"), 300),
        *[bins(name, F.col("_dt") / width, 40, width * 24.0, near & side) for name, side in (("odd", F.col("_odd")), ("even", ~F.col("_odd")))],
    ]
    if "trend" in lc.columns:
        parts += [_point("trend", time, F.col("t"), F.col("trend"), few), _point("detrended", time, F.col("t"), flux, few)]
    rows = x.select("target", F.explode(F.array(*parts)).alias("p")).where("p is not null").select("target", "p.*")
    if periodogram is not None:
        last = periodogram.groupBy("target").agg(F.max("i").alias("_last"))
        pg = attach(periodogram, last, KEY, cen)
        rows = rows.unionByName(pg.select("target", _point("periodogram", _slot(F.col("i"), F.lit(0), F.col("_last"), PERIODOGRAM_POINTS), F.col("period"), F.col("power")).alias("p")).select("target", "p.*"))
    mean = rows.where(F.col("y").isNotNull()).groupBy("target", "series", "slot", "own").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.stddev_pop("y").alias("sd"), F.count(F.lit(1)).alias("n"))
    err = F.when(F.col("series") == "fold_binned", F.coalesce(F.when(F.col("n") > 1, F.col("sd") / F.sqrt("n")), F.lit(0.0)))
    point = F.struct(C.rint_at("x").alias("x"), C.rint_at("y").alias("y"), C.rint_at(err).alias("e"))
    # equal samples of a short series are points of their own
    each = F.array_repeat(point, F.when(F.col("own"), F.col("n")).otherwise(1).cast("int"))
    series = mean.groupBy("target", "series").agg(F.sum("n").alias("n"), F.sort_array(F.flatten(F.collect_list(each))).alias("points"))
    series = series.where(~F.col("series").isin("odd", "even") | (F.col("n") > 5))
    return series.groupBy("target").agg(F.map_from_entries(F.collect_list(F.struct("series", "points"))).alias("series"))


def _model_series():
    """The fitted template over one period, as points."""
    def at(k):
        phase = k / (MODEL_POINTS - 1.0) - 0.5
        y = C.trapezoid(phase * F.col("fit_period"), "fit_depth", "fit_duration", "fit_t23", F.lit(1.0))
        return F.struct(C.rint_at(phase).alias("x"), C.rint_at(y).alias("y"), F.lit(None).cast("double").alias("e"))

    return F.when(F.col("converged"), F.transform(F.sequence(F.lit(0), F.lit(MODEL_POINTS - 1)), at))


SERIES = ("raw", "trend", "detrended", "periodogram", "fold", "fold_binned", "fold_2p", "odd", "even")
# columns that a detection may bring, from the search alone to the whole catalogue
OPTIONAL = {
    "snr": "double", "n_transits": "bigint", "label": "string", "confidence": "double", "probabilities": "map<string, double>",
    "drivers": "array<struct<name: string, value: double>>", "fit_period": "double", "fit_period_err": "double", "fit_t0": "double", "fit_depth": "double", "fit_depth_err": "double",
    "fit_duration": "double", "fit_duration_err": "double", "fit_t23": "double", "depth_observed": "double", "depth_observed_err": "double", "chi2_red": "double",
    "converged": "boolean", "reliable": "boolean", "warning": "string", "method": "string", "n_trials": "int", "is_fallback": "boolean", "sde_corrected": "double",
    "caution": "boolean", "caution_reason": "string",
}


def result_documents(lc: DataFrame, det: DataFrame, points: int = 2500, cen: Census | None = None, vectors: DataFrame | None = None,
                     periodogram: DataFrame | None = None) -> DataFrame:
    """``(target, doc)``: one nested JSON record per row of ``det``: detection, class with drivers, fit, features and display series, as far as they are known."""
    cen = census(lc, KEY) if cen is None else cen
    y = det.withColumns({c: F.lit(None).cast(kind) for c, kind in OPTIONAL.items() if c not in det.columns})
    y = attach(y, display_series(lc, det, points, cen, periodogram), KEY, cen, "left")
    if vectors is not None:
        vec = F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("key"), F.coalesce(C.finite_or_null(n), F.lit(0.0)).alias("value")) for n in K.FEATURE_NAMES]))
        y = attach(y, vectors.select("target", vec.alias("_features")), KEY, cen, "left")
    else:
        y = y.withColumn("_features", F.lit(None).cast("map<string, double>"))
    y = y.withColumn("_model", _model_series())
    found = F.coalesce(F.col("sde") >= K.SDE_THRESHOLD, F.lit(False))
    ppm, hours = (lambda c: F.col(c) * 1e6), (lambda c: F.col(c) * 24.0)
    detection = F.struct(F.col("period").alias("period_days"), "t0", hours("duration").alias("duration_hours"), ppm("depth").alias("depth_ppm"), "sde", "snr", "n_transits")
    message = F.when(F.col("sde").isNull(), F.lit("not searched")).otherwise(
        F.format_string("no dip above the limit: SDE %.1f, needed %.1f", "sde", F.lit(K.SDE_THRESHOLD)))
    label = F.when(F.col("label").isNotNull(), F.struct("label", "confidence", "probabilities", "drivers"))
    fitted = F.when(F.col("converged"), F.struct(
        F.col("fit_period").alias("period_days"), F.col("fit_period_err").alias("period_err"),
        ppm("fit_depth").alias("depth_geometric_ppm"), ppm("fit_depth_err").alias("depth_geometric_err_ppm"),
        ppm("depth_observed").alias("depth_observed_ppm"), ppm("depth_observed_err").alias("depth_observed_err_ppm"),
        hours("fit_duration").alias("duration_hours"), hours("fit_duration_err").alias("duration_err_hours"),
        F.col("chi2_red").alias("chi2_reduced"), "reliable", "warning"))
    series = F.struct(*[F.col("series")[n].alias(n) for n in SERIES], F.col("_model").alias("model"))
    doc = F.struct(F.col("target"), found.alias("detected"), F.when(~found, message).alias("message"), F.col("method").alias("detrend_method"), *[
        F.when(found, v).alias(n) for n, v in {
            "detection": detection, "classification": label, "fit": fitted, "features": F.col("_features"), "series": series, "n_detrend_trials": F.col("n_trials"),
            "detrend_is_fallback": F.col("is_fallback"), "sde_corrected": F.col("sde_corrected"), "caution_flag": F.coalesce("caution", F.lit(False)),
            "caution_reason": F.col("caution_reason")}.items()])
    return y.select("target", F.to_json(doc).alias("doc"))


def catalogue_documents(lc: DataFrame, model: PipelineModel | None, classes: list[str], **options) -> DataFrame:
    """The documents of a whole run: curves in, one record per target out."""
    cat = build_catalogue(lc, model, classes, **options)
    rows, cen = materialize(cat.rows), census(lc, KEY)
    pg = search.periodogram_large(attach(cat.curves, rows.where("detected").select("target"), KEY, cen, "left_semi"), n_periods=options.get("n_periods"), cen=cen)
    return result_documents(cat.curves, rows, cen=cen, vectors=cat.vectors, periodogram=pg)
