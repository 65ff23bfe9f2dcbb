"""Queries over curves: filters, normalisation, bins, folds, scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvemill import constants as K
from curvemill.functions import columns as C
from curvemill.functions import normal
from curvemill.functions.look_elsewhere import look_elsewhere_sde
from curvemill.operators import binning, clean
from curvemill.operators.skew import attach, census
from curvemill.plans.registry import query
from curvemill.plans.views import ctes, table, view

KEY = ["target"]


@query("scan_quality_masked", ctes("lc_user") + """
SELECT target, round(t, 8) AS t, flux, flux_err FROM lc_user
WHERE isfinite(t) AND isfinite(flux) AND isfinite(flux_err) AND (quality & 17087) = 0""")
def scan_quality_masked(spark, sf):
    return clean.quality_filter(view(spark, sf, "lc_user")).select("target", C.rd("t", 8).alias("t"), "flux", "flux_err")


@query("finite_filter", ctes("lc_user") + """
, x AS (SELECT target, t, CASE WHEN flux < 1 THEN 'NaN'::DOUBLE WHEN flux_err > 1.55 THEN NULL ELSE flux END AS flux FROM lc_user)
SELECT target, count(*) AS n, round(sum(flux), 4) AS total FROM x WHERE isfinite(t) AND isfinite(flux) GROUP BY target""")
def finite_filter(spark, sf):
    lc = view(spark, sf, "lc_user").withColumn(
        "flux", F.when(F.col("flux") < 1, float("nan")).when(F.col("flux_err") > 1.55, None).otherwise(F.col("flux")))
    return clean.finite_filter(lc).groupBy("target").agg(
        F.count(F.lit(1)).alias("n"), C.rd(F.sum("flux"), 4).alias("total"))


@query("median_normalize", ctes("lc_user", more="m AS (SELECT target, median(flux) AS med FROM lc_user GROUP BY target)") + """
SELECT target, round(t, 8) AS t, round(flux / CASE WHEN med = 0 THEN 1 ELSE med END, 8) AS flux,
       round(flux_err / CASE WHEN med = 0 THEN 1 ELSE med END, 8) AS flux_err FROM lc_user JOIN m USING (target)""")
def median_normalize(spark, sf):
    out = clean.normalize(view(spark, sf, "lc_user"))
    return out.select("target", *[C.rd(c, 8).alias(c) for c in ("t", "flux", "flux_err")])


_CLIP = """m AS (SELECT target, median(flux) AS med FROM lc_user GROUP BY target),
d AS (SELECT target, med, 1.4826E0 * median(abs(flux - med)) AS sigma FROM lc_user JOIN m USING (target) GROUP BY target, med)"""


@query("sigma_clip_upper", ctes("lc_user", more=_CLIP) + """
SELECT target, round(t, 8) AS t, flux FROM lc_user JOIN d USING (target) WHERE sigma <= 0 OR flux < med + 4.0E0 * sigma""")
def sigma_clip_upper(spark, sf):
    return clean.clip_outliers(view(spark, sf, "lc_user")).select("target", C.rd("t", 8).alias("t"), "flux")


@query("sigma_clip_both", ctes("lc_user", more=_CLIP) + """
SELECT target, round(t, 8) AS t, flux FROM lc_user JOIN d USING (target)
WHERE sigma <= 0 OR (flux < med + 1.5E0 * sigma AND flux > med - 5.0E-1 * sigma)""")
def sigma_clip_both(spark, sf):
    return clean.clip_outliers(view(spark, sf, "lc_user"), 1.5, 0.5).select("target", C.rd("t", 8).alias("t"), "flux")


@query("trim_baseline", ctes("lc_user") + """
, s AS (SELECT target, min(t) AS lo, max(t) AS hi FROM lc_user GROUP BY target)
SELECT target, count(*) AS n, round(max(t) - min(t), 8) AS span FROM lc_user JOIN s USING (target)
WHERE hi - lo <= 20.0E0 OR t <= lo + 20.0E0 GROUP BY target""")
def trim_baseline(spark, sf):
    return clean.trim_baseline(view(spark, sf, "lc_user"), 20.0).groupBy("target").agg(
        F.count(F.lit(1)).alias("n"), C.rd(F.max("t") - F.min("t"), 8).alias("span"))


@query("min_points_gate", ctes("lc_user") + """
SELECT target, count(*) AS n, round(sum(flux), 4) AS total FROM lc_user GROUP BY target HAVING count(*) >= 70""")
def min_points_gate(spark, sf):
    return clean.min_points(view(spark, sf, "lc_user"), 70).groupBy("target").agg(
        F.count(F.lit(1)).alias("n"), C.rd(F.sum("flux"), 4).alias("total"))


_FMOD = "CASE WHEN ((t - t0 + {p} * 5.0E-1) % ({p})) < 0 THEN (((t - t0 + {p} * 5.0E-1) % ({p})) + {p}) % ({p}) ELSE (t - t0 + {p} * 5.0E-1) % ({p}) END"
PMOD = _FMOD.format(p="period")
PMOD2 = _FMOD.format(p="(period * 2.0E0)")


@query("in_transit_mask", ctes("lc_user", "det_user") + f"""
SELECT target, count(*) AS n, count(*) FILTER (abs({PMOD} - period * 5.0E-1) < duration * 1.5E0 / 2.0E0) AS masked
FROM lc_user JOIN det_user USING (target) GROUP BY target""")
def in_transit_mask(spark, sf):
    lc = view(spark, sf, "lc_user")
    x = attach(lc, view(spark, sf, "det_user"), KEY, census(lc, KEY))
    return x.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count_if(C.in_event()).alias("masked"))


@query("fit_window", ctes("lc_user", "det_user") + f"""
, x AS (SELECT target, t, flux, abs({PMOD} - period * 5.0E-1) < duration * 4.0E0 / 2.0E0 AS near FROM lc_user JOIN det_user USING (target)),
h AS (SELECT target, count(*) FILTER (near) AS hits FROM x GROUP BY target)
SELECT target, round(t, 8) AS t, flux FROM x JOIN h USING (target) WHERE near OR hits < 30""")
def fit_window(spark, sf):
    out = clean.event_window(view(spark, sf, "lc_user"), view(spark, sf, "det_user"))
    return out.select("target", C.rd("t", 8).alias("t"), "flux")


@query("join_detection", ctes("lc_type", "det_type") + """
SELECT target, round(t, 8) AS t, flux, period, t0, duration, depth, round(sde, 6) AS sde FROM lc_type JOIN det_type USING (target)""")
def join_detection(spark, sf):
    lc = view(spark, sf, "lc_type")
    out = attach(lc, view(spark, sf, "det_type"), KEY, census(lc, KEY))
    return out.select("target", C.rd("t", 8).alias("t"), "flux", "period", "t0", "duration", "depth", C.rd("sde").alias("sde"))


# -- aggregates ----------------------------------------------------------------------------------

TIME_BIN = """lo AS (SELECT target, min(t) AS tmin FROM lc_type GROUP BY target),
b AS (SELECT target, CAST(floor((t - tmin) / (10.0E0 / 1440.0E0)) AS BIGINT) AS bin, avg(t) AS t, avg(flux) AS flux, count(*) AS n
      FROM lc_type JOIN lo USING (target) GROUP BY ALL)"""


@query("time_bin", ctes("lc_type", more=TIME_BIN) + """
SELECT target, bin, round(t, 8) AS t, round(flux, 8) AS flux, n FROM b""")
def time_bin(spark, sf):
    return binning.time_bin(view(spark, sf, "lc_type")).select(
        "target", "bin", C.rd("t", 8).alias("t"), C.rd("flux", 8).alias("flux"), "n")


@query("time_bin_error", ctes("lc_type", more=TIME_BIN) + """
, e AS (SELECT target, median(flux_err) AS e FROM lc_type GROUP BY target), c AS (SELECT target, median(n) AS c FROM b GROUP BY target)
SELECT target, round(e / sqrt(greatest(c, 1)), 8) AS bin_err FROM e JOIN c USING (target)""")
def time_bin_error(spark, sf):
    lc = view(spark, sf, "lc_type")
    cen = census(lc, KEY)
    return binning.time_bin_error(lc, binning.time_bin(lc, cen=cen), cen).select("target", C.rd("bin_err", 8).alias("bin_err"))


@query("phase_bin", ctes("lc_type", "det_type") + f"""
, f AS (SELECT target, CAST(floor((({PMOD}) / period - 5.0E-1 + 5.0E-1) * 200) AS INT) AS bin, flux FROM lc_type JOIN det_type USING (target)),
a AS (SELECT target, bin, avg(flux) AS mean, stddev_pop(flux) AS sd, count(*) AS n FROM f GROUP BY ALL),
g AS (SELECT target, unnest(range(200))::INT AS bin FROM det_type)
SELECT target, bin, round((bin + 5.0E-1) / 200 - 5.0E-1, 8) AS centre, round(mean, 8) AS mean,
       CASE WHEN n > 1 THEN round(sd / sqrt(n), 8) END AS err, coalesce(n, 0) AS n FROM g LEFT JOIN a USING (target, bin)""")
def phase_bin(spark, sf):
    folded = binning.fold(view(spark, sf, "lc_type"), view(spark, sf, "det_type"))
    return binning.phase_bin(folded, 200).select(
        "target", "bin", *[C.rd(c, 8).alias(c) for c in ("centre", "mean", "err")], "n")


@query("fold_2p", ctes("lc_type", "det_type") + f"""
, f AS (SELECT target, CAST(floor((({PMOD2}) / (period * 2.0E0) - 5.0E-1 + 5.0E-1) * 300) AS INT) AS bin, flux FROM lc_type JOIN det_type USING (target))
SELECT target, round((bin + 5.0E-1) / 300 - 5.0E-1, 8) AS centre, round(avg(flux), 8) AS mean FROM f GROUP BY target, bin""")
def fold_2p(spark, sf):
    folded = binning.fold(view(spark, sf, "lc_type"), view(spark, sf, "det_type"), harmonic=2.0)
    return binning.phase_bin(folded, 300, keep_empty=False).select(
        "target", C.rd("centre", 8).alias("centre"), C.rd("mean", 8).alias("mean"))


EPOCH = "round_even((t - t0) / period, 0)"


@query("odd_even_curves", ctes("lc_type", "det_type") + f"""
, x AS (SELECT target, duration, flux, (CAST({EPOCH} AS BIGINT) % 2 + 2) % 2 AS parity, (t - t0) - {EPOCH} * period AS dt FROM lc_type JOIN det_type USING (target)),
y AS (SELECT *, CAST(floor((dt / (duration * 6.0E0) + 5.0E-1) * 40) AS INT) AS bin FROM x WHERE abs(dt) < duration * 3.0E0)
SELECT target, parity, bin, round(((bin + 5.0E-1) / 40 - 5.0E-1) * duration * 6.0E0 * 24.0E0, 8) AS hours, round(avg(flux), 8) AS mean
FROM y WHERE (target, parity) IN (SELECT target, parity FROM y GROUP BY ALL HAVING count(*) > 5) GROUP BY target, parity, bin, duration""")
def odd_even_curves(spark, sf):
    out = binning.odd_even_curves(view(spark, sf, "lc_type"), view(spark, sf, "det_type"))
    return out.select("target", "parity", "bin", C.rd("hours", 8).alias("hours"), C.rd("mean", 8).alias("mean"))


@query("decimate", ctes("lc_type") + """
, r AS (SELECT target, min(t) AS lo, max(t) AS hi, count(*) AS n FROM lc_type GROUP BY target),
z AS (SELECT *, least(floor((t - lo) / (hi - lo) * 2000), 1999) AS slot FROM lc_type JOIN r USING (target))
SELECT target, round(avg(t), 8) AS x, round(avg(flux), 8) AS y FROM z WHERE n > 2000 GROUP BY target, slot
UNION ALL SELECT target, round(t, 8), round(flux, 8) FROM z WHERE n <= 2000""")
def decimate(spark, sf):
    return binning.decimate(view(spark, sf, "lc_type"), 2000).select("target", C.rd("x", 8).alias("x"), C.rd("y", 8).alias("y"))


@query("mad_scatter", ctes("lc_user", more=_CLIP) + "SELECT target, round(med, 8) AS med, round(sigma, 8) AS sigma FROM d")
def mad_scatter(spark, sf):
    return clean.robust_scatter(view(spark, sf, "lc_user")).select("target", C.rd("med", 8).alias("med"), C.rd("sigma", 8).alias("sigma"))


@query("trend_amplitude", ctes("lc_type") + """
SELECT target, round((quantile_cont(flux, 9.8E-1) - quantile_cont(flux, 2.0E-2)) / CASE WHEN median(flux) = 0 THEN 1 ELSE abs(median(flux)) END, 8) AS amplitude
FROM lc_type GROUP BY target""")
def trend_amplitude(spark, sf):
    return binning.trend_amplitude(view(spark, sf, "lc_type")).select("target", C.rd("amplitude", 8).alias("amplitude"))


@query("curve_summary", ctes("lc_user") + """
SELECT target, count(*) AS n_points, round(max(t) - min(t), 8) AS baseline_days FROM lc_user GROUP BY target""")
def curve_summary(spark, sf):
    return binning.curve_summary(view(spark, sf, "lc_user")).select("target", "n_points", C.rd("baseline_days", 8).alias("baseline_days"))


# -- scalar expressions ------------------------------------------------------------------------

@query("phase_fold", ctes("lc_user", "det_user") + f"""
SELECT target, round(t, 8) AS t, round(({PMOD}) / period - 5.0E-1, 8) AS phase, flux FROM lc_user JOIN det_user USING (target)""")
def phase_fold(spark, sf):
    folded = binning.fold(view(spark, sf, "lc_user"), view(spark, sf, "det_user"))
    return folded.select("target", C.rd("t", 8).alias("t"), C.rd("phase", 8).alias("phase"), "flux").orderBy("target", "phase")


@query("epoch_parity", ctes("lc_user", "det_user") + f"""
SELECT target, CAST({EPOCH} AS BIGINT) AS epoch, (CAST({EPOCH} AS BIGINT) % 2 + 2) % 2 AS parity, round((t - t0) - {EPOCH} * period, 8) AS dt
FROM lc_user JOIN det_user USING (target)""")
def epoch_parity(spark, sf):
    lc = view(spark, sf, "lc_user")
    x = attach(lc, view(spark, sf, "det_user"), KEY, census(lc, KEY))
    return x.select("target", C.epoch().cast("bigint").alias("epoch"), C.parity(C.epoch()).alias("parity"),
                    C.rd(C.from_mid_event(), 8).alias("dt"))


@query("implied_density", ctes("det_user") + """
, v AS (SELECT target, period, CASE WHEN sde > 8.5 THEN 0.0E0 ELSE duration END AS duration, depth * 1.0E-3 AS depth FROM det_user)
SELECT target, round(CASE WHEN period > 0 AND duration > 0 THEN 3.0E0 * pi() / (6.67430E-8 * pow(86400.0E0 * period, 2)) *
  pow(period / (pi() * duration) * (1 + sqrt(greatest(depth, 0))), 3) END, 6) AS density FROM v""")
def implied_density(spark, sf):
    d = view(spark, sf, "det_user").withColumn("duration", F.when(F.col("sde") > 8.5, 0.0).otherwise(F.col("duration")))
    return d.select("target", C.rd(C.implied_density("period", "duration", F.col("depth") * 1e-3)).alias("density"))


@query("a_over_rs", """
SELECT l_orderkey AS id, l_linenumber AS k,
  round(pow(6.67430E-8 * (l_discount * 10 + 1.0E-1) * pow(l_quantity * 86400.0E0, 2) / (3.0E0 * pi()), 1.0E0 / 3.0E0), 6) AS a_rs FROM lineitem""")
def a_over_rs(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"),
                     C.rd(C.a_over_rs("l_quantity", F.col("l_discount") * 10 + 0.1)).alias("a_rs"))


@query("transit_duration", """
WITH v AS (SELECT l_orderkey AS id, l_linenumber AS k, l_quantity AS p, l_discount * 2 AS rp, 1 + l_tax * 500 AS a, l_discount * 11 AS b FROM lineitem),
w AS (SELECT *, acos(greatest(-1, least(1, b / a))) AS inc FROM v),
x AS (SELECT *, sqrt(greatest((rp + 1) * (rp + 1) - b * b, 0)) AS num, a * sin(inc) AS den FROM w)
SELECT id, k, round(p / pi() * CASE WHEN den = 0 OR num / den >= 1 THEN 1 ELSE asin(num / den) END, 6) AS t14 FROM x""")
def transit_duration(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), C.rd(C.transit_duration(
        F.col("l_quantity"), F.col("l_discount") * 2, F.col("l_tax") * 500 + 1, F.col("l_discount") * 11)).alias("t14"))


@query("limb_q_to_u", """
WITH v AS (SELECT vec_id, embedding[1]::DOUBLE + 2.0E-1 AS q1, abs(embedding[2]::DOUBLE) AS q2 FROM embeddings),
w AS (SELECT *, sqrt(greatest(0, least(1, q1))) AS r FROM v)
SELECT vec_id, round(2 * r * q2, 8) AS u1, round(r * (1 - 2 * q2), 8) AS u2 FROM w""")
def limb_q_to_u(spark, sf):
    e = table(spark, sf, "embeddings")
    u1, u2 = C.limb_u(F.col("embedding")[0].cast("double") + 0.2, F.abs(F.col("embedding")[1].cast("double")))
    return e.select("vec_id", C.rd(u1, 8).alias("u1"), C.rd(u2, 8).alias("u2"))


@query("limb_u_to_q", """
WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS u1, embedding[2]::DOUBLE AS u2 FROM embeddings), w AS (SELECT *, u1 + u2 AS s FROM v)
SELECT vec_id, round(CASE WHEN s <= 0 THEN 0 ELSE s * s END, 8) AS q1, round(CASE WHEN s <= 0 THEN 5.0E-1 ELSE u1 / (s * 2) END, 6) AS q2 FROM w""")
def limb_u_to_q(spark, sf):
    e = table(spark, sf, "embeddings")
    q1, q2 = C.limb_q(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double"))
    return e.select("vec_id", C.rd(q1, 8).alias("q1"), C.rd(q2, 6).alias("q2"))


@query("trapezoid_eval", ctes("lc_user", "det_user") + f"""
, x AS (SELECT target, t, abs((t - t0) - {EPOCH} * period) AS x, depth, 2 * duration / 2 AS h14, duration / 2 AS h23 FROM lc_user JOIN det_user USING (target))
SELECT target, round(t, 8) AS t, round(CASE WHEN x <= h23 THEN 1 - depth WHEN x < h14 AND h14 > h23 THEN 1 - depth * (h14 - x) / (h14 - h23) ELSE 1 END, 6) AS model FROM x""")
def trapezoid_eval(spark, sf):
    lc = view(spark, sf, "lc_user")
    x = attach(lc, view(spark, sf, "det_user"), KEY, census(lc, KEY))
    m = C.trapezoid(C.from_mid_event(), "depth", F.col("duration") * 2, "duration", F.lit(1.0))
    return x.select("target", C.rd("t", 8).alias("t"), C.rd(m).alias("model"))


@query("look_elsewhere_sde", ctes("det_user") + f"""
, x AS (SELECT target, sde, CAST(trunc(sde * 2) AS INT) - 9 AS trials FROM det_user)
SELECT target, round(sde, 6) AS sde, trials, round({normal.duck().corrected("sde", "trials")}, 6) AS sde_corrected FROM x""")
def look_elsewhere(spark, sf):
    d = view(spark, sf, "det_user").withColumn("trials", (F.col("sde") * 2).cast("int") - 9)
    return d.select("target", C.rd("sde").alias("sde"), "trials", C.rd(look_elsewhere_sde("sde", "trials")).alias("sde_corrected"))


@query("unit_projection", ctes("recovery") + """
SELECT seed, k, round_even(true_depth * 1.0E6 * 1.0E8, 0) / 1.0E8 AS depth_ppm, round_even(true_period * 24.0E0 * 1.0E8, 0) / 1.0E8 AS period_hr, round_even(fit_depth * 1.0E8, 0) / 1.0E8 AS fit_depth FROM recovery""")
def unit_projection(spark, sf):
    r = view(spark, sf, "recovery")
    return r.select("seed", "k", C.rint_at(F.col("true_depth") * 1e6).alias("depth_ppm"),
                    C.rint_at(F.col("true_period") * 24.0).alias("period_hr"), C.rint_at("fit_depth").alias("fit_depth"))


@query("summary_text", ctes("det_user") + """
SELECT target, CASE WHEN sde >= 7 THEN printf('Period %.5f d; depth %.0f ppm; duration %.2f h; SDE %.1f', period, depth * 100, duration * 24, sde)
  ELSE printf('no dip above the limit (SDE %.1f, needed 7.0)', sde) END AS summary FROM det_user""")
def summary_text(spark, sf):
    from curvemill.operators.report import summary_line
    d = view(spark, sf, "det_user").withColumn("depth", F.col("depth") * 1e-4)
    return d.select("target", summary_line().alias("summary"))


@query("detection_decision", ctes("det_user") + f"""
SELECT target, round(sde, 6) AS sde, sde >= {K.SDE_THRESHOLD} AS detected FROM det_user""")
def detection_decision(spark, sf):
    return view(spark, sf, "det_user").select("target", C.rd("sde").alias("sde"), (F.col("sde") >= K.SDE_THRESHOLD).alias("detected"))


@query("event_count", ctes("lc_user", "det_user") + """
SELECT target, CAST(floor((max(t) - t0) / period) - ceil((min(t) - t0) / period) + 1 AS BIGINT) AS n_transits
FROM lc_user JOIN det_user USING (target) GROUP BY target, t0, period""")
def event_count(spark, sf):
    from curvemill.operators.search import event_counts  # noqa
    return event_counts(view(spark, sf, "lc_user"), view(spark, sf, "det_user"))
