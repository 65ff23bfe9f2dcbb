"""Queries of the vetting diagnostics and the template fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvemill import constants as K
from curvemill.functions import columns as C
from curvemill.operators import clean, features, fit
from curvemill.operators.skew import attach, census, grouped_quantiles
from curvemill.plans.q_clean import EPOCH, PMOD, PMOD2
from curvemill.plans.registry import query
from curvemill.plans.views import ctes, view

KEY = ["target"]
N_FREQ = 4000

PHASED = f"""ph AS (SELECT l.target, t, flux, period, t0, duration, depth, CAST({EPOCH} AS BIGINT) AS e1, (t - t0) - {EPOCH} * period AS d1,
  CAST({EPOCH.replace('period', '(period * 2.0E0)')} AS BIGINT) AS e2, (t - t0) - {EPOCH.replace('period', '(period * 2.0E0)')} * (period * 2.0E0) AS d2,
  abs(({PMOD} - period * 5.0E-1) / period) AS p1, abs(({PMOD2} - (period * 2.0E0) * 5.0E-1) / (period * 2.0E0)) AS p2,
  duration / period AS w1, duration / (period * 2.0E0) AS w2 FROM @LC l JOIN @DET USING (target))"""


def phased(lc: str, det: str) -> str:
    return PHASED.replace("@LC", lc).replace("@DET", det)


def odd_even_sql(n: int, out: str) -> str:
    return f"""{out}_a AS (SELECT target, count(*) FILTER (abs(d{n}) > duration AND abs(d{n}) < 2.5E0 * duration) AS oot,
  median(flux) FILTER (abs(d{n}) > duration AND abs(d{n}) < 2.5E0 * duration) AS base,
  count(*) FILTER (abs(d{n}) < duration / 2 AND e{n} % 2 = 0) AS n0, count(*) FILTER (abs(d{n}) < duration / 2 AND e{n} % 2 <> 0) AS n1,
  avg(flux) FILTER (abs(d{n}) < duration / 2 AND e{n} % 2 = 0) AS m0, avg(flux) FILTER (abs(d{n}) < duration / 2 AND e{n} % 2 <> 0) AS m1,
  stddev_pop(flux) FILTER (abs(d{n}) < duration / 2 AND e{n} % 2 = 0) AS s0, stddev_pop(flux) FILTER (abs(d{n}) < duration / 2 AND e{n} % 2 <> 0) AS s1 FROM ph GROUP BY target),
{out}_b AS (SELECT *, oot >= 10 AND n0 >= 5 AND n1 >= 5 AS ok, abs(m0 - m1) AS diff, sqrt(s0 * s0 / n0 + s1 * s1 / n1) AS err, abs((base - m0 + base - m1) / 2) AS mean FROM {out}_a),
{out} AS (SELECT target, CASE WHEN ok AND err > 0 THEN greatest(0, least(200, diff / err)) ELSE 0 END AS sigma, CASE WHEN ok AND mean <> 0 THEN greatest(0, least(10, diff / mean)) ELSE 0 END AS frac FROM {out}_b)"""


def secondary_sql(n: int, out: str, primary: str) -> str:
    quiet = f"p{n} > 2 * w{n} AND abs(p{n} - 5.0E-1) > 2 * w{n}"
    return f"""{out}_a AS (SELECT target, any_value(depth) AS depth, max(t) - min(t) AS span, any_value(period) AS period, count(*) FILTER (abs(p{n} - 5.0E-1) < w{n} / 2) AS ns, count(*) FILTER ({quiet}) AS nq,
  avg(flux) FILTER (abs(p{n} - 5.0E-1) < w{n} / 2) AS ms, median(flux) FILTER ({quiet}) AS bq, stddev_pop(flux) FILTER ({quiet}) AS sq,
  count(*) FILTER (p{n} < w{n} / 2) AS nf, avg(flux) FILTER (p{n} < w{n} / 2) AS mf FROM ph GROUP BY target),
{out}_b AS (SELECT *, CASE WHEN nf < 3 OR nq < 10 THEN 1.0E-7 ELSE greatest(bq - mf, 1.0E-7) END AS fold_depth FROM {out}_a),
{out} AS (SELECT target, span, period, fold_depth, CASE WHEN ns >= 5 AND nq >= 20 THEN CASE WHEN sq > 0 THEN greatest(-50, least(200, (bq - ms) / (sq / sqrt(ns)))) ELSE 0 END END AS sigma,
  CASE WHEN ns >= 5 AND nq >= 20 THEN greatest(-2, least(5, (bq - ms) / {primary})) END AS ratio FROM {out}_b)"""


CONSIST = """pe AS (SELECT target, e1, avg(flux) AS m FROM ph WHERE abs(d1) < duration / 2 GROUP BY ALL HAVING count(*) >= 3),
pt AS (SELECT target, count(*) AS k, avg(m) AS m, stddev_pop(m) AS s FROM pe GROUP BY target),
pb AS (SELECT target, count(*) FILTER (abs(d1) > duration AND abs(d1) < 3 * duration) AS n, median(flux) FILTER (abs(d1) > duration AND abs(d1) < 3 * duration) AS b FROM ph GROUP BY target),
cons AS (SELECT target, CASE WHEN n >= 10 AND k >= 2 AND b - m <> 0 THEN least(10, s / abs(b - m)) ELSE 0 END AS val FROM pb LEFT JOIN pt USING (target))"""

OOTVAR = """om AS (SELECT target, any_value(depth) AS depth, count(*) AS n, median(flux) AS m FROM ph WHERE abs(d1) > 1.5E0 * duration GROUP BY target),
oa AS (SELECT target, any_value(om.depth) AS depth, any_value(n) AS n, 1.4826E0 * median(abs(flux - m)) AS amp FROM ph JOIN om USING (target) WHERE abs(d1) > 1.5E0 * duration GROUP BY target),
ootvar AS (SELECT target, CASE WHEN n >= 50 AND amp > 0 THEN log10(greatest(1.0E-4, least(1.0E4, amp / depth))) ELSE 0 END AS val FROM oa)"""

SKEW = """sk AS (SELECT target, count(*) AS n, avg(flux) AS m, stddev_pop(flux) AS s FROM ph WHERE abs(d1) > 2.5E0 * duration GROUP BY target),
skw AS (SELECT target, any_value(n) AS n, any_value(s) AS s, avg(pow(flux - m, 3)) / pow(any_value(s), 3) AS g FROM ph JOIN sk USING (target) WHERE abs(d1) > 2.5E0 * duration GROUP BY target),
skewed AS (SELECT target, CASE WHEN n > 30 AND s > 0 THEN greatest(-10, least(10, g)) ELSE 0 END AS val FROM skw)"""


def ls_sql(lc: str, det: str, n: int) -> str:
    step = (K.LS_FREQ_MAX - K.LS_FREQ_MIN) / (n - 1)
    return f"""lm AS (SELECT target, avg(flux) AS ym, var_pop(flux) AS yy FROM {lc} GROUP BY target),
lf AS (SELECT l.target, k, f, yy, flux - ym AS y, cos(f * t * (2 * pi())) AS c, sin(f * t * (2 * pi())) AS s FROM {lc} l JOIN lm USING (target), (SELECT k, k * {step!r}::DOUBLE + 5.0E-2 AS f FROM range({n}) q(k)) g),
lg AS (SELECT target, k, f, any_value(yy) AS yy, avg(c) AS mc, avg(s) AS ms, avg(c * c) AS cc0, avg(s * s) AS ss0, avg(c * s) AS cs0, avg(y * c) AS yc, avg(y * s) AS ys FROM lf GROUP BY ALL),
lh AS (SELECT *, cc0 - mc * mc AS cc, ss0 - ms * ms AS ss, cs0 - mc * ms AS cs FROM lg),
lp AS (SELECT target, k, f, CASE WHEN yy > 0 AND cc * ss - cs * cs > 1.0E-12 THEN (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (yy * (cc * ss - cs * cs)) END AS power FROM lh),
lr AS (SELECT target, greatest(0, least(500, sum(greatest(0, 1 - abs(k - greatest(0, least({n - 1}, (1 / period - 5.0E-2) / {step!r}::DOUBLE)))) * power) / avg(power))) AS val FROM lp JOIN {det} USING (target) GROUP BY target)"""


def trap_sql(lc: str, det: str) -> str:
    return f"""ta AS (SELECT l.target, flux, duration, depth, (t - t0) - {EPOCH} * period AS dt FROM {lc} l JOIN {det} USING (target)),
tb AS (SELECT * FROM ta WHERE abs(dt) < 2.5E0 * duration),
tc AS (SELECT target, coalesce(median(flux) FILTER (abs(dt) > duration), 1) AS b0 FROM tb GROUP BY target HAVING count(*) > 20),
tg AS (SELECT a * 11 + r AS j, (2.0E-1 + 2.0E-1 * a) AS fa, 1.0E-1 * r AS fr FROM range(15) x(a), range(11) y(r)),
td AS (SELECT target, depth, duration, b0, j, fa, fr, flux - b0 AS g, CASE WHEN abs(dt) <= fr * fa * duration / 2 THEN 1
   WHEN abs(dt) < fa * duration / 2 AND fr < 1 THEN (fa * duration / 2 - abs(dt)) / (fa * duration / 2 - fr * fa * duration / 2) ELSE 0 END AS s FROM tb JOIN tc USING (target), tg),
te AS (SELECT target, depth, duration, b0, j, fa, fr, count(*) AS n, sum(s) AS s, sum(s * s) AS ss, sum(g) AS g, sum(g * s) AS gs, sum(g * g) AS gg FROM td GROUP BY ALL),
tf AS (SELECT *, greatest(0, least(1, CASE WHEN n * ss - s * s > 1.0E-9 THEN (s * g - n * gs) / (n * ss - s * s) ELSE 0 END)) AS f FROM te),
th AS (SELECT *, greatest(-1.0E-1, least(1.0E-1, (g + f * s) / n)) AS beta FROM tf),
ti AS (SELECT *, CASE WHEN ss > 0 THEN greatest(0, least(1, (beta * s - gs) / ss)) ELSE 0 END AS d FROM th),
tj AS (SELECT *, gg - 2 * beta * g + n * beta * beta AS flat, gg - 2 * beta * g + n * beta * beta + 2 * d * gs - 2 * beta * d * s + d * d * ss AS sse FROM ti),
tk AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY floor(sse * 1.0E6 + 5.0E-1), j) AS rn FROM tj),
trap AS (SELECT target, fa * duration AS t14, fr * fa * duration AS t23, d AS fit_depth, b0 + beta AS base, fr AS trap_t23_t14,
  least(10, d / depth) AS trap_depth_ratio, CASE WHEN flat > 0 THEN least(5, sse / flat) ELSE 1 END AS shape_resid_ratio FROM tk WHERE rn = 1)"""


def stats(spark, sf, lc="lc_user", det="det_user"):
    curves = view(spark, sf, lc)
    d = view(spark, sf, det)
    cen = census(curves, KEY)
    x = features.with_phase(curves, d.select("target", "period", "t0", "duration", "depth"), cen)
    return x, attach(d, features.sample_stats(x, cen), KEY, cen), cen


def two(x, a, b, names):
    return x.select("target", C.rd(a).alias(names[0]), C.rd(b).alias(names[1]))


@query("feat_odd_even", ctes("lc_user", "det_user", more=phased("lc_user", "det_user") + ", " + odd_even_sql(1, "oe")) + """
SELECT target, round(sigma, 6) AS odd_even_sigma, round(frac, 6) AS odd_even_frac FROM oe""")
def feat_odd_even(spark, sf):
    _, s, _ = stats(spark, sf)
    return two(s, *features.odd_even(1), ("odd_even_sigma", "odd_even_frac"))


@query("feat_secondary", ctes("lc_user", "det_user", more=phased("lc_user", "det_user") + ", " + secondary_sql(1, "sc", "depth")) + """
SELECT target, round(sigma, 6) AS secondary_sigma, round(ratio, 6) AS secondary_depth_ratio FROM sc""")
def feat_secondary(spark, sf):
    _, s, _ = stats(spark, sf)
    return two(s, *features.secondary(1, F.col("depth")), ("secondary_sigma", "secondary_depth_ratio"))


@query("feat_harmonic_2p", ctes("lc_type", "det_type", more=phased("lc_type", "det_type") + ", " + secondary_sql(2, "sc", "fold_depth") + ", " + odd_even_sql(2, "oe")) + """
SELECT target, CASE WHEN span >= 3 * period THEN round(sc.sigma, 6) END AS sec_sigma_2p, CASE WHEN span >= 3 * period THEN round(ratio, 6) END AS sec_ratio_2p,
  CASE WHEN span >= 3 * period THEN round(oe.sigma, 6) END AS odd_even_sigma_2p FROM sc JOIN oe USING (target)""")
def feat_harmonic_2p(spark, sf):
    _, s, _ = stats(spark, sf, "lc_type", "det_type")
    h = features.harmonic()
    return s.select("target", C.rd(h[0]).alias("sec_sigma_2p"), C.rd(h[1]).alias("sec_ratio_2p"), C.rd(h[2]).alias("odd_even_sigma_2p"))


@query("feat_fold_depth", ctes("lc_user", "det_user", more=phased("lc_user", "det_user") + ", " + secondary_sql(1, "sc", "depth")) + "SELECT target, round(fold_depth, 7) AS fold_depth FROM sc")
def feat_fold_depth(spark, sf):
    _, s, _ = stats(spark, sf)
    return s.select("target", C.rd(features.fold_depth(1), 7).alias("fold_depth"))


@query("feat_depth_consistency", ctes("lc_type", "det_type", more=phased("lc_type", "det_type") + ", " + CONSIST) + "SELECT target, round(val, 6) AS depth_consistency FROM cons")
def feat_depth_consistency(spark, sf):
    x, s, cen = stats(spark, sf, "lc_type", "det_type")
    return features.depth_consistency(x, s, cen).select("target", C.rd("depth_consistency").alias("depth_consistency"))


@query("feat_oot_variability", ctes("lc_user", "det_user", more=phased("lc_user", "det_user") + ", " + OOTVAR) + "SELECT target, round(val, 6) AS log_oot_var_to_depth FROM ootvar")
def feat_oot_variability(spark, sf):
    x, _, cen = stats(spark, sf)
    return features.oot_variability(x, cen).select("target", C.rd("log_oot_var_to_depth").alias("log_oot_var_to_depth"))


@query("feat_oot_variability_trend", ctes("lc_user", "det_user") + """
, m AS (SELECT target, median(flux) AS med FROM lc_user GROUP BY target),
tr AS (SELECT target, depth, period, duration, flux + (t - 15) * 2 - med AS trend FROM lc_user JOIN m USING (target) JOIN det_user USING (target)),
g AS (SELECT target, any_value(depth) AS depth, count(trend) AS n, (quantile_cont(trend, 9.8E-1) - quantile_cont(trend, 2.0E-2)) / CASE WHEN median(trend) = 0 THEN 1 ELSE abs(median(trend)) END AS amp FROM tr GROUP BY target)
SELECT target, round(CASE WHEN n >= 50 AND amp > 0 THEN log10(least(greatest(amp / depth, 1.0E-4), 1.0E4)) ELSE 0 END, 6) AS log_oot_var_to_depth FROM g""")
def feat_oot_variability_trend(spark, sf):
    """Variability from a trend column, here the flux with a slope, less its median."""
    x, _, cen = stats(spark, sf)
    med = grouped_quantiles(x, ["target"], {"_med": ("flux", 0.5)}, cen)
    x = attach(x, med, ["target"], cen).withColumn("trend", F.col("flux") + (F.col("t") - 15.0) * 2.0 - F.col("_med"))
    return features.oot_variability(x, cen, "trend").select("target", C.rd("log_oot_var_to_depth").alias("log_oot_var_to_depth"))


@query("feat_oot_skew", ctes("lc_user", "det_user", more=phased("lc_user", "det_user") + ", " + SKEW) + "SELECT target, round(coalesce(val, 0), 6) AS oot_skew FROM det_user LEFT JOIN skewed USING (target)")
def feat_oot_skew(spark, sf):
    _, s, _ = stats(spark, sf)
    return s.select("target", C.rd(features.oot_skew()).alias("oot_skew"))


@query("lomb_scargle_ratio", ctes("lc_type", "det_type", more=ls_sql("lc_type", "det_type", N_FREQ)) + "SELECT target, round(val, 5) AS ls_power_ratio FROM lr")
def lomb_scargle_ratio(spark, sf):
    r = features.ls_power_ratio(view(spark, sf, "lc_type"), view(spark, sf, "det_type"), N_FREQ)
    return r.select("target", C.rd("ls_power_ratio", 5).alias("ls_power_ratio"))


NORM = "nm AS (SELECT target, median(flux) AS med FROM lc_type GROUP BY target), nrm AS (SELECT target, t, flux / med AS flux, flux_err / med AS flux_err FROM lc_type JOIN nm USING (target))"
TRAP_COLS = ("t14", "t23", "fit_depth", "base", "trap_t23_t14", "trap_depth_ratio", "shape_resid_ratio")
DETF = "df AS (SELECT * REPLACE (4.0E-1 AS depth) FROM det_type)"


def norm_det(spark, sf):
    lc = view(spark, sf, "lc_type")
    cen = census(lc, KEY)
    return clean.normalize(lc, cen), view(spark, sf, "det_type").withColumn("depth", F.lit(0.4)), cen


@query("trapezoid_grid_fit", ctes("lc_type", "det_type", more=f"{NORM}, {DETF}, " + trap_sql("nrm", "df")) + "SELECT target, " + ", ".join(f"round({c}, 6) AS {c}" for c in TRAP_COLS) + " FROM trap")
def trapezoid_grid_fit(spark, sf):
    lc, det, cen = norm_det(spark, sf)
    return fit.trapezoid_fit(lc, det, cen=cen).select("target", *[C.rd(c).alias(c) for c in TRAP_COLS])


@query("feat_trapezoid", ctes("lc_user", "det_user", more=trap_sql("lc_user", "det_user")) + """
SELECT target, round(coalesce(trap_t23_t14, 5.0E-1), 6) AS trap_t23_t14, round(coalesce(trap_depth_ratio, 1), 6) AS trap_depth_ratio, round(coalesce(shape_resid_ratio, 1), 6) AS shape_resid_ratio
FROM det_user LEFT JOIN trap USING (target)""")
def feat_trapezoid(spark, sf):
    d = view(spark, sf, "det_user")
    f = fit.trapezoid_fit(view(spark, sf, "lc_user"), d)
    y = d.select("target").join(f, "target", "left")
    return y.select("target", C.rd(F.coalesce("trap_t23_t14", F.lit(0.5))).alias("trap_t23_t14"),
                    C.rd(F.coalesce("trap_depth_ratio", F.lit(1.0))).alias("trap_depth_ratio"),
                    C.rd(F.coalesce("shape_resid_ratio", F.lit(1.0))).alias("shape_resid_ratio"))


VECTOR = ", ".join([f"{NORM}, {DETF}", phased("nrm", "df"), odd_even_sql(1, "oe"), secondary_sql(1, "sc", "depth"), secondary_sql(2, "sd", "fold_depth"),
                    odd_even_sql(2, "of"), CONSIST, OOTVAR, SKEW, ls_sql("nrm", "df", N_FREQ), trap_sql("nrm", "df")])


@query("feature_vector", ctes("lc_type", "det_type", more=VECTOR) + """
SELECT d.target, round(log10(d.depth), 5) AS log_depth, round(log10(d.duration * 24), 5) AS log_duration_hr, round(log10(d.period), 5) AS log_period,
 round(d.duration / d.period, 5) AS duration_phase_frac, round(d.sde, 5) AS sde, round(log10(d.sde * 2), 5) AS log_snr, floor(d.sde) AS n_transits,
 round(oe.sigma, 5) AS odd_even_sigma, round(oe.frac, 5) AS odd_even_frac, round(sc.sigma, 5) AS secondary_sigma, round(sc.ratio, 5) AS secondary_depth_ratio,
 round(sd.sigma, 5) AS sec_sigma_2p, round(sd.ratio, 5) AS sec_ratio_2p, round(abs(sd.ratio - 1), 5) AS sec_ratio_2p_dev, round(of.sigma, 5) AS odd_even_sigma_2p,
 round(trap_t23_t14, 5) AS trap_t23_t14, round(trap_depth_ratio, 5) AS trap_depth_ratio, round(shape_resid_ratio, 5) AS shape_resid_ratio,
 round(log10(greatest(1.0E-4, least(1.0E6, 3 * pi() / (6.67430E-8 * pow(86400 * d.period, 2)) * pow(d.period / (pi() * d.duration) * (1 + sqrt(d.depth)), 3)))), 5) AS log_rho_implied,
 round(cons.val, 5) AS depth_consistency, round(lr.val, 5) AS ls_power_ratio, round(skewed.val, 5) AS oot_skew, round(ootvar.val, 5) AS log_oot_var_to_depth
FROM df d JOIN oe USING (target) JOIN sc USING (target) JOIN sd USING (target) JOIN of USING (target) JOIN cons USING (target) JOIN lr USING (target) JOIN skewed USING (target) JOIN ootvar USING (target) JOIN trap USING (target)""")
def feature_vector(spark, sf):
    lc, det, cen = norm_det(spark, sf)
    det = det.withColumn("snr", F.col("sde") * 2).withColumn("n_transits", F.floor("sde"))
    v = features.feature_vector(lc, det, N_FREQ, cen=cen)
    return v.select("target", *[C.rd(c, 5).alias(c) for c in K.FEATURE_NAMES])


# -- fits ---------------------------------------------------------------------------------------------------

BETA = f"""ra AS (SELECT target, t, duration, flux - (1 - depth * CASE WHEN x <= duration / 4 THEN 1 WHEN x < duration / 2 THEN (duration / 2 - x) / (duration / 2 - duration / 4) ELSE 0 END) AS r
  FROM (SELECT l.target, t, flux, duration, depth, abs((t - t0) - {EPOCH} * period) AS x FROM nrm l JOIN df USING (target))),
rb AS (SELECT *, t - lag(t) OVER (PARTITION BY target ORDER BY t) AS dt, row_number() OVER (PARTITION BY target ORDER BY t) AS rn FROM ra),
rc AS (SELECT target, count(*) AS n, stddev_pop(r) AS sd, greatest(2, round_even(any_value(duration) / median(dt), 0))::BIGINT AS per FROM rb GROUP BY target),
rd AS (SELECT target, (rn - 1) // per AS blk, avg(r) AS m FROM rb JOIN rc USING (target) WHERE (rn - 1) // per < n // per GROUP BY ALL),
re AS (SELECT target, stddev_pop(m) AS obs FROM rd GROUP BY target),
beta AS (SELECT target, CASE WHEN n >= 20 AND n // per >= 4 AND sd > 0 THEN greatest(1, least(10, obs / (sd / sqrt(per)))) ELSE 1 END AS beta FROM rc JOIN re USING (target))"""


@query("red_noise_beta", ctes("lc_type", "det_type", more=f"{NORM}, {DETF}, {BETA}") + "SELECT target, round(beta, 6) AS beta FROM beta")
def red_noise_beta(spark, sf):
    lc, det, cen = norm_det(spark, sf)
    res = fit.residuals(lc, det.withColumn("t23", F.col("duration") / 2.0), cen)
    return fit.red_noise_beta(res, cen).select("target", C.rd("beta").alias("beta"))


def dip_sql() -> str:
    def post(src: str, out: str) -> str:
        axes = ", ".join(f"sqrt(greatest(0, sum(p * pow(v_{n} - z_{n}, 2)) / sum(p) - pow(sum(p * (v_{n} - z_{n})) / sum(p), 2))) AS e_{n}" for n in "tpwr")
        return f"""{out}_w AS (SELECT g.*, exp((z.chi2 - g.chi2) / 2) AS p, z.depth AS zd, z.v_t AS z_t, z.v_p AS z_p, z.v_w AS z_w, z.v_r AS z_r FROM {src} g JOIN {src}_best z USING (target)),
{out} AS (SELECT target, {axes}, sqrt(greatest(0, sum(p * (pow(depth - zd, 2) + CASE WHEN b > 0 THEN 1 / b ELSE 0 END)) / sum(p) - pow(sum(p * (depth - zd)) / sum(p), 2))) AS e_d FROM {out}_w GROUP BY target)"""

    def grid(src: str, out: str) -> str:
        return f"""{out}_g AS (SELECT target, j, c_t + h_t * ((j % 9) / 4.0E0 - 1) AS v_t, c_p + h_p * ((j // 9 % 9) / 4.0E0 - 1) AS v_p, c_w + h_w * ((j // 81 % 5) / 2.0E0 - 1) AS v_w,
  greatest(0, least(1, c_r + h_r * ((j // 405 % 3) / 1.0E0 - 1))) AS v_r, h_t, h_p, h_w, h_r FROM {src}, range(1215) q(j)),
{out}_x AS (SELECT g.*, f.w, 1 - flux AS m, abs((t - v_t) - round_even((t - v_t) / v_p, 0) * v_p) AS x FROM win f JOIN {out}_g g USING (target)),
{out}_s AS (SELECT *, CASE WHEN x <= v_w * v_r / 2 THEN 1 WHEN x < v_w / 2 AND v_r < 1 THEN (v_w / 2 - x) / (v_w / 2 - v_w * v_r / 2) ELSE 0 END AS s FROM {out}_x),
{out}_a AS (SELECT target, j, v_t, v_p, v_w, v_r, h_t, h_p, h_w, h_r, sum(w * s * m) AS a, sum(w * s * s) AS b, sum(w * m * m) AS c, count(*) AS n FROM {out}_s GROUP BY ALL),
{out}_d AS (SELECT *, CASE WHEN b > 0 THEN greatest(0, least(3.6E-1, a / b)) ELSE 0 END AS depth FROM {out}_a),
{out} AS (SELECT *, c - 2 * depth * a + depth * depth * b AS chi2 FROM {out}_d),
{out}_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY floor(CASE WHEN c > 0 THEN chi2 / c ELSE 0 END * 1.0E10 + 5.0E-1), j) AS rn FROM {out}) WHERE rn = 1)"""
    return f"""wa AS (SELECT l.target, t, flux, flux_err, abs({PMOD} - period * 5.0E-1) < duration * 4 / 2 AS near FROM nrm l JOIN df USING (target)),
wh AS (SELECT target, count(*) FILTER (near) AS hits FROM wa GROUP BY target),
win AS (SELECT target, t, flux, 1 / (flux_err * flux_err) AS w FROM wa JOIN wh USING (target) WHERE near OR hits < 30),
start AS (SELECT target, t0 AS c_t, period AS c_p, duration * 1.2E0 AS c_w, 5.0E-1 AS c_r, duration AS h_t, period * 2.0E-2 AS h_p, duration * 8.0E-1 AS h_w, 5.0E-1 AS h_r FROM df),
{grid('start', 'g1')},
mid AS (SELECT target, v_t AS c_t, v_p AS c_p, v_w AS c_w, v_r AS c_r, h_t / 4 AS h_t, h_p / 4 AS h_p, h_w / 2 AS h_w, h_r / 1 AS h_r FROM g1_best),
{grid('mid', 'g2')},
{post('g2', 'p2')},
mid2 AS (SELECT target, v_t AS c_t, v_p AS c_p, v_w AS c_w, v_r AS c_r, least(h_t, 3 * e_t + h_t / 4) AS h_t, least(h_p, 3 * e_p + h_p / 4) AS h_p, least(h_w, 3 * e_w + h_w / 2) AS h_w, least(h_r, 3 * e_r + h_r / 1) AS h_r
  FROM g2_best JOIN p2 USING (target)),
{grid('mid2', 'g3')},
{post('g3', 'p3')}"""


@query("dip_grid_fit", ctes("lc_type", "det_type", more=f"{NORM}, {DETF}, {dip_sql()}") + """
SELECT target, round(v_p, 6) AS period, round(e_p, 6) AS period_err, round(v_t, 6) AS t0, round(z.depth, 6) AS depth, round(e_d, 6) AS depth_err,
  round(v_w, 6) AS duration, round(v_w * v_r, 6) AS t23, round(chi2 / greatest(n - 5, 1), 6) AS chi2_red, n FROM g3_best z JOIN p3 USING (target)""")
def dip_grid_fit(spark, sf):
    lc, det, cen = norm_det(spark, sf)
    f = fit.dip_fit(lc, det, cen)
    return f.select("target", *[C.rd(c).alias(c) for c in ("period", "period_err", "t0", "depth", "depth_err", "duration", "t23", "chi2_red")], "n")


@query("fit_reliability", ctes("recovery") + """
SELECT seed, k, round(fit_depth_err * (1 + true_period / 10), 10) AS err, CASE WHEN fit_depth_err > 0 THEN coalesce(abs(fit_depth - true_depth) / fit_depth_err < 3, false) ELSE false END AS reliable FROM recovery""")
def fit_reliability(spark, sf):
    r = view(spark, sf, "recovery")
    chi2 = F.abs(F.col("fit_depth") - F.col("true_depth")) / F.when(F.col("fit_depth_err") > 0, F.col("fit_depth_err"))
    x = r.withColumn("chi2_red", chi2).withColumn("converged", F.col("fit_depth_err") > 0)
    return x.select("seed", "k", C.rd(F.col("fit_depth_err") * (1.0 + F.col("true_period") / 10.0), 10).alias("err"), C.fit_reliable().alias("reliable"))


@query("observed_depth", ctes("lc_type", "det_type", more=f"{NORM}, {DETF}, " + trap_sql("nrm", "df")) + """
, pts AS (SELECT target, fit_depth, abs(t14 * (k / 2.0E2 - 1)) AS x, t14 / 2 AS h14, t23 / 2 AS h23 FROM trap, range(401) q(k))
SELECT target, round(fit_depth, 6) AS depth, round(max(fit_depth * CASE WHEN x <= h23 THEN 1 WHEN x < h14 AND h14 > h23 THEN (h14 - x) / (h14 - h23) ELSE 0 END), 6) AS depth_observed FROM pts GROUP BY target, fit_depth""")
def observed_depth(spark, sf):
    lc, det, cen = norm_det(spark, sf)
    f = fit.trapezoid_fit(lc, det, cen=cen).select("target", F.col("fit_depth").alias("depth"), F.col("t14").alias("duration"), "t23", "base")
    return fit.observed_depth(f).select("target", C.rd("depth").alias("depth"), C.rd("depth_observed").alias("depth_observed"))


CAUTION = """cv AS (SELECT seed, k, CASE k % 4 WHEN 0 THEN 'transit' WHEN 1 THEN 'eclipse' WHEN 2 THEN 'blend' ELSE 'variable' END AS label, fit_depth_err > 0 AS converged,
  CASE WHEN fit_depth_err > 0 THEN abs(fit_depth - true_depth) / fit_depth_err END AS chi2 FROM recovery),
cw AS (SELECT *, coalesce(label <> 'variable' AND converged AND isfinite(chi2) AND NOT chi2 < 3, false) AS caution FROM cv)"""


@query("caution_flag", ctes("recovery", more=CAUTION) + """
SELECT seed, k, label, caution, CASE WHEN caution THEN printf('reduced chi-square %.1f is above 3, yet the label is ''%s''; do not use the fitted values', floor(chi2), label) END AS reason FROM cw""")
def caution_flag(spark, sf):
    r = view(spark, sf, "recovery")
    chi2 = F.abs(F.col("fit_depth") - F.col("true_depth")) / F.when(F.col("fit_depth_err") > 0, F.col("fit_depth_err"))
    label = F.element_at(F.array(*[F.lit(c) for c in K.CATALOGUE_CLASSES]), F.col("k") % 4 + 1)
    x = r.select("seed", "k", label.alias("label"), (F.col("fit_depth_err") > 0).alias("converged"), chi2.alias("chi2_red"))
    x = x.withColumn("confidence", F.lit(None).cast("double")).withColumn("shown", F.floor("chi2_red").cast("double"))
    flag = C.caution()
    return x.select("seed", "k", "label", flag.alias("caution"), F.when(flag, C.caution_reason("label", "converged", "shown")).alias("reason"))
