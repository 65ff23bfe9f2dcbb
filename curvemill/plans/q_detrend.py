"""Queries over sliding windows along a curve."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvemill.functions import columns as C
from curvemill.operators import cells, detrend
from curvemill.operators.skew import attach, census
from curvemill.plans.q_clean import _CLIP, PMOD
from curvemill.plans.registry import query
from curvemill.plans.views import ctes, view

KEY = ["target"]
FRAME = "(PARTITION BY target ORDER BY t RANGE BETWEEN 2.5E-1 PRECEDING AND 2.5E-1 FOLLOWING)"


def biweight_sql(src: str, x: str, out: str) -> str:
    """CTE chain giving ``out`` = every column of ``src`` plus ``trend``."""
    return f"""{out}_a AS (SELECT *, list_filter(list({x}) OVER {FRAME}, lambda v: v IS NOT NULL) AS w FROM {src}),
{out}_b AS (SELECT *, list_aggregate(w, 'median') AS m FROM {out}_a),
{out}_c AS (SELECT *, 5.0E0 * list_aggregate(list_transform(w, lambda v: abs(v - m)), 'median') AS s FROM {out}_b),
{out}_d AS (SELECT *, list_filter(list_transform(w, lambda v: (v - m) / s), lambda u: abs(u) < 1) AS u FROM {out}_c),
{out} AS (SELECT * EXCLUDE (w, m, s, u), CASE WHEN {x} IS NULL THEN NULL WHEN s > 0 THEN m + s *
  list_sum(list_transform(u, lambda q: (1 - q * q) * (1 - q * q) * q)) / list_sum(list_transform(u, lambda q: (1 - q * q) * (1 - q * q))) ELSE m END AS trend FROM {out}_d)"""


def _out(df):
    return df.select("target", C.rd("t", 8).alias("t"), C.rd("flux").alias("flux"), C.rd("trend").alias("trend"))


@query("cadence", ctes("lc_user") + """
, d AS (SELECT target, t - lag(t) OVER (PARTITION BY target ORDER BY t) AS dt FROM lc_user)
SELECT target, round(median(dt), 8) AS cadence FROM d GROUP BY target""")
def cadence(spark, sf):
    return cells.cadence(view(spark, sf, "lc_user")).select("target", C.rd("cadence", 8).alias("cadence"))


@query("detrend_median", ctes("lc_type") + f"""
, x AS (SELECT *, median(flux) OVER {FRAME} AS trend FROM lc_type)
SELECT target, round(t, 8) AS t, round(flux / trend, 6) AS flux, round(trend, 6) AS trend FROM x""")
def detrend_median(spark, sf):
    return _out(detrend.detrend(view(spark, sf, "lc_type"), "median"))


@query("detrend_biweight", ctes("lc_type", more=biweight_sql("lc_type", "flux", "x")) + """
SELECT target, round(t, 8) AS t, round(flux / trend, 6) AS flux, round(trend, 6) AS trend FROM x""")
def detrend_biweight(spark, sf):
    return _out(detrend.detrend(view(spark, sf, "lc_type"), "biweight"))


@query("detrend_lowess", ctes("lc_type") + """
, p AS (SELECT a.target, a.t, a.flux, b.t - a.t AS d, pow(1 - pow(abs(b.t - a.t) / 2.5E-1, 3), 3) AS w, b.flux AS x
  FROM lc_type a JOIN lc_type b ON a.target = b.target AND b.t > a.t - 2.5E-1 AND b.t < a.t + 2.5E-1),
s AS (SELECT target, t, flux, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * x) AS y0, sum(w * d * x) AS y1 FROM p GROUP BY ALL),
z AS (SELECT *, CASE WHEN s0 * s2 - s1 * s1 > 1.0E-12 THEN (s2 * y0 - s1 * y1) / (s0 * s2 - s1 * s1) ELSE y0 / s0 END AS trend FROM s)
SELECT target, round(t, 8) AS t, round(flux / trend, 6) AS flux, round(trend, 6) AS trend FROM z""")
def detrend_lowess(spark, sf):
    return _out(detrend.detrend(view(spark, sf, "lc_type"), "lowess"))


def interp_sql(src: str, out: str) -> str:
    """CTE chain filling NULL ``trend`` of ``src``; at least three values per target are assumed."""
    return f"""{out}_w AS (SELECT *, last_value(CASE WHEN trend IS NOT NULL THEN struct_pack(t := t, v := trend) END IGNORE NULLS) OVER a AS p,
  first_value(CASE WHEN trend IS NOT NULL THEN struct_pack(t := t, v := trend) END IGNORE NULLS) OVER b AS n FROM {src}
  WINDOW a AS (PARTITION BY target ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY target ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{out} AS (SELECT * EXCLUDE (p, n, trend), CASE WHEN trend IS NOT NULL THEN trend WHEN p IS NULL THEN n.v WHEN n IS NULL THEN p.v
  ELSE p.v + (t - p.t) / (n.t - p.t) * (n.v - p.v) END AS trend FROM {out}_w)"""


@query("gap_interpolate", ctes("lc_type", more="""
x AS (SELECT target, t, flux, CASE WHEN flux BETWEEN 10 AND 40 THEN NULL ELSE flux END AS trend FROM lc_type),
""" + interp_sql("x", "y")) + """
SELECT target, round(t, 8) AS t, flux, round(trend, 6) AS trend FROM y""")
def gap_interpolate(spark, sf):
    lc = view(spark, sf, "lc_type").withColumn("trend", F.when(~F.col("flux").between(10, 40), F.col("flux")))
    return cells.interpolate(lc).select("target", C.rd("t", 8).alias("t"), "flux", C.rd("trend").alias("trend"))


_MASKED = f"""x AS (SELECT target, t, flux, CASE WHEN abs({PMOD} - period * 5.0E-1) < duration * 1.5E0 / 2 THEN NULL ELSE flux END AS work
  FROM lc_type JOIN det_type USING (target)),
""" + biweight_sql("x", "work", "b") + ", " + interp_sql("b", "c")


@query("detrend_masked", ctes("lc_type", "det_type", more=_MASKED) + """
SELECT target, round(t, 8) AS t, round(flux / trend, 6) AS flux, round(trend, 6) AS trend FROM c""")
def detrend_masked(spark, sf):
    lc = view(spark, sf, "lc_type")
    cen = census(lc, KEY)
    x = attach(lc, view(spark, sf, "det_type"), KEY, cen).withColumn("_mask", C.in_event())
    return _out(detrend.detrend(x, "biweight", mask=F.col("_mask"), cen=cen))


PREPARED = _CLIP.replace("lc_user", "norm") + """,
clipped AS (SELECT target, t, flux, flux_err FROM norm JOIN d USING (target) WHERE sigma <= 0 OR flux < med + 4.0E0 * sigma),
""" + biweight_sql("clipped", "flux", "trended") + """,
prepared AS (SELECT target, t, flux / trend AS flux, flux_err, trend FROM trended WHERE isfinite(flux / trend))"""


def prepared_sql(src: str) -> str:
    """CTE chain ending in ``prepared``."""
    return f"""m0 AS (SELECT target, median(flux) AS med0 FROM {src} GROUP BY target),
norm AS (SELECT target, t, flux / CASE WHEN med0 = 0 THEN 1 ELSE med0 END AS flux, flux_err / CASE WHEN med0 = 0 THEN 1 ELSE med0 END AS flux_err FROM {src} JOIN m0 USING (target)),
""" + PREPARED


@query("prepare", ctes("lc_type", more=prepared_sql("lc_type")) + """
SELECT target, round(t, 8) AS t, round(flux, 6) AS flux, round(flux_err, 6) AS flux_err, round(trend, 6) AS trend FROM prepared""")
def prepare(spark, sf):
    p = detrend.prepare(view(spark, sf, "lc_type"))
    return p.select("target", C.rd("t", 8).alias("t"), *[C.rd(c).alias(c) for c in ("flux", "flux_err", "trend")])
