"""Queries that score predictions and recovered parameters."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from curvemill import constants as K
from curvemill.functions import columns as C
from curvemill.operators import evaluate as ev
from curvemill.plans.registry import query
from curvemill.plans.views import ctes, table, view

NAMES = K.CATALOGUE_CLASSES
PRED = """pr AS (SELECT vec_id, target, y_true, s0, s1, s2, s3, greatest(s0, s1, s2, s3) AS m FROM pred),
px AS (SELECT *, exp(s0 - m) AS e0, exp(s1 - m) AS e1, exp(s2 - m) AS e2, exp(s3 - m) AS e3 FROM pr),
pp AS (SELECT vec_id, target, y_true, [e0 / (e0 + e1 + e2 + e3), e1 / (e0 + e1 + e2 + e3), e2 / (e0 + e1 + e2 + e3), e3 / (e0 + e1 + e2 + e3)] AS p FROM px),
py AS (SELECT *, list_position(p, list_max(p)) - 1 AS y_pred, list_max(p) AS confidence FROM pp)"""
NAME_OF = "list_extract(['transit', 'eclipse', 'blend', 'variable'], CAST({} AS INT) + 1)"
REPORT = """cl AS (SELECT unnest(range(4)) AS c),
rep0 AS (SELECT c, (SELECT count(*) FROM py WHERE y_true = c) AS support, (SELECT count(*) FROM py WHERE y_pred = c) AS claimed, (SELECT count(*) FROM py WHERE y_pred = c AND y_true = c) AS tp FROM cl),
rep AS (SELECT *, CASE WHEN claimed > 0 THEN tp / claimed ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
  CASE WHEN claimed + support > 0 THEN 2 * tp / (claimed + support) ELSE 0 END AS f1 FROM rep0),
tot AS (SELECT sum(tp) / sum(support) AS accuracy, sum(tp) AS correct, sum(support) AS n, avg(f1) FILTER (claimed + support > 0) AS macro_f1 FROM rep)"""
WILSON = "(({c} / {n} + 3.841458820694124E0 / (2 * {n})) {s} 1.959963984540054E0 * sqrt({c} / {n} * (1 - {c} / {n}) / {n} + 3.841458820694124E0 / (4 * {n} * {n}))) / (1 + 3.841458820694124E0 / {n})"


def scored(spark, sf):
    p = view(spark, sf, "pred").withColumn("p", ev.softmax([F.col(f"s{i}") for i in range(4)]))
    return ev.predict(p, NAMES)


@query("predict_label", ctes("pred", more=PRED) + f"SELECT vec_id, y_pred, {NAME_OF.format('y_pred')} AS label, round(confidence, 8) AS confidence, round(p[2], 8) AS p_eclipse FROM py")
def predict_label(spark, sf):
    return scored(spark, sf).select("vec_id", "y_pred", "label", C.rd("confidence", 8).alias("confidence"), C.rd(F.col("probabilities")["eclipse"], 8).alias("p_eclipse"))


@query("predict_restricted", ctes("pred", more=PRED) + "SELECT vec_id, list_extract(['transit', 'eclipse', 'blend'], CAST(list_position(p[1:3], list_max(p[1:3])) AS INT)) AS label FROM py")
def predict_restricted(spark, sf):
    return ev.predict_restricted(scored(spark, sf), NAMES, K.GEOMETRIC_CLASSES).select("vec_id", "label")


@query("confusion_matrix", ctes("pred", more=PRED) + """
SELECT a AS y_true, b AS y_pred, (SELECT count(*) FROM py WHERE y_true = a AND y_pred = b) AS n FROM range(4) x(a), range(4) y(b)""")
def confusion_matrix(spark, sf):
    return ev.confusion_matrix(scored(spark, sf), 4)


@query("classification_report", ctes("pred", more=f"{PRED}, {REPORT}") + f"""
SELECT c, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1,
  round({WILSON.format(c='correct', n='n', s='-')}, 6) AS ci_low, round({WILSON.format(c='correct', n='n', s='+')}, 6) AS ci_high FROM rep, tot""")
def classification_report(spark, sf):
    r = ev.classification_report(scored(spark, sf), 4)
    return r.select("c", "support", *[C.rd(x).alias(x) for x in ("precision", "recall", "f1", "accuracy", "macro_f1", "ci_low", "ci_high")])


@query("wilson_interval", ctes("pred", more=PRED) + f"""
, g AS (SELECT target, count(*) AS n, count(*) FILTER (y_true = y_pred) AS c FROM py GROUP BY target)
SELECT target, round({WILSON.format(c='c', n='n', s='-')}, 6) + 0.0E0 AS low, round({WILSON.format(c='c', n='n', s='+')}, 6) AS high FROM g""")
def wilson_interval(spark, sf):
    g = scored(spark, sf).groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y_true") == F.col("y_pred")).alias("c"))
    lo, hi = C.wilson("c", "n")
    return g.select("target", C.rd(lo).alias("low"), C.rd(hi).alias("high"))


@query("difference_ci", ctes("pred", more=PRED) + """
, g AS (SELECT target, count(*) AS n, avg(CASE WHEN y_true = y_pred THEN 1.0E0 ELSE 0.0E0 END) AS a, avg(CASE WHEN y_true = 0 THEN 1.0E0 ELSE 0.0E0 END) AS b FROM py GROUP BY target),
h AS (SELECT target, b - a AS d, 1.959963984540054E0 * sqrt(a * (1 - a) / n + b * (1 - b) / n) AS w FROM g)
SELECT target, round(d, 6) AS diff, round(d - w, 6) AS low, round(d + w, 6) AS high, abs(d) > w AS distinguishable FROM h""")
def difference_ci(spark, sf):
    g = scored(spark, sf).groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("a"),
                                                F.avg((F.col("y_true") == 0).cast("double")).alias("b"))
    d, lo, hi, sig = C.accuracy_difference("a", "b", "n")
    return g.select("target", C.rd(d).alias("diff"), C.rd(lo).alias("low"), C.rd(hi).alias("high"), sig.alias("distinguishable"))


@query("log_loss", ctes("pred", more=PRED) + "SELECT round(-avg(ln(greatest(2.220446049250313E-16, p[y_true + 1]))), 6) AS log_loss, count(*) AS n FROM py")
def log_loss(spark, sf):
    return ev.log_loss(scored(spark, sf)).select(C.rd("log_loss").alias("log_loss"), "n")


@query("reliability_table", ctes("pred", more=PRED) + """
, s AS (SELECT confidence * 2 AS conf, y_true = y_pred AS correct FROM py)
SELECT round((floor(conf * 10) + 5.0E-1) / 10, 6) AS centre, round(avg(conf), 6) AS mean_confidence, round(avg(CASE WHEN correct THEN 1.0E0 ELSE 0.0E0 END), 6) AS accuracy, count(*) AS n
FROM s WHERE conf < 1 GROUP BY floor(conf * 10) HAVING count(*) >= 5""")
def reliability_table(spark, sf):
    s = scored(spark, sf).select((F.col("confidence") * 2).alias("confidence"), (F.col("y_true") == F.col("y_pred")).alias("correct"))
    return ev.reliability_table(s).select(*[C.rd(c).alias(c) for c in ("centre", "mean_confidence", "accuracy")], "n")


# what new scores are compared with: the report of one half of the predictions, told by a hash
_EARLIER = "substr(md5(CAST(vec_id AS VARCHAR)), 1, 1) < '8'"
_OLD = re.sub(r"\b(py|cl|rep0|rep|tot)\b", r"old_\1", REPORT)


def _metrics_sql(tag: str, value: str) -> str:
    name = NAME_OF.format("c")
    return (f"SELECT 'accuracy' AS metric, accuracy AS {value} FROM {tag}tot UNION ALL SELECT 'macro_f1', macro_f1 FROM {tag}tot "
            f"UNION ALL SELECT {name} || ' precision', precision FROM {tag}rep UNION ALL SELECT {name} || ' recall', recall FROM {tag}rep")


@query("baseline_delta", ctes("pred", more=f"{PRED}, {REPORT}, old_py AS (SELECT * FROM py WHERE {_EARLIER}), {_OLD}") + f"""
, nw AS ({_metrics_sql("", "new")}), st AS ({_metrics_sql("old_", "old")})
SELECT metric, round(old, 6) AS old, round(new, 6) AS new, round(new - old, 6) AS delta, CASE WHEN abs(new - old) < 5.0E-3 THEN 'flat' WHEN new > old THEN 'improved' ELSE 'REGRESSED' END AS verdict FROM st JOIN nw USING (metric)""")
def baseline_delta(spark, sf):
    s = scored(spark, sf)
    earlier = s.where(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 1) < "8")
    new, old = (ev.report_metrics(ev.classification_report(x, 4), NAMES) for x in (s, earlier))
    return ev.delta_table(new, old).select("metric", *[C.rd(c).alias(c) for c in ("old", "new", "delta")], "verdict")


# -- recovery -------------------------------------------------------------------------------------------------

@query("recovery_bias", ctes("recovery") + """
, u AS (SELECT 'depth' AS parameter, fit_depth - true_depth AS r, fit_depth / true_depth * 100 - 100 AS p FROM recovery UNION ALL SELECT 'period', fit_period - true_period, fit_period / true_period * 100 - 100 FROM recovery),
m AS (SELECT parameter, median(r) AS b, median(p) AS bp FROM u GROUP BY parameter)
SELECT parameter, round(any_value(b), 8) AS bias, round(any_value(bp), 6) AS bias_percent, round(1.4826E0 * median(abs(r - b)), 8) AS scatter FROM u JOIN m USING (parameter) GROUP BY parameter""")
def recovery_bias(spark, sf):
    b = ev.recovery_bias(view(spark, sf, "recovery"), ["depth", "period"])
    return b.select("parameter", C.rd("bias", 8).alias("bias"), C.rd("bias_percent").alias("bias_percent"), C.rd("scatter", 8).alias("scatter"))


@query("pull_stats", ctes("recovery") + """
, q AS (SELECT (fit_depth - true_depth) / fit_depth_err AS p FROM recovery WHERE fit_depth_err > 0), r AS (SELECT p FROM q WHERE abs(p) < 50)
SELECT count(*) AS n, round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS std, round(avg(CASE WHEN abs(p) < 1 THEN 1.0E0 ELSE 0.0E0 END), 6) AS within_1, round(avg(CASE WHEN abs(p) < 2 THEN 1.0E0 ELSE 0.0E0 END), 6) AS within_2 FROM r""")
def pull_stats(spark, sf):
    return ev.pull_stats(view(spark, sf, "recovery"), "depth").select("n", *[C.rd(c).alias(c) for c in ("mean", "std", "within_1", "within_2")])


@query("completeness_by_depth", ctes("recovery") + """
, g AS (SELECT greatest(min(true_depth), 1.0E-5) AS lo, max(true_depth) AS hi FROM recovery),
b AS (SELECT floor(ln(true_depth / lo) / (ln(hi / lo) / 8)) AS bin, lo, hi, detected FROM recovery, g WHERE true_depth >= lo AND true_depth < hi)
SELECT CAST(bin AS BIGINT) AS bin, round(any_value(lo) * exp(ln(any_value(hi) / any_value(lo)) * ((bin + 5.0E-1) / 8)) * 1.0E6, 4) AS depth_ppm, round(avg(CASE WHEN detected THEN 1.0E0 ELSE 0.0E0 END), 6) AS fraction, count(*) AS n
FROM b GROUP BY bin HAVING count(*) >= 3""")
def completeness_by_depth(spark, sf):
    c = ev.completeness_by_depth(view(spark, sf, "recovery"))
    return c.select("bin", C.rd("depth_ppm", 4).alias("depth_ppm"), C.rd("fraction").alias("fraction"), "n")


@query("detection_completeness", ctes("recovery") + """
, e AS (SELECT detected, least(abs(fit_period / true_period - 1), abs(fit_period / true_period - 2) / 2, abs(fit_period / true_period - 5.0E-1) * 2) < 1.0E-2 AS ok FROM recovery)
SELECT round(avg(CASE WHEN detected THEN 1.0E0 ELSE 0.0E0 END), 6) AS completeness, round(avg(CASE WHEN ok THEN 1.0E0 ELSE 0.0E0 END) FILTER (detected), 6) AS correct_period FROM e""")
def detection_completeness(spark, sf):
    return ev.detection_completeness(view(spark, sf, "recovery")).select(*[C.rd(c).alias(c) for c in ("completeness", "correct_period")])


@query("batch_accuracy", ctes("pred", more=PRED) + """
SELECT round(avg(CASE WHEN y_pred = y_true THEN 1.0E0 ELSE 0.0E0 END), 6) AS accuracy, count(*) AS n FROM py WHERE confidence >= 2.7E-1""")
def batch_accuracy(spark, sf):
    s = scored(spark, sf)
    names = F.array(*[F.lit(n) for n in NAMES])
    s = s.select(F.when(F.col("confidence") >= 0.27, F.col("label")).alias("label"), F.element_at(names, F.col("y_true") + 1).alias("true_label"))
    return ev.batch_accuracy(s).select(C.rd("accuracy").alias("accuracy"), "n")


@query("caution_expectations", ctes("det_user", "lc_user") + """
, r AS (SELECT target, max(flux) > 60 AS caution FROM lc_user GROUP BY target HAVING count(*) >= 60)
SELECT d.target, sde > 7 AS expect_caution, caution, CASE WHEN caution IS NULL THEN 'SKIP' WHEN caution = (sde > 7) THEN 'PASS' ELSE 'FAIL' END AS status FROM det_user d LEFT JOIN r USING (target)""")
def caution_expectations(spark, sf):
    expected = view(spark, sf, "det_user").select("target", (F.col("sde") > 7).alias("expect_caution"))
    results = view(spark, sf, "lc_user").groupBy("target").agg((F.max("flux") > 60).alias("caution"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= 60)
    return ev.caution_expectations(expected, results)


@query("width_ratio", ctes("recovery") + """
, g AS (SELECT seed AS target, max(fit_depth_err) FILTER (k = 1) AS before, max(fit_depth_err) FILTER (k = 2) AS after FROM recovery GROUP BY seed)
SELECT target, round(before, 8) AS before, round(after, 8) AS after, round(CASE WHEN before <> 0 THEN after / before END, 6) AS ratio FROM g WHERE before IS NOT NULL AND after IS NOT NULL""")
def width_ratio(spark, sf):
    fits = view(spark, sf, "recovery").select(F.col("seed").alias("target"), F.col("k").alias("arm"), F.col("fit_depth_err").alias("err"))
    w = ev.width_ratio(fits, 1, 2)
    return w.select("target", C.rd("before", 8).alias("before"), C.rd("after", 8).alias("after"), C.rd("ratio").alias("ratio"))


# -- feature tables ----------------------------------------------------------------------------------------------

FEATURES = "f23 AS (SELECT vec_id, vec_id % 50 AS target, " + NAME_OF.format("label % 4") + " AS label, " + ", ".join(
    (f"CASE WHEN vec_id % 9 = 0 THEN NULL ELSE embedding[{i + 1}]::DOUBLE END AS {n}" if 9 <= i <= 14 else f"embedding[{i + 1}]::DOUBLE AS {n}")
    for i, n in enumerate(K.FEATURE_NAMES)) + " FROM embeddings)"


def features23(spark, sf):
    e = table(spark, sf, "embeddings")
    cols = [(F.when(F.col("vec_id") % 9 != 0, F.col("embedding")[i]) if 9 <= i <= 14 else F.col("embedding")[i]).cast("double").alias(n)
            for i, n in enumerate(K.FEATURE_NAMES)]
    label = F.element_at(F.array(*[F.lit(c) for c in NAMES]), F.col("label") % 4 + 1)
    return e.select("vec_id", (F.col("vec_id") % 50).alias("target"), label.alias("label"), *cols)


@query("density_band", f"WITH {FEATURES}" + """, r AS (SELECT label, pow(10, log_rho_implied * 10) AS rho FROM f23 WHERE log_rho_implied IS NOT NULL)
SELECT label, round(median(rho), 6) AS median_rho, round(avg(CASE WHEN rho BETWEEN 1.0E-1 AND 10 THEN 1.0E0 ELSE 0.0E0 END), 6) AS in_band, count(*) AS n FROM r GROUP BY label""")
def density_band(spark, sf):
    f = features23(spark, sf).withColumn("log_rho_implied", F.col("log_rho_implied") * 10)
    return ev.density_band(f).select("label", C.rd("median_rho").alias("median_rho"), C.rd("in_band").alias("in_band"), "n")


@query("harmonic_dev_summary", f"WITH {FEATURES}" + """, q AS (SELECT label, quantile_cont(sec_ratio_2p_dev, 2.5E-1) AS q25, median(sec_ratio_2p_dev) AS med, quantile_cont(sec_ratio_2p_dev, 7.5E-1) AS q75 FROM f23 GROUP BY label),
s AS (SELECT max(med) FILTER (label = 'eclipse') - max(med) FILTER (label = 'transit') AS sep FROM q)
SELECT label, round(q25, 8) AS q25, round(med, 8) AS median, round(q75, 8) AS q75, round(sep, 8) AS separation, sep > 5.0E-2 AS discriminating FROM q, s""")
def harmonic_dev_summary(spark, sf):
    q = ev.quartiles(features23(spark, sf))
    s = ev.separation(q)
    return q.join(F.broadcast(s)).select("label", *[C.rd(c, 8).alias(c) for c in ("q25", "median", "q75", "separation")], "discriminating")  # one row
