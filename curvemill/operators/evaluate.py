"""Scores of predictions and of recovered parameters. Everything here is a combining aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvemill import constants as K
from curvemill.functions import columns as C
from curvemill.operators.skew import grouped_quantiles


def classes_table(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("c"))


def confusion_matrix(df: DataFrame, n_classes: int, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Every (truth, prediction) pair with its count, zeros kept."""
    got = df.groupBy(F.col(truth).cast("int").alias("y_true"), F.col(pred).cast("int").alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))
    grid = classes_table(df.sparkSession, n_classes).select(
        F.col("c").alias("y_true"), F.explode(F.array(*[F.lit(i) for i in range(n_classes)])).alias("y_pred"))
    return grid.join(got, ["y_true", "y_pred"], "left").fillna(0, ["n"])


def classification_report(df: DataFrame, n_classes: int, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Per class precision, recall, F1 and support, with accuracy and macro F1 on every row.

    0/0 counts as 0. Macro F1 averages over the classes that occur in truth or prediction; the rows cover
    all classes.
    """
    cm = confusion_matrix(df, n_classes, truth, pred)
    tp = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0))
    per = cm.select(F.explode(F.array(
        F.struct(F.col("y_true").alias("c"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("claimed"), tp.cast("bigint").alias("tp")),
        F.struct(F.col("y_pred").alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("claimed"), F.lit(0).cast("bigint").alias("tp")),
    )).alias("x")).groupBy("x.c").agg(F.sum("x.support").alias("support"), F.sum("x.claimed").alias("claimed"), F.sum("x.tp").alias("tp"))
    zero = F.lit(0.0)
    per = per.withColumn("precision", F.coalesce(F.try_divide("tp", "claimed"), zero)).withColumn(
        "recall", F.coalesce(F.try_divide("tp", "support"), zero)).withColumn(
        "f1", F.coalesce(F.try_divide(F.col("tp") * 2.0, F.col("support") + F.col("claimed")), zero))
    total = per.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.sum("tp").alias("correct"), F.sum("support").alias("n"),
        F.avg(F.when(F.col("support") + F.col("claimed") > 0, F.col("f1"))).alias("macro_f1"))
    lo, hi = C.wilson("correct", "n")
    return per.drop("tp", "claimed").join(F.broadcast(total.withColumn("ci_low", lo).withColumn("ci_high", hi)))  # one row


def log_loss(df: DataFrame, probs: str = "p", truth: str = "y_true", eps: float = 2.220446049250313e-16) -> DataFrame:
    p = F.element_at(F.col(probs), F.col(truth).cast("int") + 1)
    return df.agg((-F.avg(F.ln(C.clamp(p, eps, 1.0)))).alias("log_loss"), F.count(F.lit(1)).alias("n"))


def reliability_table(df: DataFrame, n_bins: int = 10, minimum: int = 5, confidence: str = "confidence", correct: str = "correct") -> DataFrame:
    """Stated confidence against accuracy in half-open bins; a confidence of exactly 1 is in no bin."""
    x = df.withColumn("_b", F.floor(F.col(confidence) * n_bins)).where(F.col(confidence) < 1.0)
    g = x.groupBy("_b").agg(F.avg(confidence).alias("mean_confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"),
                            F.count(F.lit(1)).alias("n")).where(F.col("n") >= minimum)
    return g.select(((F.col("_b") + 0.5) / n_bins).alias("centre"), "mean_confidence", "accuracy", "n")


def delta_table(new: DataFrame, old: DataFrame, flat: float = 0.005) -> DataFrame:
    """``(metric, old, new, delta, verdict)`` for metrics in both tables."""
    d = F.col("new") - F.col("old")
    verdict = F.when(F.abs(d) < flat, "flat").when(d > 0, "improved").otherwise("REGRESSED")
    return old.select("metric", F.col("value").alias("old")).join(new.select("metric", F.col("value").alias("new")), "metric").select(
        "metric", "old", "new", d.alias("delta"), verdict.alias("verdict"))


def report_metrics(report: DataFrame, names: list[str]) -> DataFrame:
    """A classification report as ``(metric, value)``."""
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("c") + 1)
    per = report.select(F.explode(F.array(
        F.struct(F.concat(name, F.lit(" precision")).alias("metric"), F.col("precision").alias("value")),
        F.struct(F.concat(name, F.lit(" recall")).alias("metric"), F.col("recall").alias("value")))).alias("x")).select("x.*")
    top = report.agg(F.first("accuracy").alias("accuracy"), F.first("macro_f1").alias("macro_f1"))
    return per.unionByName(top.selectExpr("stack(2, 'accuracy', accuracy, 'macro_f1', macro_f1) AS (metric, value)"))


# -- recovered parameters ----------------------------------------------------------------------------------

def recovery_bias(df: DataFrame, parameters: list[str]) -> DataFrame:
    """Per parameter: median bias, median bias in percent, robust scatter of ``fit_x - true_x``."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(p).alias("parameter"), (F.col(f"fit_{p}") - F.col(f"true_{p}")).alias("resid"),
                 (F.try_divide(F.col(f"fit_{p}"), F.col(f"true_{p}")) * 100.0 - 100.0).alias("percent")) for p in parameters])).alias("x")).select("x.*")
    long = long.where(F.col("resid").isNotNull())
    key = ["parameter"]
    med = grouped_quantiles(long, key, {"bias": ("resid", 0.5), "bias_percent": ("percent", 0.5)})
    # one row per parameter; a join by shuffle would put a parameter into one task
    dev = long.join(F.broadcast(med.select("parameter", "bias")), key).withColumn("_d", F.abs(F.col("resid") - F.col("bias")))
    mad = grouped_quantiles(dev, key, {"_m": ("_d", 0.5)})
    return med.join(mad, key).select("parameter", "bias", "bias_percent", (F.col("_m") * K.MAD_TO_SIGMA).alias("scatter"))


def pull_stats(df: DataFrame, parameter: str, limit: float = 50.0, minimum: int = 5) -> DataFrame:
    """Pulls (fit - true) / error below ``limit``: mean, sample spread, share within 1 and 2 sigma.

    NULLs when fewer than ``minimum`` rows have a positive error.
    """
    err = F.col(f"fit_{parameter}_err")
    pull = (F.col(f"fit_{parameter}") - F.col(f"true_{parameter}")) / F.when(err > 0, err)
    x = df.select(F.when(F.abs(pull) < limit, pull).alias("p"), pull.isNotNull().alias("_ok"))
    g = x.agg(F.count_if("_ok").alias("_k"), F.count("p").alias("n"), F.avg("p").alias("mean"), F.stddev_samp("p").alias("std"),
              F.avg((F.abs("p") < 1.0).cast("double")).alias("within_1"), F.avg((F.abs("p") < 2.0).cast("double")).alias("within_2"))
    return g.select(*[F.when(F.col("_k") >= minimum, F.col(c)).alias(c) for c in ("n", "mean", "std", "within_1", "within_2")])


def completeness_by_depth(df: DataFrame, depth: str = "true_depth", bins: int = 8, minimum: int = 3, floor: float = 1e-5) -> DataFrame:
    """Share detected in log-spaced depth bins; the top edge is outside, as is anything below the first."""
    x = df.where(F.col(depth).isNotNull())
    rng = x.agg(F.greatest(F.min(depth), F.lit(floor)).alias("lo"), F.max(depth).alias("hi"))
    y = x.join(F.broadcast(rng)).where((F.col(depth) >= F.col("lo")) & (F.col(depth) < F.col("hi")))  # one row
    width = F.ln(F.col("hi") / F.col("lo")) / bins
    y = y.withColumn("bin", F.floor(F.ln(F.col(depth) / F.col("lo")) / width))
    g = y.groupBy("bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("detected").cast("double")).alias("fraction"))
    centre = F.col("lo") * F.exp(F.ln(F.col("hi") / F.col("lo")) * ((F.col("bin") + 0.5) / bins)) * 1e6
    return g.where(F.col("n") >= minimum).select("bin", centre.alias("depth_ppm"), "fraction", "n")


def detection_completeness(df: DataFrame) -> DataFrame:
    ok = C.harmonic_error("fit_period", "true_period") < 0.01
    return df.agg(F.avg(F.col("detected").cast("double")).alias("completeness"),
                  F.avg(F.when(F.col("detected"), ok.cast("double"))).alias("correct_period"))


def batch_accuracy(df: DataFrame, label: str = "label", truth: str = "true_label") -> DataFrame:
    x = df.where(F.col(label).isNotNull() & F.col(truth).isNotNull())
    return x.agg(F.avg((F.col(label) == F.col(truth)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def caution_expectations(expected: DataFrame, results: DataFrame) -> DataFrame:
    """PASS, FAIL, or SKIP when the target has no result."""
    x = expected.join(results.select("target", "caution"), "target", "left")
    return x.withColumn("status", F.when(F.col("caution").isNull(), "SKIP").when(F.col("caution") == F.col("expect_caution"), "PASS").otherwise("FAIL"))


def width_ratio(fits: DataFrame, before: str, after: str) -> DataFrame:
    """Error width after over before per target, both arms taken in one pass."""
    a, b = (F.max(F.when(F.col("arm") == v, F.col("err"))).alias(n) for v, n in ((before, "before"), (after, "after")))
    g = fits.groupBy("target").agg(a, b).where(F.col("before").isNotNull() & F.col("after").isNotNull())
    return g.select("target", "before", "after", F.when(F.col("before") != 0, F.col("after") / F.when(F.col("before") != 0, F.col("before"))).alias("ratio"))


# -- feature summaries ----------------------------------------------------------------------------------------

def density_band(df: DataFrame, low: float = 0.1, high: float = 10.0, column: str = "log_rho_implied") -> DataFrame:
    """Per label: share of densities in the physical band, median, count."""
    rho = F.pow(F.lit(10.0), F.col(column))
    x = df.where(F.col(column).isNotNull()).select("label", rho.alias("rho"))
    return grouped_quantiles(x, ["label"], {"median_rho": ("rho", 0.5)}, extra=[
        F.avg(F.col("rho").between(low, high).cast("double")).alias("in_band"), F.count(F.lit(1)).alias("n")])


def quartiles(df: DataFrame, column: str = "sec_ratio_2p_dev") -> DataFrame:
    q = grouped_quantiles(df, ["label"], {"_q": (column, [0.25, 0.5, 0.75])})
    return q.select("label", *[F.col("_q")[i].alias(n) for i, n in enumerate(("q25", "median", "q75"))])


def separation(quart: DataFrame, a: str = "eclipse", b: str = "transit", threshold: float = 0.05) -> DataFrame:
    """Median of ``a`` minus median of ``b`` and whether it discriminates."""
    ma, mb = (F.max(F.when(F.col("label") == v, F.col("median"))) for v in (a, b))
    return quart.agg((ma - mb).alias("separation")).withColumn("discriminating", F.col("separation") > threshold)


# -- probabilities ---------------------------------------------------------------------------------------------

def softmax(scores: list[Column]) -> Column:
    top = F.greatest(*scores)
    e = [F.exp(s - top) for s in scores]
    total = e[0]
    for v in e[1:]:
        total = total + v
    return F.array(*[v / total for v in e])


def argmax(p: Column) -> Column:
    """Index of the largest entry, the first on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def predict(df: DataFrame, names: list[str], probs: str = "p") -> DataFrame:
    """Add ``y_pred``, ``label``, ``confidence`` and the probability map."""
    p = F.col(probs)
    x = df.withColumn("y_pred", argmax(p)).withColumn("confidence", F.array_max(p))
    arr = F.array(*[F.lit(n) for n in names])
    return x.withColumn("label", F.element_at(arr, F.col("y_pred") + 1)).withColumn("probabilities", F.map_from_arrays(arr, p))


def predict_restricted(df: DataFrame, names: list[str], allowed: list[str], probs: str = "p") -> DataFrame:
    """Drop classes the labels cannot express before the argmax, not after."""
    keep = [names.index(c) for c in allowed]
    sub = F.array(*[F.col(probs)[i] for i in keep])
    return df.withColumn("label", F.element_at(F.array(*[F.lit(c) for c in allowed]), argmax(sub) + 1))
