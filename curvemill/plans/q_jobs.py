"""Queries that read and write files, run streams, apply user functions, or run the whole job."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvemill import constants as K
from curvemill.functions import columns as C
from curvemill.operators import catalogue as cat
from curvemill.operators import classify as cl
from curvemill.operators import clean, features, search
from curvemill.operators import evaluate as ev
from curvemill.operators.apply import curve_apply_safe
from curvemill.operators.skew import census
from curvemill.plans.catalogue_run import result_documents, run_catalogue
from curvemill.plans.q_catalogue import LABELLED, STAR, koi
from curvemill.plans.q_clean import EPOCH, PMOD, PMOD2
from curvemill.plans.q_evaluate import FEATURES, NAME_OF, NAMES, PRED, REPORT, features23, scored
from curvemill.plans.registry import query
from curvemill.plans.views import ctes, view
from curvemill.session import scratch_path
from curvemill.sources import readers, writers
from curvemill.streaming import incremental as inc

KEY = ["target"]


# -- sources ---------------------------------------------------------------------------------------------------

@query("scan_one_target", ctes("lc_user") + "SELECT target, round(t, 8) AS t, flux FROM lc_user WHERE target = 'U8'")
def scan_one_target(spark, sf):
    path = scratch_path(spark, "curves")
    writers.write_curves(view(spark, sf, "lc_user"), path)
    return readers.read_target(spark, path, "8", "U").select("target", C.rd("t", 8).alias("t"), "flux")


@query("scan_recursive_dir", ctes("lc_type") + "SELECT target, count(*) AS n, round(sum(flux), 4) AS total FROM lc_type GROUP BY target")
def scan_recursive_dir(spark, sf):
    path = scratch_path(spark, "files")
    lc = view(spark, sf, "lc_type").withColumn("star", F.col("target"))
    lc.repartitionByRange("target", "t").write.partitionBy("star").parquet(path)
    got = readers.read_directory(spark, path, pattern=r"/star=([^/]+)/[^/]+\.parquet$")
    return got.groupBy("target").agg(F.count(F.lit(1)).alias("n"), C.rd(F.sum("flux"), 4).alias("total"))


@query("scan_target_list", ctes("manifest") + "SELECT DISTINCT target FROM manifest WHERE mission = 'kepler'")
def scan_target_list(spark, sf):
    path = scratch_path(spark, "list")
    line = F.when(F.col("mission") == "kepler", F.concat(F.lit("  "), F.col("target"), F.lit(" "))).otherwise(F.lit("   "))
    view(spark, sf, "manifest").select(line.alias("value")).write.text(path)
    return readers.read_target_list(spark, path).distinct()


@query("scan_catalog_csv", ctes("koi", more=LABELLED) + "SELECT target, mission, label, round(published_period, 6) AS published_period, round(mag, 6) AS mag FROM labelled")
def scan_catalog_csv(spark, sf):
    path = scratch_path(spark, "catalogue")
    koi(spark, sf).select("target", "mission", "label", "published_period", "mag").write.option("header", True).csv(path)
    c = readers.read_catalogue(spark, path)
    return c.select("target", "mission", "label", C.rd("published_period").alias("published_period"), C.rd("mag").alias("mag"))


ATTEMPT = T.StructType([T.StructField("target", T.StringType()), T.StructField("label_idx", T.LongType()), T.StructField("shard", T.IntegerType()),
                        T.StructField("seed", T.LongType()), T.StructField("error", T.StringType())])


def _shards(spark, sf):
    """Good shards next to files that are no Parquet at all: three of the latter."""
    path = scratch_path(spark, "shards")
    a = view(spark, sf, "attempts")
    a.write.parquet(f"{path}/good")
    a.select(F.col("error").alias("value")).where(F.col("value").isNotNull()).repartition(3).write.text(f"{path}/broken")
    return path


@query("scan_shards_tolerant", ctes("attempts") + "SELECT target, count(*) AS n, sum(seed) AS seeds FROM attempts GROUP BY target")
def scan_shards_tolerant(spark, sf):
    got = readers.read_shards(spark, _shards(spark, sf), ATTEMPT)
    return got.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.sum("seed").alias("seeds"))


@query("scan_shards_counted", ctes("attempts") + "SELECT false AS broken, count(*) AS n_rows, NULL::BIGINT AS n_files FROM attempts UNION ALL SELECT true, 0, 3")
def scan_shards_counted(spark, sf):
    """Rows that were read, and files that were skipped."""
    f = readers.shard_files(spark, _shards(spark, sf), ATTEMPT)
    return f.groupBy("broken").agg(F.sum("n_rows").alias("n_rows"), F.when(F.col("broken"), F.count(F.lit(1))).alias("n_files"))


# -- sinks ------------------------------------------------------------------------------------------------------

@query("sink_append_shard", ctes("attempts") + "SELECT shard, count(*) AS n, count(error) AS errors FROM attempts GROUP BY shard")
def sink_append_shard(spark, sf):
    path = scratch_path(spark, "append")
    a = view(spark, sf, "attempts")
    for ok in (F.col("error").isNull(), F.col("error").isNotNull()):
        writers.append_shard(a.where(ok), path)
    return readers.read_shards(spark, path, ATTEMPT).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("errors"))


@query("sink_replace_table", ctes("koi", more=f"{LABELLED}, {STAR}") + "SELECT target, label, row_id FROM star")
def sink_replace_table(spark, sf):
    path = scratch_path(spark, "replace/deep/table")
    k = koi(spark, sf).select("target", "label", "mag", "row_id")
    writers.replace_table(k, path)
    writers.replace_table(cat.dedupe_brightest(k, "row_id"), path)
    return readers.read_table(spark, path).select("target", "label", "row_id")


@query("sink_catalog_csv", ctes("det_user") + "SELECT target, round(period, 6) AS period, round(sde, 6) AS sde FROM det_user")
def sink_catalog_csv(spark, sf):
    path = scratch_path(spark, "ranked")
    writers.write_ranked_csv(view(spark, sf, "det_user").select("target", "period", "sde"), path, [F.col("sde").desc(), F.col("target")])
    got = spark.read.schema("target string, period double, sde double").option("header", True).csv(path)
    return got.select("target", C.rd("period").alias("period"), C.rd("sde").alias("sde"))


@query("sink_failures_csv", ctes("attempts") + "SELECT target, shard, seed, error FROM attempts WHERE error IS NOT NULL")
def sink_failures_csv(spark, sf):
    path = scratch_path(spark, "failures")
    writers.write_failures(view(spark, sf, "attempts").select("target", "shard", "seed", "error"), path)
    return spark.read.schema("target string, shard int, seed long, error string").option("header", True).csv(path)


@query("sink_metrics_json", ctes("pred", more=f"{PRED}, {REPORT}") + f"""
SELECT {NAME_OF.format('c')} AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, support, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM rep, tot""")
def sink_metrics_json(spark, sf):
    """One nested record: headline numbers and a map of classes, written and read back."""
    path = scratch_path(spark, "metrics")
    r = ev.classification_report(scored(spark, sf), 4)
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.col("c") + 1)
    doc = r.agg(F.first("accuracy").alias("accuracy"), F.first("macro_f1").alias("macro_f1"),
                F.map_from_entries(F.collect_list(F.struct(name, F.struct("precision", "recall", "support")))).alias("per_class"))  # one entry per class
    writers.write_report(doc, path)
    back = spark.read.schema("accuracy double, macro_f1 double, per_class map<string, struct<precision: double, recall: double, support: bigint>>").json(path)
    x = back.select("accuracy", "macro_f1", F.explode("per_class").alias("label", "m"))
    return x.select("label", *[C.rd(F.col(f"m.{c}")).alias(c) for c in ("precision", "recall")], "m.support", C.rd("accuracy").alias("accuracy"), C.rd("macro_f1").alias("macro_f1"))


_DOC = f"""x AS (SELECT l.target, t, flux, d.period, d.duration, {PMOD} / period - 5.0E-1 AS ph1, {PMOD2} / (period * 2.0E0) - 5.0E-1 AS ph2,
  (t - t0) - {EPOCH} * period AS dt, (CAST({EPOCH} AS BIGINT) % 2 + 2) % 2 AS parity FROM lc_type l JOIN det_type d USING (target)),
rg AS (SELECT target, min(t) AS lo, max(t) AS hi, count(*) AS n FROM lc_type GROUP BY target),
raw AS (SELECT target, CASE WHEN any_value(n) <= 2500 THEN any_value(n) ELSE count(DISTINCT least(floor((t - lo) / (hi - lo) * 2500), 2499)) END AS n_raw FROM lc_type JOIN rg USING (target) GROUP BY target),
f1 AS (SELECT target, floor((ph1 + 5.0E-1) * 200) AS b, avg(flux) AS y FROM x GROUP BY ALL),
s1 AS (SELECT target, count(*) AS n_fold, round(max(y), 6) AS top FROM f1 GROUP BY target),
s2 AS (SELECT target, count(DISTINCT floor((ph2 + 5.0E-1) * 300)) AS n_fold_2p FROM x GROUP BY target),
o AS (SELECT target, parity, count(*) AS n, count(DISTINCT floor((dt / (duration * 6.0E0) + 5.0E-1) * 40)) AS k FROM x WHERE abs(dt) < duration * 3.0E0 GROUP BY ALL),
s3 AS (SELECT target, max(k) FILTER (parity = 1 AND n > 5) AS n_odd, max(k) FILTER (parity = 0 AND n > 5) AS n_even FROM o GROUP BY target)"""


@query("result_document", ctes("lc_type", "det_type", more=_DOC) + """
, o2 AS (SELECT target, parity, avg(flux) AS y FROM x WHERE abs(dt) < duration * 3.0E0 GROUP BY target, parity, floor((dt / (duration * 6.0E0) + 5.0E-1) * 40)),
s4 AS (SELECT target, round(max(y) FILTER (parity = 1), 6) AS top_odd, round(max(y) FILTER (parity = 0), 6) AS top_even FROM o2 GROUP BY target)
SELECT target, sde >= 7 AS detected, CASE WHEN sde >= 7 THEN round(d.period, 6) END AS period_days, CASE WHEN sde >= 7 THEN round(d.duration * 24, 6) END AS duration_hours,
 CASE WHEN sde < 7 THEN printf('no dip above the limit: SDE %.1f, needed 7.0', sde) END AS message,
 CASE WHEN sde >= 7 THEN n_raw END AS n_raw, CASE WHEN sde >= 7 THEN n_fold END AS n_fold, CASE WHEN sde >= 7 THEN n_fold_2p END AS n_fold_2p,
 CASE WHEN sde >= 7 THEN n_odd END AS n_odd, CASE WHEN sde >= 7 THEN n_even END AS n_even, CASE WHEN sde >= 7 THEN top END AS top,
 CASE WHEN sde >= 7 AND n_odd IS NOT NULL THEN top_odd END AS top_odd, CASE WHEN sde >= 7 AND n_even IS NOT NULL THEN top_even END AS top_even,
 CASE WHEN sde >= 7 THEN 23 END AS n_features, CASE WHEN sde >= 7 THEN round(log10(d.period), 6) END AS log_period
FROM det_type d JOIN raw USING (target) JOIN s1 USING (target) JOIN s2 USING (target) JOIN s3 USING (target) JOIN s4 USING (target)""")
def result_document(spark, sf):
    """Documents written as JSON text and read back by path."""
    lc, det = view(spark, sf, "lc_type"), view(spark, sf, "det_type")
    cen = census(lc, KEY)
    hit = det.where(F.col("sde") >= K.SDE_THRESHOLD)
    hit = hit.join(search.peak_snr(lc, hit, cen).select("target", "snr"), "target").join(search.event_counts(lc, hit, cen), "target")
    vectors = features.feature_vector(lc.join(hit.select("target"), "target", "left_semi"), hit, cen=cen)
    docs = result_documents(lc, det.join(hit.select("target", "snr", "n_transits"), "target", "left"), cen=cen, vectors=vectors)
    pts = "array<struct<x: double, y: double>>"
    schema = (f"target string, detected boolean, detection struct<period_days: double, duration_hours: double>, message string, features map<string, double>, "
              f"series struct<raw: {pts}, fold_binned: {pts}, fold_2p: {pts}, odd: {pts}, even: {pts}>")
    d = docs.select(F.from_json("doc", schema).alias("d")).select("d.*")
    size = {n: F.size(F.col(f"series.{c}")) for n, c in {"n_raw": "raw", "n_fold": "fold_binned", "n_fold_2p": "fold_2p", "n_odd": "odd", "n_even": "even"}.items()}
    top = {n: F.array_max(F.col(f"series.{c}.y")) for n, c in {"top": "fold_binned", "top_odd": "odd", "top_even": "even"}.items()}
    return d.select("target", "detected", C.rd("detection.period_days").alias("period_days"), C.rd("detection.duration_hours").alias("duration_hours"), "message",
                    *[F.when(v >= 0, v.cast("bigint")).alias(n) for n, v in size.items()], *[C.rd(v).alias(n) for n, v in top.items()],
                    F.when(F.col("features").isNotNull(), F.size("features")).alias("n_features"), C.rd(F.col("features")["log_period"]).alias("log_period"))


@query("catalogue_documents")
def catalogue_documents(spark, sf):
    """The whole run as documents: what each has, read back by path."""
    from curvemill.plans.catalogue_run import catalogue_documents as documents
    docs = documents(view(spark, sf, "lc_type"), cl.train(features23(spark, sf), NAMES), NAMES)
    parts = ("detection", "classification", "fit", "features", "series", "sde_corrected", "caution_flag")
    return docs.select("target", F.get_json_object("doc", "$.detected").alias("detected"), *[F.get_json_object("doc", f"$.{p}").isNotNull().alias(p) for p in parts])


# -- user functions ------------------------------------------------------------------------------------------------

@query("curve_apply_safe", ctes("lc_user") + """
SELECT target, CASE WHEN count(*) >= 60 THEN round(max(flux) - min(flux), 6) END AS range_, CASE WHEN count(*) >= 60 THEN count(*) END AS n,
  CASE WHEN count(*) < 60 THEN 'ValueError: only ' || count(*) || ' samples' END AS error FROM lc_user GROUP BY target HAVING count(*) < 80""")
def curve_apply(spark, sf):
    def amplitude(target, batches):
        n, low, high = 0, float("inf"), float("-inf")
        for b in batches:
            n, low, high = n + len(b), min(low, b["flux"].min()), max(high, b["flux"].max())
        if n < 60:
            raise ValueError(f"only {n} samples")
        return None if n >= 80 else {"range_": float(high - low), "n": n}

    out = curve_apply_safe(view(spark, sf, "lc_user"), amplitude, "range_ double, n long")
    return out.select("target", C.rd("range_").alias("range_"), "n", "error")


@query("refresh_features", ctes("lc_user", "det_user", "manifest") + """
, m AS (SELECT 'U' || substr(target, 5) AS target, mission FROM manifest)
SELECT m.target, mission, CASE WHEN d.target IS NULL THEN 'not cached' WHEN sde < 7 THEN printf('no detection (SDE %.1f)', sde) END AS error,
  CASE WHEN sde >= 7 THEN round(log10(period), 6) END AS log_period, CASE WHEN sde >= 7 THEN round(duration / period, 6) END AS duration_phase_frac
FROM m LEFT JOIN det_user d USING (target)""")
def refresh_features(spark, sf):
    """Features again for the known targets; a target without a curve keeps a row that says so."""
    lc, det = view(spark, sf, "lc_user"), view(spark, sf, "det_user")
    cen = census(lc, KEY)
    known = view(spark, sf, "manifest").select(F.concat(F.lit("U"), C.digits_of("target")).alias("target"), "mission")
    have = lc.select("target").distinct().join(det.select("target", "sde"), "target", "left")
    hit = det.where(F.col("sde") >= K.SDE_THRESHOLD)
    hit = hit.join(search.peak_snr(lc, hit, cen).select("target", "snr"), "target").join(search.event_counts(lc, hit, cen), "target")
    vec = features.feature_vector(lc.join(hit.select("target"), "target", "left_semi"), hit, cen=cen).drop("sde")
    x = known.join(have.withColumn("_have", F.lit(True)), "target", "left").join(vec, "target", "left")
    error = (F.when(F.col("_have").isNull(), F.lit("not cached"))
             .when(F.col("sde").isNull() | (F.col("sde") < K.SDE_THRESHOLD), F.format_string("no detection (SDE %.1f)", "sde")))
    return x.select("target", "mission", error.alias("error"), C.rd("log_period").alias("log_period"), C.rd("duration_phase_frac").alias("duration_phase_frac"))


# -- streams -------------------------------------------------------------------------------------------------------

@query("stream_incremental_features", ctes("lc_user") + """
, m AS (SELECT target, median(flux) AS med FROM lc_user GROUP BY target)
SELECT target, round(med, 8) AS med, round(1.4826E0 * median(abs(flux - med)), 8) AS sigma FROM lc_user JOIN m USING (target) GROUP BY target, med""")
def stream_incremental_features(spark, sf):
    """Two runs over a growing folder, cut by time: most targets have samples in both, and their rows are made anew."""
    src, out, ckpt = (scratch_path(spark, n) for n in ("incoming", "features", "progress"))
    lc = view(spark, sf, "lc_user").repartition("target")
    late = F.coalesce(F.col("t") >= 14.0, F.lit(True))
    for part in (~late, late):
        writers.append_shard(lc.where(part), src)
        q = inc.incremental(spark, src, readers.CURVE_SCHEMA, lambda b: clean.robust_scatter(b), out, ckpt, buckets=16)
        q.awaitTermination()
    got = inc.latest(spark, out)
    return got.select("target", C.rd("med", 8).alias("med"), C.rd("sigma", 8).alias("sigma"))


@query("stream_settled_dedupe", ctes("attempts") + """
, g AS (SELECT *, CASE WHEN error IS NULL OR starts_with(error, 'no detection') THEN 0 ELSE 1 END AS open, CASE WHEN shard <= 2 THEN 1 WHEN shard <= 4 THEN 2 ELSE 3 END AS b FROM attempts),
s AS (SELECT target, min(b) FILTER (open = 0) AS sb FROM g GROUP BY target),
r AS (SELECT g.*, row_number() OVER (PARTITION BY target ORDER BY error IS NOT NULL, open, seed, shard, label_idx) AS rn FROM g JOIN s USING (target) WHERE b <= coalesce(sb, 9))
SELECT target, shard, seed, error FROM r WHERE rn = 1""")
def stream_settled_dedupe(spark, sf):
    """Three runs, each with more attempts; a target settled in one run is left alone in the next."""
    src, out, ckpt = (scratch_path(spark, n) for n in ("attempts", "store", "progress"))
    a = view(spark, sf, "attempts")
    for lo, hi in ((1, 2), (3, 4), (5, 7)):
        writers.append_shard(a.where(F.col("shard").between(lo, hi)), src)
        inc.settled_store(spark, src, ATTEMPT, out, ckpt).awaitTermination()
    return inc.merge_settled(spark.read.parquet(out)).select("target", "shard", "seed", "error")


# -- the whole job ---------------------------------------------------------------------------------------------------

def _end_to_end(spark, sf, model):
    return run_catalogue(view(spark, sf, "lc_type"), model, NAMES)


@query("catalogue_end_to_end")
def catalogue_end_to_end(spark, sf):
    """Curves -> prepare -> search -> refine -> features -> class -> fit -> caution -> ranked catalogue."""
    out = _end_to_end(spark, sf, cl.train(features23(spark, sf), NAMES))
    return out.drop("probabilities")


@query("two_pass_refine")
def two_pass_refine(spark, sf):
    """Detections before and after the events are masked out of the trend."""
    from curvemill.plans.catalogue_run import best_trials, refine
    lc = view(spark, sf, "lc_type")
    cen = census(lc, KEY)
    best, curves = best_trials(lc, ("biweight",), cen, None, K.SDE_THRESHOLD, K.MIN_POINTS_CLEAN)
    det, _ = refine(best, curves, ("biweight",), cen, None, K.SDE_THRESHOLD)
    return best.select("target", C.rd("sde", 4).alias("sde_first"), C.rd("depth", 5).alias("depth_first")).join(
        det.select("target", C.rd("sde", 4).alias("sde_second"), C.rd("depth", 5).alias("depth_second")), "target")
