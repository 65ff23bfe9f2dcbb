"""Queries that train and use the class model. MLlib results have no SQL counterpart and are checked by rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvemill import constants as K
from curvemill.functions import columns as C
from curvemill.operators import classify as cl
from curvemill.operators import evaluate as ev
from curvemill.plans.q_evaluate import FEATURES, NAMES, features23
from curvemill.plans.registry import query
from curvemill.session import scratch_path


def sets(spark, sf):
    """Synthetic, injected and real parts of the feature table, told apart by two unused dimensions."""
    from curvemill.plans.views import table
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding")[30].alias("a"), F.col("embedding")[31].alias("b"))
    f = features23(spark, sf).join(e, "vec_id").withColumn("target", F.col("target").cast("string"))
    real, inj, syn = (f.where(c).drop("a", "b") for c in (F.col("a") > 0, (F.col("a") <= 0) & (F.col("b") > 0), (F.col("a") <= 0) & (F.col("b") <= 0)))
    return syn.withColumn("target", F.concat(F.lit("S"), "target")), inj.withColumn("target", F.concat(F.lit("B"), "target")), real


@query("balanced_weights", f"WITH {FEATURES}" + """, n AS (SELECT label, count(*) AS c FROM f23 GROUP BY label)
SELECT vec_id, label, round((SELECT count(*) FROM f23) / ((SELECT count(*) FROM n) * c), 8) AS weight FROM f23 JOIN n USING (label)""")
def balanced_weights(spark, sf):
    return cl.balanced_weights(features23(spark, sf)).select("vec_id", "label", C.rd("weight", 8).alias("weight"))


@query("train_classifier")
def train_classifier(spark, sf):
    """Trained on three quarters of the rows, scored on the others."""
    return cl.self_test(features23(spark, sf), NAMES, "vec_id")


@query("train_classifier_boosted")
def train_classifier_boosted(spark, sf):
    return cl.self_test(features23(spark, sf), NAMES, "vec_id", boosted=True)


@query("calibrate_probs")
def calibrate_probs(spark, sf):
    t = cl.train_calibrated(features23(spark, sf), NAMES, "vec_id")
    r = ev.classification_report(t.test, 4, "y", "y_pred").agg(F.first("accuracy").alias("accuracy"), F.first("macro_f1").alias("macro_f1"))
    return r.select("accuracy", "macro_f1", F.lit(t.loss_raw).alias("log_loss_raw"), F.lit(t.loss_calibrated).alias("log_loss_calibrated"),
                    F.lit(t.calibrator.method if t.calibrator else "none").alias("method"))


@query("feature_drivers")
def feature_drivers(spark, sf):
    f = features23(spark, sf)
    d = cl.drivers(cl.train(f, NAMES), f, "vec_id", NAMES)
    return d.select("vec_id", F.posexplode("drivers").alias("place", "d")).select("vec_id", "place", "d.name", C.rd("d.value").alias("value"))


@query("feature_importance")
def feature_importance(spark, sf):
    return cl.importances(cl.train(features23(spark, sf), NAMES), spark)


@query("model_roundtrip", f"WITH {FEATURES} SELECT count(*) AS n, count(*) AS same, 23 AS features FROM f23")
def model_roundtrip(spark, sf):
    """Calibrated probabilities before saving against those of the loaded model and calibrator: all rows have the same."""
    f, path = features23(spark, sf), scratch_path(spark, "model")
    t = cl.train_calibrated(f, NAMES, "vec_id")
    cl.save(t.model, path, NAMES, spark, calibrator=t.calibrator)
    again, features, classes = cl.load(path, spark)
    a = cl.apply_calibrator(t.calibrator, cl.score(t.model, f, NAMES)).select("vec_id", F.col("p").alias("pa"))
    b = cl.apply_calibrator(cl.load_calibrator(path, spark), cl.score(again, f, classes)).select("vec_id", F.col("p").alias("pb"))
    return a.join(b, "vec_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pa") == F.col("pb")).alias("same"), F.lit(len(features)).alias("features"))


@query("model_schema_guard", f"""
SELECT 23 AS features, []::VARCHAR[] AS missing, []::VARCHAR[] AS extra, true AS accepted UNION ALL SELECT 22, ['{K.FEATURE_NAMES[-1]}'], [], false""")
def model_schema_guard(spark, sf):
    """A model trained on fewer features than the table has is refused, the full one accepted: the saved names are joined with the table's."""
    f, saved = features23(spark, sf), None
    for k, names in enumerate((K.FEATURE_NAMES, K.FEATURE_NAMES[:-1])):
        path = scratch_path(spark, "model")
        cl.save(cl.train(f, NAMES, names=names), path, NAMES, spark, names)
        own = spark.read.parquet(f"{path}/names").select(F.lit(k).alias("model"), "features")
        saved = own if saved is None else saved.unionByName(own)
    return cl.compare_schemas(saved, f).select("features", "missing", "extra", "accepted")


@query("domain_gap")
def domain_gap(spark, sf):
    syn, inj, real = sets(spark, sf)
    return cl.domain_gap(syn.unionByName(inj), real, NAMES, "vec_id")


@query("regime_comparison")
def regime_comparison(spark, sf):
    return cl.compare_regimes(*sets(spark, sf), NAMES, "vec_id")


@query("regime_gaps")
def regime_gaps(spark, sf):
    return cl.regime_gaps(cl.compare_regimes(*sets(spark, sf), NAMES, "vec_id"))


@query("production_set", f"WITH {FEATURES}" + """, e AS (SELECT vec_id, embedding[31] AS a, embedding[32] AS b FROM embeddings),
f AS (SELECT f23.*, a, b FROM f23 JOIN e USING (vec_id)), real AS (SELECT vec_id, target::VARCHAR AS target, label FROM f WHERE a > 0),
inj AS (SELECT vec_id, 'B' || target AS target, label FROM f WHERE a <= 0 AND b > 0),
g AS (SELECT target, row_number() OVER (ORDER BY md5(target || '#0'), target) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT target FROM real)),
u AS (SELECT CASE WHEN rn <= ceil(n * 3.0E-1) THEN 'held_out' ELSE 'train' END AS part, real.target AS target, label FROM real JOIN g USING (target) UNION ALL SELECT 'train', target, label FROM inj)
SELECT part, target, label, count(*) AS n FROM u GROUP BY ALL""")
def production_set(spark, sf):
    _, inj, real = sets(spark, sf)
    train, held = cl.production_set(inj, real)
    both = train.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("held_out")))
    return both.groupBy("part", "target", "label").agg(F.count(F.lit(1)).alias("n"))
