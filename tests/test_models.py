"""Calibration, boosted models and what is saved of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvemill.operators import classify as cl
from curvemill.operators import isotonic
from curvemill.plans.q_evaluate import NAMES, features23
from curvemill.session import scratch_path

SF = "/root/testdata/sf0.001"


def plain(x, z):
    """Isotonic means by minimax over runs: max over starts of min over ends of the mean."""
    x, at = np.unique(x, return_inverse=True)
    t, n = np.bincount(at, z), np.bincount(at)
    ct, cn = np.concatenate(([0], np.cumsum(t))), np.concatenate(([0], np.cumsum(n)))
    means = (ct[None, 1:] - ct[:-1, None]) / np.where(cn[None, 1:] > cn[:-1, None], cn[None, 1:] - cn[:-1, None], np.nan)
    return x, np.array([max(np.nanmin(means[i, k:]) for i in range(k + 1)) for k in range(len(x))])


@pytest.mark.parametrize("rows", [1, 2, 300])
def test_isotonic_against_minimax(spark, rows):
    rng = np.random.default_rng(rows)
    x = rng.integers(0, 120, rows) / 120
    z = (rng.random(rows) < 0.2 + 0.6 * x).astype(float)
    got = isotonic.fit(spark.createDataFrame(list(zip(x.tolist(), z.tolist())), "x double, z double").repartition(7)).orderBy("low").collect()
    knots, want = plain(x, z)
    for r in got:
        inside = (knots >= r["low"]) & (knots <= r["high"])
        assert np.allclose(want[inside], r["mean"])
    assert sum(r["n"] for r in got) == rows and all(a["mean"] < b["mean"] for a, b in zip(got, got[1:]))


def test_isotonic_of_a_million_scores(spark, monkeypatch):
    monkeypatch.setattr(isotonic, "FAN", 3)
    df = spark.range(1_000_000).select(F.rand(1).alias("x")).withColumn("z", (F.rand(2) < F.col("x")).cast("double"))
    df = df.repartition(9)
    rows = df.orderBy("x").toPandas()
    low, high, total, n = isotonic.pooled(rows["x"].to_numpy(), rows["x"].to_numpy(), rows["z"].to_numpy(), np.ones(len(rows)))
    got = isotonic.fit(df).orderBy("low").toPandas()
    assert np.allclose(got["low"], low) and np.allclose(got["high"], high) and np.allclose(got["mean"], total / n) and np.allclose(got["n"], n)


def test_isotonic_of_nothing(spark):
    blocks = isotonic.fit(spark.createDataFrame([(None, 1.0), (float("nan"), 0.0)], "x double, z double"))
    assert blocks.count() == 0 and isotonic.knots(blocks) == ([], [])
    assert spark.range(2).select(isotonic.interpolate(F.col("id").cast("double"), [], [])).first()[0] == 0.0


def test_boosted_model_scores_explains_and_comes_back(spark):
    f = features23(spark, SF).limit(120).cache()
    model = cl.train(f, NAMES, boosted=True, trees=2, depth=2)
    s = cl.score(model, f, NAMES).toPandas()
    assert np.allclose(s["p"].map(sum), 1) and s["label"].isin(NAMES).all()
    raw = model.transform(cl.inf_to_null(f, cl.K.FEATURE_NAMES)).select("vec_id", F.col("prediction").cast("int").alias("y")).toPandas()
    both = s.merge(raw, on="vec_id")
    assert (both["y_pred"] == both["y"]).all()
    imp = cl.importances(model, spark).toPandas()
    assert len(imp) == 23 and imp["importance"].sum() == pytest.approx(1, abs=1e-6)
    d = cl.drivers(model, f.limit(5), "vec_id", NAMES).collect()
    assert len(d) == 5 and all(len(r["drivers"]) == 4 for r in d)
    for cal in (None, cl.Calibrator("sigmoid", [(1.5, -0.5)] * 4), cl.Calibrator("isotonic", [([0.1, 0.4], [0.0, 0.9])] * 4)):
        path = scratch_path(spark, "model")
        cl.save(model, path, NAMES, spark, calibrator=cal)
        again, _, classes = cl.load(path, spark)
        got = cl.apply_calibrator(cl.load_calibrator(path, spark), cl.score(again, f, classes)).select("vec_id", "p").collect()
        want = cl.apply_calibrator(cal, cl.score(model, f, NAMES)).select("vec_id", "p").collect()
        assert sorted(got) == sorted(want) and cl.load_calibrator(path, spark) == cal
