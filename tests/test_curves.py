"""Operators on small curves against brute force and known truths."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curvemill.functions import columns as C
from curvemill.functions.look_elsewhere import corrected, look_elsewhere_sde
from curvemill.operators import binning, catalogue, clean, detrend, features, fit, search, skew


def curve(spark, t, flux, target="s", err=None):
    pdf = pd.DataFrame({"target": target, "t": np.asarray(t, float), "flux": np.asarray(flux, float), "flux_err": 1e-3 if err is None else err, "quality": 0})
    return spark.createDataFrame(pdf)


def dips(t, period, t0, duration, depth):
    d = np.abs((t - t0 + period / 2) % period - period / 2)
    return np.where(d < duration / 2, 1 - depth, 1.0)


def ephemeris(spark, **kw):
    base = dict(target="s", period=2.0, t0=0.5, duration=0.1, depth=0.01, sde=10.0, snr=9.0, n_transits=10)
    return spark.createDataFrame([{**base, **kw}])


def test_fold_covers_the_phase_range(spark):
    t = np.arange(0, 20, 0.01)
    p = binning.fold(curve(spark, t, np.ones_like(t)), ephemeris(spark)).agg(F.min("phase"), F.max("phase")).first()
    assert p[0] >= -0.5 and p[1] < 0.5 and p[1] - p[0] > 0.98


def test_mask_share(spark):
    t = np.arange(0, 20, 2 / 1440)
    x = curve(spark, t, np.ones_like(t)).crossJoin(ephemeris(spark).drop("target"))
    share = x.agg(F.avg(C.in_event().cast("double"))).first()[0]
    assert 0.02 < share < 0.09
    none = x.withColumn("period", F.lit(float("nan"))).agg(F.count_if(C.in_event())).first()[0]
    assert none == 0


def test_clip_keeps_dips(spark):
    rng = np.random.default_rng(0)
    t = np.arange(0, 20, 0.01)
    f = dips(t, 2.0, 0.5, 0.1, 0.01) + rng.normal(0, 2e-4, len(t))
    f[100] = 1.5
    kept = clean.clip_outliers(curve(spark, t, f)).toPandas()
    assert len(kept) == len(t) - 1 or len(kept) >= len(t) - 3
    assert (kept["flux"] < 0.995).sum() == (f < 0.995).sum()


def test_search_finds_the_period_and_both_forms_agree(spark):
    rng = np.random.default_rng(3)
    t = np.arange(0, 27, 0.01)
    f = dips(t, 3.1, 1.2, 0.12, 0.01) + rng.normal(0, 1e-3, len(t))
    lc = curve(spark, t, f)
    a = search.box_search(lc, 300).first()
    b = search.box_search_large(lc, chunk=37, n_periods=300).first()
    assert min(abs(a["period"] / 3.1 / m - 1) for m in (1, 2, 0.5)) < 0.02
    for c in ("period", "t0", "duration", "depth", "power", "sde"):
        assert a[c] == pytest.approx(b[c], rel=1e-9)
    assert a["detected"] == (a["sde"] >= 7)
    c = search.box_search_large(lc, chunk=300, n_periods=300).first()
    assert c["sde"] == pytest.approx(b["sde"], rel=1e-12)


def test_short_curves_are_reported(spark):
    lc = curve(spark, np.linspace(0, 0.8, 50), np.ones(50))
    assert search.short_curves(lc).first()["error"] == "a span of 0.80 d leaves no period to try"
    assert search.box_search_large(lc, n_periods=20).count() == 0


@pytest.mark.parametrize("method", ["median", "biweight", "lowess"])
def test_trend_against_brute_force(spark, method):
    rng = np.random.default_rng(5)
    t = np.sort(rng.uniform(0, 9, 400))
    x = np.sin(t) + 3 + rng.normal(0, 0.1, len(t))
    got = detrend.detrend(curve(spark, t, x), method).toPandas().sort_values("t")
    for i in (0, 57, 200, 399):
        w = np.abs(t - t[i]) <= 0.25
        v, d = x[w], t[w] - t[i]
        if method == "median":
            want = np.median(v)
        elif method == "biweight":
            m = np.median(v)
            s = 5 * np.median(np.abs(v - m))
            k = np.where(np.abs((v - m) / s) < 1, (1 - ((v - m) / s) ** 2) ** 2, 0) if s > 0 else np.ones_like(v)
            want = m + (k * (v - m)).sum() / k.sum()
        else:
            k = np.clip(1 - np.abs(d / 0.25) ** 3, 0, None) ** 3
            a = np.array([[k.sum(), (k * d).sum()], [(k * d).sum(), (k * d * d).sum()]])
            want = np.linalg.solve(a, [(k * v).sum(), (k * d * v).sum()])[0] if np.linalg.det(a) > 1e-12 else (k * v).sum() / k.sum()
        assert got["trend"].iloc[i] == pytest.approx(want, abs=1e-9)


def test_trend_stream_is_independent_of_batches():
    rng = np.random.default_rng(7)
    pdf = pd.concat([pd.DataFrame({"target": g, "_cell": c, "t": np.sort(rng.uniform(0, 3, n)), "_x": rng.normal(size=n)})
                     for g in "ab" for c, n in ((0, 120), (1, 1), (2, 60))], ignore_index=True)
    whole = pd.concat(detrend.stream_trend([pdf], 0.25, detrend.median_rows))
    for size in (1, 7, 50, 181):
        parts = [pdf.iloc[i:i + size].reset_index(drop=True) for i in range(0, len(pdf), size)]
        got = pd.concat(detrend.stream_trend(parts, 0.25, detrend.median_rows))
        assert np.allclose(got["_trend"].to_numpy(), whole["_trend"].to_numpy())
        assert np.array_equal(got["t"].to_numpy(), pdf["t"].to_numpy())


def test_masked_points_survive_and_keep_depth(spark):
    t = np.linspace(0, 10, 2000)
    f = 1 + 0.01 * np.sin(t) - 0.02 * ((t > 4.0) & (t < 4.3))
    out = detrend.detrend(curve(spark, t, f), mask=(F.col("t") > 4.0) & (F.col("t") < 4.3)).toPandas().sort_values("t")
    assert out["trend"].notna().all() and len(out) == 2000
    inside = out[(out.t > 4.05) & (out.t < 4.25)]["flux"]
    assert 1 - inside.mean() > 0.012


def test_alternating_depths(spark):
    rng = np.random.default_rng(2)
    t = np.arange(0, 20, 2 / 1440)
    e = np.rint((t - 0.5) / 2.0)
    d = np.abs((t - 0.5) - e * 2.0) < 0.05
    f = 1 - np.where(d, np.where(e % 2 == 0, 0.010, 0.005), 0) + rng.normal(0, 2e-4, len(t))
    lc, det = curve(spark, t, f), ephemeris(spark)
    v = features.feature_vector(lc, det, 100).first()
    assert v["odd_even_sigma"] > 10 and v["odd_even_frac"] > 0.3
    assert 0.2 < 10 ** v["log_rho_implied"] < 10


def test_unmeasurable_is_null(spark):
    rng = np.random.default_rng(4)
    a = curve(spark, np.linspace(0, 5, 300), 1 + rng.normal(0, 1e-3, 300), "far")
    b = curve(spark, np.linspace(0, 10, 500), 1 + rng.normal(0, 1e-3, 500), "mid")
    det = ephemeris(spark, target="far", period=40.0).unionByName(ephemeris(spark, target="mid", period=8.0))
    v = {r["target"]: r for r in features.feature_vector(a.unionByName(b), det, 50).collect()}
    assert v["far"]["secondary_sigma"] is None and v["far"]["secondary_depth_ratio"] is None
    assert v["mid"]["sec_sigma_2p"] is None and v["mid"]["sec_ratio_2p_dev"] is None
    assert v["mid"]["odd_even_sigma"] is not None


def test_box_is_flatter_than_v(spark):
    dt = np.linspace(-0.2, 0.2, 500)
    box = 1 - 0.01 * (np.abs(dt) < 0.05)
    vee = 1 - 0.01 * np.clip(1 - np.abs(dt) / 0.05, 0, None)
    lc = curve(spark, dt + 0.5, box, "box").unionByName(curve(spark, dt + 0.5, vee, "vee"))
    det = ephemeris(spark, target="box").unionByName(ephemeris(spark, target="vee"))
    r = {x["target"]: x for x in fit.trapezoid_fit(lc, det).collect()}
    assert r["box"]["trap_t23_t14"] > 0.7 > 0.5 > r["vee"]["trap_t23_t14"]


def test_dip_fit_recovers_truth(spark):
    rng = np.random.default_rng(6)
    t = np.arange(0, 20, 0.01)
    f = dips(t, 2.0, 0.5037, 0.12, 0.02) + rng.normal(0, 1e-3, len(t))
    r = fit.full_fit(curve(spark, t, f), ephemeris(spark, duration=0.12)).first()
    assert r["period"] == pytest.approx(2.0, abs=0.01) and r["depth"] == pytest.approx(0.02, rel=0.1)
    assert r["chi2_red"] < 1.5 and r["reliable"] and 1.0 <= r["beta"] <= 10.0 and r["depth_err"] > 0


def test_coverage(spark):
    t = np.arange(0, 33, 0.002)
    gap = t[(t < 14) | (t > 18)]
    lc = curve(spark, t, np.ones_like(t), "full").unionByName(curve(spark, gap, np.ones_like(gap), "gap"))
    det = (ephemeris(spark, target="full", period=5.0, t0=2.0, duration=0.15).unionByName(ephemeris(spark, target="gap", period=100.0, t0=15.0, duration=0.15))
           .unionByName(ephemeris(spark, target="none", period=-1.0)))
    c = {r["target"]: r["coverage"] for r in catalogue.event_coverage(lc, det).collect()}
    assert c["full"] > 0.95 and c["gap"] < 0.2 and c["none"] == 0.0


def test_caution_cases(spark):
    rows = [("eclipse", 16.7, True), ("transit", 1.2, True), ("variable", 16.7, True), ("eclipse", float("nan"), False)]
    df = spark.createDataFrame(rows, "label string, chi2_red double, converged boolean").withColumn("confidence", F.lit(0.9))
    got = df.select(C.caution().alias("c"), C.caution_reason().alias("r")).collect()
    assert [r["c"] for r in got] == [True, False, False, False]
    assert "16.7" in got[0]["r"] and "90%" in got[0]["r"] and got[1]["r"] is None


def test_limb_darkening_round_trip(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame(pd.DataFrame(rng.uniform(0.01, 1, (4000, 2)), columns=["q1", "q2"]))
    u1, u2 = C.limb_u("q1", "q2")
    x = df.withColumn("u1", u1).withColumn("u2", u2)
    b1, b2 = C.limb_q("u1", "u2")
    r = x.agg(F.max(F.abs(b1 - F.col("q1"))), F.max(F.abs(b2 - F.col("q2"))), F.max(F.col("u1") + F.col("u2")), F.min("u1")).first()
    assert r[0] < 1e-9 and r[1] < 1e-9 and r[2] <= 1 + 1e-12 and r[3] >= 0


def test_look_elsewhere(spark):
    assert corrected(7.0, 1) == 7.0 and corrected(60.0, 3) == 60.0
    assert 6.8 < corrected(7.0, 2) < 7.0
    assert math.isclose(corrected(-1.0, 2), -1.0) or corrected(-1.0, 2) <= 0.0
    df = spark.createDataFrame([(8.0, 2), (None, 2)], "s double, n int")
    got = [r[0] for r in df.select(look_elsewhere_sde("s", "n")).collect()]
    assert got[0] == pytest.approx(corrected(8.0, 2)) and got[1] is None
    grid = [(float(z), n) for z in [*np.linspace(-6, 12, 73), 37.0, 40.0, math.inf] for n in (0, 1, 2, 50, 240_000)] + [(math.nan, 2)]
    df = spark.createDataFrame([(i, z, n) for i, (z, n) in enumerate(grid)], "i int, s double, n int")
    for r in df.select("s", "n", look_elsewhere_sde("s", "n").alias("x")).collect():
        want = corrected(r["s"], r["n"])
        assert (r["x"] is None) == (want is None) and (want is None or r["x"] == pytest.approx(want, rel=1e-9, abs=1e-9)), r


def test_nufft_against_direct_sums():
    from curvemill.operators.nufft import Grid
    rng = np.random.default_rng(2)
    for n, rows in ((4000, 3000), (2001, 40), (3, 100), (1, 5)):
        t, y, step = rng.uniform(0, 30, rows), rng.normal(0, 1, rows), 4.95 / max(1, n - 1)
        g = Grid(0.05, step, n)
        g.add(t[: rows // 2], y[: rows // 2]), g.add(t[rows // 2 :], y[rows // 2 :])
        some = np.arange(0, n, max(1, n // 60))
        direct = (y[:, None] * np.exp(2j * np.pi * np.multiply.outer(t, 0.05 + some * step))).sum(0)
        assert np.abs(g.sums()[some] - direct).max() < 1e-9 * np.sqrt(rows)


def test_periodogram_power_of_sliced_and_whole_curves(spark, monkeypatch):
    from curvemill.operators import features, kernels
    from curvemill.operators.skew import census
    rng = np.random.default_rng(4)
    t = np.sort(rng.uniform(0, 27, 900))
    lc = curve(spark, t, 1 + 0.3 * np.sin(2 * np.pi * t * 0.7) + rng.normal(0, 0.1, 900))
    whole = {r["k"]: r["power"] for r in features.lomb_scargle(lc, 400).collect()}
    monkeypatch.setattr(kernels, "GROUP_ROWS", 100)
    cut = {r["k"]: r["power"] for r in features.lomb_scargle(lc, 400, census(lc, ["target"], 100)).collect()}
    assert set(whole) == set(range(400)) and all(whole[k] == pytest.approx(cut[k], rel=1e-8, abs=1e-10) for k in whole)
    y = np.array([whole[k] for k in range(400)])
    assert abs(0.05 + y.argmax() * 4.95 / 399 - 0.7) < 0.02 and 0.5 < y.max() <= 1


@pytest.mark.parametrize("kind", ["plain", "narrow", "ties", "missing"])
def test_dense_windows_match_the_matrix_of_windows(kind, monkeypatch):
    """Windows of hundreds of samples: the form whose cost does not grow with the window gives what the matrix form gives."""
    rng = np.random.default_rng(11)
    n = 3000
    t = np.sort(rng.uniform(0, 2.5, n))
    x = 1 + 3 * np.sin(3 * t) + rng.normal(0, 1e-4, n) if kind == "narrow" else rng.exponential(50.0, n)
    if kind == "ties":
        t, x = np.round(t, 2), np.round(x)
    if kind == "missing":
        x[rng.random(n) < 0.3] = np.nan
    for estimate, off in ((detrend.median_rows, 0.0), (detrend.biweight_rows, 1e-11), (detrend.lowess_rows, 1e-11)):
        got = detrend.trend_of(t, x, 0, n, 0.25, estimate)
        with monkeypatch.context() as m:
            m.setattr(detrend, "DENSE", n + 1)
            want = detrend.trend_of(t, x, 0, n, 0.25, estimate)
        assert np.isfinite(want).all() and np.allclose(got, want, rtol=off, atol=0.0)


def test_dense_windows_are_no_rows_of_a_matrix(monkeypatch):
    t = np.linspace(0, 1, 5000)
    x = np.random.default_rng(2).normal(0, 1, 5000)
    monkeypatch.setattr(detrend, "BLOCK", None)  # what the matrix form divides by the window
    for estimate in detrend.ESTIMATES.values():
        assert np.isfinite(detrend.trend_of(t, x, 0, 5000, 0.25, estimate)).all()


def test_dip_fit_ties_are_kept_beyond_rounding(spark):
    """Grid points without a dip have one chi-square; what sums of many samples add by rounding must not choose among them."""
    g = spark.createDataFrame([("s", j, 8e7 + off, 8e7) for j, off in ((3, 2e-6), (7, 0.0), (9, 4e-6))], "target string, j long, chi2 double, c double")
    g = g.withColumns({n: F.lit(0.0) for n in ("depth", "n", *[f"{a}_{k}" for a in "vh" for k in fit.AXES])})
    assert fit._best(g).first()["j"] == 3


def test_dip_fit_has_no_least_width(spark):
    """A template of width 0 or less fits no sample, however near the middle of an event it lies."""
    lc = spark.createDataFrame([("s", 1.0 + 1e-7, 0.5, 1.0), ("s", 1.3, 1.0, 1.0)], "target string, t double, flux double, _w double")
    centre = {"c_t": 1.0, "c_p": 2.0, "c_w": 0.0, "c_r": 0.5, "h_t": 0.0, "h_p": 0.0, "h_w": 0.1, "h_r": 0.5}
    g = fit._round(lc, spark.createDataFrame([{"target": "s", **centre}]), skew.census(lc, ["target"])).toPandas()
    assert set(g.loc[g["v_w"] <= 0, "depth"]) == {0.0} and set(g.loc[g["v_w"] <= 0, "chi2"]) == {0.25}
    assert (g.loc[g["v_w"] > 0, "chi2"] < 0.25).all()
