"""The box search on small grids: block scan against the plain one, Spark against SQL."""

import numpy as np
import pytest

from check import compare, duck
from curvemill import constants as K
from curvemill.operators import boxscan, search
from curvemill.operators.skew import census
from curvemill.plans import q_search as q
from curvemill.plans.views import ctes, view

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n,even,gap", [(3900, True, False), (700, False, True), (60, True, False), (40, False, False), (3, True, False), (1, True, False)])
def test_block_scan_equals_plain_scan(n, even, gap):
    rng = np.random.default_rng(n)
    t = np.sort(rng.random(n)) * 27.4
    t = np.where(gap & (t > 9), t + 11.3, t) - t[0]
    y = 1 + rng.normal(0, 1e-3, n) - 3e-3 * ((t % 3.3) < 0.12)
    w = np.full(n, 1e6) if even else rng.uniform(1, 9, n) * 1e5
    for top in (2.0, 0.9, 0.3, 0.12):
        f = top - np.arange(150) * 8e-6
        a, b = boxscan.scan_chunk(t, y, w, 1 / f, K.DURATIONS), boxscan.scan_frequencies(t, y, w, f, K.DURATIONS)
        assert (np.isnan(a) == np.isnan(b)).all()
        ok = np.isfinite(a[:, 0])
        assert (a[ok, 1:3] == b[ok, 1:3]).all()
        assert np.allclose(a[ok, 0], b[ok, 0], rtol=1e-9, atol=2e-6) and np.allclose(a[ok, 3], b[ok, 3], rtol=1e-7)
        c = boxscan.scan_frequencies(t, y, w, f, K.DURATIONS, detail=False)
        assert np.allclose(a[ok, 0], c[ok, 0], rtol=1e-9, atol=2e-6)


def test_durations_longer_than_a_period_and_flat_curves():
    t = np.linspace(0, 9, 200)
    assert np.isnan(boxscan.scan_frequencies(t, np.ones(200), np.ones(200), np.array([1.0, 0.7]), K.DURATIONS)[:, 0]).all()
    y = 1 - 0.1 * ((t % 1.0) < 0.1)
    a = boxscan.scan_frequencies(t, y, np.ones(200), np.array([1.0]), [0.1, 1.4])
    assert a[0, 1] == 0 and a[0, 0] > 0


SQL = {
    "periodogram": (lambda lc: search.periodogram(lc, 100, cen=census(lc, ["target"])), """
SELECT target, i, round(period, 6) AS period, round(x.p, 4) AS power, round(x.d, 5) AS depth, x.u AS duration, round(tmin + x.m % period, 6) AS t0 FROM det_pg"""),
    "periodogram_large": (lambda lc: search.periodogram_large(lc, n_periods=100), None),
    "box_search": (lambda lc: search.box_search(lc, 100), f"SELECT {q.DET_COLS} FROM det"),
    "in chunks": (lambda lc: search.box_search_large(lc, chunk=7, n_periods=100), f"SELECT {q.DET_COLS} FROM det"),
}


# depths of some lc_user boxes stand on the edge of rounding
@pytest.mark.parametrize("name,lc", [(n, "lc_type") for n in SQL] + [("box_search", "lc_user"), ("in chunks", "lc_user")])
def test_search_matches_sql_on_a_small_grid(spark, name, lc):
    fn, sql = SQL[name]

    def run(spark, sf):
        out = fn(view(spark, sf, lc))
        if "sde" in out.columns:
            return q.det_out(out)
        rd = q.C.rd
        return out.select("target", "i", rd("period").alias("period"), rd("power", 4).alias("power"), rd("depth", 5).alias("depth"), "duration", rd("t0").alias("t0"))

    status, text, _, _ = compare(spark, duck(SF), run, ctes(lc, more=q.search_sql(lc, 100)) + (sql or SQL["periodogram"][1]), SF)
    assert status == "ok", text


def test_items_grow_with_work_and_fall_with_targets(spark):
    lc = view(spark, SF, "lc_type")
    few, many = (search.work_items(lc, census(lc, ["target"])._replace(n_groups=n), None, 10.0, K.DURATIONS, 0.2, None, 0.5, 13.0).count() for n in (5, 10**6))
    assert many == 5 and few > 50


def test_tasks_follow_the_samples_of_sparse_curves(spark, monkeypatch):
    monkeypatch.setattr(search, "ITEM_WORK", 1_000_000)
    lc = spark.range(40 * 60).selectExpr("concat('U', id % 40) as target", "(id div 40) * 0.5D as t", "1.0D as flux", "1.0D as flux_err")
    # 40 curves of 60 samples in 30 days: 2.9 million points and phase bins each, 22 million if a sample stood in every ten minutes
    items = search.work_items(lc, census(lc, ["target"]), None, 10.0, [0.25, 0.5, 1.0], 0.2, None, 2.0, 13.0)
    assert items.rdd.getNumPartitions() < 40 * 10


@pytest.mark.parametrize("sizes", [[10, 20, 40], [10, 17, 27, 40, 60, 83], [10, 560, 10, 100], [1, 2], [3]])
def test_boxes_add_up(sizes):
    v = np.random.default_rng(0).integers(0, 9, 2000)
    scan, have, cum = boxscan.EvenScan(np.arange(3.0), np.arange(3.0), np.ones(3), [1.0]), {1: v}, np.concatenate(([0], np.cumsum(v)))
    for k, parts in boxscan.box_steps(sizes):
        scan._boxes(have, k, parts)
    for k in sizes:
        assert (have[k][: 2000 - k] == cum[k:-1] - cum[: 2000 - k]).all()


def test_sparse_curves_of_one_weight_take_their_own_scan(monkeypatch):
    rng, used = np.random.default_rng(4), []
    monkeypatch.setattr(boxscan.EvenScan, "block", lambda self, f, nb, detail, out, own=boxscan.EvenScan.block: (used.append(len(f)), own(self, f, nb, detail, out))[1])
    t = np.sort(rng.random(67)) * 30
    t -= t[0]
    f = 0.5 - np.arange(700) * 6e-4
    for y in (50 + rng.normal(0, 20, 67), np.round(rng.normal(50, 2, 67)), np.ones(67)):
        for durations in ([0.25, 0.5, 1.0], [0.5, 0.25, 0.5, 2.5]):  # in any order, repeated, longer than a period
            a, b = boxscan.scan_frequencies(t, y, np.full(67, 1.3), f, durations), boxscan.scan_chunk(t, y, np.full(67, 1.3), 1 / f, durations)
            ok = np.isfinite(b[:, 0]) & (b[:, 0] > 1e-9)  # a flat curve's dips are rounding
            assert np.isfinite(a[ok, 0]).all() and (a[ok, 1:3] == b[ok, 1:3]).all()
            assert np.allclose(a[ok, 0], b[ok, 0], rtol=1e-9, atol=2e-6) and np.allclose(a[ok, 3], b[ok, 3], rtol=1e-7)
    assert sum(used) == 6 * 700
