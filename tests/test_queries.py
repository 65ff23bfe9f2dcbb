"""A sample of registered queries against their SQL; ``tools/check.py`` runs them all."""

import pytest

import __spark_entry__ as entry
from check import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = ["scan_quality_masked", "median_normalize", "time_bin_error", "label_koi", "earliest_segment", "plan_take", "confusion_matrix",
          "detrend_biweight", "look_elsewhere_sde", "result_document", "two_stage_draw", "feat_secondary", "pull_stats"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    status, text, _, _ = compare(spark, duck(SF), entry.queries()[name], entry.oracle_sql()[name], SF)
    assert status == "ok", text


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and rows == sorted(rows, key=lambda r: (-r["sde"], r["target"]))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stitched_segments_hold_every_row(spark):
    from curvemill.plans.views import view
    status, text, _, _ = compare(spark, duck(SF), entry.queries()["stitch_segments_whole"], entry.oracle_sql()["stitch_segments_whole"], SF)
    assert status == "ok", text
    rows = {n: sum(r["n"] for r in entry.queries()[n](spark, SF).collect()) for n in ("stitch_segments", "stitch_segments_whole")}
    assert rows["stitch_segments"] == rows["stitch_segments_whole"] == view(spark, SF, "lc_user").count()
