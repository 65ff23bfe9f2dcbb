"""Hot groups: the range-partitioned paths must give what the plain ones give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curvemill.operators import cells, skew

LIMIT = 100


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(1)
    n = 1500
    pdf = pd.DataFrame({"target": ["hot"] * n + ["a"] * 40 + ["b"] * 7, "t": np.r_[rng.permutation(n) * 0.01, np.arange(40) * 0.1, np.arange(7) * 1.0],
                        "flux": np.round(np.r_[rng.normal(size=n), rng.normal(size=47)], 1)})
    pdf["x"] = np.where(rng.random(len(pdf)) < 0.3, np.nan, pdf["flux"])
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    cen = skew.census(df, ["target"], LIMIT)
    assert cen.heavy == [("hot",)] and cen.n_groups == 3 and cen.n_rows == n + 47
    return pdf, df, cen


def test_quantiles_match_numpy(hot):
    pdf, df, cen = hot
    got = {r["target"]: r for r in skew.grouped_quantiles(
        df, ["target"], {"q": ("flux", [0.0, 0.02, 0.5, 0.98, 1.0]), "m": ("x", 0.5)}, cen, LIMIT, [F.count(F.lit(1)).alias("n")]).collect()}
    for name, g in pdf.groupby("target"):
        assert np.allclose(got[name]["q"], np.quantile(g["flux"], [0, 0.02, 0.5, 0.98, 1.0]), atol=1e-12)
        assert got[name]["m"] == pytest.approx(np.nanmedian(g["x"]), abs=1e-12)
        assert got[name]["n"] == len(g)


def test_quantiles_of_copies(spark):
    """A group made of copies of one row is cut too."""
    df = spark.range(5000).select(F.lit("c").alias("target"), F.when(F.col("id") < 4000, 2.0).otherwise(F.col("id").cast("double")).alias("flux"))
    got = skew.grouped_quantiles(df, ["target"], {"m": ("flux", 0.5), "hi": ("flux", 1.0)}, limit=LIMIT).first()
    assert got["m"] == 2.0 and got["hi"] == 4999.0


def test_all_null_group_keeps_its_row(spark):
    df = spark.range(500).select(F.lit("c").alias("target"), F.lit(None).cast("double").alias("flux"))
    assert skew.grouped_quantiles(df, ["target"], {"m": ("flux", 0.5)}, limit=LIMIT).first()["m"] is None


def test_row_number(hot):
    pdf, df, cen = hot
    got = skew.grouped_row_number(df, ["target"], {"t": F.col("t")}, cen, limit=LIMIT).toPandas()
    assert len(got) == len(pdf)
    for _, g in got.groupby("target"):
        assert list(g.sort_values("t")["rn"]) == list(range(1, len(g) + 1))


def test_cells_gaps_rank_and_bridges(hot):
    pdf, df, cen = hot
    gaps = cells.sample_gaps(df, cen, LIMIT).toPandas()
    assert len(gaps) == len(pdf) - 3
    assert np.allclose(gaps.loc[gaps.target == "hot", "dt"], 0.01)
    ranks = cells.time_rank(df, cen, limit=LIMIT).toPandas()
    for _, g in ranks.groupby("target"):
        assert list(g.sort_values("t")["rn"]) == list(range(1, len(g) + 1))
    filled = cells.interpolate(df, "x", cen, LIMIT).toPandas()
    for name, g in filled.groupby("target"):
        g, src = g.sort_values("t"), pdf[pdf.target == name].sort_values("t")
        ok = src["x"].notna()
        assert np.allclose(g["x"], np.interp(src["t"], src["t"][ok], src["x"][ok]), atol=1e-9)


def test_first_per_key(hot):
    _, df, _ = hot
    got = skew.first_per_key(df, ["target"], [F.col("t")]).toPandas()
    assert len(got) == 3 and set(got["t"]) == {0.0}


def test_every_group_heavy(hot):
    """With too many heavy groups to name, all rows take the range-partitioned path."""
    pdf, df, cen = hot
    got = skew.grouped_quantiles(df, ["target"], {"m": ("flux", 0.5)}, cen._replace(heavy=skew.EVERY), LIMIT).toPandas().set_index("target")["m"]
    for name, g in pdf.groupby("target"):
        assert got[name] == pytest.approx(g["flux"].median(), abs=1e-12)
