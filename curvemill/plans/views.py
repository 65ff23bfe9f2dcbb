"""Curve, catalogue and prediction views derived from the given tables, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_T_SPARK = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 8.64E10"
_T_DUCK = "date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 8.64E10"

# view -> (table, select list, distinct key column or None)
_VIEWS: dict[str, tuple[str, list[str], str | None]] = {
    "lc_user": ("events", [
        "concat('U', CAST(user_id AS STRING)) AS target", f"{_T_SPARK} AS t", "value AS flux",
        "1.0E0 + (event_id % 7) * 1.0E-1 AS flux_err",
        "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS quality"], None),
    "lc_type": ("events", [
        "event_type AS target", f"{_T_SPARK} AS t", "value AS flux",
        "1.0E0 + (event_id % 7) * 1.0E-1 AS flux_err",
        "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS quality"], None),
    "det_user": ("events", [
        "concat('U', CAST(user_id AS STRING)) AS target", "1.0E0 + (user_id % 50) * 1.0E-1 AS period",
        "(user_id % 10) * 5.0E-2 AS t0", "2.5E-1 AS duration", "1.0E1 AS depth",
        "5.0E0 + (user_id % 40) * 1.0E-1 AS sde"], "user_id"),
    "det_type": ("events", [
        "event_type AS target", "1.0E0 + length(event_type) * 2.5E-1 AS period", "4.0E-1 AS t0",
        "2.5E-1 AS duration", "1.0E1 AS depth", "4.0E0 + length(event_type) * 6.0E-1 AS sde"], "event_type"),
    "koi": ("orders", [
        "o_custkey AS kepid",
        "CASE o_orderstatus WHEN 'O' THEN 'CONFIRMED' WHEN 'F' THEN 'FALSE POSITIVE' ELSE 'CANDIDATE' END AS koi_disposition",
        "CASE WHEN (o_orderkey & 1) > 0 THEN 1 ELSE 0 END AS nt",
        "CASE WHEN (o_orderkey & 2) > 0 THEN 1 ELSE 0 END AS ss",
        "CASE WHEN (o_orderkey & 4) > 0 THEN 1 ELSE 0 END AS co",
        "CASE WHEN (o_orderkey & 8) > 0 THEN 1 ELSE 0 END AS ec",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'tess' ELSE 'kepler' END AS mission",
        "9.0E0 + (o_custkey % 600) * 1.0E-2 + (o_orderkey % 7) * 1.0E-3 AS mag",
        "5.0E-1 + (o_orderkey % 120) * 1.0E-1 AS published_period", "o_orderkey AS row_id"], None),
    "attempts": ("lineitem", [
        "concat('KIC ', CAST(l_partkey AS STRING)) AS target", "l_suppkey % 4 AS label_idx",
        "l_linenumber AS shard", "l_orderkey AS seed",
        "CASE l_returnflag WHEN 'N' THEN NULL WHEN 'R' THEN concat('no detection (SDE 6.', CAST(l_linenumber AS STRING), ')')"
        " ELSE 'TimeoutError: call exceeded the wall-clock deadline of 420 s' END AS error"], None),
    "obs": ("orders", [
        "o_orderkey AS obsid", "o_custkey AS target",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 7 END AS sequence_number",
        "o_orderpriority AS provenance", "60 + o_orderkey % 150 AS t_exptime"], None),
    "prod": ("lineitem", [
        "l_orderkey AS obsid", "CASE l_returnflag WHEN 'N' THEN 'LC' ELSE 'TP' END AS subgroup",
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('uri:', CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING)) END AS data_uri"], None),
    "manifest": ("customer", [
        "concat('KIC ', CAST(c_custkey AS STRING)) AS target",
        "CASE WHEN c_nationkey % 2 = 0 THEN 'kepler' ELSE 'tess' END AS mission",
        "6.0E0 + (c_custkey % 900) * 1.0E-2 AS mag", "c_custkey % 6 AS segment"], None),
    "pred": ("embeddings", [
        "vec_id", "vec_id % 50 AS target", "label % 4 AS y_true",
        *[f"CAST(embedding[{i}] AS DOUBLE) AS s{i}" for i in range(4)]], None),
    "recovery": ("lineitem", [
        "l_orderkey AS seed", "l_linenumber AS k", "l_extendedprice * 1.0E-7 AS true_depth",
        "l_extendedprice * 1.0E-7 * (9.5E-1 + l_discount) AS fit_depth",
        "l_extendedprice * 1.0E-7 * l_tax AS fit_depth_err", "l_quantity * 2.5E-1 AS true_period",
        "l_quantity * 2.5E-1 * CASE l_returnflag WHEN 'N' THEN 1.0E0 WHEN 'A' THEN 2.0E0 ELSE 1.3E0 END AS fit_period",
        "l_returnflag <> 'R' AS detected"], None),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, cols, distinct = _VIEWS[name]
    df = table(spark, sf_dir, source)
    if distinct:
        df = df.select(distinct).distinct()
    return df.selectExpr(*cols)


def _duck(name: str) -> str:
    source, cols, distinct = _VIEWS[name]
    text = ", ".join(cols).replace(_T_SPARK, _T_DUCK)
    for i in range(3, -1, -1):
        text = text.replace(f"embedding[{i}]", f"embedding[{i + 1}]")
    frm = f"(SELECT DISTINCT {distinct} FROM {source}) u" if distinct else source
    return f"{name} AS (SELECT {text} FROM {frm})"


def ctes(*names: str, more: str = "") -> str:
    """``WITH`` clause holding the named views, plus further CTE text."""
    return "WITH " + ", ".join(_duck(n) for n in names) + (f", {more}" if more else "") + " "
