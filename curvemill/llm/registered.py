"""The queries of this subpackage, and the SQL that some are checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` gives the same rows in DuckDB."""

    def register(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MODULES = ["q_url_filter", "q_warc", "q_pivot_index", "q_attention_quality", "q_jaccard_join", "q_fuzzy_lines", "q_containment", "q_mixing", "q_backoff_lm", "q_secret_forest",
           "q_cuckoo_index", "q_active_codes", "q_mask_search"]

for _name in MODULES:
    importlib.import_module(f"curvemill.llm.{_name}")


@query("pipeline")
def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports the operators and their queries itself

    return corpus_pipeline.run(spark, sf_dir)
