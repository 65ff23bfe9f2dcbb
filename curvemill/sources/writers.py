"""Curves, shards, tables, catalogues, failure logs and reports out. All go through Spark's commit
protocol, so a killed job leaves no half-written result."""

from __future__ import annotations

import contextlib
import uuid

from pyarrow import ArrowException
from pyarrow.fs import FileSystem
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_curves(lc: DataFrame, path: str, files: int | None = None) -> None:
    """Curves range-partitioned and sorted by (target, t): point reads skip row groups, and a hot target
    spreads over several files."""
    n = [files] if files else []
    lc.repartitionByRange(*n, "target", "t").sortWithinPartitions("target", "t").write.mode("overwrite").parquet(path)


def append_shard(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_table(df: DataFrame, path: str, keep: int = 2) -> None:
    """A new version beside the old ones, then one row that makes it current; ``readers.read_table`` follows the last such row.

    Readers see the old version until then, and for good if the writer dies. Of older versions, ``keep`` stay for readers that still use them. The rows may come from the table itself.
    """
    spark = df.sparkSession
    try:
        old = [(r["number"], r["folder"]) for r in spark.read.parquet(f"{path}/commits").orderBy(F.col("number").desc(), F.col("folder").desc()).collect()]
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        old = []
    folder = f"version-{uuid.uuid4().hex[:12]}"
    df.write.parquet(f"{path}/{folder}")
    spark.createDataFrame([(old[0][0] + 1 if old else 0, folder)], "number bigint, folder string").coalesce(1).write.mode("append").parquet(f"{path}/commits")
    for _, name in old[keep:]:
        with contextlib.suppress(OSError, ArrowException):  # gone already, or in a store that only Spark deletes from
            system, inside = FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
            system.delete_dir(f"{inside}/{name}")


def write_ranked_csv(df: DataFrame, path: str, order: list[Column]) -> None:
    """Part files in rank order, each with a header."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def write_failures(df: DataFrame, path: str) -> None:
    df.where(F.col("error").isNotNull()).write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A nested report as JSON lines."""
    df.write.mode("overwrite").json(path)
