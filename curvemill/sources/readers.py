"""Curves, target lists, catalogues and result shards in."""

from __future__ import annotations

import sys

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CURVE_SCHEMA = T.StructType([
    T.StructField("target", T.StringType()), T.StructField("t", T.DoubleType()), T.StructField("flux", T.DoubleType()),
    T.StructField("flux_err", T.DoubleType()), T.StructField("quality", T.IntegerType())])

CATALOGUE_SCHEMA = T.StructType([
    T.StructField("target", T.StringType()), T.StructField("mission", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("published_period", T.DoubleType()), T.StructField("mag", T.DoubleType())])


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CURVE_SCHEMA).parquet(path)


def read_target(spark: SparkSession, path: str, ident: str, prefix: str) -> DataFrame:
    """One star's curve; the prefix is added if the id comes without. Unknown ids give no rows.

    Curves written by ``write_curves`` are sorted by target, so all other row groups are skipped.
    """
    stem = ident if ident.startswith(prefix) else f"{prefix}{ident}"
    return read_curves(spark, path).where(F.col("target") == stem)


def read_directory(spark: SparkSession, path: str, glob: str = "*.parquet", pattern: str = r"([^/]+)\.parquet$") -> DataFrame:
    """Every curve file below a directory; the target is what ``pattern`` finds in the file's path."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).parquet(path)
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias("target"), "t", "flux")


def read_target_list(spark: SparkSession, path: str) -> DataFrame:
    """One id per line, trimmed, blank lines dropped."""
    ids = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"[\t\r]", " ")).alias("target"))
    return ids.where(F.length("target") > 0)


def read_catalogue(spark: SparkSession, path: str, schema: T.StructType = CATALOGUE_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All readable shards; files cut short by a killed writer are skipped, no files give no rows. ``shard_files`` tells which were skipped."""
    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def shard_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``(path, length, n_rows, broken)`` of every file below ``path``.

    Row counts come from a read of no column, which touches footers alone. Of files that gave no row the ends are looked at, never the whole: whole ones begin and
    end with Parquet's mark and hold the footer that they name. The ends are read through ``pyarrow.fs``.
    """
    if not _present(spark, path):
        return spark.createDataFrame([], "path string, length bigint, n_rows bigint, broken boolean")
    rows = read_shards(spark, path, schema).select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    # both name a file by its URI, with one slash or three after the scheme
    name = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    listed = files.select("path", "length").join(rows.select(name(F.col("file")).alias("_key"), "n_rows"), name(F.col("path")) == F.col("_key"), "left")
    ends = listed.select("path", "length", "n_rows").repartition("path").mapInPandas(_ends, "path string, length bigint, n_rows bigint, head binary, tail binary")
    mark = F.lit(b"PAR1")
    # the footer's length, little-endian, in the four bytes before the last mark
    footer = F.conv(F.concat(*[F.hex(F.expr(f"substring(tail, {k}, 1)")) for k in (4, 3, 2, 1)]), 16, 10).cast("bigint")
    whole = (F.col("length") >= 12) & (F.col("head") == mark) & (F.expr("substring(tail, 5, 4)") == mark) & (footer <= F.col("length") - 12)
    broken = F.col("n_rows").isNull() & ~F.coalesce(whole, F.lit(False))
    return ends.select("path", "length", F.coalesce("n_rows", F.lit(0).cast("bigint")).alias("n_rows"), broken.alias("broken"))


def _ends(batches):
    """Add the first four and the last eight bytes of files that gave no row, all that is read of them."""
    for pdf in batches:
        head, tail = [], []
        for path, length, n in zip(pdf["path"], pdf["length"], pdf["n_rows"]):
            if n == n and n is not None or length < 12:
                head.append(None)
                tail.append(None)
                continue
            system, inside = FileSystem.from_uri(path)
            with system.open_input_file(inside) as f:
                head.append(f.read_at(4, 0))
                tail.append(f.read_at(8, length - 8))
        yield pdf.assign(n_rows=pdf["n_rows"].astype("Int64"), head=pd.Series(head, dtype=object, index=pdf.index), tail=pd.Series(tail, dtype=object, index=pdf.index))


def _present(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").isEmpty()
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table that ``writers.replace_table`` wrote."""
    last = spark.read.parquet(f"{path}/commits").orderBy(F.col("number").desc(), F.col("folder").desc()).first()
    return spark.read.parquet(f"{path}/{last['folder']}")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
