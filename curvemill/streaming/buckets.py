"""A table of Parquet folders that micro-batches add to, dealt by a hash of the target into buckets.

A batch writes ``bucket=b/first=n/batch=n`` for the buckets that it touches, and reads back those alone. Once a bucket has more than FOLDERS folders, the batch also writes what
they hold as one, ``first=m/batch=n``, the batches m to n. A reader takes of each bucket the folder that reaches furthest back from its last batch, then goes on before it; folders
that are covered by others are deleted a batch later, when no run that has to be repeated can need them. A batch that is run again writes the same folders again.
"""

from __future__ import annotations

import contextlib
import re
from collections.abc import Callable, Iterable

from pyarrow import ArrowException
from pyarrow.fs import FileSystem
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, FOLDERS = 256, 8
_FOLDER = re.compile(r"^(.*?bucket=(\d+)/first=(\d+)/batch=(\d+))/[^/]*$")


class BucketStore:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.buckets = spark, path, schema, buckets

    def bucket(self, target: str = "target"):
        return F.pmod(F.xxhash64(F.col(target)), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of ``rows``; at most as many as there are."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def folders(self, buckets: Iterable[int] | None = None) -> list[tuple[int, int, int, str]]:
        """``(bucket, first, batch, path)`` of what is there. Only names are read."""
        paths = [self.path] if buckets is None else [f"{self.path}/bucket={b}" for b in buckets]
        if not paths:
            return []
        try:
            names = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(paths)
            found = {_FOLDER.match(r["path"]) for r in names.select("path").collect()}
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":  # nothing stored so far
                raise
            return []
        return sorted({(int(m[2]), int(m[3]), int(m[4]), m[1]) for m in found if m})

    def live(self, buckets: Iterable[int] | None = None, upto: int | None = None) -> list[tuple[int, int, int, str]]:
        """Folders that together hold every batch once, as of batch ``upto``."""
        out, before = [], {}
        there = [f for f in self.folders(buckets) if upto is None or f[2] <= upto]
        for f in sorted(there, key=lambda f: (f[0], -f[2], f[1])):
            if f[2] < before.get(f[0], f[2] + 1):
                out.append(f)
                before[f[0]] = f[1]
        return out

    def read(self, folders: list[tuple[int, int, int, str]]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f[3] for f in folders])

    def write(self, rows: DataFrame, number: int, merge: Callable[[DataFrame], DataFrame] = lambda df: df) -> list[int]:
        """Add a batch; returns the buckets it touches. ``merge`` thins out the rows of a bucket when its folders become one."""
        self._put(rows, number, number)
        buckets = self.touched(rows)
        live = self.live(buckets, number)
        full: dict[int, list] = {}
        for f in live:
            full.setdefault(f[0], []).append(f)
        for first in {min(f[1] for f in own) for own in full.values() if len(own) > FOLDERS}:
            some = [f for own in full.values() if len(own) > FOLDERS and min(f[1] for f in own) == first for f in own]
            self._put(merge(self.read(some)), first, number)
        # covered by a folder of an earlier batch, which is settled
        settled = {f for f in self.live(buckets, number - 1)}
        self._delete([f[3] for f in self.folders(buckets) if f[2] < number and f not in settled])
        return buckets

    def _put(self, rows: DataFrame, first: int, number: int) -> None:
        named = rows.withColumns({"bucket": self.bucket(), "first": F.lit(first), "batch": F.lit(number)})
        named.repartition("bucket").sortWithinPartitions("bucket", "target").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("bucket", "first", "batch").parquet(self.path)

    @staticmethod
    def _delete(paths: list[str]) -> None:
        for path in paths:
            with contextlib.suppress(OSError, ArrowException):  # a store that only Spark deletes from keeps them
                system, inside = FileSystem.from_uri(path)
                system.delete_dir(inside)
