"""Jobs that process new files once and resume after a kill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvemill.functions import columns as C
from curvemill.operators.skew import first_per_key
from curvemill.streaming.buckets import BUCKETS, BucketStore


def incremental(spark: SparkSession, source: str, schema: T.StructType, fn: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
                max_files: int | None = None, every: str | None = None, buckets: int = BUCKETS):
    """Keep one row of ``fn`` per target up to date while files arrive; read them with ``latest``.

    A micro-batch stores its samples, and ``fn`` runs over all samples, of this batch and earlier ones, of the targets that it touches. So a
    target whose samples come in several files, batches or runs has a right row. Samples and rows are dealt into buckets by target: a batch reads those that it touches, sorted by target,
    and no others, and their folders are merged as they add up (`BucketStore`). A batch that is run again after a kill is not counted twice. ``every`` (such as "60 seconds")
    keeps the job alive; without it the job ends when all present files are done.
    """
    read = spark.readStream.schema(schema)
    if max_files:
        read = read.option("maxFilesPerTrigger", max_files)
    samples = BucketStore(spark, f"{out}/samples", schema, buckets)

    def write(batch: DataFrame, number: int) -> None:
        touched = samples.write(batch, number)
        if not touched:
            return
        own = samples.read([f for f in samples.folders(touched) if f[1] == f[2] == number]).select("target").distinct()
        known = samples.read(samples.live(touched, number)).join(own, "target", "left_semi")
        rows = fn(known).withColumn("made_in", F.lit(number).cast("long"))
        BucketStore(spark, f"{out}/rows", rows.schema, buckets).write(rows, number, _newest)

    job = read.parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    job = job.trigger(processingTime=every) if every else job.trigger(availableNow=True)
    return job.start()


def _newest(rows: DataFrame) -> DataFrame:
    return first_per_key(rows, ["target"], [-F.col("made_in")])


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The row of each target from the last batch that touched it."""
    names = BucketStore(spark, f"{out}/rows", T.StructType([]))
    folders = names.live()
    schema = spark.read.parquet(folders[0][3]).schema
    return _newest(BucketStore(spark, f"{out}/rows", schema).read(folders)).drop("made_in")


def merge_settled(df: DataFrame) -> DataFrame:
    """One row per target: a success, else a settled failure, else a retryable one."""
    order = [F.col("error").isNotNull(), ~C.settled(), F.col("seed"), F.col("shard"), F.col("label_idx")]
    return first_per_key(df, ["target"], order)


def settled_store(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str):
    """Add new attempts to an append-only store, skipping targets settled earlier. Read the store through
    ``merge_settled``.

    What is known of a target is the state of the stream, one row, so a batch reads nothing of the store. It is the smallest row, in Spark's own
    aggregate: settled attempts come first, by the time of their micro-batch, so none of a later batch takes their place; the time also tells whether a row is new.
    A batch that is run again has the same time. For more targets than executors hold in memory, choose RocksDB as the session's state store.
    """
    rows = spark.readStream.schema(schema).parquet(source).withColumn("_seen", F.current_timestamp())
    open_ = ~C.settled()
    order = F.struct(open_.alias("o"), F.when(~open_, F.col("_seen")).alias("s"), F.col("error").isNotNull().alias("f"), "seed", "shard", "label_idx",
                     F.col("_seen").alias("since"), *[F.col(c).alias(f"_{c}") for c in schema.names])
    best = rows.groupBy("target").agg(F.min(order).alias("_b"), F.max("_seen").alias("_last"))
    best = best.where(F.col("_b.since") == F.col("_last")).select(*[F.col(f"_b._{c}").alias(c) for c in schema.names])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return best.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
