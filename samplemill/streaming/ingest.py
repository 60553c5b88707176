"""Incremental forms: ingest, de-duplication, running counts and resuming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samplemill.operators.filters import drop_ids
from samplemill.plans.session import work_path
from samplemill.sources.files import META_SCHEMA, meta_columns


def table_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as they arrive; what matches ``pattern`` may also be a table of several files in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # Braces make a pattern of a plain name, too; a path that is none would have to be a folder.
    return reader.parquet(f"{folder}/{{{pattern}}}")


def meta_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata CSV files of a folder as they arrive."""
    return meta_columns(spark.readStream.schema(META_SCHEMA).option("header", "true").csv(folder))


def drain(stream: DataFrame, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Process all that has arrived into Parquet and return the stored rows.

    Output and checkpoint lie in the shared folder; a second call with the same ``path``
    goes on where the first one stopped.
    """
    spark = stream.sparkSession
    target = path or work_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", f"{target}-state")
        .trigger(availableNow=True)
        .start(target)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def dedup_stream(stream: DataFrame, digest: str, ts: str, delay: str) -> DataFrame:
    """First arrival per digest; copies up to ``delay`` apart are dropped, state older than that is freed."""
    timed = stream.withColumn("_at", F.col(ts).cast("timestamp"))
    return timed.withWatermark("_at", delay).dropDuplicatesWithinWatermark([digest]).drop("_at")


def running_counts(stream: DataFrame, key: str, name: str, path: str | None = None) -> DataFrame:
    """Counts per key over all that has arrived so far.

    Each micro-batch adds its own partial counts as a Parquet part named by the batch, which
    makes a repeated batch harmless; the total is the sum of the parts.
    """
    spark = stream.sparkSession
    target = path or work_path(spark, name)
    schema = T.StructType([stream.schema[key], T.StructField("n", T.LongType())])

    def add(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(add)
        .option("checkpointLocation", f"{target}-state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    # Before anything has arrived there is no folder yet.
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{target}/batch=-1")
    return spark.read.schema(schema).parquet(target).groupBy(key).agg(F.sum("n").cast("bigint").alias("n"))


def resume(todo: DataFrame, key: str, done: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply ``work`` to the ids that are not finished and add the finished rows."""
    return done.unionByName(work(drop_ids(todo, done, key)))
