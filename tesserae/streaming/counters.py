"""Counters over streams of accesses, and upserts of change logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def counts(log: DataFrame) -> DataFrame:
    """Accesses by key; the same for a table and for a stream."""
    return log.groupBy("key").agg(F.count("*").alias("n"))


def windowed(log: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Accesses by tumbling window. late: how long a stream waits for rows that come late."""
    some = log.withWatermark("ts", late) if late and log.isStreaming else log
    return some.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "n")


def run_to_end(df: DataFrame, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and return its result table, which lies beside the checkpoint.

    Each micro-batch is written by the executors, under its number, so a batch that runs again replaces itself; in complete
    mode the last one is the result, else all of them together.
    """
    spark, out = df.sparkSession, checkpoint.rstrip("/") + "-result"

    def batch(some: DataFrame, number: int) -> None:
        some.write.mode("overwrite").parquet(f"{out}/batch={number if mode != 'complete' else 0}")

    query = df.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(out).select(*df.columns)


def apply_changes(changes: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]):
    """Hand each micro-batch of a change stream to a function that writes it; reruns get the same number."""
    query = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def kept_up_to_date(df: DataFrame, checkpoint: str, store: Callable[[DataFrame, int], None], every: str = "1 second"):
    """Hand a stream's counts to a function that stores them, at most once in a while; the running query comes back."""
    return df.writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
