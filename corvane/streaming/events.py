"""Structured streams over a folder of events: late rows, counts of windows, repeated deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import shared_folder


def deliver(events: DataFrame, number: Column, n: int) -> str:
    """Write events as n deliveries, one after the other, by their number from 0, and give their folder.

    The order of a file stream is that of the files' times, so each delivery is a later batch than the one before.
    """
    folder = shared_folder(events.sparkSession, "deliveries")
    numbered = events.withColumn("__number", number)
    for i in range(n):
        numbered.where(F.col("__number") == i).drop("__number").coalesce(1).write.mode("append").parquet(folder)
    return folder


def event_stream(spark: SparkSession, path: str, time: str = "ts", files_per_batch: int | None = 1) -> DataFrame:
    """The files of path (a folder or one file) as a stream, with time as a timestamp that watermarks take."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream takes a single file by a pattern only
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(pattern).withColumn(time, F.col(time).cast("timestamp"))


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """window_start, kind, n_events, total: counts of tumbling windows; rows later than `late` are dropped. Null times count nowhere."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), kind, "n_events", "total")


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """The first row of each key within the watermark; keys are forgotten after `late`, so state stays bounded."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def drain_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run an aggregating stream over all there is; its latest row for each of keys.

    Each batch is written under its number, so a batch that is repeated after a failure replaces itself.
    """
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession, "stream")
    out = f"{folder}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(out)
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("__row"))
    return latest.select(*keys, *(F.col(f"__row.{v}").alias(v) for v in values))


def drain_rows(stream: DataFrame) -> DataFrame:
    """Run a stream that only appends over all there is; its rows."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession, "stream")
    stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").start(f"{folder}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
