"""Tables read as streams, and live counters over them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet file or folder as a stream, with the schema it has now."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # A pattern, so that a single file may be given as well as a folder.
    return reader.parquet(path[:-1] + f"[{path[-1]}]")


def run_to_files(stream: DataFrame, folder: str) -> DataFrame:
    """Process all available input into Parquet files and read them back."""
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .option("path", f"{folder}/out")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def counters(
    events: DataFrame, window: Column | Callable[[], Column], keys: Sequence[str], time: str = "timestamp", late: str = "1 hour"
) -> DataFrame:
    """Counts per time window and key; events later than the watermark are dropped.

    ``window`` is F.window(...) for tumbling or sliding windows, or
    F.session_window(...). Counting is partial before the shuffle.
    """
    span = window() if callable(window) else window
    return (
        events.withWatermark(time, late)
        .groupBy(span.alias("span"), *keys)
        .agg(F.count("*").alias("n"))
        .select(F.col("span.start").alias("start"), F.col("span.end").alias("end"), *keys, "n")
    )


def run_counters(counts: DataFrame, folder: str, keys: Sequence[str]) -> DataFrame:
    """Run counters over all available input; the latest count of each window.

    Updates of each micro-batch go to their own folder; the newest one wins.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    query = (
        counts.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    updates = counts.sparkSession.read.parquet(f"{folder}/counts")
    return updates.groupBy("start", "end", *keys).agg(F.max_by("n", "batch").alias("n"))
