"""Counts per event-time window over a growing folder of files, with late rows told apart."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from communitylens.sources.tables import scan_parquet


def scan_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files under ``path`` as a stream; ``files_per_batch`` bounds a batch."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)


def windowed_counts(rows: DataFrame, time: str, keys: Sequence[str], length: str, late: str, slide: str | None = None) -> DataFrame:
    """(start, end, keys..., count) per window of event time, on a stream or a table.

    On a stream a window's count is kept as state until the watermark, ``late`` behind the latest time seen, has passed its end.
    """
    counted = rows.withWatermark(time, late) if rows.isStreaming else rows
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return counted.groupBy(window.alias("_window"), *keys).agg(F.count("*").alias("count")).select(
        F.col("_window.start").alias("start"), F.col("_window.end").alias("end"), *keys, "count")


class Counter:
    """A running count: what has arrived is counted by ``advance``, ``table`` gives all windows, ``dropped`` the late rows.

    ``folder`` keeps the stream's progress and state and the counts, so a new Counter on the folder goes on where an earlier one
    ended, also after it was broken off: a batch writes its own folder anew when it is repeated.
    """

    def __init__(self, counts: DataFrame, keys: Sequence[str], folder: str):
        self.counts, self.keys, self.folder = counts, list(keys), folder

    def advance(self) -> int:
        """Count all files that have arrived since, batch by batch; the number of rows that came too late."""
        spark, folder = self.counts.sparkSession, self.folder

        def store(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{folder}/counts/run={number}")

        query = (
            self.counts.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress")
            .trigger(availableNow=True).foreachBatch(store).start()
        )
        query.awaitTermination()
        return sum(operator["numRowsDroppedByWatermark"] for progress in query.recentProgress for operator in progress["stateOperators"])

    def table(self) -> DataFrame:
        """(start, end, keys..., count): of every window the count of the last batch that changed it."""
        spark = self.counts.sparkSession
        stored = scan_parquet(spark, f"{self.folder}/counts").drop("run")
        latest = stored.groupBy("start", "end", *self.keys).agg(F.max(F.struct("batch", "count")).alias("_last"))
        return latest.select("start", "end", *self.keys, F.col("_last.count").alias("count"))


def new_folder(root: str) -> str:
    return f"{root}/stream-{uuid.uuid4().hex}"
