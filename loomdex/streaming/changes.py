"""The change log as a stream: new runs' changes, deduplicated within a watermark, counted by window or merged into a latest-state table."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.operators import changes
from loomdex.schema import TABLES


def read(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """Rows of an append-only Parquet log as they come."""
    return spark.readStream.schema(schema or TABLES["changes"]).parquet(folder)


def once(stream: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each change once, though a file may be delivered again; rows later than ``late`` are past."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def counts(stream: DataFrame, window: str = "1 hour", slide: str | None = None, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """window_start, change_type, n for tumbling or sliding windows of event time."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    agg = stream.withWatermark(ts, late).groupBy(w, "change_type").agg(F.count("*").alias("n"))
    return agg.select(F.col("window.start").alias("window_start"), "change_type", "n")


def keep_latest(stream: DataFrame, folder: str, keys: list[str], order: list[str], checkpoint: str):
    """A query that keeps the last row of each key in ``folder``: a micro batch is merged and the pointer moves in one step.

    A batch that is delivered again gives the same folder again, so the result is exactly-once.
    """
    import os

    def merge(batch: DataFrame, epoch: int) -> None:
        spark, pointer = batch.sparkSession, Path(folder) / "current"
        old = pointer.read_text("utf-8").strip() if pointer.exists() else ""
        if old and int(old) >= epoch + 1:
            return
        every = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{folder}/{old}")) if old else batch
        changes.last_per_key(every, keys, order).select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/{epoch + 1}")
        step = Path(folder) / ".current"
        step.write_text(str(epoch + 1), encoding="utf-8")
        os.replace(step, pointer)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """What ``keep_latest`` has so far."""
    return spark.read.parquet(f"{folder}/{(Path(folder) / 'current').read_text('utf-8').strip()}")
