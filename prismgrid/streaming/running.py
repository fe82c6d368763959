"""Incremental jobs: background moments as tiles arrive, detection frequency as members finish."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.rules import ratio
from ..operators.moments import background_moments, merge_moments


def start_moments(
    tiles: DataFrame, state: str, checkpoint: str, keys: list[str], bands: list[int], width: int, refl: str = "refl", available_now: bool = True
) -> StreamingQuery:
    """Keep one moment state per micro-batch and key below ``state``.

    A batch writes its own folder, replacing an earlier attempt of the same batch, so a retry after a lost
    executor or a restart does not count pixels twice.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        background_moments(batch, keys, bands, width, refl).write.mode("overwrite").parquet(os.path.join(state, f"batch_id={batch_id}"))

    writer = tiles.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_moments(spark: SparkSession, state: str, keys: list[str]) -> DataFrame:
    """Merged moments over all batches so far."""
    parts = spark.read.parquet(state)
    return merge_moments(parts, keys)


def running_frequency(members: DataFrame, pixel: list[str], member: str = "member_id", delivered: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Streaming detections over valid members per pixel; a member delivered again counts once.

    With a delivery timestamp the duplicate state is bounded by the watermark.
    """
    ids = [member, *pixel]
    once = members.withWatermark(delivered, delay).dropDuplicatesWithinWatermark(ids) if delivered else members.dropDuplicates(ids)
    out = once.groupBy(*pixel).agg(
        F.sum(F.when(F.col("valid") & F.col("detected"), 1).otherwise(0)).alias("n_detected"), F.count_if("valid").alias("n_valid")
    )
    return out.withColumn("frequency", ratio("n_detected", "n_valid"))


def start_frequency(frequency: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write the changed pixels of every micro-batch to their own folder (update mode)."""
    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(target, f"batch_id={batch_id}"))

    writer = frequency.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_frequency(spark: SparkSession, target: str, pixel: list[str]) -> DataFrame:
    """The newest row of every pixel."""
    rows = spark.read.parquet(target)
    names = [c for c in rows.columns if c not in {*pixel, "batch_id"}]
    newest = F.max_by(F.struct(*names), "batch_id")
    return rows.groupBy(*pixel).agg(newest.alias("_r")).select(*pixel, "_r.*")
