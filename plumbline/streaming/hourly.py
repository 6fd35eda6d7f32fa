"""Streams: hourly means with a watermark, and estimates for points as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.predict import bme_predict


def hourly_stream(events: DataFrame, ts: str = "ts", by: str = "site", value: str = "value", late: str = "2 hours") -> DataFrame:
    """Means and counts by site and hour; hours close once the watermark has passed them."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w"), by).agg(F.avg(value).alias("mean"), F.count(value).alias("n")).select(F.col("w.start").alias("hour"), by, "mean", "n")


def estimate_stream(points: DataFrame, hard: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Estimates of each micro-batch of (est_id, coords) against a table of hard data, appended as Parquet; a replayed batch overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        bme_predict(batch, hard, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
