"""Novelty scoring of arriving rows and windowed running metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bandweave.operators.neighbors import lof, lof_fit


def novelty_stream(stream: DataFrame, known: DataFrame, sink: str, checkpoint: str, k: int = 7, limit: float = 1.5, only_novel: bool = True) -> StreamingQuery:
    """Score each arriving batch against the known rows and keep the novel ones.

    A batch writes to its own folder and overwrites it when the batch is run again after a failure.
    """

    fitted = lof_fit(known, k)

    def score(batch: DataFrame, batch_id: int) -> None:
        scored = lof(known, batch, k, limit, fitted=fitted)
        kept = scored.where("novel") if only_novel else scored
        kept.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def metric_windows(events: DataFrame, window: str, by=(), ts: str = "ts", value: str = "value", n: str = "n") -> DataFrame:
    """Count-weighted average per tumbling window; the same plan for batch and stream."""
    sums = events.groupBy(F.window(ts, window), *by).agg(F.sum(F.col(value) * F.col(n)).alias("_s"), F.sum(n).alias("count"))
    return sums.select(F.col("window.start").alias("start"), *by, (F.col("_s") / F.col("count")).alias("average"), "count")


def metric_stream(stream: DataFrame, window: str, lateness: str, sink: str, checkpoint: str, by=()) -> StreamingQuery:
    """Windows that the watermark has closed are appended; rows later than the allowed lateness are dropped."""
    closed = metric_windows(stream.withWatermark("ts", lateness), window, by)
    return (
        closed.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
