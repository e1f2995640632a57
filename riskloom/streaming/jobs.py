"""Monitoring on streams of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import is_night, log_amount, time_hours
from ..operators.drift import P_VALUE_THRESHOLD, PSI_THRESHOLD, StoredReference, drift_from_reference, store_reference


def class_rate(events: DataFrame, ts: str, positive: Column, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Positive rate per tumbling window; rows later than ``delay`` are dropped.

    Zone-free timestamps are cast, as a watermark needs an instant. In append mode a window appears
    once the watermark has passed its end; ``write_windows`` gives the open ones as well.
    """
    return (
        events.withColumn("__ts", F.col(ts).cast("timestamp"))
        .withWatermark("__ts", delay)
        .groupBy(F.window("__ts", window).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("positives"))
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "positives",
            (F.col("positives") / F.col("n")).alias("rate"),
        )
    )


def write_windows(rates: DataFrame, path: str, checkpoint: str, window: str = "window_start") -> StreamingQuery:
    """Run windowed totals over what is there now; every window is there once, the last and still open ones too.

    Windows that a batch has changed are written to a folder of their own start, in place of what was there, so that a
    batch that is run again changes nothing.
    """

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(window).parquet(path)

    return rates.writeStream.foreachBatch(replace).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_features(events: DataFrame, amount: str, seconds: str) -> DataFrame:
    """Transaction features of each event, without state."""
    return events.withColumns({"amount_log": log_amount(amount), "time_hours": time_hours(seconds)}).withColumn(
        "is_night", is_night("time_hours")
    )


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over what is there now into Parquet."""
    return (
        df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_drift(
    events: DataFrame,
    reference: DataFrame | StoredReference,
    features: Sequence[str],
    path: str,
    checkpoint: str,
    psi_threshold: float = PSI_THRESHOLD,
    p_threshold: float = P_VALUE_THRESHOLD,
) -> StreamingQuery:
    """Drift of every micro-batch against a stored reference.

    The counts of a reference that is given as a table are written once, beside the stream's own checkpoint; no batch reads the
    table. A batch writes to a folder of its own number, so a batch that is run again replaces its result.
    """
    stored = reference if isinstance(reference, StoredReference) else store_reference(reference, features, f"{checkpoint}-reference")

    def report(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        drift_from_reference(stored, batch, psi_threshold, p_threshold).write.mode("overwrite").parquet(
            f"{path}/batch_id={batch_id}"
        )

    return (
        events.writeStream.foreachBatch(report).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
