"""Drift of a growing folder of snapshot entries, and windowed counts of events, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from stonecrop.operators import integrity


def windowed_counts(events: DataFrame, time_col: str = "ts", key_col: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, key, n, total) in tumbling windows; rows later than ``late`` are dropped from a stream."""
    rows = events.withWatermark(time_col, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time_col, window).alias("w"), F.col(key_col).alias("key")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "key", "n", "total")


def watch(spark: SparkSession, folder: str, before: DataFrame, checkpoint: str, act: Callable[[DataFrame, DataFrame | None, int], None], mode: str = "fast", gates: dict[str, float] | None = None, once: bool = True) -> StreamingQuery:
    """For each batch of new entry files in ``folder``: what changed against ``before``, and the gates on the counts of changes.

    A batch says nothing of entries it doesn't hold, so missing ones aren't told. ``act`` gets the changes, the gates'
    results or None, and the batch's number. A gate is a status with the most that may be so.
    """
    def batch(df: DataFrame, number: int) -> None:
        changes = integrity.diff(before, df, mode).filter("status <> 'missing'")
        passed = None
        if gates:
            counts = integrity.drift(changes)
            report = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in counts.columns])).alias("x")).select("x.*")
            table = df.sparkSession.createDataFrame([(k, float(v)) for k, v in gates.items()], "gate string, threshold double")
            passed = table.join(report, table["gate"] == report["metric"]).select("gate", "threshold", F.col("value").alias("actual"), (F.col("value") <= F.col("threshold")).alias("passed"))
        act(changes, passed, number)

    stream = spark.readStream.schema(before.schema).parquet(folder)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


