"""Rollups kept up as events arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from footfall.operators.rollups import PAGE_EVENT
from footfall.sources import store


def _with_delay(events: DataFrame, delay: str | None) -> DataFrame:
    """Events whose windows close once they are ``delay`` old; never without a delay.

    Watermarks need a zoned time, so ``time`` becomes one.
    """
    timed = events.withColumn("time", F.col("time").cast("timestamp"))
    return timed.withWatermark("time", delay) if delay else timed


def _plain(time: str) -> Column:
    return F.col(time).cast("timestamp_ntz")


def hourly(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Hourly counts. With a ``delay`` later events are left to ``rollups.reconciled_hours``."""
    return (
        _with_delay(events, delay)
        .groupBy("tenant_id", F.window("time", "1 hour").alias("span"), "event_name")
        .agg(F.count("*").alias("count"))
        .select("tenant_id", _plain("span.start").alias("hour"), "event_name", "count")
    )


def sessions(
    events: DataFrame, visitor: str, gap: str = "30 minutes", delay: str | None = None
) -> DataFrame:
    return (
        _with_delay(events, delay)
        .groupBy("tenant_id", visitor, F.session_window("time", gap).alias("span"))
        .agg(
            F.count("*").alias("events"),
            F.count_if(F.col("event_name") == PAGE_EVENT).alias("page_count"),
            F.max("time").alias("ended_at"),
        )
        .select(
            "tenant_id", visitor, _plain("span.start").alias("started_at"),
            _plain("ended_at").alias("ended_at"), "events", "page_count",
        )
    )


def without_repeats(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event once, if its copies arrive within ``delay`` of each other.

    The clock is that of the micro-batch, not the client's time: no first copy is late, however old it is.
    """
    timed = events.withColumn("_at", F.current_timestamp())
    return timed.withWatermark("_at", delay).dropDuplicatesWithinWatermark(["event_id"]).drop("_at")


def start_append(table: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Rows that will not change any more go to files. Needs a watermark on aggregates."""
    writer = table.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def start_complete(table: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The whole result after each micro-batch, as a new version of the table."""

    def write(result: DataFrame, batch_id: int) -> None:
        result.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    writer = table.writeStream.foreachBatch(write).outputMode("complete")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    newest = store.committed(spark, path, "version")[-1]
    return spark.read.parquet(f"{path}/version={newest}")
