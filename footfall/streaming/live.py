"""Live feed, rooms and realtime numbers as events are stored."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from footfall.operators import live, stats
from footfall.operators.scope import TenantScope
from footfall.sources import store

#: The longest span, in hours, at whose multiples subscriptions are cut.
MOST_HOURS = 24


@dataclass(frozen=True)
class LiveFeed:
    """The newest events per tenant. A batch merges into the version before it."""

    spark: SparkSession
    path: str

    def _version(self, before: int | None = None) -> DataFrame | None:
        versions = store.committed(self.spark, self.path, "version")
        if before is not None:
            versions = [n for n in versions if n < before]
        if not versions:
            return None
        return self.spark.read.parquet(f"{self.path}/version={versions[-1]}")

    def process(self, events: DataFrame, batch_id: int) -> None:
        feed = self._version(before=batch_id)
        merged = live.newest(events) if feed is None else live.merged_feed(feed, events)
        merged.write.mode("overwrite").parquet(f"{self.path}/version={batch_id}")

    def start(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        writer = events.writeStream.foreachBatch(self.process)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def read(self) -> DataFrame:
        return self._version()


def refresh_realtime(
    events: DataFrame, tenant_id: str, path: str, batch_id: int, as_of: datetime | None = None
) -> None:
    """Exact realtime numbers of a tenant from the stored events, as the table's next version."""
    numbers = stats.realtime(TenantScope(events, tenant_id), as_of)
    numbers.write.mode("overwrite").parquet(f"{path}/version={batch_id}")


def _span_hours(spark: SparkSession, delay: str) -> int:
    """An eighth of the delay, from an hour to ``MOST_HOURS``."""
    delayed = F.timestamp_seconds(F.lit(0)) + F.lit(delay).cast("interval")
    return min(MOST_HOURS, max(1, spark.range(1).select(F.unix_seconds(delayed)).first()[0] // 8 // 3600))


def fan_out_stream(
    events: DataFrame, subscriptions: DataFrame, delay: str = "1 hour", salts: int = 8
) -> DataFrame:
    """Which subscriber gets which event: those in the tenant's room at the time the event was stored.

    ``events`` is a stream of tenant_id, event_id, time and any other columns, ``subscriptions`` one of subscriber_id, tenant_id,
    joined_at and left_at (not in the room any more). Either may come first, and up to ``delay`` late. Subscriptions are cut at full
    spans of some hours, so rows meet by tenant and span, and a piece's state goes once its span is ``delay`` past. The events of a tenant
    and span are dealt over ``salts`` parts, each of which holds the pieces of that span once.

    Pieces are most of the state, so spans are as long as an eighth of ``delay``, which keeps state little longer and makes fewer
    pieces. Rows hold nothing twice and meet by one number made of tenant, span and part; the tenants themselves are compared afterwards.
    """
    hours = _span_hours(events.sparkSession, delay)
    span_s = hours * 3600
    span = lambda at: F.floor(F.unix_seconds(at) / span_s).cast("long")
    others = [c for c in events.columns if c != "time"]
    at = F.col("time").cast("timestamp")
    part = F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int")
    timed = events.select(*others, at.alias("at"), F.xxhash64("tenant_id", span(at), part).alias("met_by")).withWatermark("at", delay)
    begin, end = (F.col(name).cast("timestamp") for name in ("joined_at", "left_at"))
    last = F.timestamp_micros(F.unix_micros(end) - 1)
    pieces = (
        subscriptions.where(begin < end)
        .select("subscriber_id", F.col("tenant_id").alias("room_tenant"), begin.alias("begin"), end.alias("end"), F.explode(F.sequence(span(begin), span(last))).alias("piece"))
        .withColumn("from_at", F.greatest("begin", F.timestamp_seconds(F.col("piece") * span_s)))
        .withColumn("room_part", F.explode(F.array(*map(F.lit, range(salts)))))
        .select("subscriber_id", "room_tenant", "end", "from_at", F.xxhash64("room_tenant", "piece", "room_part").alias("room_met_by"))
        .withWatermark("from_at", delay)
    )
    same_tenant = (F.col("tenant_id") >= F.col("room_tenant")) & (F.col("tenant_id") <= F.col("room_tenant"))  # an equality would be a key
    met = (
        (F.col("met_by") == F.col("room_met_by")) & same_tenant
        & (F.col("at") >= F.col("from_at")) & (F.col("at") < F.col("end"))
        & (F.col("at") < F.col("from_at") + F.expr(f"interval {hours} hours"))  # within the span; lets Spark clear the state
    )
    stored = [F.col("at").cast(events.schema["time"].dataType).alias("time") if c == "time" else F.col(c) for c in events.columns]
    return timed.join(pieces, met).select("subscriber_id", *stored)
