"""Hourly counts and sessions derived from the event table."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from footfall.functions import timing
from footfall.operators import validation
from footfall.operators.lookup import sized
from footfall.operators.scope import TenantScope

PAGE_EVENT = "pageview"
SESSION_PARTS = 16


def hourly_stats(events: DataFrame) -> DataFrame:
    """Events per tenant, hour and event name; counted before the shuffle."""
    return events.groupBy(
        "tenant_id", timing.bucket("hour", F.col("time")).alias("hour"), "event_name"
    ).agg(F.count("*").alias("count"))


def sessions(events: DataFrame) -> DataFrame:
    """Sessions under the id the client gave; country and device are those of the first event.

    Every aggregate has a fixed size, so a session may have any number of events.
    """
    first = F.struct("time", "event_id")
    return events.groupBy("tenant_id", F.col("session_id").alias("id")).agg(
        F.min("time").alias("started_at"),
        F.max("time").alias("ended_at"),
        F.count_if(F.col("event_name") == PAGE_EVENT).alias("page_count"),
        F.min_by("country", first).alias("country"),
        F.min_by("device", first).alias("device"),
    )


def sessions_by_gap(
    events: DataFrame, visitor: str, gap: timedelta = timedelta(minutes=30)
) -> DataFrame:
    """Sessions for inputs without a session id: a visitor's events less than ``gap`` apart.

    Events within one slot of ``gap`` length always belong together, so slots are aggregated first,
    before the shuffle. A visitor then has at most one row per slot, however many the events.
    """
    gap_us = gap // timedelta(microseconds=1)
    micros = F.unix_micros(F.col("time").cast("timestamp"))
    slots = events.groupBy(
        "tenant_id", visitor, F.floor(micros / gap_us).cast("long").alias("slot")
    ).agg(
        F.min("time").alias("first"),
        F.max("time").alias("last"),
        F.count("*").alias("events"),
        F.count_if(F.col("event_name") == PAGE_EVENT).alias("page_count"),
    )
    in_order = Window.partitionBy("tenant_id", visitor).orderBy("slot")
    pause = F.col("first") - F.lag("last").over(in_order)
    starts = F.coalesce(pause >= F.lit(gap), F.lit(True))
    numbered = slots.withColumn("starts", starts.cast("int")).withColumn(
        "session", F.sum("starts").over(in_order)
    )
    return (
        numbered.groupBy("tenant_id", visitor, "session")
        .agg(
            F.min("first").alias("started_at"),
            F.max("last").alias("ended_at"),
            F.sum("events").alias("events"),
            F.sum("page_count").alias("page_count"),
        )
        .drop("session")
    )


def timeseries_from_hours(
    hours: DataFrame, tenant_id: str | None, range_key: str = "7d", event_name: str | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """The series served from hourly counts; the range starts at a full hour."""
    event_name = validation.check_event_name(event_name)
    start = timing.range_start(range_key, as_of).replace(minute=0, second=0, microsecond=0)
    rows = TenantScope(hours.withColumnRenamed("hour", "time"), tenant_id).since(start)
    if event_name is not None:
        rows = rows.where(F.col("event_name") == event_name)
    unit = timing.bucket_unit(range_key)
    return (
        rows.groupBy(timing.bucket(unit, F.col("time")).alias("bucket"))
        .agg(F.sum("count").alias("count"))
        .orderBy("bucket")
    )


def numbered_sessions(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``tenant_id, session_id, part, number`` of every session in ``events`` or ``known``; known ones keep their number.

    Numbers are dense within a tenant and part, so bitmaps over them are short, and new ones go on after the last.
    A tenant's sessions are dealt over ``SESSION_PARTS`` parts by hash, so no task numbers all of a large tenant.
    """
    part = F.pmod(F.xxhash64("session_id"), F.lit(SESSION_PARTS)).cast("int")
    found = events.where(F.col("session_id").isNotNull()).select("tenant_id", "session_id").distinct().withColumn("part", part)
    in_part = Window.partitionBy("tenant_id", "part").orderBy("session_id")
    if known is None:
        return found.withColumn("number", F.row_number().over(in_part).cast("long") - 1)
    new = found.join(known.select("tenant_id", "session_id"), ["tenant_id", "session_id"], "left_anti")
    last = known.groupBy("tenant_id", "part").agg(F.max("number").alias("last"))
    numbered = new.withColumn("nth", F.row_number().over(in_part)).join(last, ["tenant_id", "part"], "left")
    number = F.coalesce("last", F.lit(-1).cast("long")) + F.col("nth")
    return known.unionByName(numbered.select("tenant_id", "session_id", "part", number.alias("number")))


def hourly_sessions(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """``tenant_id, hour, part, bucket, seen, events``: events, and which sessions were seen, as bitmaps of their numbers.

    Bitmaps can be merged over any hours, which counts of sessions cannot. Events are counted per session and hour before they meet the
    numbers. Those without a session are counted in part -1, whose bitmap is empty.
    """
    hour = timing.bucket("hour", F.col("time")).alias("hour")
    counted = events.groupBy("tenant_id", "session_id", hour).agg(F.count("*").alias("n"))
    met = counted.join(sessions, ["tenant_id", "session_id"], "left")
    return met.groupBy(
        "tenant_id", "hour", F.coalesce("part", F.lit(-1)).alias("part"),
        F.coalesce(F.bitmap_bucket_number("number"), F.lit(0).cast("long")).alias("bucket"),
    ).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("seen"), F.sum("n").alias("events"))


def summary_from_hours(
    hours: DataFrame, tenant_id: str | None, range_key: str = "7d", as_of: datetime | None = None
) -> DataFrame:
    """Total events and unique sessions served from ``hourly_sessions``; the range starts at a full hour."""
    start = timing.range_start(range_key, as_of).replace(minute=0, second=0, microsecond=0)
    rows = TenantScope(hours.withColumnRenamed("hour", "time"), tenant_id).since(start)
    merged = rows.groupBy("part", "bucket").agg(F.bitmap_or_agg("seen").alias("seen"), F.sum("events").alias("events"))
    none = F.lit(0).cast("long")
    return merged.agg(
        F.coalesce(F.sum("events"), none).alias("total_events"), F.coalesce(F.sum(F.bitmap_count("seen")), none).alias("unique_sessions")
    )


def touched_days(new_events: DataFrame) -> DataFrame:
    """Days whose stored rollups the new events make out of date."""
    return new_events.select(F.to_date("time").alias("event_date")).distinct()


def reconciled_hours(stored: DataFrame, events: DataFrame, days: DataFrame) -> DataFrame:
    """Stored hourly counts with the rows of ``days`` counted anew from all events.

    Event dates come from clients, so ``days`` is broadcast only where it is small.
    """
    days = sized(days)
    kept = stored.withColumn("event_date", F.to_date("hour")).join(days, "event_date", "left_anti")
    anew = _hours_of(events, days)
    return kept.select(anew.columns).unionByName(anew)


def _hours_of(events: DataFrame, days: DataFrame) -> DataFrame:
    if "event_date" not in events.columns:
        events = events.withColumn("event_date", F.to_date("time"))
    return hourly_stats(events.join(days, "event_date", "left_semi"))


def refresh_hours(events: DataFrame, days: DataFrame, path: str) -> None:
    """Count ``days`` anew and replace just these days in the stored hourly counts."""
    anew = _hours_of(events, sized(days)).withColumn("event_date", F.to_date("hour"))
    writer = anew.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("event_date").parquet(path)
