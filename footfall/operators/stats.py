"""The reports of one tenant."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from footfall.functions import timing
from footfall.functions.events import agent_label, property_value
from footfall.functions.text import or_dash
from footfall.operators import validation
from footfall.operators.scope import TenantScope

TOP = 10


def _in_range(
    scope: TenantScope, range_key: str, as_of: datetime | None, bounded: bool
) -> DataFrame:
    as_of = as_of or timing.utc_now()
    return scope.since(timing.range_start(range_key, as_of), as_of if bounded else None)


def summary(
    scope: TenantScope, range_key: str = "24h", as_of: datetime | None = None, bounded: bool = False
) -> DataFrame:
    """Total events and distinct sessions; zeros when there are none."""
    return _in_range(scope, range_key, as_of, bounded).agg(
        F.count("*").alias("total_events"),
        F.countDistinct("session_id").alias("unique_sessions"),
    )


def top_values(
    scope: TenantScope, column: str, range_key: str = "24h", as_of: datetime | None = None,
    bounded: bool = False,
) -> DataFrame:
    """The ten most frequent values of ``column``, ties in order of the value."""
    return (
        _in_range(scope, range_key, as_of, bounded)
        .where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "value")
        .limit(TOP)
    )


def overview(
    scope: TenantScope, range_key: str = "24h", as_of: datetime | None = None, bounded: bool = False
) -> DataFrame:
    """Totals and both rankings in one row, from one scan.

    Each event is counted under its session, its page and its referrer; counting combines before
    the one shuffle, and only the counted values go further.
    """
    counted = (
        _in_range(scope, range_key, as_of, bounded)
        .select(
            F.stack(
                F.lit(3),
                F.lit("session"), F.col("session_id"),
                F.lit("page"), F.col("url"),
                F.lit("referrer"), F.col("referrer"),
            ).alias("kind", "value")
        )
        .where((F.col("kind") == "session") | F.col("value").isNotNull())
        .groupBy("kind", "value")
        .agg(F.count("*").alias("count"))
    )
    # Neither branch filters on kind, so that both read the same shuffle.
    sessions = F.col("kind") == "session"
    totals = counted.agg(
        F.coalesce(F.sum(F.when(sessions, F.col("count"))), F.lit(0)).alias("total_events"),
        F.count(F.when(sessions, F.col("value"))).alias("unique_sessions"),
    )
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("count"), "value"))
    ranked = counted.withColumn("rank", rank).where(F.col("rank") <= TOP)

    def listed(kind: str) -> Column:
        row = F.struct("rank", "value", "count")
        rows = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, row)))
        return F.transform(rows, lambda r: F.struct(r["value"].alias("value"), r["count"].alias("count")))

    lists = ranked.agg(listed("page").alias("top_pages"), listed("referrer").alias("top_referrers"))
    # Two one-row frames become one: at most one row of each is not NULL.
    both = totals.unionByName(lists, allowMissingColumns=True)
    return both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns])


def timeseries(
    scope: TenantScope, range_key: str = "7d", event_name: str | None = None,
    as_of: datetime | None = None, bounded: bool = False,
) -> DataFrame:
    """Events per hour (24h) or day; empty buckets are absent."""
    event_name = validation.check_event_name(event_name)
    rows = _in_range(scope, range_key, as_of, bounded)
    if event_name is not None:
        rows = rows.where(F.col("event_name") == event_name)
    unit = timing.bucket_unit(range_key)
    return (
        rows.groupBy(timing.bucket(unit, F.col("time")).alias("bucket"))
        .agg(F.count("*").alias("count"))
        .orderBy("bucket")
    )


def scaled_series(series: DataFrame) -> DataFrame:
    """Points of a sparkline: x and y from 0 to 1. A lone point has x = 0, a flat series y = 0.

    A series has one row per bucket of a range, so one task suffices.
    """
    everything = Window.partitionBy()
    points = F.count("*").over(everything)
    low, high = F.min("count").over(everything), F.max("count").over(everything)
    place = F.row_number().over(Window.orderBy("bucket")) - 1
    return series.select(
        "bucket",
        "count",
        (place / F.greatest(points - 1, F.lit(1))).alias("x"),
        ((F.col("count") - low) / F.coalesce(F.nullif(high - low, F.lit(0)), F.lit(1))).alias("y"),
    )


def realtime(
    scope: TenantScope, as_of: datetime | None = None, bounded: bool = False
) -> DataFrame:
    """Events of the last 30 minutes and sessions of the last 5."""
    as_of = as_of or timing.utc_now()
    recent = scope.since(as_of - timedelta(minutes=30), as_of if bounded else None)
    active = F.col("time") >= timing.literal(as_of - timedelta(minutes=5))
    return recent.agg(
        F.count("*").alias("events_last_30_minutes"),
        F.countDistinct(F.when(active, F.col("session_id"))).alias("active_users"),
    )


LOG_COLUMNS = [
    "time", "event_name", "properties", "session_id", "url", "referrer",
    "country", "device", "os", "browser",
]


def event_log(scope: TenantScope, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of the log, newest first. Tasks keep ``offset + limit`` rows at most."""
    validation.check_page(limit, offset)
    return (
        scope.rows()
        .select("event_id", *LOG_COLUMNS)
        .orderBy(F.desc("time"), F.desc("event_id"))
        .offset(offset)
        .limit(limit)
    )


def displayed_log(log: DataFrame) -> DataFrame:
    return log.select(
        "event_id",
        timing.short_time(F.col("time")).alias("shown_time"),
        "event_name",
        or_dash(F.col("url")).alias("shown_url"),
        F.substring("session_id", 1, 8).alias("shown_session"),
        agent_label(F.col("device"), F.col("browser")).alias("agent"),
    )


def property_breakdown(scope: TenantScope, name: str) -> DataFrame:
    """Events per value of one property; ``properties`` may be text or variants (``sources.properties``)."""
    rows = scope.rows()
    if isinstance(rows.schema["properties"].dataType, T.VariantType):
        value = F.try_variant_get("properties", f"$['{name}']", "string")
        return rows.groupBy("event_name", value.alias("value")).agg(F.count("*").alias("count"))
    return (
        rows
        .groupBy("event_name", property_value(F.col("properties"), name).alias("value"))
        .agg(F.count("*").alias("count"))
    )
