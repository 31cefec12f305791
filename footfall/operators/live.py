"""What watchers of a tenant see as events are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from footfall.functions import timing
from footfall.operators.lookup import lookup
from footfall.session import stage

# The room names a relay accepts, and the length of a live list.
ROOM = r"(?i)^tenant:[0-9a-f-]{36}\z"
FEED_LENGTH = 10

RELAY_COLUMNS = [
    "time", "tenant_id", "event_name", "url", "referrer", "session_id",
    "device", "os", "browser", "properties",
]


def relay(events: DataFrame) -> DataFrame:
    """Messages for the rooms of tenants; neither country nor address hash leaves the store."""
    return events.select(
        "event_id",
        F.concat(F.lit("tenant:"), "tenant_id").alias("room"),
        timing.to_iso(F.col("time")).alias("time"),
        *RELAY_COLUMNS[1:],
    ).where(F.col("room").rlike(ROOM))


def newest(events: DataFrame, length: int = FEED_LENGTH) -> DataFrame:
    """The newest events of every tenant; each task passes on ``length`` rows per tenant."""
    newest_first = Window.partitionBy("tenant_id").orderBy(F.desc("time"), F.desc("event_id"))
    return events.withColumn("place", F.row_number().over(newest_first)).where(
        F.col("place") <= length
    )


def merged_feed(feed: DataFrame, arrived: DataFrame, length: int = FEED_LENGTH) -> DataFrame:
    """A feed after new events came in."""
    columns = [c for c in feed.columns if c != "place"]
    return newest(feed.select(columns).unionByName(arrived.select(columns)), length)


def fan_out(feed: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Rows of a stored feed, which is short per tenant, for each subscriber of the tenant."""
    return lookup(subscriptions, feed, "tenant_id", "inner")


def delivered(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Messages each subscriber got: counted per tenant first, then joined."""
    sent = events.groupBy("tenant_id").agg(
        F.count("*").alias("messages"), F.max("time").alias("last_time")
    )
    # Written, since the look at its size must not count all events once more.
    return lookup(subscriptions, stage(sent, "sent"), "tenant_id", "inner")
