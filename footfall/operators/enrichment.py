"""Accepted events to rows of the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from footfall import schemas
from footfall.functions import net, timing, useragent
from footfall.functions.text import compact, trimmed
from footfall.operators import validation


def split_jobs(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound jobs, and the ones that break a rule (with ``violations``)."""
    checked = jobs.withColumn("violations", validation.job_violations())
    sound = F.col("violations") == ""
    return checked.where(sound).drop("violations"), checked.where(~sound)


def enrich(jobs: DataFrame) -> DataFrame:
    """Narrow: no shuffle, no Python. ``country`` has no source and stays NULL."""
    agent = F.col("user_agent")
    return jobs.select(
        "event_id",
        timing.from_iso(F.col("occurred_at")).alias("time"),
        F.lower("tenant_id").alias("tenant_id"),
        trimmed(F.col("event_name")).alias("event_name"),
        "properties",
        F.lower("session_id").alias("session_id"),
        "url",
        F.nullif("referrer", F.lit("")).alias("referrer"),
        F.lit(None).cast("string").alias("country"),
        compact(useragent.device(agent)).alias("device"),
        compact(useragent.operating_system(agent)).alias("os"),
        compact(useragent.browser(agent)).alias("browser"),
        net.ip_hash(F.col("ip_address")).alias("ip_hash"),
    ).select(schemas.EVENTS.names)


def by_tenant(events: DataFrame) -> DataFrame:
    """How a batch divides over tenants."""
    return events.groupBy("tenant_id").agg(
        F.count("*").alias("events"),
        F.min("time").alias("first_time"),
        F.max("time").alias("last_time"),
    )
