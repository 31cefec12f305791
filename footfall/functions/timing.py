"""Ranges, buckets and time texts."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

# The ranges a report may ask for.
RANGES = {"24h": timedelta(hours=24), "7d": timedelta(days=7), "30d": timedelta(days=30)}

# Date-time with an offset or Z; seconds are required, a fraction is allowed.
ISO_WITH_OFFSET = (
    r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])"
    r"T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?(Z|[+-]\d{2}:?\d{2})\z"
)


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def literal(moment: datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def range_start(range_key: str, as_of: datetime | None = None) -> datetime:
    if range_key not in RANGES:
        raise ValueError(f"range must be one of {', '.join(RANGES)}")
    return (as_of or utc_now()) - RANGES[range_key]


def bucket_unit(range_key: str) -> str:
    return "hour" if range_key == "24h" else "day"


def bucket(unit: str, time: Column) -> Column:
    return F.date_trunc(unit, time).cast("timestamp_ntz")


def from_iso(text: Column) -> Column:
    """UTC time of an ISO text with offset, to the millisecond; NULL if it is not one."""
    moment = F.try_to_timestamp(F.when(text.rlike(ISO_WITH_OFFSET), text))
    return F.date_trunc("MILLISECOND", moment).cast("timestamp_ntz")


def to_iso(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def short_time(time: Column) -> Column:
    return F.date_format(time, "MMM d, hh:mm a")


def millis(time: Column) -> Column:
    return F.unix_millis(time.cast("timestamp"))


def from_millis(value: Column) -> Column:
    return F.timestamp_millis(value).cast("timestamp_ntz")
