"""Explicit schemas of every table and message. Times are UTC wall clock (``timestamp_ntz``)."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in fields])


_S, _L, _T = T.StringType(), T.LongType(), T.TimestampNTZType()

# One POST to the collector: the body as sent plus what the collector knows about the request.
RAW = _schema(
    ("event_id", _L, False),
    ("arrived_at", _T, False),
    ("body", _S, True),
    ("header_user_agent", _S, True),
    ("forwarded_for", _S, True),
    ("remote_ip", _S, True),
)

# An admitted event on its way to the store.
JOB = _schema(
    ("event_id", _L, False),
    ("arrived_at", _T, False),
    ("tenant_id", _S, True),
    ("event_name", _S, True),
    ("properties", _S, True),
    ("session_id", _S, True),
    ("url", _S, True),
    ("referrer", _S, True),
    ("occurred_at", _S, True),
    ("user_agent", _S, True),
    ("ip_address", _S, True),
)

EVENTS = _schema(
    ("event_id", _L, False),
    ("time", _T, False),
    ("tenant_id", _S, False),
    ("event_name", _S, False),
    ("properties", _S, False),
    ("session_id", _S, False),
    ("url", _S, True),
    ("referrer", _S, True),
    ("country", _S, True),
    ("device", _S, True),
    ("os", _S, True),
    ("browser", _S, True),
    ("ip_hash", _S, True),
)

TENANTS = _schema(
    ("id", _S, False),
    ("name", _S, False),
    ("token", _S, False),
    ("domain_whitelist", T.ArrayType(_S), False),
    ("plan", _S, False),
    ("created_at", _T, False),
    ("owner_user_id", _S, True),
)

# Tenants and whitelists change, so the stored form is a log of versions; the newest one counts.
TENANT_LOG = T.StructType(TENANTS.fields + [T.StructField("version", _L, False)])

STEP = T.StructType([T.StructField("event", _S)])

FUNNELS = _schema(
    ("id", _S, False),
    ("tenant_id", _S, False),
    ("name", _S, False),
    ("steps", _S, False),
    ("created_at", _T, False),
)

HOURLY_STATS = _schema(
    ("tenant_id", _S, False),
    ("hour", _T, False),
    ("event_name", _S, False),
    ("count", _L, False),
)

SESSIONS = _schema(
    ("id", _S, False),
    ("tenant_id", _S, False),
    ("started_at", _T, False),
    ("ended_at", _T, False),
    ("page_count", _L, False),
    ("country", _S, True),
    ("device", _S, True),
)

# The accepted keys of a payload; any other key refuses it.
PAYLOAD_KEYS = [
    "token", "eventName", "properties", "sessionId", "url", "referrer", "occurredAt", "userAgent",
]
