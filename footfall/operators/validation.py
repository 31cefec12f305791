"""Payload, job and request rules, one boolean column each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from footfall import schemas
from footfall.functions import net, timing
from footfall.functions.text import trimmed, utf16_length

# The limits of the wire format.
MAX_BODY_BYTES = 32 * 1024
MAX_PROPERTIES = 10_240
MAX_URL = 2048
MAX_AGENT = 1024
MAX_EVENT_NAME_JOB = 128
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"
EVENT_NAME = r"^[a-zA-Z0-9_\-.]{1,100}\z"
JSON_SPACE = " \t\r\n"

# Column and wire name of the text fields. Those in _TYPED would pass their rule as another JSON type
# or as null, so their type is read too.
_TYPED = {"event_name", "referrer", "occurred_at", "user_agent"}
_TEXT_FIELDS = {
    "token": "token",
    "event_name": "eventName",
    "session_id": "sessionId",
    "url": "url",
    "referrer": "referrer",
    "occurred_at": "occurredAt",
    "user_agent": "userAgent",
}


def _optional(kind: Column, rule: Column) -> Column:
    return kind.isNull() | ((kind == "STRING") & rule)


def _url_rule(url: Column) -> Column:
    return (utf16_length(url) <= MAX_URL) & net.is_url(url)


def parse_bodies(raw: DataFrame) -> DataFrame:
    """Payload fields out of the JSON body.

    ``readable`` is false for text that is no JSON object or array or that is over the size limit;
    a missing or empty body reads as an empty object.
    A field's ``_kind`` is NULL if the field is absent and VOID for a JSON null.
    """
    body = F.coalesce(F.nullif("body", F.lit("")), F.lit("{}"))
    text = F.btrim(body, F.lit(JSON_SPACE))
    in_size = F.octet_length(body) <= MAX_BODY_BYTES
    is_object = in_size & text.startswith("{") & text.endswith("}")
    is_list = in_size & text.startswith("[") & text.endswith("]")
    schema = ", ".join(
        ["properties variant"]
        + [f"{wire} {'variant' if name in _TYPED else 'string'}" for name, wire in _TEXT_FIELDS.items()]
    )
    read = raw.withColumn("keys", F.when(is_object, F.json_object_keys(body))).withColumn(
        "_payload", F.from_json(F.when(F.col("keys").isNotNull(), body), schema)
    )
    field = lambda name: F.col(f"_payload.{name}")
    is_readable = F.col("keys").isNotNull() | (is_list & F.try_parse_json(body).isNotNull())
    return read.select(
        *raw.columns,
        F.coalesce(is_readable, F.lit(False)).alias("readable"),
        "keys",
        F.to_json(field("properties")).alias("properties"),
        *[field(wire).cast("string").alias(name) for name, wire in _TEXT_FIELDS.items()],
        *[
            F.schema_of_variant(field(wire)).alias(f"{name}_kind")
            for name, wire in _TEXT_FIELDS.items()
            if name in _TYPED
        ],
    )


def payload_violations() -> Column:
    """Names of the rules a parsed payload breaks, joined by ``|``; empty for a sound one."""
    name = trimmed(F.col("event_name"))
    rules = {
        "token": F.col("token").rlike(UUID),
        "eventName": (F.col("event_name_kind") == "STRING") & name.rlike(EVENT_NAME),
        "properties": F.col("properties").isNull()
        | (F.col("properties").startswith("{") & (utf16_length(F.col("properties")) <= MAX_PROPERTIES)),
        "sessionId": F.col("session_id").rlike(UUID),
        "url": _url_rule(F.col("url")),
        "referrer": _optional(F.col("referrer_kind"), _url_rule(F.col("referrer"))),
        "occurredAt": _optional(
            F.col("occurred_at_kind"), timing.from_iso(F.col("occurred_at")).isNotNull()
        ),
        "userAgent": _optional(
            F.col("user_agent_kind"), utf16_length(F.col("user_agent")) <= MAX_AGENT
        ),
        "keys": F.size(F.array_except("keys", F.lit(schemas.PAYLOAD_KEYS))) == 0,
    }
    return _broken(rules)


def job_violations() -> Column:
    """Names of the rules a queued job breaks: as for payloads, but any event name up to 128."""
    rules = {
        "tenantId": F.col("tenant_id").rlike(UUID),
        "eventName": utf16_length(trimmed(F.col("event_name"))).between(1, MAX_EVENT_NAME_JOB),
        "properties": F.col("properties").startswith("{") & F.try_parse_json("properties").isNotNull(),
        "sessionId": F.col("session_id").rlike(UUID),
        "url": _url_rule(F.col("url")),
        "referrer": F.col("referrer").isNull() | _url_rule(F.col("referrer")),
        "occurredAt": timing.from_iso(F.col("occurred_at")).isNotNull(),
        "userAgent": F.col("user_agent").isNull()
        | (utf16_length(F.col("user_agent")) <= MAX_AGENT),
    }
    return _broken(rules)


def _broken(rules: dict[str, Column]) -> Column:
    # Text rather than an array: dropping NULLs from an array would leave generated code.
    return F.concat_ws(
        "|", *[F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]
    )


def _text_within(text: Column, limit: int) -> Column:
    return utf16_length(trimmed(text)).between(1, limit)


def tenant_name_ok(name: Column) -> Column:
    return F.coalesce(_text_within(name, 120), F.lit(False))


def domains_ok(domains: Column) -> Column:
    each = F.forall(domains, lambda domain: F.coalesce(_text_within(domain, 255), F.lit(False)))
    return F.coalesce((F.size(domains) <= 50) & each, F.lit(False))


def funnel_ok(name: Column, steps: Column) -> Column:
    """``steps`` is an array of event names."""
    each = F.forall(steps, lambda step: F.coalesce(_text_within(step, 120), F.lit(False)))
    return F.coalesce(_text_within(name, 120) & F.size(steps).between(1, 12) & each, F.lit(False))


def check_page(limit: int, offset: int) -> None:
    if not 1 <= limit <= 200:
        raise ValueError("limit must be from 1 to 200")
    if not 0 <= offset <= 10_000:
        raise ValueError("offset must be from 0 to 10000")


def check_event_name(name: str | None) -> str | None:
    if name is None:
        return None
    name = name.strip()
    if not 1 <= len(name) <= 128:
        raise ValueError("event must have 1 to 128 characters")
    return name
