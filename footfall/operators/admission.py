"""From raw posts to accepted events: read, check, resolve the tenant, domain, rate limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from footfall.functions import hosts, net, timing
from footfall.functions.text import trimmed
from footfall.operators import validation
from footfall.operators.lookup import lookup
from footfall.operators.ratelimit import Limit, rate_limit
from footfall.session import stage

# The status of a post by its first failing check.
ACCEPTED, UNREADABLE, MALFORMED, BAD_TOKEN, BAD_DOMAIN, LIMITED = 200, 500, 400, 401, 403, 429
REASONS = {
    ACCEPTED: "accepted",
    UNREADABLE: "unreadable_body",
    MALFORMED: "malformed_payload",
    BAD_TOKEN: "invalid_token",
    BAD_DOMAIN: "domain_not_allowed",
    LIMITED: "rate_limited",
}


def validate(raw: DataFrame) -> DataFrame:
    """Parsed payloads with their ``violations``."""
    return validation.parse_bodies(raw).withColumn(
        "violations", F.when(F.col("readable"), validation.payload_violations())
    )


def by_token(tenants: DataFrame) -> DataFrame:
    """Tenants by lower-case token, their whitelists already reduced to host endings."""
    return tenants.select(
        F.lower("token").alias("_token"),
        F.col("id").alias("tenant_id"),
        net.whitelist_endings(F.col("domain_whitelist")).alias("_endings"),
    )


def resolve(checked: DataFrame, tenants: DataFrame) -> DataFrame:
    """Adds the tenant and the ``status`` that is known before the rate limit (NULL if none)."""
    sound = F.col("violations") == ""
    # Hosts are read before the join, where a hot token's posts are still spread over all tasks.
    keyed = checked.withColumn("_token", F.when(sound, F.lower("token"))).withColumn("_host", net.dotted(hosts.browser_host(F.col("url"))))
    joined = lookup(keyed, by_token(tenants), "_token").drop("_token")
    allowed = net.domain_allowed(F.col("_host"), F.col("_endings"))
    return joined.withColumn(
        "status",
        F.when(~F.col("readable"), UNREADABLE)
        .when(F.col("violations") != "", MALFORMED)
        .when(F.col("tenant_id").isNull(), BAD_TOKEN)
        .when(~allowed, BAD_DOMAIN),
    ).drop("_host", "_endings")


def apply_limit(
    resolved: DataFrame, limit: Limit, carry: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Rate limit over the events that passed the other checks; the rest keep their status.

    Refused earlier means no quota used and no quota columns.
    """
    waiting = F.col("status").isNull()
    verdict = rate_limit(resolved.where(waiting), limit, carry, counts)
    limited = verdict.withColumn("status", F.when(F.col("allowed"), ACCEPTED).otherwise(LIMITED))
    return limited.drop("allowed").unionByName(
        resolved.where(~waiting), allowMissingColumns=True
    )


def with_reason(outcomes: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(part) for pair in REASONS.items() for part in pair])
    return outcomes.withColumn("reason", names[F.col("status")])


def admit(raw: DataFrame, tenants: DataFrame, limit: Limit = Limit()) -> DataFrame:
    """Every post with its ``status`` and ``reason``.

    The resolved posts are written once: three later steps read them, and parsing is the dear part.
    """
    resolved = stage(resolve(validate(raw), tenants), "resolved")
    return with_reason(apply_limit(resolved, limit))


def jobs(outcomes: DataFrame) -> DataFrame:
    """Accepted posts in the shape the enrichment reads."""
    agent = F.coalesce("user_agent", "header_user_agent")
    return outcomes.where(F.col("status") == ACCEPTED).select(
        "event_id",
        "arrived_at",
        "tenant_id",
        trimmed(F.col("event_name")).alias("event_name"),
        F.coalesce("properties", F.lit("{}")).alias("properties"),
        "session_id",
        "url",
        "referrer",
        F.coalesce("occurred_at", timing.to_iso(F.col("arrived_at"))).alias("occurred_at"),
        F.nullif(agent, F.lit("")).alias("user_agent"),
        net.client_ip(F.col("forwarded_for"), F.col("remote_ip")).alias("ip_address"),
    )


def rejects(outcomes: DataFrame) -> DataFrame:
    """The quarantine: refused posts as they came, with the reason."""
    return outcomes.where(F.col("status") != ACCEPTED).select(
        "event_id", "arrived_at", "body", "status", "reason", "violations"
    )


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("status", "reason").agg(F.count("*").alias("events"))


def unknown_tokens(events: DataFrame, tenants: DataFrame) -> DataFrame:
    """Events whose token belongs to no tenant."""
    keyed = events.withColumn("_token", F.lower("token"))
    return lookup(keyed, by_token(tenants).select("_token"), "_token", "left_anti").drop("_token")
