"""Tenants, whitelists and funnel definitions as append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from footfall import schemas
from footfall.functions.text import trimmed
from footfall.operators import validation
from footfall.operators.lookup import lookup
from footfall.operators.scope import TenantScope, same_tenant, visible_tenants

_TENANT_RESULT = ["id", "name", "token", "domain_whitelist", "plan"]


def latest(log: DataFrame) -> DataFrame:
    """The newest version of each tenant; max_by combines before the shuffle."""
    columns = [c for c in log.columns if c != "id"]
    newest = F.max_by(F.struct(*columns), "version").alias("row")
    return log.groupBy("id").agg(newest).select("id", "row.*")


def listing(tenants: DataFrame) -> DataFrame:
    return tenants.select("id", "name", "token", "domain_whitelist")


def with_token(tenants: DataFrame, token: str) -> DataFrame:
    return tenants.where(F.col("token") == token.lower()).select(
        "id", "token", "domain_whitelist", "plan"
    )


def of_owner(tenants: DataFrame, user_id: str) -> DataFrame:
    """The tenant a user owns, at most one row."""
    return visible_tenants(tenants, None, user_id).select(_TENANT_RESULT).limit(1)


def of_owners(tenants: DataFrame, users: DataFrame) -> DataFrame:
    """``users`` (owner_user_id) with their tenants; users without one have NULLs."""
    return lookup(users, tenants.select("owner_user_id", *_TENANT_RESULT), "owner_user_id")


def setup(tenants: DataFrame, requests: DataFrame, new_id: Column, new_token: Column) -> DataFrame:
    """New tenant rows for owners that have none yet; an owner's first request counts.

    ``requests`` has owner_user_id, name, requested_at and request_id. Owners that already have a
    tenant keep it unchanged.
    """
    sound = requests.where(validation.tenant_name_ok(F.col("name")))
    first = (
        sound.groupBy("owner_user_id")
        .agg(F.min_by(F.struct("name", "requested_at", "request_id"), F.struct("requested_at", "request_id")).alias("r"))
        .select("owner_user_id", "r.*")
    )
    owners = tenants.where(F.col("owner_user_id").isNotNull()).select("owner_user_id").distinct()
    new = lookup(first, owners, "owner_user_id", "left_anti")
    return new.select(
        new_id.alias("id"),
        trimmed(F.col("name")).alias("name"),
        new_token.alias("token"),
        F.array().cast("array<string>").alias("domain_whitelist"),
        F.lit("free").alias("plan"),
        F.col("requested_at").alias("created_at"),
        "owner_user_id",
    ).select(schemas.TENANTS.names)


def with_domains(log: DataFrame, changes: DataFrame) -> DataFrame:
    """New versions of tenants whose whole whitelist is replaced.

    ``changes`` has id, domains and version; unsound ones and those for unknown tenants are left
    out, and the newest change of a tenant counts.
    """
    sound = changes.where(validation.domains_ok(F.col("domains")))
    newest = sound.groupBy("id").agg(
        F.max_by("domains", "version").alias("domains"), F.max("version").alias("new_version")
    )
    return (
        latest(log)
        .join(newest, "id")
        .withColumn("domain_whitelist", F.transform("domains", trimmed))
        .withColumn("version", F.col("new_version"))
        .select(schemas.TENANT_LOG.names)
    )


def new_funnels(requests: DataFrame, new_id: Column) -> DataFrame:
    """Funnel rows for sound requests (tenant_id, name, steps as event names, created_at)."""
    step = lambda event: F.struct(trimmed(event).alias("event"))
    return requests.where(validation.funnel_ok(F.col("name"), F.col("steps"))).select(
        new_id.alias("id"),
        "tenant_id",
        trimmed(F.col("name")).alias("name"),
        F.to_json(F.transform("steps", step)).alias("steps"),
        "created_at",
    )


def funnels_of(scope: TenantScope) -> DataFrame:
    """A tenant's funnels, newest first."""
    steps = F.from_json("steps", F.lit("array<struct<event:string>>"))
    return (
        scope.rows()
        .select("id", "name", F.transform(steps, lambda s: s["event"]).alias("steps"), "created_at")
        .orderBy(F.desc("created_at"), F.desc("id"))
    )


def shown_funnels(funnels: DataFrame) -> DataFrame:
    return funnels.select(
        "id", "name", F.array_join("steps", " -> ").alias("shown_steps"), "created_at"
    )


def purge(table: DataFrame, gone: DataFrame, tenant_column: str = "tenant_id") -> DataFrame:
    """The rows that stay when the tenants in ``gone`` (tenant_id) are removed."""
    ids = gone.select(F.col("tenant_id").alias(tenant_column)).distinct()
    return lookup(table, ids, tenant_column, "left_anti").select(table.columns)


__all__ = [
    "funnels_of", "latest", "listing", "new_funnels", "of_owner", "of_owners", "purge",
    "same_tenant", "setup", "shown_funnels", "visible_tenants", "with_domains", "with_token",
]
