"""Tenants as a collector with a cache sees them: up to the cache's lifetime old.

The first arrival of a token after its tenant exists loads the tenant and keeps it for ``ttl``; arrivals within that time
get what was loaded, however the tenant has changed since, and the first one after it loads anew. A token without a tenant
is not kept, so it is found as soon as its tenant exists.

Which arrivals load depends on all loads before; ``operators.chains`` finds them per token and millisecond of arrival,
day by day. What a load saw is an as-of join of loads and tenant versions: both are merged in order of time per token,
and each load takes the last version before it. A token has one load per ``ttl`` at most, so that merge is small for a hot token too.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window, functions as F

from footfall.functions import timing
from footfall.operators import chains
from footfall.operators.lookup import lookup

TTL = timedelta(seconds=300)
DAY_MS = 86_400_000


def as_of(probes: DataFrame, versions: DataFrame, keys: list[str], at: str, order: list[str], value: str) -> DataFrame:
    """``probes`` (keys, ``at``) with ``value``: that of the newest row of ``versions`` (keys, ``at``, ``order``, ``value``) not after them.

    The two are merged and read in order of time, so no pairs are made. Null keys find nothing.
    """
    none = [F.lit(None).cast(versions.schema[name].dataType).alias(name) for name in (*order, value)]
    merged = probes.select(*keys, at, F.lit(True).alias("probe"), *none).unionByName(
        versions.select(*keys, at, F.lit(False).alias("probe"), *order, value)
    )
    so_far = Window.partitionBy(*keys).orderBy(at, "probe", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.last(value, ignorenulls=True).over(so_far)
    any_null = F.lit(False)
    for key in keys:
        any_null = any_null | F.col(key).isNull()
    return merged.withColumn(value, F.when(~any_null, known)).where("probe").select(*keys, at, value)


def resolve_as_of(arrivals: DataFrame, versions: DataFrame, ttl: timedelta = TTL) -> DataFrame:
    """``event_id, token, tenant_id, version, loaded_at`` of every arrival (event_id, token, arrived_at).

    ``versions`` has id, token, version and changed_at; of two versions of one time the higher counts. Tokens without a tenant
    at that time have nulls.
    """
    ttl_ms = ttl // timedelta(milliseconds=1)
    timed = arrivals.select("event_id", F.lower("token").alias("token"), timing.millis(F.col("arrived_at")).alias("ms"))
    dated = versions.select(
        F.lower("token").alias("token"), timing.millis(F.col("changed_at")).alias("ms"), "version", F.struct("id", "version").alias("seen")
    )
    known_since = dated.groupBy("token").agg(F.min("ms").alias("since"))
    moments = timed.where(F.col("token").isNotNull()).select("token", "ms").distinct()
    moments = lookup(moments, known_since, "token", "inner").where(F.col("ms") >= F.col("since"))
    rows = moments.select("token", F.col("ms").alias("place"), (F.col("ms") + ttl_ms).alias("bound"))
    held = chains.spans(rows, ["token"], ttl_ms, max(DAY_MS, ttl_ms))
    loads = held.where(F.col("place") == F.col("begin")).select("token", F.col("begin").alias("ms"))
    seen = as_of(loads, dated, ["token"], "ms", ["version"], "seen").withColumnRenamed("ms", "begin")
    by_moment = held.select("token", F.col("place").alias("ms"), "begin").join(seen, ["token", "begin"])
    return timed.join(by_moment, ["token", "ms"], "left").select(
        "event_id", "token", F.col("seen.id").alias("tenant_id"), F.col("seen.version").alias("version"),
        timing.from_millis(F.col("begin")).alias("loaded_at"),
    )
