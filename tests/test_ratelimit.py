"""The rate limit against a plain sequential run."""

import random
from collections import deque
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from footfall.operators import lookup
from footfall.operators.ratelimit import Limit, admitted_counts, arrival_rate, carry_over, rate_limit

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, token string, arrived_at timestamp_ntz"


def sequential(rows, limit):
    verdicts, admitted = {}, {}
    for event_id, token, at in sorted(rows, key=lambda r: (r[2], r[0])):
        times = admitted.setdefault(token, deque())
        ms = (at - START) // timedelta(milliseconds=1)
        while times and times[0] <= ms - limit.window_ms:
            times.popleft()
        if len(times) < limit.max_events:
            times.append(ms)
            verdicts[event_id] = (True, limit.max_events - len(times))
        else:
            verdicts[event_id] = (False, 0)
    return verdicts


def traffic(seed, events, seconds, bursts=True):
    """A hot token with a third of the events, quiet ones, bursts, and equal milliseconds."""
    rng = random.Random(seed)
    rows = []
    for event_id in range(events):
        token = "hot" if rng.random() < 0.34 else f"t{rng.randrange(12)}"
        ms = rng.randrange(seconds * 1000)
        if bursts and rng.random() < 0.5:
            ms = ms // 60_000 * 60_000 + rng.randrange(40)
        rows.append((event_id, token, START + timedelta(milliseconds=ms)))
    rng.shuffle(rows)
    return rows


def verdicts(df):
    return {r["event_id"]: (r["allowed"], r["remaining"]) for r in df.collect()}


@pytest.mark.parametrize(
    ("seed", "limit", "seconds"),
    [
        (1, Limit(3, 10), 3600),  # windows far shorter than the traffic: many chains
        (2, Limit(5, 600), 3600),  # always over the limit: one long chain
        (3, Limit(40, 60), 1200),
        (4, Limit(1, 1), 30),
        (5, Limit(), 60),  # never over the limit
    ],
)
def test_equals_sequential_run(spark, seed, limit, seconds):
    rows = traffic(seed, 2500, seconds)
    expected = sequential(rows, limit)
    assert verdicts(rate_limit(spark.createDataFrame(rows, SCHEMA), limit)) == expected


def test_no_window_exceeds_the_limit_and_refusals_are_due(spark):
    rows, limit = traffic(6, 2000, 900), Limit(4, 30)
    counts = admitted_counts(spark.createDataFrame(rows, SCHEMA), limit).collect()
    by_token = {}
    for r in sorted(counts, key=lambda r: r["ms"]):
        by_token.setdefault(r["token"], []).append(r)
    for series in by_token.values():
        for r in series:
            window = sum(x["admitted"] for x in series if r["ms"] - limit.window_ms < x["ms"] <= r["ms"])
            assert window <= limit.max_events
            if r["admitted"] < r["fresh"]:
                assert window == limit.max_events


def test_arrival_rate_counts_refused_posts_too(spark):
    rows, limit = traffic(7, 800, 300), Limit(4, 30)
    found = arrival_rate(spark.createDataFrame(rows, SCHEMA), limit).collect()
    times = {}
    for _, token, at in rows:
        times.setdefault(token, []).append(at)
    assert sum(r["arrivals"] for r in found) == len(rows)
    epoch = datetime(1970, 1, 1)
    for r in found:
        at = epoch + timedelta(milliseconds=r["ms"])
        inside = [t for t in times[r["token"]] if at - timedelta(seconds=30) < t <= at]
        assert r["in_window"] == len(inside)


def test_carry_makes_slices_equal_the_whole(spark):
    rows, limit = traffic(8, 2000, 900), Limit(4, 50)
    rows.sort(key=lambda r: (r[2], r[0]))
    expected = sequential(rows, limit)
    found, carry = {}, None
    # The second cut falls between events of one millisecond.
    for part in (rows[:700], rows[700:703], rows[703:1500], rows[1500:]):
        events = spark.createDataFrame(part, SCHEMA)
        counts = admitted_counts(events, limit, carry)
        found |= verdicts(rate_limit(events, limit, carry, counts))
        last = carry_over(counts, limit).collect()
        idle = [r for r in (carry.collect() if carry else []) if r["token"] not in {x["token"] for x in last}]
        carry = spark.createDataFrame([tuple(r) for r in last + idle], "token string, ms long, admitted long")
    assert found == expected


def test_lookup_beyond_the_broadcast_size(spark, monkeypatch):
    facts = spark.createDataFrame([(n, "hot" if n % 3 else f"k{n % 7}") for n in range(300)], "n int, key string")
    dimension = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "key string, v int")
    small = {tuple(r) for r in lookup.lookup(facts, dimension, "key").collect()}
    small_anti = {tuple(r) for r in lookup.lookup(facts, dimension.select("key"), "key", "left_anti").collect()}
    monkeypatch.setattr(lookup, "is_small", lambda df: False)
    assert {tuple(r) for r in lookup.lookup(facts, dimension, "key").collect()} == small
    anti = lookup.lookup(facts, dimension.select("key"), "key", "left_anti").collect()
    assert {tuple(r) for r in anti} == small_anti


def test_a_large_dimension_is_sent_once_and_hot_keys_are_cut(spark, monkeypatch):
    monkeypatch.setattr(lookup, "is_small", lambda df: False)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    }
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        key = F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id")))
        facts = spark.range(0, 40_000, 1, 8).select("id", key.alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
        dimension = spark.range(0, 30_000, 3).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").alias("v"))
        joined = lookup.lookup(facts, dimension, "key")
        found = joined.collect()
        plan = joined._jdf.queryExecution().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert "explode" not in plan.lower()
    assert "skew=true" in plan
    assert {(r["id"], r["v"]) for r in found} == {(n, n if n % 3 == 0 and n < 30_000 else None) for n in range(40_000)}


def test_neither_side_of_a_large_join_is_broadcast(spark, monkeypatch):
    # By the size of its files Spark would broadcast both.
    monkeypatch.setattr(lookup, "is_small", lambda df: False)
    facts = spark.range(100).select(F.concat(F.lit("k"), F.col("id") % 7).alias("key"), "id")
    dimension = spark.range(7).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").alias("v"))
    for how in ("inner", "left"):
        joined = lookup.lookup(facts, dimension, "key", how)
        assert {(r["id"], r["v"]) for r in joined.collect()} == {(n, n % 7) for n in range(100)}
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()


def test_is_small_checks_rows_and_bytes(spark):
    df = spark.range(100)
    assert lookup.is_small(df)
    assert not lookup.is_small(df, rows=99)
    assert not lookup.is_small(df, size=50)
