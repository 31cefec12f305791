"""Funnel conversion against a plain fold, with a session that spans partitions and batches."""

import random
from datetime import datetime, timedelta

import pytest

from footfall.operators.funnels import conversion, session_reach

START = datetime(2024, 1, 1)
SCHEMA = "tenant_id string, session_id string, time timestamp_ntz, event_id long, event_name string"


def traffic(seed, events):
    rng = random.Random(seed)
    rows = []
    for event_id in range(events):
        hot = rng.random() < 0.34
        session = "hot" if hot else f"s{rng.randrange(events // 6)}"
        name = rng.choice(["x", "a", "b", "c"] if not hot else ["a", "x", "x"] if event_id < events * 0.9 else ["b", "c"])
        rows.append((f"t{rng.randrange(2)}" if not hot else "t0", session, START + timedelta(seconds=rng.randrange(50) if not hot else event_id), event_id, name))
    rng.shuffle(rows)
    return rows


def folded(rows, steps):
    reached = {}
    for tenant, session, time, event_id, name in sorted(rows, key=lambda r: (r[2], r[3])):
        at = reached.setdefault((tenant, session), 0)
        if at < len(steps) and name == steps[at]:
            reached[tenant, session] = at + 1
    return {key: n for key, n in reached.items() if n}


@pytest.mark.parametrize("steps", [["a", "b", "c"], ["a"], ["a", "a"], ["c", "b", "a", "b"], ["a"] * 12, ["nowhere", "a"]])
def test_equals_a_plain_fold(spark, steps):
    rows = traffic(3, 1500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        events = spark.createDataFrame(rows, SCHEMA)
        found = {(r["tenant_id"], r["session_id"]): r["reached"] for r in session_reach(events, steps).collect()}
        table = conversion(events, steps).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = folded(rows, steps)
    assert {key: n for key, n in found.items() if n} == expected
    assert [r["reached"] for r in table] == [sum(n >= k for n in expected.values()) for k in range(1, len(steps) + 1)]
    counts = [r["reached"] for r in table]
    assert counts == sorted(counts, reverse=True)


def test_steps_are_checked(spark):
    events = spark.createDataFrame([], SCHEMA)
    for steps in ([], ["a"] * 13):
        with pytest.raises(ValueError):
            session_reach(events, steps)


def test_no_events(spark):
    table = conversion(spark.createDataFrame([], SCHEMA), ["a", "b"]).collect()
    assert [tuple(r) for r in table] == [(1, "a", 0, None, None), (2, "b", 0, None, None)]
