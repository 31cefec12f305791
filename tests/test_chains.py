"""Batches by size or time, tenants as a cache sees them, and the chains below both, against walking the queue."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from footfall.operators import batching, chains, freshness
from footfall.operators.batching import Batching
from pyspark.sql import functions as F

START = datetime(2024, 1, 1)


def walked(rows):
    """(place, bound) in order: (begin, number) of each."""
    out, begin, bound, number = {}, None, None, -1
    for place, own in sorted(rows):
        if begin is None or place >= bound:
            begin, bound, number = place, own, number + 1
        out[place] = (begin, number)
    return out


@pytest.mark.parametrize("block", [40, 97, 5000])
@pytest.mark.parametrize("kind", ["dense", "sparse", "gaps"])
def test_spans_equal_walking(spark, block, kind):
    rng, rows = random.Random(block), []
    for key in ("a", "b", None):
        places = {
            "dense": range(700), "sparse": sorted(rng.sample(range(20_000), 300)),
            "gaps": [*range(90), *range(400, 480), *range(2000, 2200, 3)],
        }[kind]
        rows += [(key, place, place + rng.randint(1, 40)) for place in places]
    found = chains.spans(spark.createDataFrame(rows, "queue string, place long, bound long"), ["queue"], 40, block).collect()
    assert len(found) == len(rows)
    by_key = defaultdict(list)
    for key, place, bound in rows:
        by_key[key].append((place, bound))
    for key, own in by_key.items():
        assert {r.place: (r.begin, r.number) for r in found if r.queue == key} == walked(own)


def test_span_may_not_reach_over_a_block(spark):
    with pytest.raises(ValueError):
        chains.spans(spark.range(1), ["id"], 10, 9)


def batches_of(arrivals, size, wait_ms):
    """(ms, id) in order as (first id, first ms, size)."""
    out = []
    for ms, i in sorted(arrivals):
        if not out or out[-1][2] == size or ms > out[-1][1] + wait_ms:
            out.append([i, ms, 0])
        out[-1][2] += 1
    return [tuple(b) for b in out]


@pytest.fixture(scope="module")
def arrivals(spark):
    rng, rows = random.Random(4), []
    for queue, n, pause in (("busy", 900, 3), ("slow", 120, 900), ("burst", 300, 0), (None, 80, 400)):
        ms = 0
        for _ in range(n):
            ms += rng.randint(0, 2 * pause) + (5000 if rng.random() < 0.01 else 0)
            rows.append((len(rows), queue, ms))
    rows += [(len(rows), "edge", ms) for ms in (0, 1000, 1001, 2001, 2002)]
    timed = [(i, q, START + timedelta(milliseconds=ms)) for i, q, ms in rows]
    return rows, spark.createDataFrame(timed, "event_id long, queue string, arrived_at timestamp_ntz")


@pytest.mark.parametrize("block", [50, 130, 1 << 16])
def test_batches_equal_a_worker(arrivals, block):
    rows, df = arrivals
    found = batching.batches(df, Batching(50, 1000), "queue", block).collect()
    by_queue = defaultdict(list)
    for i, q, ms in rows:
        by_queue[q or ""].append((ms, i))
    assert {r.queue for r in found} == set(by_queue)
    for queue, own in by_queue.items():
        mine = sorted((r for r in found if r.queue == queue), key=lambda r: r.number)
        assert [r.number for r in mine] == list(range(len(mine)))
        got = [(r.first_event, (r.first_time - START) // timedelta(milliseconds=1), r["size"]) for r in mine]
        assert got == batches_of(own, 50, 1000)
    assert 50 in {r["size"] for r in found if r.queue == "burst"}
    # An arrival just as the first one has waited long enough still belongs to its batch.
    assert [r["size"] for r in sorted(found, key=lambda r: r.number) if r.queue == "edge"] == [2, 2, 1]


def test_one_queue_for_all(arrivals):
    rows, df = arrivals
    found = sorted(batching.batches(df).collect(), key=lambda r: r.number)
    assert [r["size"] for r in found] == [b[2] for b in batches_of([(ms, i) for i, _, ms in rows], 50, 1000)]
    assert batching.batches(df.limit(0)).count() == 0


def test_the_look_ahead_is_a_search(spark):
    # A frame over the waiting time costs the arrivals within it, for each arrival.
    rng = random.Random(2)
    times = sorted(rng.choice([rng.randrange(4000), rng.randrange(60_000)]) for _ in range(400))
    df = spark.createDataFrame([("q", i, ms, i) for i, ms in enumerate(times)], "queue string, event_id long, ms long, place long")
    bounded = batching._bounded(df, Batching(20, 1000), 64)
    assert "RangeFrame" not in bounded._jdf.queryExecution().toString()
    found = {r.place: r.bound for r in bounded.collect()}
    assert found == {i: min(i + 20, sum(t <= ms + 1000 for t in times)) for i, ms in enumerate(times)}


# Tenants as a cache sees them


def seen_by_cache(arrivals, versions, ttl):
    """(token, ms) arrivals: (tenant, version, loaded) of each in order."""
    out, cache = {}, {}
    for i, token, ms in sorted(arrivals, key=lambda a: a[2]):
        if token in cache and ms < cache[token][2] + ttl:
            out[i] = cache[token]
            continue
        known = [v for v in versions if v[1] == token and v[3] <= ms]
        cache.pop(token, None)
        out[i] = (None, None, None)
        if known:
            newest = max(known, key=lambda v: (v[3], v[2]))
            out[i] = cache[token] = (newest[0], newest[2], ms)
    return out


def test_tenants_are_as_old_as_the_cache(spark):
    rng = random.Random(9)
    day = 86_400_000
    arrivals = [(i, rng.choice("ABCD"), rng.choice([rng.randrange(3 * day), rng.randrange(day, day + 900_000)])) for i in range(1500)]
    # Two arrivals in one millisecond, one at the very end of a lifetime, and one of no token.
    arrivals += [(1500, "E", 0), (1501, "E", 0), (1502, "E", 300_000), (1503, "E", 299_999), (1504, None, 5)]
    versions = [(f"t{t}", t, n, at) for t in "ABE" for n, at in enumerate([0, 1000, day, day + 100_000, day + 100_000, 2 * day])]
    versions += [("tC", "C", 0, day + 450_000)]
    at = lambda ms: START + timedelta(milliseconds=ms)
    found = freshness.resolve_as_of(
        spark.createDataFrame([(i, t, at(ms)) for i, t, ms in arrivals], "event_id long, token string, arrived_at timestamp_ntz"),
        spark.createDataFrame([(i, t, v, at(ms)) for i, t, v, ms in versions], "id string, token string, version long, changed_at timestamp_ntz"),
    ).collect()
    expected = seen_by_cache(
        [(i, t.lower() if t else t, ms) for i, t, ms in arrivals], [(i, t.lower(), v, ms) for i, t, v, ms in versions], 300_000
    )
    assert len(found) == len(arrivals)
    for r in found:
        tenant, version, loaded = expected[r.event_id]
        assert (r.tenant_id, r.version, r.loaded_at) == (tenant, version, None if loaded is None else at(loaded))
    stale = [r for r in found if r.version is not None]
    assert len({r.version for r in stale}) > 3


def test_as_of_finds_the_last_version(spark):
    probes = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9), (None, 9), ("a", 0)], "k string, at long")
    versions = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 2, "y"), ("a", 6, 3, "z"), (None, 1, 1, "n")], "k string, at long, v int, value string")
    found = freshness.as_of(probes, versions, ["k"], "at", ["v"], "value").collect()
    assert {(r.k, r["at"]): r.value for r in found} == {("a", 5): "y", ("a", 1): "y", ("b", 9): None, (None, 9): None, ("a", 0): None}
