"""Reports on empty input, scopes, and consistency between reports."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from footfall import schemas
from footfall.operators import live, quality, rollups, stats, tenancy
from footfall.operators.scope import TenantScope, visible_tenants
from footfall.sources.fixtures import AS_OF, HOT_TENANT


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], schemas.EVENTS)


def test_empty_reports(empty):
    scope = TenantScope(empty, HOT_TENANT)
    assert tuple(stats.summary(scope, "24h", AS_OF).first()) == (0, 0)
    assert tuple(stats.overview(scope, "24h", AS_OF).first()) == (0, 0, [], [])
    assert tuple(stats.realtime(scope, AS_OF).first()) == (0, 0)
    assert stats.timeseries(scope, "7d", as_of=AS_OF).count() == 0
    assert stats.event_log(scope).count() == 0


def test_future_events_count_unless_bounded(spark):
    times = [AS_OF - timedelta(hours=24), AS_OF - timedelta(hours=24, milliseconds=1), AS_OF, AS_OF + timedelta(days=3)]
    rows = [(n, t, "t", "e", "{}", f"s{n % 2}", None, None, None, None, None, None, None) for n, t in enumerate(times)]
    scope = TenantScope(spark.createDataFrame(rows, schemas.EVENTS), "T")
    assert tuple(stats.summary(scope, "24h", AS_OF).first()) == (3, 2)
    assert tuple(stats.summary(scope, "24h", AS_OF, bounded=True).first()) == (2, 1)


def test_overview_agrees_with_its_parts(fixtures):
    scope = TenantScope(fixtures.web_events(), HOT_TENANT)
    whole = stats.overview(scope, "30d", AS_OF).first()
    assert (whole["total_events"], whole["unique_sessions"]) == tuple(stats.summary(scope, "30d", AS_OF).first())
    for name, column in (("top_pages", "url"), ("top_referrers", "referrer")):
        alone = stats.top_values(scope, column, "30d", AS_OF).collect()
        assert [tuple(r) for r in whole[name]] == [tuple(r) for r in alone]


def test_overview_reads_the_events_once(fixtures):
    """Both branches of the report share one shuffle of counted values."""
    report = stats.overview(TenantScope(fixtures.web_events(), HOT_TENANT), "30d", AS_OF)
    report.collect()
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_hours_add_up(fixtures):
    events = fixtures.plain_events()
    hours = rollups.hourly_stats(events)
    assert hours.agg(F.sum("count")).first()[0] == events.count()


def test_scopes_do_not_overlap(fixtures):
    events = fixtures.plain_events()
    ids = [r[0] for r in events.select("tenant_id").distinct().collect()]
    assert sum(TenantScope(events, i).rows().count() for i in ids) == events.count()
    assert TenantScope(events, None).rows().count() == 0
    assert TenantScope(events, "").rows().count() == 0
    scope = TenantScope(events, ids[0])
    assert scope.foreign_rows(scope.rows()).count() == 0


def test_tenants_are_visible_by_id_or_owner(spark):
    rows = [(i, i, i, [], "free", AS_OF, owner) for i, owner in (("a", "u"), ("b", None), ("c", "v"))]
    tenants = spark.createDataFrame(rows, schemas.TENANTS)
    seen = lambda t, u: sorted(r["id"] for r in visible_tenants(tenants, t, u).collect())
    assert seen("b", "v") == ["b", "c"]
    assert seen(None, "u") == ["a"]
    assert seen("", None) == []


def test_series_of_one_point_and_flat_series(spark):
    one = spark.createDataFrame([(AS_OF, 5)], "bucket timestamp_ntz, count long")
    assert tuple(stats.scaled_series(one).first())[2:] == (0.0, 0.0)
    flat = spark.createDataFrame([(AS_OF + timedelta(days=n), 5) for n in range(3)], "bucket timestamp_ntz, count long")
    assert [(r["x"], r["y"]) for r in stats.scaled_series(flat).orderBy("bucket").collect()] == [(0, 0), (0.5, 0), (1, 0)]


def test_session_takes_device_of_first_event(spark):
    rows = [
        (2, datetime(2024, 1, 1, 0, 0), "t", "pageview", "{}", "s", None, None, None, "mobile", None, None, None),
        (1, datetime(2024, 1, 1, 0, 0), "t", "click", "{}", "s", None, None, None, "tablet", None, None, None),
        (3, datetime(2024, 1, 2, 0, 0), "t", "pageview", "{}", "s", None, None, None, "desktop", None, None, None),
    ]
    (row,) = rollups.sessions(spark.createDataFrame(rows, schemas.EVENTS)).collect()
    assert (row["device"], row["page_count"], row["ended_at"]) == ("tablet", 2, datetime(2024, 1, 2))


def test_relay_hides_address_and_country(fixtures):
    columns = live.relay(fixtures.stored_events()).columns
    assert "ip_hash" not in columns and "country" not in columns


def test_merged_feed_equals_feed_of_all(fixtures):
    events = fixtures.plain_events().select("tenant_id", "event_id", "time")
    early, late = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")
    merged = live.merged_feed(live.newest(early), late)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, live.newest(events).collect()))


def test_audits(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "y")], "tenant_id string, v string")
    nulls = {r["column_name"]: r["null_count"] for r in quality.null_audit(df, ["tenant_id", "v"]).collect()}
    assert nulls == {"tenant_id": 1, "v": 1}
    assert [tuple(r) for r in quality.unique_audit(df, ["tenant_id"]).collect()] == [("a", 2)]
    assert quality.required(schemas.EVENTS)[:3] == ["event_id", "time", "tenant_id"]


def test_purge_twice_changes_nothing(fixtures):
    gone = fixtures.plain_events().select("tenant_id").distinct().limit(3)
    once = tenancy.purge(fixtures.plain_events(), gone)
    assert once.count() == tenancy.purge(once, gone).count()


# Totals from bitmaps of sessions


def test_session_numbers_are_dense_and_stay(fixtures):
    events = fixtures.plain_events()
    early = events.where("event_id % 3 = 0")
    known = rollups.numbered_sessions(early)
    whole = rollups.numbered_sessions(events, known)
    key = lambda r: (r.tenant_id, r.session_id)
    first, both = {key(r): r for r in known.collect()}, {key(r): r for r in whole.collect()}
    assert len(both) == events.select("tenant_id", "session_id").distinct().count() > len(first)
    assert all(both[k] == r for k, r in first.items())
    numbers = {}
    for r in both.values():
        numbers.setdefault((r.tenant_id, r.part), []).append(r.number)
    assert all(sorted(own) == list(range(len(own))) for own in numbers.values())


def test_totals_of_any_range_from_bitmaps(spark, fixtures):
    odd = fixtures.plain_events().limit(40).withColumn("session_id", F.lit(None).cast("string"))
    events = fixtures.plain_events().unionByName(odd)
    hours = rollups.hourly_sessions(events, rollups.numbered_sessions(events))
    for tenant in (HOT_TENANT, None):
        for key in ("24h", "7d", "30d"):
            expected = stats.summary(TenantScope(events, tenant), key, AS_OF).first()
            assert tuple(rollups.summary_from_hours(hours, tenant, key, AS_OF).first()) == tuple(expected)


def test_bitmaps_of_many_sessions(spark):
    # More sessions in a part than a bitmap has bits.
    events = spark.range(700_000).selectExpr(
        "'t' AS tenant_id", "concat('s', id) AS session_id", "timestamp_ntz'2024-01-30 12:00:00' AS time"
    )
    hours = rollups.hourly_sessions(events, rollups.numbered_sessions(events))
    assert hours.select("bucket").distinct().count() > 1
    assert tuple(rollups.summary_from_hours(hours, "t", "24h", AS_OF).first()) == (700_000, 700_000)
