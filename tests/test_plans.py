"""Plans that must keep their shape for large data."""

from pyspark.sql import functions as F

from footfall.operators import admission, enrichment, funnels, live, ratelimit, stats
from footfall.operators.scope import TenantScope
from footfall.session import stage, work_dir
from footfall.sources.fixtures import AS_OF, HOT_TENANT


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_posts_are_resolved_and_enriched_without_a_shuffle(spark, fixtures):
    posts = stage(fixtures.raw_posts(), "posts")
    resolved = plan(admission.resolve(admission.validate(posts), fixtures.tenants()))
    assert "Exchange hashpartitioning" not in resolved
    assert "BroadcastHashJoin" in resolved
    enriched = plan(enrichment.enrich(stage(fixtures.queued_jobs(), "jobs")))
    assert "Exchange" not in enriched
    assert "Python" not in enriched


def test_rankings_are_cut_before_the_shuffle(fixtures):
    assert "WindowGroupLimit" in plan(live.newest(fixtures.plain_events()))
    pages = plan(stats.top_values(TenantScope(fixtures.web_events(), HOT_TENANT), "url", "7d", AS_OF))
    assert "TakeOrderedAndProject" in pages
    assert "partial_count" in pages


def test_page_of_the_log_is_not_a_full_sort(fixtures):
    log = plan(stats.event_log(TenantScope(fixtures.stored_events(), HOT_TENANT), 50, 100))
    assert "TakeOrderedAndProject(limit=150" in log


def test_reports_read_only_their_columns(spark, fixtures):
    events = stage(fixtures.stored_events(), "events")
    report = plan(stats.realtime(TenantScope(events, HOT_TENANT), AS_OF))
    assert "ReadSchema: struct<time:timestamp_ntz,tenant_id:string,session_id:string>" in report


def test_arrivals_combine_before_the_shuffle_and_windows_are_blocks(fixtures):
    rate = plan(ratelimit.arrival_rate(fixtures.arrivals()))
    assert "partial_count" in rate
    assert "hashpartitioning(token" in rate and "block" in rate


def test_funnel_cuts_sessions_by_range(fixtures):
    reach = plan(funnels.session_reach(fixtures.plain_events(), ["pageview", "click"]))
    assert "rangepartitioning(tenant_id" in reach
    assert "MapInArrow" in reach


def test_work_dir_is_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    assert shared is None or work_dir(spark).startswith(shared)


def test_salted_join_keeps_facts_without_a_key(spark, monkeypatch):
    from footfall.operators import lookup

    facts = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "n int, key string")
    dimension = spark.createDataFrame([("a", 10)], "key string, v int")
    monkeypatch.setattr(lookup, "is_small", lambda df: False)
    joined = lookup.lookup(facts, dimension, "key").orderBy(F.col("n")).collect()
    assert [(r["n"], r["v"]) for r in joined] == [(1, 10), (2, None), (3, None)]
