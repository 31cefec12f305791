"""Every registered query: ``name -> (spark, folder of the test tables) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from footfall import schemas
from footfall.functions import events as event_functions
from footfall.functions import hosts, net, text, timing, useragent
from footfall.operators import (
    admission, batching, enrichment, freshness, funnels, live, quality, ratelimit, rollups, stats, tenancy, validation,
)
from footfall.operators.lookup import lookup
from footfall.operators.scope import TenantScope
from footfall.session import configure, new_path, stage
from footfall.sources import properties, raw, store
from footfall.sources.fixtures import (
    AS_OF, CLASSED_AGENTS, CLICKED, FUNNEL_STEPS, GONE, HOT_TENANT, JOB_FAILS, SHAPED_URLS, Fixtures,
)
from footfall.sources.table import Site, Table
from footfall.streaming import activity as stream_activities
from footfall.streaming import batches as stream_batching
from footfall.streaming import limiter as stream_limiter
from footfall.streaming import live as stream_live
from footfall.streaming import rollups as stream_rollups
from footfall.streaming.ingest import IngestPipeline
from footfall.streaming.retries import RetryQueue

Query = Callable[[SparkSession, str], DataFrame]

# The default limit never strikes on this sparse data.
LIMIT = ratelimit.Limit(max_events=10, window_seconds=6 * 3600)
# For the same reason batches wait, and tenants are kept, for hours.
BATCHING = batching.Batching(size=50, wait_ms=4 * 3600 * 1000)
TTL = timedelta(hours=6)
OTHER_TENANT = "00000000-0000-4000-8000-000000000002"
OWNER = "20000000-0000-4000-8000-000000000003"

SITE = {"events": schemas.EVENTS, "hours": schemas.HOURLY_STATS, "sessions": schemas.SESSIONS, "funnels": schemas.FUNNELS}

QUERIES: dict[str, Query] = {}


def query(build: Callable[[Fixtures], DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(Fixtures(configure(spark), folder))

    QUERIES[build.__name__] = run
    return run


def _joined(items: str | Column) -> Column:
    return F.array_join(items, "|")


def _scope(events: DataFrame, tenant: str = HOT_TENANT) -> TenantScope:
    return TenantScope(events, tenant)


# Admission


@query
def ingest_parse(f: Fixtures) -> DataFrame:
    parsed = validation.parse_bodies(f.raw_posts())
    return parsed.select(
        "event_id", "readable", "token", "event_name", "properties", "session_id", "url", "referrer",
        "occurred_at", "user_agent",
    )


@query
def ingest_validation(f: Fixtures) -> DataFrame:
    checked = admission.validate(f.raw_posts())
    return checked.select("event_id", "readable", "violations")


@query
def job_validation(f: Fixtures) -> DataFrame:
    return f.queued_jobs().select("event_id", validation.job_violations().alias("violations"))


@query
def tenant_resolve(f: Fixtures) -> DataFrame:
    resolved = admission.resolve(admission.validate(f.raw_posts()), f.tenants())
    return resolved.select("event_id", "tenant_id", "status")


@query
def unknown_tokens(f: Fixtures) -> DataFrame:
    return admission.unknown_tokens(f.arrivals(), f.tenants())


@query
def whitelist_normalise(f: Fixtures) -> DataFrame:
    entries = f.tenant_log().select("id", "version", F.posexplode("domain_whitelist").alias("place", "entry"))
    return entries.select(
        "id", "version", F.col("place").cast("long").alias("place"),
        net.whitelist_host(F.col("entry")).alias("host"),
    )


@query
def url_host(f: Fixtures) -> DataFrame:
    url = F.col("url")
    return f.table("pages").select("page_id", net.url_host(url).alias("host"), net.is_url(url).alias("is_url"))


@query
def url_host_shapes(f: Fixtures) -> DataFrame:
    return f.sql(SHAPED_URLS).select("page_id", "url", hosts.browser_host(F.col("url")).alias("host"))


@query
def domain_admission(f: Fixtures) -> DataFrame:
    events = f.web_events().select("event_id", "tenant_id", net.url_host(F.col("url")).alias("host"))
    hosts = f.tenants().select(
        F.col("id").alias("tenant_id"), net.whitelist_endings(F.col("domain_whitelist")).alias("endings")
    )
    allowed = net.domain_allowed(net.dotted(F.col("host")), F.col("endings"))
    return lookup(events, hosts, "tenant_id", "inner").select("event_id", "host", allowed.alias("allowed"))


@query
def client_ip(f: Fixtures) -> DataFrame:
    ip = net.client_ip(F.col("forwarded_for"), F.col("remote_ip"))
    return f.raw_posts().select("event_id", ip.alias("client_ip"))


@query
def ip_anonymise(f: Fixtures) -> DataFrame:
    ip = F.col("remote_ip")
    return f.raw_posts().select("event_id", net.truncated_ip(ip).alias("truncated"), net.ip_hash(ip).alias("ip_hash"))


@query
def ua_enrich(f: Fixtures) -> DataFrame:
    agent = F.col("user_agent")
    return f.plain_events().select(
        "event_id",
        useragent.device(agent).alias("device"),
        useragent.operating_system(agent).alias("os"),
        useragent.browser(agent).alias("browser"),
    )


@query
def ua_classes(f: Fixtures) -> DataFrame:
    agent = F.col("user_agent")
    return f.sql(CLASSED_AGENTS).select(
        "event_id", "user_agent", useragent.device(agent).alias("device"),
        useragent.operating_system(agent).alias("os"), useragent.browser(agent).alias("browser"),
    )


@query
def arrival_rate(f: Fixtures) -> DataFrame:
    return ratelimit.arrival_rate(f.arrivals(), LIMIT)


@query
def rate_limit(f: Fixtures) -> DataFrame:
    return ratelimit.rate_limit(f.arrivals(), LIMIT)


@query
def ingest_batches(f: Fixtures) -> DataFrame:
    return batching.batches(f.arrivals(), BATCHING).drop("queue")


@query
def ingest_batches_by_worker(f: Fixtures) -> DataFrame:
    # One worker takes every other arrival, three share the rest.
    worker = F.when(F.col("event_id") % 2 == 0, 0).otherwise(F.col("event_id") % 3 + 1)
    return batching.batches(f.arrivals().withColumn("worker", worker), BATCHING, "worker", block=256)


@query
def tenant_resolve_asof(f: Fixtures) -> DataFrame:
    return freshness.resolve_as_of(f.arrivals(), f.tenant_versions(), TTL)


def _outcomes(f: Fixtures) -> DataFrame:
    return admission.admit(f.raw_posts(), f.tenants(), LIMIT)


@query
def admission_outcomes(f: Fixtures) -> DataFrame:
    return admission.outcome_counts(_outcomes(f))


@query
def accepted_events(f: Fixtures) -> DataFrame:
    return admission.jobs(_outcomes(f))


@query
def quarantine(f: Fixtures) -> DataFrame:
    return admission.rejects(_outcomes(f))


@query
def enriched_events(f: Fixtures) -> DataFrame:
    sound, _ = enrichment.split_jobs(f.queued_jobs())
    return enrichment.enrich(sound)


# Reports of a tenant


@query
def overview_summary(f: Fixtures) -> DataFrame:
    return stats.summary(_scope(f.plain_events()), "7d", AS_OF)


@query
def top_pages(f: Fixtures) -> DataFrame:
    return stats.top_values(_scope(f.web_events()), "url", "7d", AS_OF)


@query
def top_referrers(f: Fixtures) -> DataFrame:
    return stats.top_values(_scope(f.web_events()), "referrer", "30d", AS_OF)


@query
def overview(f: Fixtures) -> DataFrame:
    listed = lambda name: F.array_join(
        F.transform(name, lambda row: F.concat(row["value"], F.lit("="), row["count"])), "|"
    )
    return stats.overview(_scope(f.web_events()), "30d", AS_OF).select(
        "total_events", "unique_sessions", listed("top_pages").alias("top_pages"),
        listed("top_referrers").alias("top_referrers"),
    )


@query
def timeseries_hour(f: Fixtures) -> DataFrame:
    return stats.timeseries(_scope(f.plain_events()), "24h", as_of=AS_OF)


@query
def timeseries_day(f: Fixtures) -> DataFrame:
    return stats.timeseries(_scope(f.plain_events()), "30d", as_of=AS_OF)


@query
def timeseries_day_event(f: Fixtures) -> DataFrame:
    return stats.timeseries(_scope(f.plain_events()), "7d", " pageview ", AS_OF)


@query
def series_scaled(f: Fixtures) -> DataFrame:
    return stats.scaled_series(stats.timeseries(_scope(f.plain_events()), "30d", as_of=AS_OF))


@query
def realtime(f: Fixtures) -> DataFrame:
    return stats.realtime(_scope(f.plain_events()), AS_OF)


@query
def event_log(f: Fixtures) -> DataFrame:
    return stats.event_log(_scope(f.stored_events()), limit=50, offset=25)


@query
def event_log_display(f: Fixtures) -> DataFrame:
    return stats.displayed_log(stats.event_log(_scope(f.stored_events(), OTHER_TENANT), limit=200))


@query
def property_breakdown(f: Fixtures) -> DataFrame:
    return stats.property_breakdown(_scope(f.plain_events()), "k")


@query
def property_breakdown_stored(f: Fixtures) -> DataFrame:
    root = new_path(f.spark, "site")
    for number, part in enumerate(_slices(f.plain_events(), "time")):
        properties.write_properties(part, root, number)
    return stats.property_breakdown(_scope(properties.read_properties(f.spark, root)), "k")


@query
def synthetic_posts(f: Fixtures) -> DataFrame:
    tokens = f.arrivals().groupBy("token").agg(F.max("arrived_at").alias("at"))
    posts = raw.synthetic_traffic(tokens, "https://example.com/try", "https://example.com/", F.col("at"))
    parsed = validation.parse_bodies(posts)
    return parsed.select(
        "arrived_at", "readable", "token", "event_name", "properties", "session_id", "url", "referrer", "occurred_at",
    )


@query
def click_properties(f: Fixtures) -> DataFrame:
    clicked = event_functions.click_properties(
        F.col("tag"), F.col("element_id"), F.col("text"), F.col("href")
    )
    return f.sql(CLICKED).select("event_id", clicked.alias("click")).select("event_id", "click.*")


@query
def tenant_isolation(f: Fixtures) -> DataFrame:
    events = f.plain_events()
    seen = [
        TenantScope(events, tenant).rows().agg(F.count("*").alias("visible")).withColumn("scope", F.lit(name))
        for name, tenant in (("hot", HOT_TENANT), ("other", OTHER_TENANT), ("unset", None), ("empty", ""))
    ]
    refused = _scope(events).foreign_rows(events).agg(F.count("*").alias("visible"))
    return reduce(DataFrame.unionByName, seen).unionByName(refused.withColumn("scope", F.lit("foreign to hot")))


@query
def tenant_visibility(f: Fixtures) -> DataFrame:
    return tenancy.visible_tenants(f.tenants(), OTHER_TENANT, OWNER).select("id", "owner_user_id")


# Rollups, sessions, funnels


@query
def batch_by_tenant(f: Fixtures) -> DataFrame:
    counted = enrichment.by_tenant(f.plain_events())
    return counted.withColumn("shown_events", text.grouped_digits(F.col("events")))


@query
def hourly_stats(f: Fixtures) -> DataFrame:
    return rollups.hourly_stats(f.plain_events())


@query
def sessions(f: Fixtures) -> DataFrame:
    return rollups.sessions(f.stored_events())


@query
def sessions_by_gap(f: Fixtures) -> DataFrame:
    return rollups.sessions_by_gap(f.plain_events(), "user_id", timedelta(hours=12))


@query
def timeseries_from_rollup(f: Fixtures) -> DataFrame:
    hours = rollups.hourly_stats(f.plain_events())
    return rollups.timeseries_from_hours(hours, HOT_TENANT, "30d", "pageview", AS_OF)


@query
def overview_from_rollup(f: Fixtures) -> DataFrame:
    # The second half of the month comes later: sessions known by then keep their numbers.
    events = f.plain_events()
    early = events.where(F.col("time") < F.lit("2024-01-16 12:00:00").cast("timestamp_ntz"))
    known = stage(rollups.numbered_sessions(early), "sessions")
    numbered = stage(rollups.numbered_sessions(events, known), "sessions")
    hours = stage(rollups.hourly_sessions(events, numbered), "hours")
    return rollups.summary_from_hours(hours, HOT_TENANT, "7d", AS_OF)


@query
def rollup_reconcile(f: Fixtures) -> DataFrame:
    # Late events touch a third of the days. Stored counts are off by a thousand, so kept rows can be told
    # from rows counted anew.
    events = f.plain_events()
    late = (F.col("event_name") == "error") & (F.day("time") % 3 == 0)
    stored = rollups.hourly_stats(events.where(~late)).withColumn("count", F.col("count") + 1000)
    return rollups.reconciled_hours(stored, events, rollups.touched_days(events.where(late)))


def _funnel(name: str, steps: list[str], tenant: str | None) -> None:
    def build(f: Fixtures) -> DataFrame:
        events = f.plain_events()
        return funnels.conversion(events if tenant is None else _scope(events, tenant).rows(), steps)

    build.__name__ = name
    query(build)


_funnel("funnel_conversion", FUNNEL_STEPS[0], HOT_TENANT)
_funnel("funnel_conversion_all_tenants", FUNNEL_STEPS[0], None)
@query
def funnel_conversion_range(f: Fixtures) -> DataFrame:
    start = timing.range_start("7d", AS_OF)
    return funnels.conversion(_scope(f.plain_events(), HOT_TENANT).since(start), FUNNEL_STEPS[0])


_funnel("funnel_conversion_two_steps", FUNNEL_STEPS[1], None)
_funnel("funnel_conversion_repeated_step", FUNNEL_STEPS[2], None)


# Live views


@query
def live_feed(f: Fixtures) -> DataFrame:
    return live.newest(f.plain_events()).select(
        "tenant_id", "event_id", "time", "event_name", "session_id", F.col("place").cast("long").alias("place")
    )


@query
def live_relay(f: Fixtures) -> DataFrame:
    return live.relay(f.stored_events())


@query
def live_fanout(f: Fixtures) -> DataFrame:
    feed = live.newest(f.plain_events().select("tenant_id", "event_id", "time", "event_name"))
    return live.fan_out(stage(feed.drop("place"), "feed"), f.subscriptions())


@query
def live_delivered(f: Fixtures) -> DataFrame:
    return live.delivered(f.plain_events(), f.subscriptions())


# Tenants and definitions


def _flat(tenants: DataFrame) -> DataFrame:
    return tenants.withColumn("domain_whitelist", _joined("domain_whitelist"))


@query
def tenant_list(f: Fixtures) -> DataFrame:
    return _flat(tenancy.listing(f.tenants()))


@query
def tenant_by_token(f: Fixtures) -> DataFrame:
    return _flat(tenancy.with_token(f.tenants(), HOT_TENANT.replace("0", "1", 1)))


@query
def tenant_for_owner(f: Fixtures) -> DataFrame:
    users = f.setup_requests().select("owner_user_id").distinct()
    return _flat(tenancy.of_owners(f.tenants(), users))


@query
def tenant_latest(f: Fixtures) -> DataFrame:
    return _flat(tenancy.latest(f.tenant_log())).select("id", "name", "domain_whitelist", "version")


@query
def tenant_setup(f: Fixtures) -> DataFrame:
    # Ids are random in use; here they follow from the request.
    numbered = lambda prefix: F.concat(F.lit(prefix), F.lpad(F.col("request_id").cast("string"), 12, "0"))
    new = tenancy.setup(
        f.tenants(), f.setup_requests(), numbered("30000000-0000-4000-8000-"), numbered("40000000-0000-4000-8000-")
    )
    return _flat(new)


@query
def domain_update(f: Fixtures) -> DataFrame:
    changed = tenancy.with_domains(f.tenant_log(), f.domain_requests())
    return _flat(changed).select("id", "name", "domain_whitelist", "version")


def _funnel_rows(f: Fixtures) -> DataFrame:
    new_id = F.concat(F.lit("50000000-0000-4000-8000-"), F.lpad(F.col("request_id").cast("string"), 12, "0"))
    return tenancy.new_funnels(f.funnel_requests(), new_id)


@query
def funnel_create(f: Fixtures) -> DataFrame:
    return _funnel_rows(f)


@query
def funnel_list(f: Fixtures) -> DataFrame:
    return tenancy.shown_funnels(tenancy.funnels_of(_scope(_funnel_rows(f), OTHER_TENANT)))


@query
def definition_validation(f: Fixtures) -> DataFrame:
    rules = [
        f.setup_requests().select(
            F.lit("tenant").alias("kind"), F.col("request_id").alias("request_id"),
            validation.tenant_name_ok(F.col("name")).alias("sound"),
        ),
        f.domain_requests().select(
            F.lit("domains").alias("kind"), F.col("version").alias("request_id"),
            validation.domains_ok(F.col("domains")).alias("sound"),
        ),
        f.funnel_requests().select(
            F.lit("funnel").alias("kind"), F.col("request_id").alias("request_id"),
            validation.funnel_ok(F.col("name"), F.col("steps")).alias("sound"),
        ),
    ]
    return reduce(DataFrame.unionByName, rules)


@query
def parse_list(f: Fixtures) -> DataFrame:
    items = f.table("documents").select("doc_id", text.parse_list(F.col("text")).alias("items"))
    return items.select("doc_id", F.size("items").cast("long").alias("items"), F.md5(_joined("items")).alias("digest"))


@query
def tenant_purge(f: Fixtures) -> DataFrame:
    return tenancy.purge(f.plain_events(), f.sql(GONE)).select("event_id", "tenant_id")


def _purged_site(f: Fixtures) -> Site:
    """Events, their rollups and funnels, from which a part of the tenants is removed."""
    site = Site(f.spark, new_path(f.spark, "site"), **SITE)
    events = stage(f.stored_events(), "stored")
    for name, rows in {
        "events": events, "hours": rollups.hourly_stats(events), "sessions": rollups.sessions(events), "funnels": _funnel_rows(f),
    }.items():
        site[name].append(rows.select(SITE[name].names))
    site.remove(f.sql(GONE))
    return site


@query
def tenant_purge_cascade(f: Fixtures) -> DataFrame:
    # Half of the tables still hold the removed rows in their files, the other half doesn't.
    site = _purged_site(f)
    for name in ("events", "funnels"):
        site[name].rewrite()
    counts = [site[name].read().groupBy("tenant_id").agg(F.count("*").alias("rows")).withColumn("kind", F.lit(name)) for name in SITE]
    return reduce(DataFrame.unionByName, counts)


@query
def events_append_writers(f: Fixtures) -> DataFrame:
    root = new_path(f.spark, "shared-events")
    tables = [Table(f.spark, root, SITE["events"]) for _ in range(4)]
    with ThreadPoolExecutor(4) as writers:  # each with its own part of the month, at the same time
        list(writers.map(lambda pair: pair[0].append(pair[1]), zip(tables, _slices(stage(f.stored_events(), "stored"), "time"))))
    return tables[0].read()


# Quality


@query
def null_audit(f: Fixtures) -> DataFrame:
    return quality.null_audit(f.stored_events(), schemas.EVENTS.names)


@query
def unique_audit(f: Fixtures) -> DataFrame:
    # The newest version of each tenant keeps the rules; requests ask twice for an owner and so break one.
    newest = stage(tenancy.latest(f.tenant_log()), "newest")
    by_key = lambda df, key, rule: quality.unique_audit(df, [key]).select(
        F.lit(rule).alias("rule"), F.col(key).alias("value"), "copies"
    )
    audits = [by_key(newest, key, key) for key in ("id", "token", "owner_user_id")]
    audits.append(by_key(f.setup_requests(), "owner_user_id", "requested owner"))
    hours = quality.unique_audit(rollups.hourly_stats(f.plain_events()), ["tenant_id", "hour", "event_name"])
    hours = hours.select(F.lit("hour").alias("rule"), F.col("tenant_id").alias("value"), "copies")
    return reduce(DataFrame.unionByName, [*audits, hours])


@query
def orphan_audit(f: Fixtures) -> DataFrame:
    left = tenancy.purge(f.tenants(), f.sql(GONE), "id")
    return quality.orphan_audit(f.plain_events(), left)


# Store and streams


def _slices(df: DataFrame, time: str) -> list[DataFrame]:
    """All rows in four slices of time, as they would arrive."""
    cuts = [F.lit(f"2024-01-{day:02} 00:00:00").cast("timestamp_ntz") for day in (8, 15, 22)]
    at = F.col(time)
    return [
        df.where(at < cuts[0]),
        df.where((at >= cuts[0]) & (at < cuts[1])),
        df.where((at >= cuts[1]) & (at < cuts[2])),
        df.where((at >= cuts[2]) | at.isNull()),
    ]


@query
def events_append(f: Fixtures) -> DataFrame:
    root = new_path(f.spark, "events")
    first, second, third, fourth = _slices(f.stored_events(), "time")
    store.append(first, root)
    store.append(second, root)
    store.compact(f.spark, root)
    store.append(third, root)
    store.append(fourth, root)
    return store.read_events(f.spark, root)


def _stream_of(f: Fixtures, df: DataFrame, time: str, name: str) -> DataFrame:
    """``df`` as a stream of micro-batches, one per slice of time.

    All slices have as many files, and a micro-batch takes that many.
    """
    path, files = new_path(f.spark, name), f.spark.sparkContext.defaultParallelism
    for part in _slices(df, time):
        part.repartition(files).write.mode("append").parquet(path)
    reader = f.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files)
    return reader.parquet(path)


def _event_stream(f: Fixtures, copies: int = 1) -> DataFrame:
    """The events in several micro-batches; every eleventh, and each further copy, lands ten days after its neighbours."""
    events = f.plain_events().withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    late = (F.col("copy") - 1) + F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)
    landed = events.withColumn("landed_at", F.col("time") + F.make_dt_interval(days=10 * late))
    return _stream_of(f, landed, "landed_at", "events").drop("copy", "landed_at")


@query
def stream_ingest(f: Fixtures) -> DataFrame:
    root = new_path(f.spark, "ingest")
    pipeline = IngestPipeline(f.spark, root, f.tenants, LIMIT)
    posts = _stream_of(f, f.raw_posts(), "arrived_at", "posts")
    pipeline.start(posts, f"{root}/checkpoint").awaitTermination()
    return pipeline.events()


@query
def stream_rate_limit(f: Fixtures) -> DataFrame:
    path = new_path(f.spark, "limited")
    posts = _stream_of(f, f.arrivals(), "arrived_at", "arrivals")
    limited = stream_limiter.limited(posts, LIMIT)
    with stream_limiter.state_store(f.spark):
        stream_rollups.start_append(limited, path, f"{path}-checkpoint").awaitTermination()
    return f.spark.read.schema(limited.schema).parquet(path).select("event_id", "token", "allowed", "remaining", "reset_at")


@query
def stream_dedupe(f: Fixtures) -> DataFrame:
    path = new_path(f.spark, "deduplicated")
    once = stream_rollups.without_repeats(_event_stream(f, copies=2))
    stream_rollups.start_append(once, path, f"{path}-checkpoint").awaitTermination()
    return f.spark.read.schema(once.schema).parquet(path).select("event_id", "tenant_id", "time", "event_name")


def _complete(f: Fixtures, table: DataFrame, name: str) -> DataFrame:
    path = new_path(f.spark, name)
    stream_rollups.start_complete(table, path, f"{path}-checkpoint").awaitTermination()
    return stream_rollups.read_latest(f.spark, path)


@query
def stream_hourly(f: Fixtures) -> DataFrame:
    return _complete(f, stream_rollups.hourly(_event_stream(f)), "hourly")


@query
def stream_sessions(f: Fixtures) -> DataFrame:
    return _complete(f, stream_rollups.sessions(_event_stream(f), "user_id", "12 hours"), "sessions")


@query
def stream_activity(f: Fixtures) -> DataFrame:
    path = new_path(f.spark, "activity")
    changes = stream_activities.activity_changes(_event_stream(f))
    with stream_limiter.state_store(f.spark):
        stream_activities.start_activity(changes, path, f"{path}-checkpoint").awaitTermination()
    return stream_activities.read_activity(f.spark, path)


@query
def stream_batches(f: Fixtures) -> DataFrame:
    path = new_path(f.spark, "batches")
    arrivals = f.arrivals().select("event_id", "arrived_at")
    closing = arrivals.agg((F.max("arrived_at") + F.make_dt_interval(days=F.lit(1))).alias("arrived_at"))
    arrivals = arrivals.unionByName(closing.select(F.lit(None).cast("long").alias("event_id"), "arrived_at"))
    batched = stream_batching.batched(_stream_of(f, arrivals, "arrived_at", "arrivals"), BATCHING)
    with stream_limiter.state_store(f.spark):
        stream_rollups.start_append(batched, path, f"{path}-checkpoint").awaitTermination()
    stored = f.spark.read.schema(batched.schema).parquet(path)
    return stored.select("number", "first_event", "first_time", "size")


@query
def stream_fanout(f: Fixtures) -> DataFrame:
    path = new_path(f.spark, "fanout")
    events = _event_stream(f).select("tenant_id", "event_id", "time", "event_name")
    visits = _stream_of(f, f.room_visits(), "joined_at", "visits")
    sent = stream_live.fan_out_stream(events, visits, delay="11 days")
    with stream_limiter.state_store(f.spark):
        stream_rollups.start_append(sent, path, f"{path}-checkpoint").awaitTermination()
    return f.spark.read.schema(sent.schema).parquet(path)


@query
def retry_outcomes(f: Fixtures) -> DataFrame:
    root = new_path(f.spark, "retries")
    queue = RetryQueue(f.spark, root, lambda jobs: jobs.withColumn("failed", F.expr(JOB_FAILS)))
    jobs = _stream_of(f, f.arrivals().select("event_id", "arrived_at"), "arrived_at", "jobs")
    queue.start(jobs, f"{root}/checkpoint").awaitTermination()
    queue.finish()
    return queue.outcomes().select("event_id", "attempts", "status", "finished_at")


@query
def stream_realtime(f: Fixtures) -> DataFrame:
    root, numbers = new_path(f.spark, "events"), new_path(f.spark, "realtime")

    def store_and_refresh(events: DataFrame, batch_id: int) -> None:
        store.write_batch(events, root, batch_id)
        stored = store.read_events(f.spark, root)
        stream_live.refresh_realtime(stored, HOT_TENANT, numbers, batch_id, AS_OF)

    events = _stream_of(f, f.stored_events(), "time", "stored")
    writer = events.writeStream.foreachBatch(store_and_refresh)
    writer = writer.option("checkpointLocation", f"{root}-checkpoint").trigger(availableNow=True)
    writer.start().awaitTermination()
    return stream_rollups.read_latest(f.spark, numbers)


@query
def stream_live_feed(f: Fixtures) -> DataFrame:
    path = new_path(f.spark, "feed")
    feed = stream_live.LiveFeed(f.spark, path)
    events = f.plain_events().select("tenant_id", "event_id", "time", "event_name", "session_id")
    feed.start(_stream_of(f, events, "time", "stored"), f"{path}-checkpoint").awaitTermination()
    return feed.read().withColumn("place", F.col("place").cast("long"))
