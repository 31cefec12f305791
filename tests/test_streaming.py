"""Streams give what the batch gives, and survive replays."""

import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from footfall.operators import live, rollups
from footfall.operators.ratelimit import Limit
from footfall.plans.catalog import _slices, _stream_of
from footfall.session import new_path
from footfall.sources import raw, store
from footfall.streaming import rollups as stream_rollups
from footfall.streaming.ingest import IngestPipeline
from footfall.streaming.live import LiveFeed


def rows(df):
    return sorted(map(repr, df.collect()))


def test_replayed_batch_changes_nothing(spark, fixtures):
    pipeline = IngestPipeline(spark, new_path(spark, "replay"), fixtures.tenants, Limit(10, 6 * 3600))
    first, second, third, fourth = _slices(fixtures.raw_posts(), "arrived_at")
    pipeline.process(first, 0)
    pipeline.process(second, 1)
    before = rows(pipeline.events()), rows(pipeline.feed()), rows(pipeline.outcomes())
    pipeline.process(second, 1)
    assert (rows(pipeline.events()), rows(pipeline.feed()), rows(pipeline.outcomes())) == before


def test_store_survives_compaction_and_replay(spark, fixtures):
    root = new_path(spark, "store")
    events = fixtures.stored_events()
    parts = _slices(events, "time")
    for number, part in enumerate(parts[:3]):
        store.write_batch(part, root, number)
    assert store.compact(spark, root) == 2
    assert store.compact(spark, root) is None
    store.write_batch(parts[3], root, 3)
    stored = store.read_events(spark, root)
    assert rows(stored.select(events.columns)) == rows(events)
    assert store.committed(spark, f"{root}/batches", "batch_id") == [0, 1, 2, 3]


def test_unfinished_batch_is_not_read(spark, fixtures):
    root = new_path(spark, "store")
    store.write_batch(fixtures.stored_events(), root, 0)
    fixtures.stored_events().write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(
        f"{root}/batches/batch_id=1"
    )
    assert store.read_events(spark, root).count() == fixtures.stored_events().count()


def test_report_prunes_days(spark, fixtures):
    from footfall.operators import stats
    from footfall.operators.scope import TenantScope
    from footfall.sources.fixtures import AS_OF, HOT_TENANT

    root = new_path(spark, "store")
    store.append(fixtures.stored_events(), root)
    report = stats.summary(TenantScope(store.read_events(spark, root), HOT_TENANT), "24h", AS_OF)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        plan = report._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "GreaterThanOrEqual(time" in plan
    assert "EqualTo(tenant_id" in plan


def test_closed_hours_then_reconcile(spark, fixtures):
    """Hours left open or late by the stream are put right by the batch job."""
    events = fixtures.plain_events().select("event_id", "tenant_id", "time", "event_name")
    path = new_path(spark, "hours")
    hours = stream_rollups.hourly(_stream_of(fixtures, events, "time", "events"), delay="1 hour")
    stream_rollups.start_append(hours, path, f"{path}-checkpoint").awaitTermination()
    stored = spark.read.schema(hours.schema).parquet(path)
    assert stored.count() < rollups.hourly_stats(events).count()
    whole = rollups.reconciled_hours(stored, events, rollups.touched_days(events))
    assert rows(whole) == rows(rollups.hourly_stats(events))


def test_live_feed_replay(spark, fixtures):
    feed = LiveFeed(spark, new_path(spark, "feed"))
    events = fixtures.plain_events().select("tenant_id", "event_id", "time")
    parts = _slices(events, "time")
    for number, part in enumerate(parts):
        feed.process(part, number)
    feed.process(parts[3], 3)
    assert rows(feed.read().select(live.newest(events).columns)) == rows(live.newest(events))


def test_raw_readers(spark, fixtures):
    path = new_path(spark, "raw")
    # JSON holds milliseconds.
    whole = F.date_trunc("MILLISECOND", "arrived_at").cast("timestamp_ntz")
    posts = fixtures.raw_posts().withColumn("arrived_at", whole)
    posts.write.json(path)
    assert rows(raw.read_raw(spark, path)) == rows(posts)
    bodies = new_path(spark, "bodies")
    posts.select("body").write.text(bodies)
    assert rows(raw.read_bodies(spark, bodies).select("body")) == rows(posts.select("body"))


def test_kafka_records(spark):
    schema = "value binary, partition int, offset long, timestamp timestamp, headers array<struct<key string, value binary>>"
    schema = schema.replace("key string", "key: string").replace("value binary>>", "value: binary>>")
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([(bytearray(b"{}"), 1, 7, at, [("user-agent", bytearray(b"UA"))])], schema)
    row = raw.from_kafka(df).first()
    assert (row["event_id"], row["body"], row["header_user_agent"], row["remote_ip"]) == ((1 << 44) + 7, "{}", "UA", None)


def test_synthetic_traffic_is_admitted(spark):
    from footfall.operators import admission

    token = "10000000-0000-4000-8000-00000000000c"
    posts = raw.synthetic_traffic(
        spark.createDataFrame([(token,)], "token string"), "http://localhost:8080/t.html", "http://referrer.example",
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"),
    )
    checked = admission.validate(posts).collect()
    assert [r["violations"] for r in checked] == ["", "", ""]
    assert len({r["session_id"] for r in checked}) == 1


def test_batch_without_an_accepted_post(spark, fixtures):
    pipeline = IngestPipeline(spark, new_path(spark, "refused"), fixtures.tenants)
    posts = fixtures.raw_posts()
    pipeline.process(posts.withColumn("body", F.lit("nonsense")), 0)
    pipeline.process(posts.where("false"), 1)
    assert pipeline.events().count() == 0
    assert pipeline.quarantine().count() == posts.count()
    pipeline.process(posts, 2)
    assert pipeline.events().count() > 0


def test_refresh_replaces_touched_days_only(spark, fixtures):
    path = new_path(spark, "hours")
    events = fixtures.plain_events()
    late = F.col("event_name") == "error"
    rollups.refresh_hours(events.where(~late), rollups.touched_days(events), path)
    first_week = events.where(F.col("time") < F.lit("2024-01-08").cast("timestamp_ntz"))
    rollups.refresh_hours(events, rollups.touched_days(first_week), path)
    stored = spark.read.parquet(path)
    expected = events.where(~late).unionByName(first_week.where(late))
    columns = ["tenant_id", "hour", "event_name", "count"]
    assert rows(stored.select(columns)) == rows(rollups.hourly_stats(expected).select(columns))


def test_old_first_copies_are_kept(spark):
    path = new_path(spark, "old")
    schema = "event_id long, time timestamp_ntz, landed int"
    hours = [[(1, 12)], [(2, 13), (1, 12)], [(3, 9), (2, 13)]]
    for landed, batch in enumerate(hours):
        made = [(event, datetime(2024, 1, 1, hour), landed) for event, hour in batch]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    once = stream_rollups.without_repeats(stream)
    stream_rollups.start_append(once, f"{path}-once", f"{path}-checkpoint").awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{path}-once").collect()) == [1, 2, 3]


def test_large_compactions_get_more_cuts(spark, fixtures):
    events = fixtures.stored_events()
    cut = store.in_store_order(events, 7 * store.FILE_BYTES)
    assert "REPARTITION_BY_NUM" in cut._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" not in store.in_store_order(events, 1)._jdf.queryExecution().toString()


# Batches, activity, retries and rooms


def _pieces(spark, tmp_path, parts, schema):
    """A stream with one micro-batch for each list of rows."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are taken in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def _at(seconds):
    return datetime(2024, 1, 1) + timedelta(seconds=seconds)


def test_batches_end_by_size_by_time_and_by_watermark(spark, tmp_path):
    from footfall.operators.batching import Batching
    from footfall.streaming import batches, limiter, rollups

    schema = "event_id long, worker string, arrived_at timestamp_ntz"
    parts = [
        [(1, "a", _at(0)), (2, "a", _at(0.5)), (3, "a", _at(1.0)), (4, "a", _at(1.2))],  # three make a batch, the fourth waits
        [(5, "a", _at(2.1)), (6, "b", _at(50))],  # 5 is in time for 4
        [(7, "c", _at(100))],  # the watermark ends what waits in a and b
        [(None, "c", _at(101))],
    ]
    stream = _pieces(spark, tmp_path, parts, schema)
    batched = batches.batched(stream, Batching(3, 1000), "worker")
    with limiter.state_store(spark):
        rollups.start_append(batched, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.queue, r.number, r.event_ids) for r in rows) == [("a", 0, [1, 2, 3]), ("a", 1, [4, 5]), ("b", 0, [6]), ("c", 0, [7])]
    assert all(r["size"] == len(r.event_ids) and r.first_event == r.event_ids[0] for r in rows)


def test_batches_by_the_wall_clock_end_by_a_timer(spark, tmp_path):
    from footfall.operators.batching import Batching
    from footfall.streaming import batches, limiter, rollups

    schema = "event_id long, arrived_at timestamp_ntz"
    stream = _pieces(spark, tmp_path, [[(1, _at(0)), (2, _at(900)), (3, _at(1))]], schema)
    batched = batches.batched(stream, Batching(2, 500), clock="wall")
    with limiter.state_store(spark):
        query = rollups.start_append(batched, f"{tmp_path}/out", f"{tmp_path}/checkpoint", every="1 second")
        for _ in range(60):
            time.sleep(1)
            if store.exists(spark, f"{tmp_path}/out") and spark.read.schema(batched.schema).parquet(f"{tmp_path}/out").count() == 2:
                break
        query.stop()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.number, r.event_ids) for r in rows) == [(0, [1, 3]), (1, [2])]  # times of arrivals give the order alone


def test_activity_counts_sessions_once_a_window(spark, tmp_path):
    from footfall.streaming import activity, limiter

    minute = lambda m: _at(60 * m)
    schema = "tenant_id string, session_id string, time timestamp_ntz"
    parts = [
        [("t", "a", minute(1)), ("t", "a", minute(2)), ("t", "b", minute(7)), ("u", "a", minute(1)), ("t", None, minute(1))],
        [("t", "a", minute(8)), ("t", "a", minute(200))],
        [("t", "b", minute(1)), ("t", "c", minute(210))],  # nothing is late without a delay
    ]
    for delay, late in ((None, True), ("1 hour", False)):
        path = f"{tmp_path}/{late}"
        stream = _pieces(spark, path, parts, schema)
        with limiter.state_store(spark):
            changes = activity.activity_changes(stream, delay)
            activity.start_activity(changes, f"{path}/out", f"{path}/checkpoint").awaitTermination()
        got = {(r.tenant_id, r.until): (r.events, r.sessions) for r in activity.read_activity(spark, f"{path}/out").collect()}
        expected = {}
        rows = [r for part in parts for r in part if late or r != ("t", "b", minute(1))]
        for tenant in "tu":
            for k in range(1, 60):
                own = [r for r in rows if r[0] == tenant and minute(5 * k - 30) <= r[2] < minute(5 * k)]
                if own:
                    expected[tenant, minute(5 * k)] = (len(own), len({r[1] for r in own} - {None}))
        assert got == expected


def test_retries_pause_double_and_end(spark, tmp_path):
    from footfall.streaming.retries import Retry, RetryQueue

    # Fails so many times.
    work = lambda jobs: jobs.withColumn("failed", F.col("attempt") <= F.col("fails"))
    queue = RetryQueue(spark, str(tmp_path / "queue"), work, Retry(3, 1000))
    jobs = lambda *rows: spark.createDataFrame(rows, "event_id long, fails int, arrived_at timestamp_ntz")
    queue.process(jobs((1, 0, _at(0)), (2, 1, _at(0)), (3, 2, _at(0)), (4, 9, _at(0))), 0)
    ended = lambda: {r.event_id: (r.status, r.attempts, r.finished_at) for r in queue.outcomes().collect()}
    assert ended() == {1: ("done", 1, _at(0))}
    assert {(r.event_id, r.attempt, r.due_ms % 100_000) for r in queue.waiting().collect()} == {
        (i, 2, int(_at(1).timestamp() * 1000) % 100_000) for i in (2, 3, 4)
    }
    # Time has come for the second attempts, not for the third ones.
    queue.process(jobs((5, 0, _at(1.5))), 1)
    assert ended() == {1: ("done", 1, _at(0)), 2: ("done", 2, _at(1)), 5: ("done", 1, _at(1.5))}
    # The same batch again, as after a failure, changes nothing; a job may use up all attempts at once.
    for _ in range(2):
        queue.process(jobs((6, 2, _at(2)), (7, 0, _at(100))), 2)
    after = ended()
    assert after[3] == ("done", 3, _at(3)) and after[4] == ("dead", 3, _at(3)) and after[6] == ("done", 3, _at(5))
    assert queue.waiting().count() == 0 and {r.event_id for r in queue.dead_letters().collect()} == {4}
    queue.process(jobs((8, 9, _at(101))), 3)
    queue.finish()
    assert ended()[8] == ("dead", 3, _at(104)) and len(ended()) == 8 == queue.outcomes().count()


def test_rooms_are_joined_and_left(spark, tmp_path):
    from footfall.streaming import limiter, live, rollups

    events = [
        [("t", 1, _at(0)), ("t", 2, _at(3599)), ("u", 3, _at(10))],
        [("t", 4, _at(7200)), ("t", 5, _at(10)), ("t", 6, _at(7199))],
    ]
    visits = [[("x", "t", _at(0), _at(7200)), ("y", "t", _at(3599), _at(3600)), ("z", "u", _at(20), _at(20))], [("w", "t", _at(5), _at(11))]]
    sent = live.fan_out_stream(
        _pieces(spark, tmp_path / "e", events, "tenant_id string, event_id long, time timestamp_ntz"),
        _pieces(spark, tmp_path / "v", visits, "subscriber_id string, tenant_id string, joined_at timestamp_ntz, left_at timestamp_ntz"),
        delay="1 day",
    )
    with limiter.state_store(spark):
        rollups.start_append(sent, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.subscriber_id, r.event_id) for r in rows) == [("w", 5), ("x", 1), ("x", 2), ("x", 5), ("x", 6), ("y", 2)]


def test_a_room_keeps_few_rows(spark, tmp_path):
    from footfall.streaming import limiter, live, rollups

    events = [[("t", n, _at(n * 3600 + 5)) for n in range(48)] + [(None, 48, _at(7)), ("t", 49, None)]]
    visits = [[("x", "t", _at(3605), _at(86_400)), ("y", None, _at(0), _at(90_000)), ("z", "t", _at(86_399), _at(86_406))]]
    sent = live.fan_out_stream(
        _pieces(spark, tmp_path / "e", events, "tenant_id string, event_id long, time timestamp_ntz"),
        _pieces(spark, tmp_path / "v", visits, "subscriber_id string, tenant_id string, joined_at timestamp_ntz, left_at timestamp_ntz"),
        delay="11 days",
    )
    with limiter.state_store(spark):
        query = rollups.start_append(sent, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        query.awaitTermination()
    rows = spark.read.schema(sent.schema).parquet(f"{tmp_path}/out").collect()
    # A visit that ends with the day is in no room of the next one.
    assert sorted((r.subscriber_id, r.event_id) for r in rows) == [*(("x", n) for n in range(1, 24)), ("z", 24)]
    assert {r.time for r in rows} == {_at(n * 3600 + 5) for n in range(1, 25)}
    # Days, not hours, as state is kept for days: one piece of x, two each of y and z, in eight parts.
    kept = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])
    assert kept <= 8 * 5 + 50
    assert (live._span_hours(spark, "1 hour"), live._span_hours(spark, "1 day"), live._span_hours(spark, "10 minutes")) == (1, 3, 1)
