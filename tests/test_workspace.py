"""The whole way: set up, whitelist, funnel, ingest, reports."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from footfall import schemas
from footfall.session import new_path
from footfall.sources import store
from footfall.sources.raw import stream_raw
from footfall.streaming.ingest import IngestPipeline
from footfall.workspace import TenantNotSetUp, Workspace

NOW = datetime(2024, 1, 31, 12)
USER = "20000000-0000-4000-8000-000000000001"
OTHER = "20000000-0000-4000-8000-000000000002"


def post(n, token, name, url="http://localhost:5173", session="00000000-0000-4000-8000-000000000001"):
    at = NOW - timedelta(minutes=10) + timedelta(seconds=n)
    body = {
        "token": token, "eventName": name, "properties": {"source": "test"}, "sessionId": session, "url": url,
        "referrer": "http://localhost:5173", "occurredAt": at.isoformat(timespec="milliseconds") + "Z",
    }
    return (n, at, json.dumps(body), "Mozilla/5.0", None, "127.0.0.1")


@pytest.fixture(scope="module")
def workspace(spark):
    ws = Workspace(spark, new_path(spark, "workspace"))
    requests = [(USER, " First ", NOW, 1), (USER, "Second", NOW, 2), (OTHER, "Other", NOW, 3)]
    schema = "owner_user_id string, name string, requested_at timestamp_ntz, request_id long"
    ws.setup_tenants(spark.createDataFrame(requests, schema))
    ws.setup_tenants(spark.createDataFrame([(USER, "Third", NOW, 4)], schema))
    tenant = ws.tenant(USER)
    ws.update_domains(
        spark.createDataFrame([(tenant["id"], ["localhost"], 1)], "id string, domains array<string>, version long")
    )
    funnel = [(tenant["id"], "Signup", ["pageview", "signup", "purchase"], NOW)]
    ws.create_funnels(
        spark.createDataFrame(funnel, "tenant_id string, name string, steps array<string>, created_at timestamp_ntz")
    )
    posts = [
        post(1, tenant["token"], "pageview"), post(2, tenant["token"], "signup"),
        post(3, tenant["token"], "pageview", url="http://elsewhere.example"),
        post(4, ws.tenant(OTHER)["token"], "pageview", url="http://elsewhere.example"),
    ]
    outcomes = ws.ingest(spark.createDataFrame(posts, schemas.RAW))
    assert {r["event_id"]: r["status"] for r in outcomes.collect()} == {1: 200, 2: 200, 3: 403, 4: 200}
    return ws


def test_setup_keeps_the_first_tenant(workspace):
    tenant = workspace.tenant(USER)
    assert (tenant["name"], tenant["domain_whitelist"], tenant["plan"]) == ("First", ["localhost"], "free")
    with pytest.raises(TenantNotSetUp):
        workspace.tenant("20000000-0000-4000-8000-00000000000f")


def test_reports(workspace):
    overview = workspace.overview(USER, "24h", NOW).first()
    assert (overview["total_events"], overview["unique_sessions"]) == (2, 1)
    assert [tuple(p) for p in overview["top_pages"]] == [("http://localhost:5173", 2)]
    assert [tuple(r) for r in workspace.timeseries(USER, "24h", None, NOW).collect()] == [("2024-01-31T11:00:00.000Z", 2)]
    assert tuple(workspace.realtime(USER, NOW).first()) == (2, 0)
    assert [r["event_name"] for r in workspace.event_log(USER).collect()] == ["signup", "pageview"]
    assert [r["place"] for r in workspace.live_feed(OTHER).collect()] == [1]


def test_funnel(workspace):
    (funnel,) = workspace.list_funnels(USER).collect()
    assert funnel["steps"] == ["pageview", "signup", "purchase"]
    table = workspace.funnel_conversion(USER, funnel["id"]).collect()
    assert [r["reached"] for r in table] == [1, 1, 0]
    with pytest.raises(LookupError):
        workspace.funnel_conversion(OTHER, funnel["id"])


def test_batches_and_streams_do_not_mix(spark, workspace, fixtures):
    with pytest.raises(RuntimeError):
        workspace.ingest_stream(fixtures.raw_posts())
    streamed = Workspace(spark, new_path(spark, "streamed"))
    requests = [(USER, "Streamed", NOW, 1)]
    schema = "owner_user_id string, name string, requested_at timestamp_ntz, request_id long"
    streamed.setup_tenants(spark.createDataFrame(requests, schema))
    posts = new_path(spark, "posts")
    token = streamed.tenant(USER)["token"]
    spark.createDataFrame([post(n, token, "pageview") for n in range(5)], schemas.RAW).write.parquet(posts)
    streamed.ingest_stream(stream_raw(spark, posts, "parquet")).awaitTermination()
    assert streamed.overview(USER, "24h", NOW).first()["total_events"] == 5
    with pytest.raises(RuntimeError):
        streamed.ingest(spark.read.parquet(posts))


@pytest.mark.parametrize("broken", ["landing", "outcomes", "events", "feed"])
def test_failed_batch_is_taken_once(spark, monkeypatch, broken):
    site = Workspace(spark, new_path(spark, "retried"))
    schema = "owner_user_id string, name string, requested_at timestamp_ntz, request_id long"
    site.setup_tenants(spark.createDataFrame([(USER, "Retried", NOW, 1)], schema))
    token = site.tenant(USER)["token"]
    first = spark.createDataFrame([post(n, token, "pageview") for n in range(2)], schemas.RAW)
    second = spark.createDataFrame([post(n, token, "signup") for n in range(2, 5)], schemas.RAW)
    site.ingest(first)
    kept, write_batch = IngestPipeline._kept, store.write_batch

    def kept_then_fail(self, df, name, batch_id):
        out = kept(self, df, name, batch_id)
        if name == broken:
            raise OSError("lost")
        return out

    def stored_then_fail(events, root, batch_id):
        write_batch(events, root, batch_id)
        if broken == "events":
            raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(IngestPipeline, "_kept", kept_then_fail)
        patch.setattr(store, "write_batch", stored_then_fail)
        with pytest.raises(OSError):
            site.ingest(second)
    assert site.events().count() == 2
    assert {r["status"] for r in site.ingest(second).collect()} == {200}
    assert sorted(r["event_id"] for r in site.events().collect()) == [0, 1, 2, 3, 4]
    assert site.pipeline().feed().count() == site.pipeline().outcomes().count() == 5


def test_second_batch_and_purge(spark, workspace):
    workspace.ingest(spark.createDataFrame([post(9, workspace.tenant(USER)["token"], "purchase")], schemas.RAW))
    assert workspace.overview(USER, "24h", NOW).first()["total_events"] == 3
    gone = workspace.tenants().where(F.col("owner_user_id") == USER).select(F.col("id").alias("tenant_id"))
    workspace.purge_tenants(gone)
    left = Workspace(spark, f"{workspace.root}-purged")
    assert left.events().count() == 1
    assert left.funnel_rows().count() == 0
    assert left.tenant(OTHER)["name"] == "Other"
    left.ingest(spark.createDataFrame([post(11, left.tenant(OTHER)["token"], "purchase")], schemas.RAW))
    assert left.events().count() == 2


def test_removed_tenants_are_gone_at_once(spark, workspace):
    site = workspace
    token, other = site.tenant(USER)["token"], site.tenant(OTHER)["token"]
    before = site.events().count()
    own = site.overview(USER, "30d", NOW).first()["total_events"]
    gone = site.tenants().where(F.col("owner_user_id") == USER).select(F.col("id").alias("tenant_id"))
    site.remove_tenants(gone)
    with pytest.raises(TenantNotSetUp):
        site.tenant(USER)
    assert site.events().count() == before - own and site.funnel_rows().count() == 0
    outcomes = site.ingest(spark.createDataFrame([post(71, token, "pageview"), post(72, other, "pageview")], schemas.RAW))
    assert {r.event_id: r.status for r in outcomes.collect()} == {71: 401, 72: 200}
    assert site.events().count() == before - own + 1
