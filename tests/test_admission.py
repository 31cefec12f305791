"""Payload rules one by one, and the order of the checks."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from footfall import schemas
from footfall.operators import admission, enrichment, validation
from footfall.operators.ratelimit import Limit

AT = datetime(2024, 1, 1, 12)
TOKEN = "10000000-0000-4000-8000-00000000000a"
OPEN_TOKEN = "10000000-0000-4000-8000-00000000000b"
GOOD = {
    "token": TOKEN, "eventName": "pageview", "properties": {"a": 1},
    "sessionId": "00000000-0000-4000-8000-000000000001", "url": "https://shop.example.com/x",
}


def raw(spark, bodies):
    rows = [(n, AT + timedelta(seconds=n), body, "Mozilla/5.0", None, "203.0.113.7") for n, body in enumerate(bodies)]
    return spark.createDataFrame(rows, schemas.RAW)


def tenants(spark):
    rows = [
        ("00000000-0000-4000-8000-00000000000a", "A", TOKEN, ["example.com"], "free", AT, None),
        ("00000000-0000-4000-8000-00000000000b", "B", OPEN_TOKEN, [], "free", AT, None),
    ]
    return spark.createDataFrame(rows, schemas.TENANTS)


def body(**changes):
    payload = {**GOOD, **changes}
    return json.dumps({k: v for k, v in payload.items() if v is not ...}, ensure_ascii=False)


VIOLATIONS = [
    (body(), ""),
    (body(token="x"), "token"),
    (body(token=5), "token"),
    (body(token=...), "token"),
    (body(eventName="  trimmed  "), ""),
    (body(eventName="two words"), "eventName"),
    (body(eventName=""), "eventName"),
    (body(eventName="x" * 100), ""),
    (body(eventName="x" * 101), "eventName"),
    (body(eventName=7), "eventName"),
    (body(properties=...), ""),
    (body(properties=[1]), "properties"),
    (body(properties=None), "properties"),
    (body(properties={"a": "x" * 10232}), ""),
    (body(properties={"a": "x" * 10233}), "properties"),
    (body(properties={"a": "\U0001f600" * 5117}), "properties"),
    (body(sessionId="1"), "sessionId"),
    (body(url="/relative"), "url"),
    (body(url="https://e.example/" + "x" * 2030), ""),
    (body(url="https://e.example/" + "x" * 2031), "url"),
    (body(referrer="https://r.example"), ""),
    (body(referrer=None), "referrer"),
    (body(referrer=""), "referrer"),
    (body(occurredAt="2024-01-01T00:00:00Z"), ""),
    (body(occurredAt="2024-01-01T00:00:00"), "occurredAt"),
    (body(occurredAt=None), "occurredAt"),
    (body(userAgent="x" * 1025), "userAgent"),
    (body(userAgent=1), "userAgent"),
    (body(extra=1), "keys"),
    (body(token="x", extra=1), "token|keys"),
    ("[]", "token|eventName|sessionId|url|keys"),
    ("{}", "token|eventName|sessionId|url"),
    ("nonsense", None),
    ('{"token": "x"', None),
    ("7", None),
    ("", "token|eventName|sessionId|url"),
    (None, "token|eventName|sessionId|url"),
    (body(properties={"a": "x" * 33000}), None),
]


def test_violations(spark):
    checked = admission.validate(raw(spark, [b for b, _ in VIOLATIONS]))
    found = [r["violations"] for r in checked.orderBy("event_id").collect()]
    assert found == [expected for _, expected in VIOLATIONS]


def test_checks_run_in_order(spark):
    bodies = [
        body(),  # accepted
        "nonsense",
        body(url="bad"),
        body(token="10000000-0000-4000-8000-00000000000f"),
        body(url="https://elsewhere.example"),
        body(),  # accepted
        body(),  # limited
        body(token=OPEN_TOKEN, url="https://elsewhere.example"),  # its own quota
        body(token=TOKEN.upper()),  # the limit counts tokens as they are spelled
    ]
    outcomes = admission.admit(raw(spark, bodies), tenants(spark), Limit(2, 60)).orderBy("event_id").collect()
    assert [r["status"] for r in outcomes] == [200, 500, 400, 401, 403, 200, 429, 200, 200]
    assert [r["remaining"] for r in outcomes] == [1, None, None, None, None, 0, 0, 1, 1]
    assert outcomes[0]["reset_at"] == AT + timedelta(seconds=60)


def test_refused_posts_go_to_quarantine_and_none_is_lost(spark, fixtures):
    outcomes = admission.admit(fixtures.raw_posts(), fixtures.tenants(), Limit(10, 6 * 3600))
    accepted, refused = admission.jobs(outcomes).count(), admission.rejects(outcomes).count()
    assert accepted > 0 and refused > 0
    assert accepted + refused == fixtures.raw_posts().count()


def test_job_defaults(spark):
    bodies = [body(occurredAt=..., properties=..., userAgent=...), body(userAgent="", referrer="https://r.example")]
    jobs = admission.jobs(admission.admit(raw(spark, bodies), tenants(spark))).orderBy("event_id").collect()
    assert jobs[0]["occurred_at"] == "2024-01-01T12:00:00.000Z"
    assert jobs[0]["properties"] == "{}"
    assert jobs[0]["user_agent"] == "Mozilla/5.0"
    assert jobs[1]["user_agent"] is None
    assert jobs[0]["ip_address"] == "203.0.113.7"


def test_enrichment(spark):
    bodies = [body(occurredAt="2024-01-01T10:00:00.123456+02:00", eventName=" click ", sessionId=GOOD["sessionId"].upper())]
    jobs = admission.jobs(admission.admit(raw(spark, bodies), tenants(spark)))
    row = enrichment.enrich(jobs).first()
    assert row["time"] == datetime(2024, 1, 1, 8, 0, 0, 123000)
    assert (row["event_name"], row["session_id"]) == ("click", GOOD["sessionId"])
    assert (row["country"], row["device"], row["os"], row["browser"]) == (None, "desktop", None, None)


@pytest.mark.parametrize("broken", [None, "a" * 129])
def test_broken_jobs_are_set_aside(spark, broken):
    job = (1, AT, "00000000-0000-4000-8000-00000000000a", broken, "{}", GOOD["sessionId"], GOOD["url"], None,
           "2024-01-01T00:00:00Z", None, None)
    good = (2, *job[1:3], "any name, 128 at most", *job[4:])
    sound, bad = enrichment.split_jobs(spark.createDataFrame([job, good], schemas.JOB))
    assert [r["event_id"] for r in sound.collect()] == [2]
    assert [(r["event_id"], r["violations"]) for r in bad.collect()] == [(1, "eventName")]


def test_definition_rules(spark):
    df = spark.createDataFrame(
        [
            ("ok", ["a"], ["x"]),
            (" ", ["a"] * 51, []),
            ("n" * 121, ["a", " "], ["x"] * 13),
            ("n" * 120, ["d" * 256], ["x" * 121]),
        ],
        "name string, domains array<string>, steps array<string>",
    )
    found = df.select(
        validation.tenant_name_ok(F.col("name")), validation.domains_ok(F.col("domains")),
        validation.funnel_ok(F.lit("f"), F.col("steps")),
    ).collect()
    assert [tuple(r) for r in found] == [(True, True, True), (False, False, False), (False, False, False), (True, False, False)]


def test_page_arguments():
    for limit, offset in ((0, 0), (201, 0), (50, -1), (50, 10_001)):
        with pytest.raises(ValueError):
            validation.check_page(limit, offset)
    validation.check_page(200, 10_000)
    with pytest.raises(ValueError):
        validation.check_event_name("  ")


def test_missing_and_empty_bodies_read_as_empty_objects(spark):
    posts = spark.createDataFrame([(1, None), (2, ""), (3, "{}"), (4, " ")], "event_id long, body string")
    read = validation.parse_bodies(posts).withColumn("violations", validation.payload_violations())
    found = {r["event_id"]: (r["readable"], r["violations"]) for r in read.collect()}
    assert found[1] == found[2] == found[3] == (True, "token|eventName|sessionId|url")
    assert found[4][0] is False
