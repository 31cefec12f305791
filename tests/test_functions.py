
import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from footfall.functions import events, net, text, timing, useragent


def values(spark, column, inputs):
    rows = [(place, value) for place, value in enumerate(inputs)]
    df = spark.createDataFrame(rows, "place int, v string")
    return [r["out"] for r in df.select("place", column(F.col("v")).alias("out")).orderBy("place").collect()]


def table(cases):
    return list(cases), list(cases.values())


HOSTS = {
    "https://Blog.Example.COM/a?b#c": "blog.example.com",
    "http://user:pw@host.example:8080/x": "host.example",
    "HTTP://[2001:DB8::1]:443/": "[2001:db8::1]",
    "https:\\\\back.example\\slash": "back.example",
    " http://edges.example \n": "edges.example",
    "http://under_score.example": "under_score.example",
    "ht\ntp://broken.example/": "broken.example",
    "http:no-slashes.example": "no-slashes.example",
    "app://Custom/x": "custom",
    "http://a@b@c.example/": "c.example",
    "http://": None,
    "http://bad host/": None,
    "http://port.example:70000/": None,
    "http://port.example:65535/": "port.example",
    "mailto:x@y.example": None,
    "/relative": None,
    "not a url": None,
    "": None,
}


def test_url_host(spark):
    inputs, expected = table(HOSTS)
    assert values(spark, net.url_host, inputs) == expected


def test_is_url(spark):
    cases = {
        "https://example.com": True, "mailto:x@y.example": True, "file:///tmp/x": True, "data:,x": True,
        "http://": False, "http://bad host/": False, "example.com": False, "//example.com": False,
        "": False, "1http://example.com": False,
    }
    inputs, expected = table(cases)
    assert values(spark, net.is_url, inputs) == expected


def test_whitelist_host(spark):
    cases = {
        "example.com": "example.com", " Example.COM ": "example.com", "example.com/path": "example.com",
        "localhost:3000": "localhost", "https://shop.example.org/x": "shop.example.org",
        "://": None, "   ": None, "": None, "/x": None, " a.example﻿": "a.example",
    }
    inputs, expected = table(cases)
    assert values(spark, net.whitelist_host, inputs) == expected


@pytest.mark.parametrize(
    ("host", "whitelist", "allowed"),
    [
        ("a.example.com", [], True),
        (None, [], True),
        ("a.example.com", ["example.com"], True),
        ("example.com", ["example.com"], True),
        ("notexample.com", ["example.com"], False),
        ("example.com", ["a.example.com"], False),
        ("example.com", ["  "], False),
        (None, ["example.com"], False),
        ("x.example", ["  ", "x.example:80/y"], True),
    ],
)
def test_domain_allowed(spark, host, whitelist, allowed):
    df = spark.createDataFrame([(host, whitelist)], "host string, whitelist array<string>")
    verdict = net.domain_allowed(net.dotted(F.col("host")), net.whitelist_endings(F.col("whitelist")))
    assert df.select(verdict).first()[0] is allowed


def test_truncated_ip(spark):
    cases = {
        "203.0.113.9": "203.0.113.0", "::ffff:203.0.113.9": "203.0.113.0", " 203.0.113.9 ": "203.0.113.0",
        "2001:db8:1:2:3:4:5:6": "2001:db8:1:2:3:4::", "2001:db8::1": "2001:db8::", "::1": "::",
        "::FFFF:203.0.113.9": "::FFFF:203.0.113.0", "1.2.3": "1.2.3", "unknown": "unknown", "": "",
    }
    inputs, expected = table(cases)
    assert values(spark, net.truncated_ip, inputs) == expected


def test_ip_hash(spark):
    digest = hashlib.sha256(b"203.0.113.0").hexdigest()
    assert values(spark, net.ip_hash, ["203.0.113.77", "", None, "  "]) == [digest, None, None, None]


def test_client_ip(spark):
    rows = [(" 1.2.3.4 , 5.6.7.8", "9.9.9.9"), ("", "9.9.9.9"), (None, "9.9.9.9"), (" ,5.6.7.8", "9.9.9.9"), (None, None)]
    df = spark.createDataFrame(rows, "f string, r string")
    found = [r[0] for r in df.select(net.client_ip(F.col("f"), F.col("r"))).collect()]
    assert found == ["1.2.3.4", "9.9.9.9", "9.9.9.9", None, None]


AGENTS = {
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36 Edg/120.0.0.0": ("desktop", "Windows", "Edge"),
    "Mozilla/5.0 (iPad; CPU OS 16_0 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/16.0 Mobile/15E148 Safari/604.1": ("tablet", "iOS", "Mobile Safari"),
    "Mozilla/5.0 (Linux; Android 12; SM-X906C) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/80.0 Safari/537.36": ("tablet", "Android", "Chrome"),
    "Mozilla/5.0 (Linux; Android 13; SM-S911B) AppleWebKit/537.36 (KHTML, like Gecko) SamsungBrowser/23.0 Chrome/115.0 Mobile Safari/537.36": ("mobile", "Android", "Samsung Internet"),
    "Mozilla/5.0 (X11; Ubuntu; Linux x86_64; rv:109.0) Gecko/20100101 Firefox/115.0": ("desktop", "Ubuntu", "Firefox"),
    "Mozilla/5.0 (PlayStation 5 3.11) AppleWebKit/605.1.15 (KHTML, like Gecko)": ("console", "PlayStation", None),
    "Mozilla/5.0 (SMART-TV; Linux; Tizen 5.0) AppleWebKit/538.1 (KHTML, like Gecko) Version/5.0 TV Safari/538.1": ("smarttv", "Tizen", "Safari"),
    "Mozilla/5.0 (Windows NT 10.0; WOW64; Trident/7.0; rv:11.0) like Gecko": ("desktop", "Windows", "IE"),
    "Mozilla/5.0": ("desktop", None, None),
    "": ("desktop", None, None),
}


def test_agents(spark):
    inputs, expected = table(AGENTS)
    kinds = [values(spark, f, inputs + [None]) for f in (useragent.device, useragent.operating_system, useragent.browser)]
    assert list(zip(*kinds)) == expected + [("desktop", None, None)]


def test_from_iso(spark):
    cases = {
        "2024-01-31T10:00:00.123456Z": datetime(2024, 1, 31, 10, 0, 0, 123000),
        "2024-01-31T10:00:00+02:00": datetime(2024, 1, 31, 8),
        "2024-01-31T10:00:00-0530": datetime(2024, 1, 31, 15, 30),
        "2024-01-31T10:00:00": None, "2024-02-30T10:00:00Z": None, "2024-01-31 10:00:00Z": None,
        "2024-01-31T10:00Z": None, "2024-01-31": None, "": None,
    }
    inputs, expected = table(cases)
    assert values(spark, timing.from_iso, inputs) == expected


def test_text(spark):
    assert values(spark, text.compact, [" a ", " \t", "", None]) == ["a", None, None, None]
    assert values(spark, text.parse_list, ["a, b\r\n\n ,c", " ,\n", "", "one"]) == [["a", "b", "c"], [], [], ["one"]]
    assert values(spark, text.utf16_length, ["abc", "\U0001f600", ""]) == [3, 2, 0]
    assert values(spark, lambda v: text.grouped_digits(v.cast("long")), ["1234567", "5"]) == ["1,234,567", "5"]


def test_click_text_is_cut_after_spaces_are_joined(spark):
    clicked = lambda v: events.click_properties(F.lit("A"), F.lit(""), v, F.lit(None).cast("string"))
    (row,) = values(spark, clicked, ["  x \n y" + "z" * 200])
    assert row["text"] == "x y" + "z" * 117
    assert (row["tag"], row["id"], row["href"]) == ("a", None, None)


def test_agent_label(spark):
    rows = [("mobile", "Chrome"), ("mobile", None), (None, None), ("", "")]
    df = spark.createDataFrame(rows, "d string, b string")
    shown = [r[0] for r in df.select(events.agent_label(F.col("d"), F.col("b"))).collect()]
    assert shown == ["mobile / Chrome", "mobile", "-", "-"]


def test_range_argument():
    with pytest.raises(ValueError):
        timing.range_start("1h")
    assert timing.range_start("24h", datetime(2024, 1, 2)) == datetime(2024, 1, 1)
