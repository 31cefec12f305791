"""Hosts as a browser reads them. Expected values follow the URL standard and RFC 3492."""

import random

from pyspark.sql import functions as F

from footfall.functions import hosts, net
from test_functions import HOSTS, table, values

BROWSER = {
    "http://ex%61mple.com/": "example.com", "http://%45xample.com": "example.com", "http://a%2Fb.example/": None, "http://a%b.example/": None,
    "http://a+b.example/": "a+b.example", "http://%ff.example/": None, "https://caf%C3%A9.example/x": "xn--caf-dma.example",
    "http://127.1/": "127.0.0.1", "http://0x7f.0.0.1/": "127.0.0.1", "http://0177.0.0.1/": "127.0.0.1", "http://2130706433/": "127.0.0.1",
    "http://0x7F000001": "127.0.0.1", "http://1.2.3/": "1.2.0.3", "http://1.65536/": "1.1.0.0", "http://256.1.1.1/": None, "http://1.2.3.4.5/": None,
    "http://08.1/": None, "http://4294967296/": None, "http://4294967295/": "255.255.255.255", "http://1.2.3.4./": "1.2.3.4", "http://0x/": "0.0.0.0",
    "http://a.1/": None, "http://a.0xg/": "a.0xg", "http://%31.2.3.4/": "1.2.3.4", "http://1.2.3.4:80/p": "1.2.3.4",
    "http://bücher.example/": "xn--bcher-kva.example", "http://BÜCHER.example/": "xn--bcher-kva.example", "http://例え.テスト/": "xn--r8jz45g.xn--zckzah",
    "http://faß.de/": "xn--fa-hia.de", "http://a。b．c/": "a.b.c", "http://☃.net": "xn--n3h.net", "http://1a.2b/": "1a.2b", "http://9.example": "9.example",
    "http://user@bücher.example:8080/": "xn--bcher-kva.example", "app://B%C3%BC/x": "b%c3%bc", None: None,
}


def test_browser_hosts(spark):
    inputs, expected = table(BROWSER)
    found = values(spark, hosts.browser_host, inputs)
    assert {url: got for url, got in zip(inputs, found)} == dict(zip(inputs, expected))


def test_plain_hosts_are_as_before(spark):
    inputs, expected = table(HOSTS)
    assert values(spark, hosts.browser_host, inputs) == expected


def test_punycode_equals_the_codec(spark):
    rng = random.Random(6)
    letters = "abc-xyz019äöüßéñøжщдλμ漢字仮名テスト한국☃😀𝒳"
    labels = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 20))) for _ in range(150)] + ["ü" * 60, "漢" * 40]
    labels = [label for label in labels if not label.isascii()]
    found = values(spark, hosts.punycode, labels)
    assert found == [label.encode("punycode").decode() for label in labels]


def test_pages_have_the_same_hosts(spark, fixtures):
    pages = fixtures.table("pages")
    differ = pages.where(~hosts.browser_host(F.col("url")).eqNullSafe(net.url_host(F.col("url"))))
    assert differ.count() == 0
