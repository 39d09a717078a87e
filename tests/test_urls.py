import random
from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from millrace.functions.urls import (
    host_allowed,
    host_suffixes,
    normalize_url,
    resolve_link,
    resolve_links,
    url_host,
    url_origin,
)

NORMAL = [
    ("HTTP://User@EX.com:8080/a/b//;p?q#f", "http://ex.com/a/b"),
    ("http://h", "http://h/"),
    ("http://h/", "http://h/"),
    ("http://h//", "http://h/"),
    ("http://h?q=/z/", "http://h/"),
    ("https://h:443/", "https://h/"),
    ("http://h/a;b", "http://h/a"),
    ("http://h/a;b/c/", "http://h/a;b/c"),
    ("http://h/a;b;c", "http://h/a"),
    ("http://h//a", "http://h//a"),
    ("HTTP://h/%7Ea/?x", "http://h/%7Ea"),
    ("http://h/a b", "http://h/a b"),
    (" http://h/a", "http://h/a"),
    ("http://h/a\n/b", "http://h/a/b"),
    ("http://[::1]:80/x", "http://[::1]/x"),
    ("http://u:p@[::1]/x/", "http://[::1]/x"),
    ("ftp://F/x/", "ftp://f/x"),
    ("http:///x", None),
    ("mailto:x@y", None),
    ("example.org", None),
    ("/rel", None),
    ("", None),
    (None, None),
    ("http://[bad/x", None),
]


def test_normalize_edges(spark):
    rows = spark.createDataFrame(NORMAL, "url string, expected string")
    got = rows.select("url", "expected", normalize_url(F.col("url")).alias("key"))
    assert got.filter(~F.col("key").eqNullSafe(F.col("expected"))).collect() == []


def test_normalize_is_idempotent(spark):
    rows = spark.createDataFrame(NORMAL, "url string, expected string")
    once = rows.select(normalize_url(F.col("url")).alias("key"))
    twice = once.withColumn("again", normalize_url(F.col("key")))
    assert twice.filter(~F.col("key").eqNullSafe(F.col("again"))).collect() == []


def test_normalize_is_linear(spark):
    long = 300_000
    urls = [
        "http://h/a" + "/" * long + "b",
        "http://h/" + ";" * long + "/",
        "http://" + "@" * long + "h/",
        "http://h/" + "a/" * long,
    ]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    assert rows.select(F.length(normalize_url(F.col("url"))).alias("n")).filter("n > 0").count() == 4


RFC_BASE = "http://h/a/b?x=1#f"
BASES = [
    RFC_BASE,
    "http://h",
    "https://h/a/b/",
    "http://h/a;p/b;q?z",
    "http://u@h:8/a//b/../c",
    "http://h/;p",
    "http://h?q",
    "http://h/x/./y",
]
HREFS = (
    "c|../c|/c|?q=1|#z||./|../../../z|//o/c|HTTP://O/p|https:foo|http:foo|mailto:q|..|.|/a/../b|"
    "/./|/..|/../x|a/./b/../c|..;x|a;b|a;b;c|a;b/c;d|?|#|/p?|/p#|/p?#|c?a?b#c#d| /x|/x y|//o|//o?x|"
    "///x|/a//b|a//b|b/|http://h2|..//x|a;|/;p|javascript:void(0)|x:y|1:2|/.hid|/a/.b|/..a/b|../|"
    "../..|./.././q;r?s#t|é/ü|\t/x\n/y|/a/b;c/../d;e|;p|http://h/../a|http:|https://|a\nb#c|"
    "http://h/p?|https://o/p;x|https://o/p;|http://o/a/../b|https://o/x#|http://[bad/x|//[bad]x"
).split("|")


def _joined(base, href):
    try:
        return urljoin(base, href)
    except ValueError:
        return None


def _assert_resolves(spark, pairs):
    rows = spark.createDataFrame(
        [(b, h, _joined(b, h)) for b, h in pairs], "base string, href string, expected string"
    )
    got = rows.withColumn("link", resolve_link(F.col("base"), F.col("href")))
    assert got.filter(~F.col("link").eqNullSafe(F.col("expected"))).collect() == []


def test_resolve_edges(spark):
    _assert_resolves(spark, [(b, h) for b in BASES for h in HREFS])


def test_resolve_random(spark):
    rng = random.Random(7)
    tokens = ["/", "/", "..", ".", "a", "b", ";", "?", "#", "x=1", "//", "é", " ", "http:", "h2", ":"]

    def text(longest):
        return "".join(rng.choice(tokens) for _ in range(rng.randint(0, longest)))

    pairs = []
    while len(pairs) < 4000:
        base = "http://h" + rng.choice(["", "/", "/a/", "/a/b"]) + text(4).replace("http:", "")
        if urlsplit(base).netloc == "h":
            pairs.append((base, text(7)))
    _assert_resolves(spark, pairs)


def test_resolve_array_equals_single(spark):
    rows = spark.createDataFrame([(RFC_BASE, HREFS)], "base string, hrefs array<string>")
    links = rows.select(resolve_links(F.col("base"), F.col("hrefs")).alias("links")).first()[0]
    assert links == [_joined(RFC_BASE, h) for h in HREFS]


@pytest.mark.parametrize(
    "url,allowed",
    [
        ("http://ex.com/", True),
        ("http://a.EX.com:8/x", True),
        ("http://notex.com/", False),
        ("http://ex.com.evil.org/", False),
        ("mailto:x@ex.com", False),
        ("", False),
        ("http://u@other.net/", True),
    ],
)
def test_host_allowed(spark, url, allowed):
    row = spark.createDataFrame([(url,)], "url string")
    assert row.select(host_allowed(F.col("url"), "EX.com  other.net")).first()[0] is allowed


def test_host_parts(spark):
    row = spark.createDataFrame([("http://u@A.b.c:1/x?y",)], "url string")
    url = F.col("url")
    got = row.select(url_host(url), host_suffixes(url_host(url)), url_origin(normalize_url(url)))
    assert got.first()[:] == ("a.b.c", ["a.b.c", "b.c", "c"], "http://a.b.c")
