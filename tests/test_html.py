import html
import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from millrace.functions.html import link_texts, page_language, page_record, page_title, title_and_links, unescape
from millrace.scratch import fresh_dir
from millrace.sources.web import wide_records

REFERENCES = [
    "a&amp;b", "&lt;&gt;&quot;&#39;&apos;", "&copy 2020", "&notit;", "&notin;", "&amp", "&bogus;",
    "&", "&&", "a & b", "&#x41;&#65;&#0;&#x80;&#x9f;&#129;&#xD800;&#x110000;&#99999999999;",
    "&#13;", "&#1;", "&#xb;", "&#x1F600;", "&nbsp;x", "&AMP;", "&hellip;&mdash", "&NotEqualTilde;",
    "&#;", "&#x;", "&#xg", "&ampx", "&eacute;t&eacute", "&#x7f;", "&#xfdd0;&#x1fffe;", "x&#32;y",
    "&lt", "&#0065;", "&#x00000041", "&CounterClockwiseContourIntegral;", "&fooo;amp;", "&#129",
    "plain", "",
]


def test_unescape(spark):
    rows = spark.createDataFrame(
        [(t, html.unescape(t)) for t in REFERENCES], "text string, expected string"
    )
    got = rows.withColumn("got", unescape(F.col("text")))
    assert got.filter(~F.col("got").eqNullSafe(F.col("expected"))).collect() == []


DOCUMENTS = [
    ('<html><head><title> A &amp; B\n</title></head><a href="/x">x</a>', "A & B", ["/x"]),
    (
        '<!-- <title>no</title><a href="n"> --><script>"<title>no</title><a href=\'n\'>"</script>'
        "<TITLE lang=x>Yes</TITLE><A class=q HREF=bare>..</A><a\nhref='s q'>",
        "Yes",
        ["bare", "s q"],
    ),
    (
        '<a>none</a><a name=x>n</a><abbr href="no"><a data-href="no" href>e</a><area href=no>'
        '<a title="href=\'x\' > y" href="z&amp;w">',
        "",
        ["", "z&w"],
    ),
    ("", "", []),
    ("no markup", "", []),
    ("<title></title>", "", []),
    ("<title>a<b>c</b></title>", "", []),
    ("<title><b>c</b></title>", "c", []),
    ("<title>open", "open", []),
    ("<titles>x</titles><title>y</title>", "y", []),
    ("<title>first</title><title>second</title>", "first", []),
    ("<title>  x </title>", "x", []),
    ('<a href="1" href="2">', "", ["2"]),
    ('<a/href="1"><a href = "2" ><a href="3"', "", ["1", "2"]),
    ('<style>a{}</style><a href="k">', "", ["k"]),
    ("<script src=x></script><a href=m>", "", ["m"]),
    ("<scripty><a href=m></scripty>", "", ["m"]),
    ("<script><a href=m>", "", []),
    ("<!-- open <a href=m>", "", []),
    ("a < b <a href=/q/>x", "", ["/q/"]),
    ("<p title=don't><a href='u'>", "", ["u"]),
    ('<p x="><a href=no>" y><a href=yes>', "", ["yes"]),
    ("<![CDATA[x]]><?php x ?><a href=y>", "", ["y"]),
    ("<![CDATA[<title>c</title>]]><title>d</title>", "d", []),
    ("<?php <title>e</title> ?><title>f</title>", "f", []),
    ("<!foo <a href=n>><a href=m>", "", ["m"]),
]


def test_documents(spark):
    rows = spark.createDataFrame(DOCUMENTS, "html string, title string, links array<string>")
    document = F.col("html")
    got = rows.select(
        "*",
        page_title(document).alias("got_title"),
        link_texts(document).alias("got_links"),
        title_and_links(document).alias("both"),
    )
    for row in got.collect():
        assert row["got_title"] == row["title"], row["html"]
        assert row["got_links"] == row["links"], row["html"]
        assert row["both"]["title"] == row["title"]
        assert row["both"]["hrefs"] == row["links"]


class Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.links = []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and "href" in dict(attrs):
            self.links.append(dict(attrs)["href"] or "")


def test_random_documents_match_the_standard_parser(spark):
    rng = random.Random(11)
    values = ["", "=x", "='a \"b> c'", '="d \'e> <a href=no>"', " = y", '="&amp;&eacute;"', "=/p?q=1"]
    names = ["href", "HREF", "class", "data-href", "title", "x"]
    tags = ["a", "A", "abbr", "p", "b", "area", "aside", "script2"]
    between = [" ", "text", "a < b", "</a>", "</p >", "<br/>", "<!-- <a href=no> -->", "&lt;a href=no>",
               "<script>'<a href=no>'</script>", "<style><a href=no></style>", "<!doctype html>",
               "<?php <a href=n> ?>", "<![CDATA[<a href=n>]]>", "<!foo <a href=n>>", "<?x>", "<![if a]>",
               "<!DOCTYPE x '<a href=n>'>", "<![CDATA[ ]] > <a href=n> ]] >"]

    def tag():
        attributes = [rng.choice(names) + rng.choice(values) for _ in range(rng.randint(0, 4))]
        spaced = "".join(rng.choice([" ", "\n", "  "]) + a for a in attributes)
        return "<" + rng.choice(tags) + spaced + rng.choice([">", " >", " />"])

    documents = [
        "".join(rng.choice([tag, lambda: rng.choice(between)])() for _ in range(rng.randint(1, 12)))
        for _ in range(3000)
    ]
    rows = []
    for document in documents:
        parser = Anchors()
        parser.feed(document)
        parser.close()
        rows.append((document, parser.links))
    frame = spark.createDataFrame(rows, "html string, links array<string>")
    got = frame.withColumn("got", link_texts(F.col("html")))
    wrong = got.filter(~F.col("got").eqNullSafe(F.col("links"))).limit(5).collect()
    assert wrong == []


def test_missing_document(spark):
    row = spark.createDataFrame([(None,)], "html string")
    assert row.select(page_title(F.col("html")), link_texts(F.col("html"))).first()[:] == ("", None)


@pytest.mark.parametrize(
    "part,times",
    [
        ("x ", 500_000),
        ("<", 500_000),
        ("<a ", 200_000),
        ('<a href="', 100_000),
        ("<!--", 200_000),
        ("<![CDATA[", 100_000),
        ("<!x", 200_000),
        ("<?", 200_000),
        ("<script>", 100_000),
        ("<title>", 100_000),
        ('="', 300_000),
        ("&amp", 100_000),
        ("  ", 200_000),
    ],
)
def test_long_documents_take_linear_time(spark, part, times):
    rows = spark.createDataFrame([("<title>a" + part * times,)], "html string")
    started = time.time()
    for read in (title_and_links, page_record):
        rows.select(read(F.col("html")).alias("r")).write.format("noop").mode("overwrite").save()
    assert time.time() - started < 30


def test_whole_document_is_read(spark):
    text = "<p>" + "word " * 400_000 + "<a href=/end>"
    rows = spark.createDataFrame([(text,)], "html string")
    assert rows.select(link_texts(F.col("html"))).first()[0] == ["/end"]


RECORDS = [
    (
        """<!doctype html><HTML class=x Lang='d&eacute;'><head><!-- <meta name=no content=no> --><meta charset=utf-8>
        <META NAME="Author" content="A &amp; B"><meta name=author content=second><meta property='og:title' content="T>t">
        <meta name=empty content=""><meta name=lost><meta content=alone><meta charset=late><title> T &lt; </title>
        <link rel=stylesheet href=s><link rel="Canonical" href="/c?a&amp;b"><link rel=canonical href=/later></head>
        <script>"<a href=no>"</script><a name=x><a href="/1&amp;2">1</a><a href=/1&2>""",
        ("T <", "dé", "utf-8", "/c?a&b", ["/1&2", "/1&2"], {"author": "A & B", "og:title": "T>t", "empty": ""}),
    ),
    ("", ("", None, None, None, [], {})),
    ("plain text", ("", None, None, None, [], {})),
    ("<html><title>x</title><meta><link><a></html>", ("x", None, None, None, [], {})),
    ("<p lang=no><meta name=A content=1><META name=a content=2><meta name=b content=3>", ("", None, None, None, [], {"a": "1", "b": "3"})),
]


def test_wide_records(spark):
    frame = spark.createDataFrame([(document,) for document, _ in RECORDS] + [(None,)], "html string")
    got = frame.select(page_record(F.col("html")).alias("r"), page_language(F.col("html")).alias("lang")).collect()
    assert [tuple(row["r"]) for row in got[:-1]] == [wanted for _, wanted in RECORDS]
    assert [row["lang"] for row in got[:-1]] == [wanted[1] for _, wanted in RECORDS]
    assert got[-1]["r"] is None


def test_wide_records_of_a_snapshot(spark):
    rows = [
        ("http://h/a?1", None, 200, "<title>a</title><a href=b>", "Text/HTML", 7),
        ("http://h/a?2", "http://h/z/", None, "<meta name=k content=v>", None, None),
        ("http://h/b", None, 404, "x", None, 7), ("http://h/c", None, 200, "x", "image/png", 7), ("nowhere", None, 200, "x", None, 7),
    ]
    snapshot = spark.createDataFrame(rows, "url string, final_url string, status int, html string, content_type string, fetched_at long")
    wide = wide_records(snapshot, 99)
    path = fresh_dir(spark, "wide")
    wide.write.parquet(f"{path}/parquet")
    wide.write.json(f"{path}/json")
    for stored in (spark.read.parquet(f"{path}/parquet"), spark.read.schema(wide.schema).json(f"{path}/json")):
        assert sorted((r["final_url"], r["fetched_at"], r["title"], r["links"], r["meta"]) for r in stored.collect()) == [
            ("http://h/a", 7, "a", ["b"], {}), ("http://h/z", 99, "", [], {"k": "v"})]
