import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import runs
from millrace.operators.crawl import crawl
from millrace.operators.seen import SeenTable
from millrace.scratch import fresh_dir
from millrace.sources.web import has_places, read_pages, with_kind

SCHEMA = "id int, url string, final_url string, status int, html string"


def page(i, url, links=(), title="t", status=200, final=None, html=None):
    body = f"<title>{title}</title>" + "".join(f'<a href="{h}">x</a>' for h in links)
    return (i, url, final, status, body if html is None else html)


WEB = [
    page(1, "http://ex.org/", ["a", "/b", "http://ex.org/"], "root"),
    page(2, "http://ex.org/a", ["c", "b", "http://evil.com/x", "missing"], "A"),
    page(3, "http://ex.org/b", ["d", "/", "a"], "B", status=None),
    page(4, "http://ex.org/c?x=1", ["e", "http://ex.org/e"], "C", final="http://other.net/moved/"),
    page(5, "http://ex.org/c?x=2", ["never"], "copy"),
    page(6, "http://ex.org/d", ["f"], "D", status=404),
    page(7, "http://ex.org/e", html=""),
]
FULL = {
    "http://ex.org/": (0, True),
    "http://ex.org/a": (1, True),
    "http://ex.org/b": (1, True),
    "http://ex.org/c": (2, True),
    "http://ex.org/d": (2, False),
    "http://ex.org/missing": (2, False),
    "http://ex.org/e": (3, False),
}


def run(spark, rows=WEB, seeds="HTTP://EX.org nope http://ex.org", allowed="EX.org", **options):
    options = {"max_depth": 3, "max_pages": None, "max_enqueue": None, **options}
    snapshot = spark.createDataFrame(rows, SCHEMA)
    return crawl(snapshot, "id", seeds, allowed, run_ts=5, run_id="r", **options)


def visits(result):
    rows = result.visits.collect()
    assert len({r["url"] for r in rows}) == len(rows)
    return {r["url"]: (r["depth"], r["fetched"]) for r in rows}


def test_cycle_diamond_copies_failures(spark):
    result = run(spark)
    assert visits(result) == FULL
    assert {tuple(r) for r in result.records.collect()} == {
        ("http://ex.org/", "root", 0, 5),
        ("http://ex.org/a", "A", 1, 5),
        ("http://ex.org/b", "B", 1, 5),
        ("http://other.net/moved", "C", 2, 5),
    }
    assert result.manifest("out").first().asDict() == {
        "run_id": "r", "attempted": 7, "fetched": 4, "emitted": 4, "failed": 3, "left_by_pages": 0, "left_by_queue": 0,
        "destination": "out", "errors": {"empty": 1, "no page": 1, "status 404": 1},
    }
    assert '{"url":"http://ex.org/a","title":"A","depth":1,"ts":5}' in {
        r["value"] for r in result.json_lines.collect()
    }


@pytest.mark.parametrize("cap", [0, 2, 4, 7])
def test_page_cap_counts_attempts_in_order(spark, cap):
    ordered = sorted(FULL, key=lambda u: (FULL[u][0], u))
    assert visits(run(spark, max_pages=cap)) == {u: FULL[u] for u in ordered[:cap]}


def test_enqueue_cap_takes_smallest_waiting_addresses(spark):
    assert visits(run(spark, max_enqueue=1)) == {
        "http://ex.org/": (0, True),
        "http://ex.org/a": (1, True),
        "http://ex.org/b": (2, True),
        "http://ex.org/d": (3, False),
    }


def test_what_caps_leave_out_is_counted(spark):
    row = run(spark, max_pages=2).manifest().first()
    assert (row["attempted"], row["left_by_pages"], row["left_by_queue"]) == (2, 1, 0)
    row = run(spark, max_enqueue=1).manifest().first()
    assert row["attempted"] == 4 and row["left_by_queue"] > 0


@pytest.mark.parametrize("options", [{}, {"max_pages": 1}, {"max_enqueue": 1}, {"max_depth": 0}, {"allowed": "x.net"}])
def test_only_documents_that_a_level_wants_are_parsed(spark, options):
    rows = WEB + [page(100 + i, f"http://ex.org/far/{i}") for i in range(300)] + [page(900, "http://evil.com/x", ["/y"])]
    result = run(spark, rows, **options)
    fetched = result.fetched.count()
    assert fetched <= result.parsed <= fetched + 1  # and the empty one


def test_a_snapshot_in_files_is_read_where_it_lies(spark):
    path = fresh_dir(spark, "snapshot")
    spark.createDataFrame(WEB, SCHEMA).repartition(3).write.parquet(path)
    stored = spark.read.parquet(path)
    assert has_places(stored.withColumn("more", F.lit(1)).filter("id > 0"))
    assert not has_places(stored.union(stored)) and not has_places(spark.createDataFrame(WEB, SCHEMA))
    assert visits(crawl(stored, "id", "http://ex.org", "ex.org", max_depth=3)) == FULL


def test_earlier_runs_are_left_out(spark):
    earlier = spark.createDataFrame([("http://ex.org/a",)], "url string")
    assert visits(run(spark, earlier=earlier)) == {
        "http://ex.org/": (0, True), "http://ex.org/b": (1, True), "http://ex.org/d": (2, False),
    }


def test_runs_share_a_table_of_seen_addresses(spark):
    path = fresh_dir(spark, "seen")
    seen = SeenTable.open(spark, path, buckets=3)
    snapshot = spark.createDataFrame(WEB, SCHEMA)

    def attempts(run_id, seeds, seen, **options):
        found = crawl(snapshot, "id", seeds, "ex.org", max_depth=3, run_id=run_id, seen=seen, **options)
        return {r["url"][-1] for r in found.attempts.collect()}

    def stored(seen):
        return sorted((r["run_id"], r["url"][-1], r["depth"]) for r in seen.rows().collect())

    first = [("it's", "/", 0), ("it's", "a", 1), ("it's", "b", 1)]
    for _ in range(2):  # a repeated run sees what others attempted, not what it did itself
        assert attempts("it's", "http://ex.org", seen, max_pages=3) == {"/", "a", "b"}
        assert stored(seen) == first
    seen.forget()
    again = SeenTable.open(spark, path)
    assert again.buckets == 3 and stored(again) == first
    # The second run comes to nothing new but by way of an address of its own.
    assert attempts("2", "http://ex.org http://ex.org/c", again) == {"c", "e"}
    assert stored(again) == sorted([*first, ("2", "c", 0), ("2", "e", 1)])
    assert attempts("3", "", again) == set() and len(stored(again)) == 5
    again.forget()


TYPED = [
    (*page(1, "http://ex.org/", ["p", "x", "n", "i"]), "Text/HTML; charset=utf-8"),
    (*page(2, "http://ex.org/p", ["never"]), "application/pdf"),
    (*page(3, "http://ex.org/x"), " application/xhtml+xml "),
    (*page(4, "http://ex.org/n"), None),
    (*page(5, "http://ex.org/i", status=404), "image/png"),
    (*page(6, "http://ex.org/i?2"), "text/html"),
    (*page(7, "http://ex.org/odd"), "nonsense"),
]


@pytest.mark.parametrize("stored", [False, True])
def test_documents_of_other_types_are_not_parsed(spark, stored):
    snapshot = spark.createDataFrame(TYPED, f"{SCHEMA}, content_type string")
    if stored:
        with_kind(snapshot).write.parquet(path := fresh_dir(spark, "typed"))
        snapshot = spark.read.parquet(path)
    seeds = "http://ex.org http://ex.org/odd"
    result = crawl(snapshot, "id", seeds, "ex.org", max_depth=1)
    assert {(r["url"][-1], r["reason"]) for r in result.failures.collect()} == {
        ("p", "type application"), ("i", "status 404"), ("d", "type other")}
    assert result.parsed == 3 == result.manifest().first()["fetched"]
    lifted = crawl(snapshot, "id", seeds, "ex.org", max_depth=1, types=None)
    assert lifted.manifest().first()["errors"] == {"status 404": 1}
    assert {p["url"][-1] for p in read_pages(snapshot, "id").collect()} == {"/", "x", "n"}
    assert {p["url"][-1] for p in read_pages(snapshot, "id", types=None).collect()} == {"/", "p", "x", "n", "d"}


def test_a_recorded_run_replaces_itself(spark):
    path = fresh_dir(spark, "runs")
    for run_id, pages in (("a/b", 2), ("c", None), ("a/b", None)):
        snapshot = spark.createDataFrame(WEB, SCHEMA)
        runs.record_run(crawl(snapshot, "id", "http://ex.org", "ex.org", pages, 3, run_id=run_id), path)
    history = runs.history(spark, path)
    assert sorted((r["run_id"], r["attempted"]) for r in history.collect()) == [("a/b", 7), ("c", 7)]
    assert {tuple(r) for r in runs.errors(history).collect()} == {("empty", 2), ("no page", 2), ("status 404", 2)}


def test_one_list_means_the_same_short_and_long(spark):
    rows = [page(1, "http://example.org./x"), page(2, "http://ex.org/y")]
    seeds = "http://example.org./x http://ex.org/y"
    endless = "http://" + "x" * 300 + "/"
    rows, seeds = [*rows, page(3, endless)], f"{seeds} {endless}"
    short = run(spark, rows, seeds, allowed=["", "ex.org", "x" * 300])
    long = run(spark, rows, seeds, allowed=["", "ex.org", "x" * 300, *[f"d{i}.net" for i in range(100)]])
    assert visits(short) == visits(long) == {"http://ex.org/y": (0, True)}


def test_failures_by_reason(spark):
    found = run(spark).failures.collect()
    assert {(r["url"][-1], r["reason"]) for r in found} == {("d", "status 404"), ("g", "no page"), ("e", "empty")}


def test_depth_zero_and_no_seeds(spark):
    assert visits(run(spark, max_depth=0)) == {"http://ex.org/": (0, True)}
    assert visits(run(spark, seeds="")) == {}
    assert run(spark, seeds="").manifest().first()["attempted"] == 0


def test_allowlist_as_frame_and_as_long_list(spark):
    frame = spark.createDataFrame([("Ex.Org",), ("sub.ex.org",)], "domain string")
    assert visits(run(spark, allowed=frame)) == FULL
    assert visits(run(spark, allowed=["ex.org", *[f"d{i}.net" for i in range(100)]])) == FULL


def test_first_row_of_copies_counts(spark):
    failed_first = [page(8, "http://ex.org/g?1", status=500), page(9, "http://ex.org/g?2")]
    pages = read_pages(spark.createDataFrame(WEB + failed_first, SCHEMA), "id").collect()
    assert {p["url"][-1] for p in pages} == {"/", "a", "b", "c"}
    assert len(pages) == 4
    (copy,) = [p for p in pages if p["url"] == "http://ex.org/c"]
    assert (copy["title"], copy["links"]) == ("C", ["http://other.net/moved/e", "http://ex.org/e"])


def test_a_copy_that_loses_takes_no_other_row_along(spark):
    rows = [page(1, "http://ex.org/a?1", title="first"), page(9, "http://ex.org/a?2"), page(9, "http://ex.org/b")]
    pages = read_pages(spark.createDataFrame(rows, SCHEMA), "id").collect()
    assert {(p["url"], p["title"]) for p in pages} == {("http://ex.org/a", "first"), ("http://ex.org/b", "t")}


def brute_force(rows, seeds, max_depth, max_pages):
    links = {}
    for _, url, _, status, html in sorted(rows, reverse=True):
        links[url] = html.split('href="')[1:] if status == 200 and html else None
    level, seen, depth = sorted(seeds), {}, 0
    while level and depth <= max_depth:
        for url in level:
            if len(seen) < max_pages:
                seen[url] = (depth, links.get(url) is not None)
        found = {part.split('"')[0] for u in level if u in seen for part in links.get(u) or ()}
        level, depth = sorted(found - set(seen)), depth + 1
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_random_webs_match_brute_force(spark, seed):
    rng = random.Random(seed)
    urls = [f"http://ex.org/{i}" for i in range(40)]
    rows = [
        page(i, u, rng.sample(urls, rng.randint(0, 4)), status=rng.choice([200, 200, 200, 500]))
        for i, u in enumerate(urls[:35])
    ]
    seeds = rng.sample(urls, 3)
    for cap in (10, 10_000):
        result = run(spark, rows, " ".join(seeds), max_pages=cap, max_depth=4)
        assert visits(result) == brute_force(rows, seeds, 4, cap)


def test_hot_address_and_hot_copies(spark):
    """A third of all rows are copies of one address and all pages link to it."""
    rows = [page(i, f"http://ex.org/hot?{i}", ["/x"]) for i in range(300)]
    rows += [page(1000 + i, f"http://ex.org/{i}", ["/hot", f"/{i + 1}"]) for i in range(600)]
    result = run(spark, rows, "http://ex.org/0", max_depth=3)
    assert visits(result)["http://ex.org/hot"] == (1, True)
    assert visits(result)["http://ex.org/x"] == (2, False)
    assert result.attempts.groupBy("url").count().filter(F.col("count") > 1).count() == 0
