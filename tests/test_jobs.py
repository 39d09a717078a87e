import pytest

from millrace.jobs import crawl, ingest
from millrace.operators.runs import history
from millrace.scratch import fresh_dir
from millrace.sinks.topics import produce
from millrace.sources.tables import json_lines, versioned_table
from millrace.sources.topics import RecordFiles
from tests.test_tables_and_streams import records

PAGES = [
    (1, "http://ex.org/", "<title>root</title><a href=a>a</a><a href=b>b</a>"),
    (2, "http://ex.org/a", "<title>A</title>"),
]


def test_crawl_job(spark, monkeypatch):
    snapshot, out = fresh_dir(spark, "snapshot"), fresh_dir(spark, "raw")
    spark.createDataFrame(PAGES, "page_id int, url string, html string").write.parquet(snapshot)
    monkeypatch.setenv("SEEDS", "http://ex.org")
    monkeypatch.setenv("ALLOWED_DOMAINS", "ex.org")
    monkeypatch.setenv("MAX_DEPTH", "1")
    argv = ["--snapshot", snapshot, "--out", out]
    counters = crawl.run(spark, crawl.arguments(argv))
    assert (counters["attempted"], counters["fetched"], counters["failed"]) == (3, 2, 1)
    crawl.run(spark, crawl.arguments([*argv, "--max-depth", "0"]))
    rows = json_lines(spark, out, "url string, title string, depth int, ts long, dt string, run_id string")
    assert sorted((r["title"], r["depth"]) for r in rows.collect()) == [("A", 1), ("root", 0), ("root", 0)]
    assert rows.select("run_id").distinct().count() == 2


def test_repeated_and_later_crawl_jobs(spark):
    snapshot, out, seen, runs = (fresh_dir(spark, name) for name in ("snapshot", "raw", "seen", "runs"))
    spark.createDataFrame(PAGES, "page_id int, url string, html string").write.parquet(snapshot)
    argv = ["--snapshot", snapshot, "--out", out, "--allowed", "ex.org", "--seen", seen, "--runs", runs, "--max-depth", "0"]
    for run_id, seeds in (("one", "http://ex.org"), ("one", "http://ex.org"), ("two", "http://ex.org http://ex.org/a")):
        crawl.run(spark, crawl.arguments([*argv, "--seeds", seeds, "--run-id", run_id, "--run-ts", "86400"]))
    rows = json_lines(spark, out, "title string, dt string, run_id string").collect()
    assert sorted(map(tuple, rows)) == [("A", "19700102", "two"), ("root", "19700102", "one")]
    assert {(r["run_id"], r["attempted"]) for r in history(spark, runs).collect()} == {("one", 1), ("two", 1)}


def test_a_cap_can_be_lifted(monkeypatch):
    argv = ["--snapshot", "x", "--out", "y", "--seeds", "a", "--allowed", "b"]
    assert crawl.arguments(argv).max_pages == 20
    monkeypatch.setenv("MAX_PAGES", "none")
    args = crawl.arguments([*argv, "--max-enqueue", "none"])
    assert args.max_pages is None and args.max_enqueue is None


def test_crawl_job_needs_seeds(monkeypatch):
    monkeypatch.delenv("SEEDS", raising=False)
    with pytest.raises(SystemExit):
        crawl.arguments(["--snapshot", "x", "--out", "y"])


@pytest.mark.parametrize("raw", [False, True])
def test_ingest_job(spark, raw):
    topic = RecordFiles(fresh_dir(spark, "topic"))
    produce(records(spark, 0, 20), topic)
    table = fresh_dir(spark, "table")
    argv = ["--records", topic.path, "--table", table, "--checkpoint", fresh_dir(spark, "ck")]
    argv += ["--format", "parquet", "--drain", *(["--raw"] if raw else ["--schema", "message string"])]
    ingest.run(spark, ingest.arguments(argv))
    appended = versioned_table(spark, table, fmt="parquet")
    assert appended.columns == ["msg" if raw else "message"]
    assert appended.count() == 20


def test_ingest_job_needs_a_topic():
    with pytest.raises(SystemExit):
        ingest.arguments(["--table", "x", "--checkpoint", "y", "--servers", "kafka:9092"])
