"""Properties of physical plans that matter at scale."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)
from millrace.functions.scalars import plus_one
from millrace.operators.caps import first_rows
from millrace.operators.counts import element_counts
from millrace.operators.crawl import _stored_index
from millrace.operators.frontier import first_visits
from millrace.operators.seen import SeenTable
from millrace.plans.registry import PLANS, table
from millrace.scratch import fresh_dir
from millrace.sources.web import read_pages, with_kind

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def executed(spark):
    """A function that gives the plans of all executions that the session still remembers."""
    store = spark._jsparkSession.sharedState().statusStore()

    def texts():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.executionsList()
        return [found.apply(i).physicalPlanDescription() for i in range(found.size())]

    return texts


@pytest.mark.parametrize("name", list(PLANS))
def test_no_cross_joins_and_no_python_but_where_asked(spark, name):
    """In the plan of the result and in those of all that was written on the way."""
    seen = executed(spark)
    before = len(seen())
    text = "".join([plan(PLANS[name](spark, SF_DIR)), *seen()[before:]])
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert ("EvalPython" in text) == (name == "parallel_map")
    # Only the choice of a row for an address sorts, which is narrow.
    assert not ("SortAggregate" in text and name.startswith(("link", "snapshot", "frontier")))


def test_a_title_is_looked_up_without_links(spark):
    assert "href" not in plan(PLANS["snapshot_lookup"](spark, SF_DIR))


def test_a_cap_sorts_no_more_rows_than_it_keeps(spark):
    rows = spark.range(5_000).select(F.col("id").cast("string").alias("url"))
    seen = executed(spark)
    before = len(seen())
    first = first_rows(rows, "url", 700, sorted_rows=0)
    assert first.count() == 700
    assert not any("TakeOrdered" in text for text in seen()[before:])


def test_scans_read_only_what_is_asked(spark):
    text = plan(element_counts(table(spark, SF_DIR, "events").filter("event_id > 5"), "event_type"))
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in text
    assert "PushedFilters: [IsNotNull(event_id), GreaterThan(event_id,5)]" in text
    assert text.count("HashAggregate") == 2
    mapped = table(spark, SF_DIR, "lineitem").select(plus_one(F.col("l_linenumber")))
    assert "ReadSchema: struct<l_linenumber:int>" in plan(mapped)


@pytest.fixture
def without_broadcasts(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_neither_seen_addresses_nor_the_index_are_shuffled(spark, without_broadcasts):
    def addresses(n):
        return spark.range(n).select(F.col("id").cast("string").alias("url"), F.lit(0).alias("depth"))

    seen = SeenTable.open(spark, fresh_dir(spark, "seen"))
    seen.start(addresses(20), "1")
    seen.add(addresses(30), "2")
    fresh = seen.unseen(first_visits(addresses(50)), without_run="none")
    assert plan(fresh).count("Exchange") == 1  # the candidates, to be made distinct
    assert fresh.count() == 20
    rows = addresses(100).select("url", F.lit(1).alias("order"), F.lit("f").alias("file"), F.lit(1).alias("row"), F.lit(None).cast("string").alias("reason"))
    index, forget = _stored_index(rows, lambda urls: urls, seen.buckets, fresh_dir(spark, "index"))
    joined = seen.level("2", 0).join(index, "url", "left")
    assert "Exchange" not in plan(joined) and joined.count() == 30
    forget()
    seen.forget()


def test_documents_are_not_shuffled(spark, without_broadcasts):
    pages = table(spark, SF_DIR, "pages").withColumns({"final_url": F.lit(None).cast("string"), "status": F.lit(200)})
    lines = plan(read_pages(pages, "page_id")).splitlines()
    exchanges = [line for line in lines if "Exchange" in line]
    assert exchanges and not any("html" in line for line in exchanges)
    below = [line for line in lines if "html" in line]
    depth = {name: next(i for i, line in enumerate(lines) if name in line) for name in ("Exchange", "html")}
    assert below and depth["html"] > depth["Exchange"]  # parsed under the exchange, which carries the result


def test_types_reach_the_scan(spark):
    path = fresh_dir(spark, "typed")
    typed = spark.range(3).selectExpr(
        "id", "'http://h/' || id url", "null :: string final_url", "200 status", "'x' html", "'Text/HTML' content_type"
    )
    with_kind(typed).write.parquet(path)
    text = plan(read_pages(spark.read.parquet(path), "id"))
    assert "In(content_kind, [application/xhtml+xml,text/html])" in text and "PushedFilters" in text


