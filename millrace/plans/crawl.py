"""Crawl queries over a web derived from the pages table.

The links of the test pages all lead to addresses without a page, so a crawl of the
table alone would stop at once.  The web here gives those addresses a page each: a
*section*, which links on to its *archive*, back to the origin's *root* and out of scope;
some sections fail, and some are no page but a document of another type.  Every derived page has a fixed number of links, and each origin's
pages are entered from the seeds, so no page ever lists a whole origin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.urls import url_origin
from millrace.operators import runs
from millrace.operators.caps import head
from millrace.operators.counts import row_count
from millrace.operators.crawl import RECORD_SCHEMA, Crawl, crawl
from millrace.operators.seen import SeenTable
from millrace.plans import sql_fragments as sql
from millrace.plans.registry import query, table
from millrace.plans.web import ALLOWED, PAGE_CAP, seed_texts, snapshot
from millrace.scratch import fresh_dir
from millrace.sinks import files as sink
from millrace.sources.tables import json_lines, parquet
from millrace.sources.web import parsed, read_pages, with_kind

# Parameters of the registered crawls.
MAX_DEPTH = 3
RUN_TS = 1_700_000_000
RUN_DAY = "20231114"
RUN_ID = "run-1"
DERIVED_ORDER = 2**62


# The derived pages, as Spark SQL over their address ``url``.
NAME = "regexp_extract(url, '([^/]*)$', 1)"
SECTION = f"""named_struct(
    'url', url, 'final_url', CAST(NULL AS STRING), 'status', IF(url LIKE '%e', 404, 200),
    'content_type', CASE WHEN url LIKE '%n' THEN 'Application/PDF' WHEN url LIKE '%r' THEN 'text/html' END,
    'html', IF(url LIKE '%s', '', concat(
        '<html><head><!-- <title>x</title> --><title> Section ', {NAME},
        ' &amp; more</title></head><body><a class=up href=".">up</a><a href="', {NAME},
        '/archive?page=1">all</a><a href="//mirror.example.com/">copy</a>',
        '<a href="mailto:info@example.org">mail</a></body></html>')))"""
ARCHIVE = """named_struct(
    'url', concat(url, '/archive'), 'final_url', concat(url, '/archive/index.html?all=1'),
    'status', 200, 'content_type', 'Text/HTML; charset=utf-8',
    'html', '<title>Archive</title><a href="?page=2">next</a><a href=older>older</a>')"""
ROOT = """named_struct(
    'url', url, 'final_url', CAST(NULL AS STRING), 'status', CAST(NULL AS INT),
    'content_type', 'application/xhtml+xml',
    'html', concat('<title>', url, '</title><a href="/">home</a><a href="sitemap">map</a>'))"""


def web(pages: DataFrame) -> DataFrame:
    """Articles, sections, archives and roots as one stored snapshot.

    The addresses are stored once.  They are spread by hash before pages are made of them:
    file splits go by size, and so few bytes would put all that work into a few tasks.
    """
    spark = pages.sparkSession
    articles = snapshot(pages).withColumn("content_type", F.lit(None).cast("string"))
    root = F.concat(url_origin(F.col("url")), F.lit("/"))
    path = fresh_dir(spark, "addresses")
    sink.parquet(
        parsed(articles)
        .select(F.explode(F.concat(F.array(root), F.col("page.links"))).alias("url"))
        .distinct(),
        path,
    )
    derived = (
        parquet(spark, path)
        .repartition("url")
        .selectExpr(f"inline(IF(url LIKE '%/', array({ROOT}), array({SECTION}, {ARCHIVE})))")
        .withColumn("page_id", F.lit(DERIVED_ORDER))
    )
    stored = fresh_dir(spark, "web")
    sink.parquet(with_kind(articles.unionByName(derived)), stored)
    return parquet(spark, stored)


def _crawl(
    spark: SparkSession,
    sf_dir: str,
    max_pages: int | None = None,
    max_enqueue: int | None = None,
    earlier: DataFrame | None = None,
    snapshot: DataFrame | None = None,
    run_id: str = RUN_ID,
    seen: SeenTable | None = None,
) -> Crawl:
    pages = table(spark, sf_dir, "pages")
    return crawl(
        web(pages) if snapshot is None else snapshot,
        order="page_id",
        seeds=seed_texts(pages),
        allowed=ALLOWED,
        max_pages=max_pages,
        max_depth=MAX_DEPTH,
        max_enqueue=max_enqueue,
        run_ts=RUN_TS,
        run_id=run_id,
        earlier=earlier,
        seen=seen,
    )


# Sections that are a page: they neither fail, nor are empty or of another type.
OPEN = "url NOT LIKE '%e' AND url NOT LIKE '%s' AND url NOT LIKE '%n'"


def _visits(more: str = "true") -> str:
    """The crawl's walk in SQL; ``more`` is a condition on every address, named ``at``."""
    return f"""
    WITH RECURSIVE
    article AS MATERIALIZED ({sql.FIRST_PAGES}),
    edge AS MATERIALIZED ({sql.EDGES}),
    target AS MATERIALIZED (SELECT DISTINCT dst_url AS url FROM edge),
    root AS (SELECT DISTINCT {sql.origin('url')} || '/' AS url FROM article),
    node AS MATERIALIZED (
        SELECT url, url AS final_url, {sql.title('html')} AS title FROM article
        UNION ALL
        SELECT url, url, 'Section ' || regexp_extract(url, '([^/]*)$', 1) || ' & more' FROM target
        WHERE {OPEN}
        UNION ALL
        SELECT url || '/archive', url || '/archive/index.html', 'Archive' FROM target
        UNION ALL
        SELECT url, url, url FROM root),
    hop AS MATERIALIZED (
        SELECT src_url, dst_url FROM edge
        UNION ALL SELECT url, url || '/archive' FROM target
                  WHERE {OPEN}
        UNION ALL SELECT url, {sql.origin('url')} || '/' FROM target
                  WHERE {OPEN}
        UNION ALL SELECT url || '/archive', url || '/archive/index.html' FROM target
        UNION ALL SELECT url || '/archive', url || '/archive/older' FROM target
        UNION ALL SELECT url, url FROM root
        UNION ALL SELECT url, url || 'sitemap' FROM root),
    walk(url, depth) AS (
        SELECT url, 0 FROM article WHERE {sql.in_domains('url', ALLOWED)} AND {more.replace('at', 'url')}
        UNION SELECT url, 0 FROM root WHERE {sql.in_domains('url', ALLOWED)} AND {more.replace('at', 'url')}
        UNION
        SELECT dst_url, depth + 1 FROM walk JOIN hop ON src_url = url
        WHERE depth < {MAX_DEPTH} AND {sql.in_domains('dst_url', ALLOWED)}
          AND {more.replace('at', 'dst_url')}),
    visit AS (SELECT url, min(depth) AS depth FROM walk GROUP BY url)
    """


VISITS = _visits()
RECORDS = f"""
    SELECT final_url AS url, title, depth, {RUN_TS}::BIGINT AS ts
    FROM visit JOIN node USING (url)
"""
FETCHED = "(url IN (SELECT url FROM node)) AS fetched"


@query(f"{VISITS} SELECT url, depth, {FETCHED} FROM visit")
def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address attempted, its depth, and whether a page came back."""
    return _crawl(spark, sf_dir).visits


@query(
    f"""
    {VISITS}
    SELECT url, depth, {FETCHED} FROM (SELECT * FROM visit ORDER BY depth, url LIMIT {PAGE_CAP})
    """
)
def crawl_bfs_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same crawl stopped by its page cap."""
    return _crawl(spark, sf_dir, max_pages=PAGE_CAP).visits


def _capped_levels(cap: int) -> str:
    """Levels of which each takes the first ``cap`` addresses that no level before it has."""
    levels = ["level0 AS (SELECT DISTINCT url, 0 AS depth FROM walk WHERE depth = 0)"]
    for depth in range(1, MAX_DEPTH + 1):
        seen = " UNION ALL ".join(f"SELECT url FROM level{d}" for d in range(depth))
        levels.append(
            f"""
            found{depth} AS MATERIALIZED (
                SELECT DISTINCT dst_url AS url, {depth} AS depth
                FROM level{depth - 1} JOIN hop ON src_url = url
                WHERE {sql.in_domains('dst_url', ALLOWED)} AND dst_url NOT IN ({seen})),
            level{depth} AS MATERIALIZED (
                SELECT * FROM found{depth} ORDER BY url LIMIT {cap})"""
        )
    return ", ".join(levels)


def _all_levels(kind: str) -> str:
    first = 0 if kind == "level" else 1
    return " UNION ALL ".join(f"SELECT * FROM {kind}{d}" for d in range(first, MAX_DEPTH + 1))


QUEUE_CAP = 40


@query(
    f"""
    {VISITS}, {_capped_levels(QUEUE_CAP)}
    SELECT url, depth, {FETCHED} FROM ({_all_levels('level')})
    """
)
def crawl_enqueue_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same crawl with a cap on the addresses that wait for a level."""
    return _crawl(spark, sf_dir, max_enqueue=QUEUE_CAP).visits


@query(
    f"""
    {VISITS}, {_capped_levels(QUEUE_CAP)}
    SELECT '{RUN_ID}' AS run_id, count(*) AS attempted, count(*) FILTER (WHERE fetched) AS fetched,
           count(*) FILTER (WHERE fetched) AS emitted,
           count(*) FILTER (WHERE NOT fetched) AS failed, 0::BIGINT AS left_by_pages,
           (SELECT count(*) FROM ({_all_levels('found')}))
               - count(*) FILTER (WHERE depth > 0) AS left_by_queue,
           'crawl/raw' AS destination
    FROM (SELECT depth, {FETCHED} FROM ({_all_levels('level')}))
    """
)
def crawl_capped_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of that crawl, with what the cap left out."""
    return _crawl(spark, sf_dir, max_enqueue=QUEUE_CAP).manifest("crawl/raw").drop("errors")


def _seen(spark: SparkSession) -> SeenTable:
    return SeenTable.open(spark, fresh_dir(spark, "seen-runs"))


@query(
    f"""
    {VISITS}, first AS MATERIALIZED (SELECT * FROM visit ORDER BY depth, url LIMIT {PAGE_CAP}),
    start AS (
        SELECT url FROM article WHERE {sql.in_domains('url', ALLOWED)}
        UNION SELECT url FROM root WHERE {sql.in_domains('url', ALLOWED)}),
    level0 AS MATERIALIZED (
        SELECT url, 0 AS depth FROM start WHERE url NOT IN (SELECT url FROM first)),
    {", ".join(
        f"""level{depth} AS MATERIALIZED (
            SELECT DISTINCT dst_url AS url, {depth} AS depth FROM level{depth - 1} JOIN hop ON src_url = url
            WHERE {sql.in_domains('dst_url', ALLOWED)} AND dst_url NOT IN (SELECT url FROM first)
              AND dst_url NOT IN ({" UNION ALL ".join(f"SELECT url FROM level{d}" for d in range(depth))}))"""
        for depth in range(1, MAX_DEPTH + 1))}
    SELECT 'run-1' AS run_id, url, depth FROM first
    UNION ALL SELECT 'run-2', url, depth FROM ({_all_levels('level')})
    """
)
def cross_run_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one table of seen addresses: the second leaves out what the first attempted.

    The first is repeated under its name, and so is the second's start: neither is there twice.
    """
    seen, snapshot = _seen(spark), web(table(spark, sf_dir, "pages"))
    for run_id, max_pages in (("run-1", PAGE_CAP), ("run-1", PAGE_CAP), ("run-2", None)):
        _crawl(spark, sf_dir, max_pages=max_pages, snapshot=snapshot, run_id=run_id, seen=seen)
    return seen.rows().select("run_id", "url", "depth")


@query(
    f"""
    WITH article AS MATERIALIZED ({sql.KEYED}),
    target AS MATERIALIZED (SELECT DISTINCT dst_url AS url FROM ({sql.EDGES.replace(sql.FIRST_PAGES, sql.KEYED)}))
    SELECT url FROM article UNION SELECT url FROM target WHERE {OPEN}
    UNION SELECT url || '/archive' FROM target UNION SELECT {sql.origin('url')} || '/' FROM article
    """
)
def content_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses of the web that hold a page: what failed, is empty or of another type does not."""
    pages = read_pages(web(table(spark, sf_dir, "pages")), "page_id", ["title"])
    return pages.select("url")


REASON = """CASE WHEN url IN (SELECT url FROM target) AND url LIKE '%e' THEN 'status 404'
                    WHEN url IN (SELECT url FROM target) AND url LIKE '%n' THEN 'type application'
                    WHEN url IN (SELECT url FROM target) AND url LIKE '%s' THEN 'empty'
                    ELSE 'no page' END"""
FAILED = f"NOT {FETCHED.removesuffix(' AS fetched')}"


@query(f"{VISITS} SELECT url, {REASON} AS reason FROM visit WHERE {FAILED}")
def crawl_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every failed attempt of a crawl and its reason."""
    return _crawl(spark, sf_dir).failures


@query(f"{VISITS} SELECT reason, count(*) AS n FROM (SELECT {REASON} AS reason FROM visit WHERE {FAILED}) GROUP BY 1")
def run_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failed attempts of a crawl by reason."""
    return runs.by_reason(_crawl(spark, sf_dir).failures)


ATTEMPTS = f"""
    attempt AS MATERIALIZED (
        SELECT * FROM visit
        UNION ALL SELECT * FROM (SELECT * FROM visit ORDER BY depth, url LIMIT {PAGE_CAP}))"""


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of two runs, of which the first is recorded twice."""
    path, snapshot = fresh_dir(spark, "runs"), web(table(spark, sf_dir, "pages"))
    for run_id, max_pages in (("run-1", None), ("run-2", PAGE_CAP)):
        run = _crawl(spark, sf_dir, max_pages=max_pages, snapshot=snapshot, run_id=run_id)
        runs.record_run(run, path)
        if max_pages is None:
            runs.record_run(run, path)
    return runs.history(spark, path)


@query(
    f"""
    {VISITS}, {ATTEMPTS}
    SELECT 2::BIGINT AS runs, count(*) AS attempted, count(*) FILTER (WHERE fetched) AS emitted,
           count(*) FILTER (WHERE NOT fetched) / count(*) AS error_rate, true AS timed
    FROM (SELECT {FETCHED} FROM attempt)
    """
)
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics over a table of runs."""
    found = runs.metrics(_recorded(spark, sf_dir))
    timed = (F.col("emitted_per_second") > 0) & (F.col("last_recorded") > RUN_TS)
    return found.withColumn("timed", timed).drop("emitted_per_second", "last_recorded")


@query(
    f"""
    {VISITS}, {ATTEMPTS}
    SELECT reason, count(*)::BIGINT AS n FROM (SELECT {REASON} AS reason FROM attempt WHERE {FAILED}) GROUP BY 1
    """
)
def run_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failures by reason over a table of runs, from the sums that each run noted."""
    return runs.errors(_recorded(spark, sf_dir))


@query(f"{VISITS} {RECORDS}")
def crawl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawl(spark, sf_dir).records


@query(
    f"""
    {VISITS}
    SELECT '{{"url":' || to_json(url) || ',"title":' || to_json(title) || ',"depth":' || depth
           || ',"ts":' || ts || '}}' AS value
    FROM ({RECORDS})
    """
)
def crawl_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawl(spark, sf_dir).json_lines


@query(
    f"""
    {VISITS}
    SELECT '{RUN_ID}' AS run_id, count(*) AS attempted, count(*) FILTER (WHERE fetched) AS fetched,
           count(*) FILTER (WHERE fetched) AS emitted,
           count(*) FILTER (WHERE NOT fetched) AS failed, 0::BIGINT AS left_by_pages,
           0::BIGINT AS left_by_queue, 'crawl/raw' AS destination
    FROM (SELECT {FETCHED} FROM visit)
    """
)
def crawl_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawl(spark, sf_dir).manifest("crawl/raw").drop("errors")


def _stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "raw")
    run = _crawl(spark, sf_dir)
    for _ in range(2):  # a repeated run replaces what it wrote
        sink.dated_json_lines(run.records, path, run.run_id, run.run_ts)
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RECORD_SCHEMA.fields)
    return json_lines(spark, path, f"{names}, dt string, run_id string")


@query(f"{VISITS} SELECT *, '{RUN_DAY}' AS dt, '{RUN_ID}' AS run_id FROM ({RECORDS})")
def crawl_jsonl_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON lines under day and run, read back with a stated schema."""
    return _stored_records(spark, sf_dir)


@query(f"{VISITS} SELECT *, '{RUN_DAY}' AS dt, '22' AS hour, '{RUN_ID}' AS run_id FROM ({RECORDS})")
def crawl_hourly_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a folder per hour."""
    path = fresh_dir(spark, "raw")
    run = _crawl(spark, sf_dir)
    sink.dated_json_lines(run.records, path, run.run_id, run.run_ts, hourly=True)
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RECORD_SCHEMA.fields)
    return json_lines(spark, path, f"{names}, dt string, hour string, run_id string")


@query(f"{VISITS} SELECT count(*) AS n FROM ({RECORDS})")
def crawl_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_count(_stored_records(spark, sf_dir))


@query(f"{VISITS} SELECT url, title FROM ({RECORDS}) ORDER BY url LIMIT 3")
def jsonl_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preview of the written records."""
    return head(_stored_records(spark, sf_dir).select("url", "title"), "url", 3)
