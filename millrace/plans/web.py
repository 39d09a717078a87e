"""URL, HTML and frontier queries over the pages table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.html import link_texts, page_title
from millrace.functions.urls import (
    host_allowed,
    is_web_address,
    normalize_url,
    resolve_links,
    url_host,
    url_origin,
)
from millrace.operators.allowlist import semi_join_allowed
from millrace.operators.caps import first_rows
from millrace.operators.frontier import (
    first_parents,
    first_visits,
    link_edges,
    unseen,
    with_seen,
)
from millrace.plans import sql_fragments as sql
from millrace.plans.registry import query, table
from millrace.sources.rows import seed_urls
from millrace.sources.web import look_up, read_pages

# The scope and the page cap of the registered crawl queries.
ALLOWED = "example.org example.net"
PAGE_CAP = 100
ENQUEUE_CAP = 200


def snapshot(pages: DataFrame) -> DataFrame:
    """The pages table as a snapshot: everything was fetched, nothing redirected."""
    return pages.withColumns(
        {"final_url": F.lit(None).cast("string"), "status": F.lit(200)}
    )


def _read(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_pages(snapshot(table(spark, sf_dir, "pages")), "page_id", columns)


@query(f"SELECT page_id, {sql.normal('url')} AS url FROM pages")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", normalize_url(F.col("url")).alias("url"))


@query(
    f"""
    SELECT page_id, {sql.host('url')} AS host, {sql.in_domains('url', ALLOWED)} AS allowed
    FROM pages
    """
)
def host_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", url_host(url).alias("host"), host_allowed(url, ALLOWED).alias("allowed")
    )


@query(
    f"""
    WITH hosts AS (SELECT DISTINCT {sql.host('url')} AS domain FROM pages
                   WHERE url LIKE 'https://%')
    SELECT page_id, url FROM pages
    WHERE EXISTS (SELECT 1 FROM hosts
                  WHERE {sql.host('url')} = domain
                     OR suffix({sql.host('url')}, '.' || domain))
    """
)
def host_allowlist_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages on, or below, a host that some page serves over https."""
    pages = table(spark, sf_dir, "pages")
    secure = pages.filter(F.col("url").startswith("https://"))
    domains = secure.select(url_host(F.col("url")).alias("domain"))
    return semi_join_allowed(pages.select("page_id", "url"), domains)


@query(f"SELECT page_id, {sql.title('html')} AS title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", page_title(F.col("html")).alias("title"))


@query(f"SELECT page_id, unnest({sql.hrefs('html')}) AS href FROM pages")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.explode(link_texts(F.col("html"))).alias("href"))


@query(
    f"""
    SELECT page_id, link, {sql.normal('link')} AS url
    FROM (SELECT page_id, regexp_extract(url, '^[^:]*://[^/?#]*') || unnest({sql.hrefs('html')}) AS link
          FROM pages)
    """
)
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page as an absolute address and as a visiting key."""
    pages = table(spark, sf_dir, "pages")
    links = F.filter(resolve_links(F.col("url"), link_texts(F.col("html"))), is_web_address)
    return pages.select("page_id", F.explode(links).alias("link")).withColumn(
        "url", normalize_url(F.col("link"))
    )


def seed_texts(pages: DataFrame) -> DataFrame:
    """Per page a seed text: its address, its origin, and a word that is no address."""
    url = F.col("url")
    return pages.select(
        F.concat_ws("  ", url, url_origin(normalize_url(url)), url_host(url)).alias("seeds")
    )


@query(
    f"""
    SELECT DISTINCT url, 0 AS depth
    FROM (SELECT {sql.normal('url')} AS url FROM pages
          UNION ALL SELECT {sql.origin(sql.normal('url'))} || '/' FROM pages)
    """
)
def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_urls(seed_texts(table(spark, sf_dir, "pages")))


@query(f"SELECT src_url, dst_url FROM ({sql.EDGES})")
def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_edges(_read(spark, sf_dir, "links"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages at depth 0 and what they link to at depth 1, with the linking page."""
    pages = _read(spark, sf_dir, "links")
    roots = pages.select("url", F.lit(0).alias("depth"), F.lit("").alias("src_url"))
    linked = link_edges(pages).select(
        F.col("dst_url").alias("url"), F.lit(1).alias("depth"), "src_url"
    )
    return roots.unionByName(linked)


CANDIDATES = f"""
    SELECT url, 0 AS depth, '' AS src_url FROM ({sql.FIRST_PAGES})
    UNION ALL SELECT dst_url, 1, src_url FROM ({sql.EDGES})
"""


@query(f"SELECT url, min(depth) AS depth FROM ({CANDIDATES}) GROUP BY url")
def frontier_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_visits(_candidates(spark, sf_dir))


@query(
    f"""
    SELECT url, depth, src_url FROM (
        SELECT *, row_number() OVER (PARTITION BY url ORDER BY depth, src_url) AS rn
        FROM ({CANDIDATES}))
    WHERE rn = 1
    """
)
def frontier_first_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_parents(_candidates(spark, sf_dir))


@query(
    f"""
    SELECT DISTINCT dst_url AS url FROM ({sql.EDGES}) e
    WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE {sql.normal('p.url')} = e.dst_url)
      AND NOT EXISTS (SELECT 1 FROM pages p
                      WHERE {sql.origin(sql.normal('p.url'))} || '/' = e.dst_url)
    """
)
def frontier_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets that are neither a page nor the root of a page's origin."""
    pages = _read(spark, sf_dir, "links")
    visited = pages.select("url")
    roots = visited.select(F.concat(url_origin(F.col("url")), F.lit("/")).alias("url"))
    seen = with_seen(visited, roots).distinct()
    return unseen(link_edges(pages).select(F.col("dst_url").alias("url")).distinct(), seen)


@query(
    f"""
    SELECT DISTINCT dst_url AS url FROM ({sql.EDGES})
    WHERE {sql.in_domains('dst_url', ALLOWED)} ORDER BY url LIMIT {PAGE_CAP}
    """
)
def page_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses a crawl may still attempt when its page cap leaves that many."""
    targets = link_edges(_read(spark, sf_dir, "links")).select(F.col("dst_url").alias("url")).distinct()
    return first_rows(targets.filter(host_allowed(F.col("url"), ALLOWED)), "url", PAGE_CAP)


@query(
    f"SELECT DISTINCT dst_url AS url FROM ({sql.EDGES}) ORDER BY url LIMIT {ENQUEUE_CAP}"
)
def enqueue_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the cap on waiting addresses; there are more of them at every scale."""
    targets = link_edges(_read(spark, sf_dir, "links")).select(F.col("dst_url").alias("url")).distinct()
    return first_rows(targets, "url", ENQUEUE_CAP)


@query(
    f"""
    SELECT s.url, {sql.title('html')} AS title
    FROM (SELECT {sql.normal('url')} AS url FROM pages
          UNION SELECT {sql.origin(sql.normal('url'))} || '/' FROM pages) s
    JOIN ({sql.FIRST_PAGES}) p ON s.url = p.url
    """
)
def snapshot_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds looked up in the snapshot; those it does not hold drop out."""
    found = look_up(seeds(spark, sf_dir), _read(spark, sf_dir, "title"))
    return found.select("url", "title")
