"""Bodies, cleaned texts, rich page records and tables that grow columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.html import page_language
from millrace.operators.cleaning import clean_split, distinct_bodies
from millrace.plans import sql_fragments as sql
from millrace.plans.registry import query, table
from millrace.plans.web import snapshot
from millrace.scratch import fresh_dir
from millrace.sources.evolving import EvolvingTable
from millrace.sources.tables import json_lines
from millrace.sources.web import wide_records

LEAST_CHARS = 200
RUN_TS = 1_700_000_000
CLEAN = r"trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'))"
PLACE = "CAST('0x' || substr(md5(body_hash), 1, 4) AS INTEGER) % 100"


@query(
    """
    SELECT min(doc_id) AS doc_id, sha256(text) AS body_hash, count(*) AS copies
    FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)
    """
)
def content_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each body once, with the smallest id that has it."""
    return distinct_bodies(table(spark, sf_dir, "documents"), "text", "doc_id")


@query(
    f"""
    SELECT doc_id, n_chars, body_hash, copies,
           CASE WHEN {PLACE} < 90 THEN 'train' WHEN {PLACE} < 95 THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT min(doc_id) AS doc_id, length(t) AS n_chars, sha256(t) AS body_hash, count(*) AS copies
          FROM (SELECT doc_id, {CLEAN} AS t FROM documents) WHERE length(t) >= {LEAST_CHARS}
          GROUP BY t)
    """
)
def clean_dedupe_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts cleaned, each once, and dealt to three splits."""
    return clean_split(table(spark, sf_dir, "documents"), "text", "doc_id", LEAST_CHARS)


METAS = "regexp_extract_all(html, '<meta name=\"([^\"]*)\" content=\"[^\"]*\"', 1)"
CONTENTS = METAS.replace('content="[^"]*"', 'content="([^"]*)"').replace('name="([^"]*)"', 'name="[^"]*"')


@query(
    f"""
    SELECT page_id, {sql.title('html')} AS title,
           nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS lang,
           nullif(regexp_extract(html, '<meta charset="([^"]*)"', 1), '') AS charset,
           nullif(regexp_extract(html, '<link rel="canonical" href="([^"]*)"', 1), '') AS canonical,
           len({sql.hrefs('html')})::BIGINT AS n_links, array_to_string({sql.hrefs('html')}, ' ') AS links,
           array_to_string(list_sort(list_transform(range(1, len({METAS}) + 1),
               lambda i: ({METAS})[i] || '=' || ({CONTENTS})[i])), '; ') AS meta,
           {RUN_TS}::BIGINT AS fetched_at
    FROM pages
    """
)
def rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide record of every page, stored as Parquet and as JSON lines, with its list and its map."""
    path = fresh_dir(spark, "wide")
    wide = wide_records(snapshot(table(spark, sf_dir, "pages")), RUN_TS, "page_id")
    wide.write.parquet(f"{path}/parquet")
    spark.read.schema(wide.schema).parquet(f"{path}/parquet").write.json(f"{path}/json")
    entries = F.array_sort(F.map_entries("meta"))
    return json_lines(spark, f"{path}/json", wide.schema).select(
        "page_id",
        *["title", "lang", "charset", "canonical"],
        F.size("links").cast("bigint").alias("n_links"),
        F.array_join("links", " ").alias("links"),
        F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), "; ").alias("meta"),
        "fetched_at",
    )


@query(
    f"""
    SELECT page_id, url, CASE WHEN page_id % 3 > 0
               THEN nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') END AS lang,
           CASE WHEN page_id % 3 = 2 THEN length(html) ELSE NULL END::BIGINT AS n_chars
    FROM pages
    """
)
def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrow records, wider ones, and some whose number is a long one, in one table read as one."""
    pages, grown = table(spark, sf_dir, "pages"), EvolvingTable(spark, fresh_dir(spark, "evolving"))
    page_id = F.col("page_id").cast("int").alias("page_id")
    lang = page_language(F.col("html")).alias("lang")
    grown.append(pages.filter("page_id % 3 = 0").select(page_id, "url"))
    grown.append(pages.filter("page_id % 3 = 1").select(page_id, "url", lang))
    wide = pages.filter("page_id % 3 = 2")
    grown.append(wide.select("page_id", lang, "url", F.length("html").alias("n_chars")))
    return grown.read().withColumn("n_chars", F.col("n_chars").cast("bigint"))
