"""Page snapshots: what a fetch would have returned, held in a table.

Columns: ``url``, ``final_url`` (after redirects, NULL if none), ``status`` (NULL means
fetched), ``html`` and, if known, ``content_type`` or, written by ``with_kind``, ``content_kind``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millrace.functions.binding import bind
from millrace.functions.html import link_texts, page_record, page_title, title_and_links
from millrace.functions.urls import is_web_address, normalize_url, resolve_links
from millrace.operators.probe import bitmaps_of, possible
from millrace.scratch import fresh_dir

# Types of documents that are parsed, and the registered kinds of types.
PAGE_TYPES = ("text/html", "application/xhtml+xml")
TYPE_FAMILIES = "application audio font image message model multipart text video".split()

BITMAP_SCHEMA = pa.schema([("_probe_bucket", pa.int64()), ("_probe_bits", pa.binary())])
LISTED_FILES = 10_000


def was_fetched() -> Column:
    """Whether a snapshot row holds a page: no error status and a body that is not empty."""
    ok_status = F.coalesce(F.col("status") < 400, F.lit(True))
    return ok_status & (F.coalesce(F.length("html"), F.lit(0)) > 0)


def _kind(snapshot: DataFrame) -> Column | None:
    """The type of a row's document without parameters, in lower case; None if no column tells."""
    if "content_kind" in snapshot.columns:
        return F.col("content_kind")
    if "content_type" in snapshot.columns:
        return F.lower(F.trim(F.substring_index("content_type", ";", 1)))
    return None


def with_kind(snapshot: DataFrame) -> DataFrame:
    """The snapshot with ``content_kind`` in place of ``content_type``.

    Stored like this, a scan for some types leaves out the row groups that have none of them.
    """
    kind = _kind(snapshot)
    return snapshot if kind is None else snapshot.withColumn("content_kind", kind).drop("content_type")


def is_page_type(snapshot: DataFrame, types: Sequence[str] | None = PAGE_TYPES) -> Column:
    """Whether a row's document is of a listed type; true for a row without a type, as it may be one.

    ``types`` None lifts the condition.
    """
    kind = _kind(snapshot)
    return F.lit(True) if kind is None or types is None else kind.isin(*types) | kind.isNull()


def of_type(snapshot: DataFrame, types: Sequence[str] | None = PAGE_TYPES) -> DataFrame:
    """Rows whose document is of a listed type, or of none that is known."""
    return snapshot.filter(is_page_type(snapshot, types))


def failure_reason(snapshot: DataFrame, types: Sequence[str] | None = PAGE_TYPES) -> Column:
    """Why a row gives no page, without a look at its body: ``status <n>``, ``type <family>`` or NULL.

    There are as many reasons as error statuses and families of types, however many types there are.
    """
    status = F.when(F.col("status") < 600, F.col("status").cast("string")).otherwise("other")
    reason = F.when(F.col("status") >= 400, F.concat(F.lit("status "), status))
    kind = _kind(snapshot)
    if kind is None:
        return reason
    family = F.substring_index(kind, "/", 1)
    named = F.when(family.isin(*TYPE_FAMILIES), family).otherwise("other")
    return reason.when(~is_page_type(snapshot, types), F.concat(F.lit("type "), named))


def outgoing(base: Column, hrefs: Column) -> Column:
    """Normalised web addresses the links of a page lead to, each once."""
    resolved = F.filter(resolve_links(base, hrefs), is_web_address)
    keys = F.transform(resolved, normalize_url)
    return F.array_distinct(F.filter(keys, lambda url: url.isNotNull()))


@lru_cache
def _page(application_id: str, columns: tuple[str, ...]) -> Column:
    """The page struct of a snapshot row with its ``key``; NULL if the fetch failed.

    Kept per application: naming its parts one by one costs the driver a second.
    """
    base = F.coalesce(F.col("final_url"), F.col("key"))
    html = F.col("html")

    def page(title: Column | None, hrefs: Column | None) -> Column:
        parts = {"final_url": normalize_url(base)}
        if "title" in columns:
            parts["title"] = title
        if "links" in columns:
            parts["links"] = outgoing(base, hrefs)
        return F.struct(*[part.alias(name) for name, part in parts.items()])

    if set(columns) == {"title", "links"}:
        return F.when(was_fetched(), bind(title_and_links(html), lambda r: page(r["title"], r["hrefs"])))
    return F.when(was_fetched(), page(page_title(html), link_texts(html)))


COLUMNS = ("title", "links")


def keyed(snapshot: DataFrame) -> DataFrame:
    """Snapshot rows with their normalised address ``key``; those without one are dropped."""
    return snapshot.withColumn("key", normalize_url(F.col("url"))).filter("key IS NOT NULL")


def parsed(snapshot: DataFrame, *keep: str, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """Snapshot rows as ``(url, page)``, in place and copies included.

    ``url`` is the normalised address, and rows without one are dropped; ``page`` is a
    struct of ``final_url`` and ``columns``, NULL if the fetch failed.
    """
    page = _page(snapshot.sparkSession.sparkContext.applicationId, tuple(columns))
    return keyed(snapshot).select(F.col("key").alias("url"), *keep, page.alias("page"))


def read_pages(
    snapshot: DataFrame,
    order: str,
    columns: Sequence[str] = COLUMNS,
    types: Sequence[str] | None = PAGE_TYPES,
) -> DataFrame:
    """The pages a snapshot holds: ``url``, ``final_url`` and ``columns``, each ``url`` once.

    Of several rows with one address the one with the smallest ``order``, a column without repeats
    among them, counts; if that one failed or is of another type, the address has no page.
    Documents are parsed where they lie.  Addresses with copies are found on addresses and numbers
    alone, and only parsed rows meet them.
    """
    spark, path = snapshot.sparkSession, fresh_dir(snapshot.sparkSession, "copies")
    names = keyed(snapshot).select(F.col("key").alias("url"), order)
    counted = names.groupBy("url").agg(F.min(order).alias("_first"), F.count("*").alias("_n"))
    copies = counted.filter("_n > 1").drop("_n")
    copies.write.parquet(path)
    copies = spark.read.schema(copies.schema).parquet(path)
    found = parsed(of_type(snapshot, types), order, columns=columns).filter("page IS NOT NULL")
    found = found.join(copies, "url", "left")
    kept = F.col("_first").isNull() | (F.col(order) == F.col("_first"))
    return found.filter(kept).select("url", "page.*")


def wide_records(snapshot: DataFrame, run_ts: int, *keep: str, types: Sequence[str] | None = PAGE_TYPES) -> DataFrame:
    """The wide record of every snapshot row that holds a page: ``url``, ``final_url``, ``fetched_at``
    (the snapshot's column of that name, or else when the run began) and the fields of
    ``functions.html.page_record``; copies included, documents parsed where they lie."""
    at = F.lit(run_ts).cast("bigint")
    if "fetched_at" in snapshot.columns:
        at = F.coalesce(F.col("fetched_at").cast("bigint"), at)
    rows = keyed(of_type(snapshot, types)).filter(was_fetched())
    final = normalize_url(F.coalesce(F.col("final_url"), F.col("key"))).alias("final_url")
    record = page_record(F.col("html")).alias("record")
    wide = rows.select(*keep, F.col("key").alias("url"), final, at.alias("fetched_at"), record)
    return wide.select(*keep, "url", "final_url", "fetched_at", "record.*")


def has_places(snapshot: DataFrame) -> bool:
    """Whether rows can be told by file and place in it: files of a format that numbers its rows."""
    try:
        snapshot.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def address_rows(snapshot: DataFrame, order: str, types: Sequence[str] | None = PAGE_TYPES) -> DataFrame:
    """``url``, ``order``, ``file``, ``row`` and ``reason`` of every row that has an address; bodies
    are not read."""
    reason = failure_reason(snapshot, types).alias("reason")
    places = F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    return keyed(snapshot).select(F.col("key").alias("url"), F.col(order).alias("order"), *places, reason)


def first_of_copies(rows: DataFrame) -> DataFrame:
    """``address_rows`` with each ``url`` once: the row with the smallest ``order``, chosen before and
    after the exchange, so copies of a popular address do not meet in one task."""
    first = F.min(F.struct("order", "file", "row", "reason")).alias("first")
    return rows.groupBy("url").agg(first).select("url", "first.file", "first.row", "first.reason")


def fetch(
    snapshot: DataFrame, wanted: DataFrame, path: str, columns: Sequence[str] = COLUMNS
) -> int:
    """Write to ``path``, if there are any, the rows of ``wanted`` (``file``, ``row`` and more, stored) that give a page, with that page.

    Only files in which rows are wanted are read, and of these only documents whose place has its
    bit in a bitmap of 2 to the 23rd bits are parsed, in place, whatever the size of ``wanted``:
    a megabyte is broadcast, documents are not shuffled, and a place that only shares a bit with
    another is dropped when the parsed rows are joined with those wanted.  The number of documents
    parsed is returned.
    """
    spark, wanted = snapshot.sparkSession, wanted.filter("reason IS NULL")
    files = [r["file"] for r in wanted.select("file").distinct().limit(LISTED_FILES + 1).collect()]
    if not files:
        return 0
    held = bitmaps_of(wanted, "file", "row").collect()  # at most a megabyte
    bitmaps = spark.createDataFrame(pa.Table.from_pylist([r.asDict() for r in held], BITMAP_SCHEMA))
    rows = snapshot.filter(F.col("_metadata.file_path").isin(files)) if len(files) <= LISTED_FILES else snapshot
    rows = rows.withColumns({"file": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index")})
    chosen = possible(rows, bitmaps, "file", "row")
    parse = Observation()
    found = parsed(chosen.observe(parse, F.count(F.lit(1)).alias("n")), "file", "row", columns=columns)
    # Stored before it is joined: a plan with the parser in it takes the driver long to change.
    found.write.parquet(f"{path}-parsed")
    found = spark.read.schema(found.schema).parquet(f"{path}-parsed").filter("page IS NOT NULL").drop("url")
    names = [name for name in wanted.columns if name not in ("file", "row", "reason")]
    wanted.join(found, ["file", "row"]).select(*names, "page.*").write.parquet(path)
    return parse.get["n"]


def look_up(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """The frontier rows whose fetch gives a page, with that page.

    Both sides have one row per address, so no key is hot.  A frontier small enough by its
    stored size is broadcast; a larger one is shuffled to the buckets of ``pages``, where it is
    the side that is hashed, so the pages are not sorted.
    """
    return pages.join(frontier.hint("shuffle_hash"), "url").select(
        *frontier.columns, *[c for c in pages.columns if c != "url"]
    )
