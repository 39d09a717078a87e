"""Breadth-first crawl over a table of page snapshots.

One loop turn per depth, at most ``max_depth + 1`` of them; the driver sees counts, never
addresses.  What has been attempted is a stored table bucketed by address (``operators.seen``), and
so is an index of the snapshot's addresses; a level is looked up in the one and checked against the
other without moving either.  Documents are read and parsed only where a level wants them.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.messages import encode_json
from millrace.functions.urls import domain_list, host_allowed
from millrace.operators.allowlist import Allowlist
from millrace.operators.caps import first_rows
from millrace.operators.frontier import first_visits, linked, unseen
from millrace.operators.seen import SeenTable
from millrace.scratch import fresh_dir
from millrace.sources.rows import literal_rows, seed_urls
from millrace.sources.web import PAGE_TYPES, address_rows, fetch, first_of_copies, has_places

# Fixed value: the crawl's default.
MAX_DEPTH = 2

LITERAL_DOMAINS = 50

NO_PAGE, EMPTY = "no page", "empty"

ATTEMPT_SCHEMA = T.StructType(
    [T.StructField("url", T.StringType()), T.StructField("depth", T.IntegerType())]
)
WANTED_SCHEMA = T.StructType(
    [
        *ATTEMPT_SCHEMA.fields,
        T.StructField("file", T.StringType()),
        T.StructField("row", T.LongType()),
        T.StructField("reason", T.StringType()),
    ]
)
FETCHED_SCHEMA = T.StructType(
    [
        *ATTEMPT_SCHEMA.fields,
        T.StructField("final_url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("links", T.ArrayType(T.StringType())),
    ]
)
RECORD_SCHEMA = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("ts", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Crawl:
    """What a crawl left behind.

    ``attempts`` is ``(url, depth, reason)`` and ``fetched`` has ``url``, ``depth``, ``final_url``,
    ``title`` and ``links``; both have one row per address, and an attempt without a fetched row failed,
    for its ``reason`` or, where that is NULL, since its body is empty.  ``links`` is
    NULL at the last depth, where none are followed.  ``run_ts`` is when the run began.
    ``left_by_pages`` and ``left_by_queue`` count the addresses that the two caps left out, once
    for each level that would have visited them; ``parsed`` counts the documents that were parsed.
    """

    attempts: DataFrame
    fetched: DataFrame
    run_id: str
    run_ts: int
    left_by_pages: int = 0
    left_by_queue: int = 0
    seconds: float = 0.0
    parsed: int = 0

    @property
    def _told(self) -> DataFrame:
        got = self.fetched.select("url", F.lit(True).alias("got"))
        return self.attempts.join(got, "url", "left").withColumn("got", F.coalesce("got", F.lit(False)))

    @property
    def visits(self) -> DataFrame:
        """``url``, ``depth`` and whether the fetch gave a page."""
        return self._told.select("url", "depth", F.col("got").alias("fetched"))

    @property
    def failures(self) -> DataFrame:
        """``url`` and ``reason`` of every attempt without a page."""
        reason = F.coalesce("reason", F.lit(EMPTY)).alias("reason")
        return self._told.filter(~F.col("got")).select("url", reason)

    @property
    def records(self) -> DataFrame:
        """``url``, ``title``, ``depth``, ``ts`` of every page fetched.

        ``url`` is where the fetch ended up, so a redirect may repeat an address.
        """
        return self.fetched.select(
            F.col("final_url").alias("url"),
            "title",
            "depth",
            F.lit(self.run_ts).cast("bigint").alias("ts"),
        )

    @property
    def json_lines(self) -> DataFrame:
        """The records, one JSON object each, in the column ``value``."""
        return self.records.select(encode_json(*RECORD_SCHEMA.names).alias("value"))

    def manifest(self, destination: str = "") -> DataFrame:
        """One row of counters for the run, with its failures by reason in the map ``errors``."""
        page, got = "page", "fetched"
        marks = self.attempts.select(F.coalesce("reason", F.lit(page)).alias("mark"))
        counts = marks.unionByName(self.fetched.select(F.lit(got).alias("mark"))).groupBy("mark").count()

        def total(which: Column) -> Column:
            return F.coalesce(F.sum(F.when(which, F.col("count"))), F.lit(0))

        mark = F.col("mark")
        counted = counts.agg(
            total(mark != got).alias("attempted"),
            total(mark == got).alias("fetched"),
            total(mark == page).alias("_pages"),
            # As many as there are reasons, which are few.
            F.collect_list(F.when(~mark.isin(page, got), F.struct("mark", "count"))).alias("_told"),
        )
        empty = F.struct(F.lit(EMPTY).alias("mark"), (F.col("_pages") - F.col("fetched")).alias("count"))
        told = F.filter(F.concat("_told", F.array(empty)), lambda e: e["count"] > 0)
        return counted.select(
            F.lit(self.run_id).alias("run_id"),
            "attempted",
            "fetched",
            F.col("fetched").alias("emitted"),
            (F.col("attempted") - F.col("fetched")).alias("failed"),
            F.lit(self.left_by_pages).cast("bigint").alias("left_by_pages"),
            F.lit(self.left_by_queue).cast("bigint").alias("left_by_queue"),
            F.lit(destination).alias("destination"),
            F.map_from_entries(F.array_sort(told)).alias("errors"),
        )


def crawl(
    snapshot: DataFrame,
    order: str,
    seeds: DataFrame | str,
    allowed: DataFrame | str | Iterable[str],
    max_pages: int | None = None,
    max_depth: int = MAX_DEPTH,
    max_enqueue: int | None = None,
    run_ts: int | None = None,
    run_id: str | None = None,
    earlier: DataFrame | None = None,
    seen: SeenTable | None = None,
    types: Sequence[str] | None = PAGE_TYPES,
) -> Crawl:
    """Visit allowed addresses breadth first, each once, at its smallest depth.

    ``snapshot`` is described in ``sources.web``; ``order`` names its column that decides
    between rows for one address.  ``seeds`` is white-space-separated text, or a frame with
    a text column ``seeds``.  ``allowed`` is a string or list of domains, or a frame with a
    column ``domain``.  ``max_pages`` bounds attempts, failures included; ``max_enqueue``
    bounds the addresses waiting for the next level; both take the smallest addresses first,
    so runs agree, and without a number there is no cap.

    ``seen`` is the table of what earlier runs attempted, which this one does not; it is left with
    this run's attempts, in place of those of an earlier run with its ``run_id``.  ``earlier`` holds the
    ``url`` of more addresses to leave out.  Documents of other ``types`` fail without being parsed;
    None takes all.  A snapshot whose rows cannot be told by file and place is stored once.
    """
    spark = snapshot.sparkSession
    began = time.time()
    run_id = run_id or uuid.uuid4().hex
    work = fresh_dir(spark, "crawl")
    if isinstance(seeds, str):
        seeds = literal_rows(spark, [(seeds,)], "seeds string")
    if not has_places(snapshot):
        snapshot.write.parquet(f"{work}/snapshot")
        snapshot = spark.read.schema(snapshot.schema).parquet(f"{work}/snapshot")

    attempted = left_by_pages = left_by_queue = documents = 0
    wanted_paths: list[str] = []
    fetched_paths: list[str] = []
    in_scope = _scope(spark, allowed)
    own_table = seen is None
    seen = seen or SeenTable.open(spark, f"{work}/seen")
    index, forget_index = _stored_index(address_rows(snapshot, order, types), in_scope, seen.buckets, f"{work}/index")
    try:
        fresh = (lambda urls: urls) if earlier is None else (lambda urls: unseen(urls, earlier))
        frontier = fresh(in_scope(seed_urls(seeds)))
        if not own_table:
            frontier = seen.unseen(frontier, without_run=run_id)
        for depth in range(max_depth + 1):
            room = None if max_pages is None else max_pages - attempted
            waiting = None if depth == 0 else max_enqueue
            if depth == 0 or room is not None or waiting is not None:
                level, size, found_size = _capped(frontier, room, waiting, f"{work}/level-{depth}")
                (seen.add if depth else seen.start)(level, run_id)
            else:
                size = found_size = seen.add(frontier, run_id)
            queued = found_size if waiting is None else min(found_size, waiting)
            left_by_queue += found_size - queued
            left_by_pages += queued - size
            attempted += size

            wanted_paths.append(f"{work}/wanted-{depth}")
            reason = F.when(F.col("file").isNull(), NO_PAGE).otherwise(F.col("reason")).alias("reason")
            looked_up = seen.level(run_id, depth).join(index, "url", "left")
            looked_up.select(*ATTEMPT_SCHEMA.names, "file", "row", reason).write.parquet(wanted_paths[-1])
            wanted = spark.read.schema(WANTED_SCHEMA).parquet(wanted_paths[-1])
            columns = ["title"] if depth == max_depth else ["title", "links"]
            found = fetch(snapshot, wanted, f"{work}/fetched-{depth}", columns)
            documents += found
            fetched_paths += [f"{work}/fetched-{depth}"] if found else []
            if not found or depth == max_depth or attempted == max_pages:
                break

            fetched = spark.read.schema(FETCHED_SCHEMA).parquet(fetched_paths[-1])
            frontier = seen.unseen(fresh(in_scope(first_visits(linked(fetched)))))
    finally:
        forget_index()
        if own_table:
            seen.forget()
    fetched = spark.read.schema(FETCHED_SCHEMA)
    return Crawl(
        spark.read.schema(WANTED_SCHEMA).parquet(*wanted_paths).select(*ATTEMPT_SCHEMA.names, "reason"),
        fetched.parquet(*fetched_paths) if fetched_paths else literal_rows(spark, [], FETCHED_SCHEMA),
        run_id,
        int(began) if run_ts is None else run_ts,
        left_by_pages,
        left_by_queue,
        time.time() - began,
        documents,
    )


def _stored_index(
    rows: DataFrame, in_scope: Callable[[DataFrame], DataFrame], buckets: int, path: str
) -> tuple[DataFrame, Callable[[], object]]:
    """The snapshot's addresses in scope, each once, written bucketed, so no level has to shuffle them.

    An address without a row in it is an attempt that finds no page.  Only the table's name goes away
    at the end; the files stay with the run.
    """
    spark = rows.sparkSession
    name = f"crawl_index_{uuid.uuid4().hex}"
    first = first_of_copies(in_scope(rows)).repartition(buckets, "url")  # as the table's buckets are
    first.write.format("parquet").option("path", path).bucketBy(buckets, "url").saveAsTable(name)
    table = spark.table(name)
    return table, lambda: spark.sql(f"DROP TABLE IF EXISTS {name}")


def _capped(
    frontier: DataFrame, room: int | None, waiting: int | None, path: str
) -> tuple[DataFrame, int, int]:
    """The part of a frontier that may be visited, stored; its size and the frontier's.

    The rows are counted while they are written.  A level is put in order only if it does not
    fit under the caps.
    """
    counted = Observation()
    frontier.observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(path)
    size = counted.get["n"]
    limit = min((n for n in (room, waiting) if n is not None), default=size)
    stored = frontier.sparkSession.read.schema(ATTEMPT_SCHEMA).parquet(path)
    return (stored, size, size) if size <= limit else (first_rows(stored, "url", limit), limit, size)


def _scope(
    spark: SparkSession, allowed: DataFrame | str | Iterable[str]
) -> Callable[[DataFrame], DataFrame]:
    """What keeps the allowed addresses of a frame; a list in a table is prepared once."""
    if not isinstance(allowed, DataFrame):
        domains = domain_list(allowed)
        if len(domains) <= LITERAL_DOMAINS:
            return lambda urls: urls.filter(host_allowed(F.col("url"), domains))
        allowed = literal_rows(spark, [(d,) for d in domains], "domain string")
    return Allowlist.store(allowed).keep
