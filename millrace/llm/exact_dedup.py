"""Exact deduplication as a stateful stream.

The stream reads document files as they come and keeps, on disk (RocksDB) and without expiry,
one entry per digest: the stable identifier of its first document, a locator of its content
(file and row), and how many documents had it.  What a batch changed is written out, so the
latest entry of a digest is what the state holds.  A hit, a document whose digest was there
before, counts as a copy only after its bytes have been compared with those at the locator.
Documents of a digest for which that fails are grouped by their bytes themselves.

Defined cases: a null text counts as empty; white space is folded, not removed, so an empty
text and a blank one differ; a null ``doc_id`` comes after all others; of rows that repeat a
``doc_id`` the one that lies first in the files stays; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.probe import bitmaps_of, possible, without
from millrace.scratch import fresh_dir

# State lives in one small store per partition, so stores do not reserve space ahead (4 MB each).
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

DECISION = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def folded(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _place() -> Column:
    """Where a row lies, ordered by ``doc_id`` first and null last."""
    return F.struct(
        F.col("doc_id").isNull().alias("unnamed"),
        F.col("doc_id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def run_stream(spark: SparkSession, path: str, work: str, digest=sha256_hex, batch_bytes: int | None = None) -> DataFrame:
    """Entries of the state once the stream has read all there is: ``digest``, ``first``, ``n``.

    ``batch_bytes`` bounds a batch; a restart with the same ``work`` goes on where it stopped.
    """
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    source = spark.readStream.schema(schema)
    if batch_bytes:
        source = source.option("maxBytesPerTrigger", batch_bytes)
    # As a pattern the path may name a folder or one file.
    bare = path.rstrip("/")
    arrived = source.parquet(f"{bare[:-1]}[{bare[-1]}]" if bare[-1].isalnum() else bare).select(digest(folded(F.col("text"))).alias("digest"), _place().alias("place"))
    state = arrived.groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("n"))

    def store(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{work}/changed/batch={batch}")

    before = {name: spark.conf.get(name, None) for name in STATE_CONF}
    for name, value in STATE_CONF.items():
        spark.conf.set(name, value)
    try:
        query = (
            state.writeStream.outputMode("update")
            .foreachBatch(store)
            .option("checkpointLocation", f"{work}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    kind = f"struct<unnamed:boolean,doc_id:{schema['doc_id'].dataType.simpleString()},file:string,row:bigint>"
    changed = spark.read.schema(f"digest string, first {kind}, n bigint, batch bigint")
    try:
        entries = changed.parquet(f"{work}/changed")
    except Exception as error:  # an empty folder gives no batch at all
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], f"digest string, first {kind}, n bigint")
    latest = F.max_by(F.struct("first", "n"), "batch").alias("entry")
    return entries.groupBy("digest").agg(latest).select("digest", "entry.*")


def decide(spark: SparkSession, path: str, digest=sha256_hex, batch_bytes: int | None = None) -> DataFrame:
    """``DECISION`` and ``place`` for every row of the Parquet files at ``path``."""
    work = fresh_dir(spark, "exact-dedup")
    entries = run_stream(spark, path, work, digest, batch_bytes)
    # As a table, so that the join below can split a digest that most rows have.
    entries.write.parquet(f"{work}/entries")
    entries = spark.read.schema(entries.schema).parquet(f"{work}/entries")
    rows = spark.read.parquet(path).select("doc_id", "text", _place().alias("place"))
    found = rows.select(digest(folded(F.col("text"))).alias("digest"), "doc_id", "place")
    told = found.join(entries, "digest")
    told.write.parquet(f"{work}/told")
    told = spark.read.parquet(f"{work}/told")
    wrong = _disagreeing(rows, told.filter("n > 1"), work)
    sure = told
    if wrong is not None:
        sure = told.join(wrong, "digest", "left_anti")
    sha = F.col("digest") if digest is sha256_hex else F.lit(None).cast("string")
    out = sure.select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("place") == F.col("first")).alias("kept"),
        sha.alias("text_sha256"),
        "place",
    )
    if wrong is not None:
        out = out.unionByName(_by_bytes(rows, told.join(wrong, "digest", "left_semi")))
    return out


def _texts_at(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` with the folded ``text`` that lies there; other texts stay where they are."""
    near = possible(rows, bitmaps_of(places, "place"), "place")
    return near.join(places, "place").withColumn("text", folded(F.col("text")))


def _disagreeing(rows: DataFrame, hits: DataFrame, work: str) -> DataFrame | None:
    """Digests of hits whose bytes are not those at the locator; None if there are none.

    One row stands at a locator, and hits that share it are on the other side of the join, where
    a skewed partition can be split.
    """
    texts = _texts_at(rows, hits.select("place", "digest", "first"))
    copies = texts.filter("place <> first").select("first", "digest", "text")
    firsts = texts.filter("place = first").select("first", F.col("text").alias("kept_text"))
    checked = copies.join(firsts, "first").filter("text <> kept_text")
    checked.select("digest").distinct().write.parquet(f"{work}/wrong")
    wrong = rows.sparkSession.read.schema("digest string").parquet(f"{work}/wrong")
    return None if wrong.isEmpty() else wrong


def _by_bytes(rows: DataFrame, told: DataFrame) -> DataFrame:
    """The decision for rows of shared digests, by the whole text itself."""
    texts = _texts_at(rows, told.select("place"))
    groups = texts.groupBy("text").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    return texts.join(groups, "text").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("place") == F.col("first")).alias("kept"),
        sha256_hex(F.col("text")).alias("text_sha256"),
        "place",
    )


def kept_rows(docs: DataFrame) -> DataFrame:
    """``docs`` without later copies, all columns as they were.

    The rows land as files first, since a stream reads files.
    """
    spark, path = docs.sparkSession, fresh_dir(docs.sparkSession, "landed")
    docs.write.option("compression", "zstd").parquet(path)
    work = fresh_dir(spark, "copies")
    dropped = decide(spark, path).filter("NOT kept").select(
        F.col("place.file").alias("_file"), F.col("place.row").alias("_row")
    )
    dropped.write.parquet(work)
    dropped = spark.read.schema(dropped.schema).parquet(work)
    landed = spark.read.schema(docs.schema).parquet(path)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    placed = landed.select(
        row, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    return without(placed, dropped, "_file", "_row").select("row.*")
