"""WARC archives: written as plain record files, and read back by verified boundary chains.

Writing: a record per page.  Of pages with equal payloads the one with the smallest id is a
response and the others are revisits of it.  Records are lines of a text file whose line end is
the empty lines that end a WARC record, so Spark's committer writes the archives.

Reading: archives are read in splits, cut wherever the version line stands.  A payload may hold
that line too, so each cut is a candidate only: from its header it tells where its successor
must begin.  Within a split the pointers are followed in memory, by doubling; between splits they
are joined, by doubling again, from the start of each file.  Candidates that the chain reaches
are records, and the others are parts of payloads.

Defined cases: a null page has an empty payload; a null URL gives a record without a target; line
breaks and characters beyond ASCII in a URL are percent-encoded; a null ``page_id`` is written
as an empty one and read as null; pages that repeat an id are records each, and of equal
payloads under one id those with the smallest hash of the URL are responses; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.scratch import fresh_dir

# Fixed values of the format.
VERSION = "WARC/1.0\r\n"
LINE = "\r\n"
BLANK = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
BASE_32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE_32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"

SMALL_ROWS = 100_000
FILE_RECORDS = 200_000


def sha1_base32(value: Column) -> Column:
    """The SHA-1 of bytes in upper-case base 32: 20 bits, five hex digits, give four digits."""
    digest = F.sha1(value)
    quads = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), BASE_32_DIGITS, BASE_32)


def _address(url: Column) -> Column:
    """A URL as one ASCII header value."""
    encoded = F.replace(F.url_encode(url), F.lit("+"), F.lit("%20"))
    return F.when(url.rlike(r"^[\x21-\x7E]*$"), url).otherwise(encoded)


def write(pages: DataFrame, path: str, min_bytes: int = 0, small_rows: int = SMALL_ROWS) -> None:
    """Archive ``pages`` (``page_id``, ``url``, ``html``) in ``path``.

    ``min_bytes``: smaller payloads are never revisited.  Payloads that repeat are found by
    their SHA-256, on narrow rows; few of them are broadcast, so that pages stay where they are,
    and many are joined by shuffle.
    """
    spark = pages.sparkSession
    payload = F.coalesce("html", F.lit(""))
    own = F.struct(F.col("page_id").isNull().alias("unnamed"), F.col("page_id"), F.xxhash64("url").alias("tie"))
    keyed = pages.select(
        "page_id", "url", payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("key"), own.alias("own")
    ).withColumn("long", F.octet_length("payload") >= min_bytes)
    narrow = fresh_dir(spark, "warc-firsts")
    firsts = keyed.filter("long").groupBy("key").agg(F.min("own").alias("first"), F.count("*").alias("n"))
    firsts.filter("n > 1").select("key", "first").write.parquet(narrow)
    firsts = spark.read.parquet(narrow)
    if firsts.count() <= small_rows:
        firsts = F.broadcast(firsts)
    told = keyed.join(firsts, "key", "left")
    first = F.col("first.page_id")
    revisit = F.col("first").isNotNull() & F.col("long") & (F.col("own") != F.col("first"))
    block = F.when(revisit, "").otherwise(
        F.concat(F.lit(HTTP), F.octet_length("payload").cast("string"), F.lit(BLANK), F.col("payload"))
    )
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    field = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(LINE))
    target = F.when(F.col("url").isNotNull(), field("WARC-Target-URI", _address(F.col("url")))).otherwise("")
    refers = field("WARC-Profile", F.lit(REVISIT)), field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), name(first), F.lit(">")))
    head = F.concat(
        F.lit(VERSION),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), name(F.col("page_id")), F.lit(">"))),
        field("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        target,
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1_base32(F.col("payload").cast("binary")))),
        F.when(revisit, F.concat(*refers)).otherwise(""),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length("block").cast("string")),
    )
    records = told.withColumn("block", block).select(F.concat(head, F.lit(LINE), F.col("block")).alias("value"))
    records.write.option("lineSep", BLANK).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _cuts(spark: SparkSession, path: str) -> DataFrame:
    """What follows each version line: ``file``, ``split``, ``seq`` (order in the split), ``value``.

    The piece before the first version line of a file is there too, and empty.
    """
    return (
        spark.read.option("lineSep", VERSION)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("seq"),
            "value",
        )
    )


def _after_header(block: Column) -> Column:
    """The payload of an HTTP block; a block without a header has none."""
    at = F.instr(block, BLANK)
    return F.when(at > 0, F.substr(block, at + len(BLANK))).otherwise("")


def _header(name: str) -> Column:
    return F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A narrow row per cut: its offset, where its successor must begin, and its fields.

    The payload's digest is that of the piece up to the next cut; it holds where nothing but the
    record itself lies there.
    """
    cuts = _cuts(spark, path).withColumn("head", F.substring_index("value", BLANK, 1))
    size = F.octet_length("value") + len(VERSION)
    has_head = F.instr("value", BLANK) > 0
    head_size = F.octet_length("head") + len(VERSION) + len(BLANK)
    length = F.when(has_head, _header("Content-Length").try_cast("bigint"))
    # The block, without the blank lines that end the record, and what follows its own header.
    told = cuts.withColumn("inner", F.substr("value", F.char_length("head") + len(BLANK) + 1))
    told = told.withColumn(
        "block", F.substr("inner", F.lit(1), F.greatest(F.char_length("inner") - len(BLANK), F.lit(0)))
    )
    told = told.withColumn("payload", _after_header(F.col("block")))
    narrow = told.select(
        "file", "split", "seq", size.alias("size"), head_size.alias("head_size"), length.alias("length"),
        _header("WARC-Type").alias("type"),
        F.regexp_extract("head", r"WARC-Record-ID: <urn:page:([^>]*)>", 1).try_cast("bigint").alias("page_id"),
        F.regexp_extract("head", r"WARC-Refers-To: <urn:page:([^>]*)>", 1).try_cast("bigint").alias("refers_to"),
        F.regexp_extract("head", r"WARC-Payload-Digest: sha1:([A-Z2-7]*)", 1).alias("told_digest"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        sha1_base32(F.col("payload").cast("binary")).alias("digest"),
        F.xxhash64("value").alias("mark"),
    )
    place = fresh_dir(spark, "warc-cuts")
    narrow.write.parquet(place)
    narrow = spark.read.parquet(place)
    # A split's rows are bounded by its bytes; the rows of splits, by their number in a file.
    within = W.partitionBy("file", "split").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    splits = narrow.groupBy("file", "split").agg(F.sum("size").alias("bytes"))
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.select("file", "split", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    # The piece before a file's first version line is that line's own beginning.
    own = F.coalesce(F.sum("size").over(within), F.lit(0))
    at = F.col("base") + own - len(VERSION)
    found = narrow.withColumn("own", own).join(splits, ["file", "split"]).withColumn("at", at)
    successor = F.col("at") + F.col("head_size") + F.col("length") + len(BLANK)
    return found.filter("at >= 0").select(
        "file", "split", "at", "size", "head_size", "length", successor.alias("next"), "type", "page_id",
        "refers_to", "told_digest", "payload_bytes", "digest", "mark",
    )


def _follow(at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """For each place the last place of its chain among ``at`` (sorted), by doubling."""
    last = np.searchsorted(at, to)
    last[last == len(at)] = 0
    last = np.where(at[last] == to, last, np.arange(len(at)))
    while True:
        further = last[last]
        if (further == last).all():
            return last
        last = further


def _exits(frame: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a split where its chain leaves the split; -1 where it breaks."""
    frame = frame.sort_values("at")
    at, to = frame["at"].to_numpy(), frame["next"].fillna(-1).to_numpy().astype(np.int64)
    return frame[["file", "split", "at"]].assign(leaves=to[_follow(at, to)])


def _marked(frame: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a split that the chain from its entry passes."""
    frame = frame.sort_values("at")
    at, to = frame["at"].to_numpy(), frame["next"].fillna(-1).to_numpy().astype(np.int64)
    step = np.minimum(np.searchsorted(at, to), len(at) - 1)
    jump = np.where(at[step] == to, step, -1)
    passed = at == frame["entry"].iloc[0]
    while True:
        onward = jump[passed]
        onward = onward[onward >= 0]
        if not len(onward):
            return frame[["file", "at"]][passed]
        passed[onward] = True
        jump = np.where(jump >= 0, jump[jump], -1)


def reached(found: DataFrame, work: str) -> DataFrame:
    """``file``, ``at`` of the candidates on the chain that begins at a file's first byte."""
    spark = found.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    pointers = found.select("file", "split", "at", "next")
    exits = stored(
        pointers.groupBy("file", "split").applyInPandas(_exits, "file string, split bigint, at bigint, leaves bigint"), "exits"
    )
    targets = exits.select("file", F.col("leaves").alias("at")).distinct()
    entries = exits.join(targets, ["file", "at"], "left_semi").unionByName(exits.filter("at = 0"))
    jump = stored(entries.select("file", "at", "leaves").distinct(), "jump-0")
    passed = stored(jump.filter("at = 0").select("file", "at"), "passed-0")
    turn, size = 0, passed.count()
    while True:
        turn += 1
        onward = passed.join(jump, ["file", "at"]).select("file", F.col("leaves").alias("at"))
        onward = onward.join(exits.select("file", "at"), ["file", "at"], "left_semi")
        passed = stored(passed.unionByName(onward).distinct(), f"passed-{turn}")
        grown = passed.count()
        if grown == size:
            break
        size = grown
        further = jump.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("beyond"))
        jump = stored(
            jump.join(further, ["file", "leaves"]).select("file", "at", F.col("beyond").alias("leaves")), f"jump-{turn}"
        )
    entry = passed.join(exits.select("file", "at", "split"), ["file", "at"])
    entered = pointers.join(entry.select("file", "split", F.col("at").alias("entry")), ["file", "split"])
    return stored(entered.groupBy("file", "split").applyInPandas(_marked, "file string, at bigint"), "marked")


def _of_pieces(spark: SparkSession, path: str, found: DataFrame, records: DataFrame, small_rows: int) -> DataFrame:
    """``file``, ``at``, ``payload_bytes``, ``digest`` of records that cuts fall into.

    Their pieces are read again, found by their content, and put together record by record.
    """
    broken = records.filter("at + size <> next")
    files = broken.select("file").distinct()
    owner = records.select("file", "at", F.col("at").alias("owner"))
    last = F.last("owner", ignorenulls=True).over(
        W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    pieces = found.join(files, "file", "left_semi").join(owner, ["file", "at"], "left").withColumn("owner", last)
    wanted = pieces.join(broken.select("file", F.col("at").alias("owner")), ["file", "owner"], "left_semi")
    wanted = wanted.select("file", "mark", F.col("size").alias("size"), "owner", "at")
    texts = _cuts(spark, path).select(
        "file", F.xxhash64("value").alias("mark"), (F.octet_length("value") + len(VERSION)).alias("size"), "value"
    )
    keys = wanted.select("file", "mark", "size").distinct()
    if keys.count() <= small_rows:
        keys = F.broadcast(keys)
    texts = texts.join(keys, ["file", "mark", "size"], "left_semi")
    texts = texts.groupBy("file", "mark", "size").agg(F.first("value").alias("value"))
    whole = wanted.join(texts, ["file", "mark", "size"]).groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("at", "value"))).alias("pieces")
    )
    text = F.array_join(F.transform("pieces", lambda p: p["value"]), VERSION)
    inner = whole.select("file", F.col("owner").alias("at"), text.alias("value")).withColumn(
        "inner", F.substr("value", F.instr("value", BLANK) + len(BLANK))
    )
    block = F.substr("inner", F.lit(1), F.char_length("inner") - len(BLANK))
    payload = inner.withColumn("block", block).withColumn("payload", _after_header(F.col("block")))
    return payload.select(
        "file", "at", F.octet_length("payload").cast("bigint").alias("whole_bytes"),
        sha1_base32(F.col("payload").cast("binary")).alias("whole_digest"),
    )


def read(spark: SparkSession, path: str, small_rows: int = SMALL_ROWS) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` of every record.

    A response's payload is measured and must have the digest its header tells; a revisit has
    the size of the response it refers to.
    """
    work = fresh_dir(spark, "warc")
    found = candidates(spark, path)
    found.write.parquet(f"{work}/found")
    found = spark.read.schema(found.schema).parquet(f"{work}/found")
    records = found.join(reached(found, work), ["file", "at"], "left_semi")
    if not records.filter("at + size <> next").isEmpty():
        whole = _of_pieces(spark, path, found, records, small_rows)
        records = records.join(whole, ["file", "at"], "left").withColumns(
            {
                "payload_bytes": F.coalesce("whole_bytes", "payload_bytes"),
                "digest": F.coalesce("whole_digest", "digest"),
            }
        )
    wrong = F.raise_error(F.concat(F.lit("payload of another digest at "), "file", F.lit(" "), "at")).cast("string")
    digest = F.when(F.col("digest") == F.col("told_digest"), F.col("digest")).otherwise(wrong)
    responses = records.filter("type = 'response'").select(
        "page_id", "payload_bytes", digest.alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"
    )
    sizes = responses.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(
        F.max("payload_bytes").alias("payload_bytes")
    )
    revisits = records.filter("type = 'revisit'").select("page_id", F.col("told_digest").alias("told"), "refers_to")
    same = revisits["refers_to"].eqNullSafe(sizes["refers_to"]) & (revisits["told"] == sizes["payload_digest"])
    revisits = revisits.join(sizes, same, "left").select(
        "page_id", "payload_bytes", F.col("told").alias("payload_digest"), F.lit("revisit").alias("record_type"), revisits["refers_to"]
    )
    return responses.unionByName(revisits)
