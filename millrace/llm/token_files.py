"""Token ids of documents in block files, each document compressed by itself.

A folder holds three Parquet tables.  ``blocks`` has one row per block of consecutive
documents: the frames of its documents one after the other (``data``), and beside them, in
columns that can be read alone, the offset index: ``doc_ids``, ``n_tokens`` and ``ends``
(where each frame ends in ``data``), with ``dict_hash``, ``shard``, ``block`` and ``first`` (ids
of the shard before the block).  ``dictionary`` has the zstandard dictionary that all frames
share, with its hash and the bytes per id.  ``shards`` has the ids each shard holds and those
before it.  Spark's committer writes all of it, so a lost task leaves nothing half written.

Defined cases: a null text is an empty one and has the end id alone; a null ``doc_id`` sorts
before all others; rows that repeat a ``doc_id`` stay, in the order of their texts' hashes; an
empty table gives empty files; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.rows import arrow_schema, bytes_of, chunks
from millrace.llm.tokens import encoder

BLOCK_DOCS = 512
DICT_BYTES = 64 << 10
DICT_DOCS = 512
DICT_TEXT_BYTES = 64 << 10
LEVEL = 3

BLOCKS = (
    "shard int, block int, first bigint, dict_hash string, doc_ids array<bigint>, "
    "n_tokens array<bigint>, ends array<bigint>, data binary"
)
READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def _frames(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(np.uint16 if width == 2 else np.uint32).tobytes()


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int, width: int) -> bytes:
    """A dictionary from a sample of about ``DICT_DOCS`` documents, chosen by hash.

    It changes sizes only, never what is read back.  The sample takes whole documents of at
    most ``DICT_TEXT_BYTES`` and stops at four times their number, which bounds what the driver
    holds when rows repeat.
    """
    small = docs.filter(F.octet_length("text").between(1, DICT_TEXT_BYTES))
    steps = 1 << 30
    share = int(steps * min(1, DICT_DOCS / max(1, small.count())))
    sample = small.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(steps)) < share)
    rows = sample.select("text").limit(4 * DICT_DOCS).collect()
    texts = [row["text"].encode() for row in rows]
    samples = [_frames(np.append(ids, end_id), width) for ids in encoder(vocabulary).encode(texts)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: they are the dictionary
        return b"".join(samples)[:DICT_BYTES]


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Write ``docs`` (``doc_id``, ``text``) to ``path`` in ascending order of ``doc_id``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(vocabulary).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    dictionary = train_dictionary(docs, vocabulary, end_id, width)
    digest = sha256(dictionary).hexdigest()
    spark.createDataFrame(
        [(digest, width, bytearray(dictionary))], "dict_hash string, width int, dictionary binary"
    ).coalesce(1).write.parquet(f"{path}/dictionary")

    kind = arrow_schema(BLOCKS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, first = TaskContext.get().partitionId(), 0, 0
        packer = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)
        )
        for batch in batches:
            for part in chunks(batch):
                for at in range(0, part.num_rows, BLOCK_DOCS):
                    docs_of = part.slice(at, BLOCK_DOCS)
                    ids = encoder(vocabulary).encode(bytes_of(docs_of.column(1)))
                    frames = [packer.compress(_frames(np.append(x, end_id), width)) for x in ids]
                    n = [len(x) + 1 for x in ids]
                    yield pa.RecordBatch.from_pylist(
                        [
                            {
                                "shard": shard,
                                "block": block,
                                "first": first,
                                "dict_hash": digest,
                                "doc_ids": docs_of.column(0).to_pylist(),
                                "n_tokens": n,
                                "ends": np.cumsum([len(x) for x in frames]).tolist(),
                                "data": b"".join(frames),
                            }
                        ],
                        schema=kind,
                    )
                    block, first = block + 1, first + sum(n)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions(
        "doc_id", F.xxhash64("text")
    )
    ordered.mapInArrow(encode, BLOCKS).write.parquet(f"{path}/blocks")
    _write_shards(spark, path)


def _write_shards(spark: SparkSession, path: str) -> None:
    """Ids of each shard and before it; the driver sees one row a shard."""
    per_block = F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, b: a + b)
    totals = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("shard", per_block.alias("n"))
    rows, before = [], 0
    for row in totals.groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect():
        rows.append((row["shard"], row["n"], before))
        before += row["n"]
    spark.createDataFrame(rows, "shard int, n bigint, before bigint").coalesce(1).write.parquet(
        f"{path}/shards"
    )


def _opened(spark: SparkSession, path: str) -> tuple[dict, dict]:
    """The dictionary's row and the ids before each shard; both are small by construction."""
    book = spark.read.parquet(f"{path}/dictionary").first().asDict()
    if sha256(bytes(book["dictionary"])).hexdigest() != book["dict_hash"]:
        raise ValueError(f"the dictionary in {path} is not the one that was written")
    rows = spark.read.schema("shard int, before bigint").parquet(f"{path}/shards").collect()
    return book, {row["shard"]: row["before"] for row in rows}


def _unpacker(book: dict):
    return zstandard.ZstdDecompressor(
        dict_data=zstandard.ZstdCompressionDict(bytes(book["dictionary"]))
    )


def _documents(row: dict, book: dict, unpacker) -> Iterator[tuple[int, int, np.ndarray]]:
    """``doc_id``, ids before it in its shard, and its ids, for each document of a block."""
    if row["dict_hash"] != book["dict_hash"]:
        raise ValueError(f"shard {row['shard']} was written with another dictionary")
    begin, before, kind = 0, row["first"], np.uint16 if book["width"] == 2 else np.uint32
    for doc_id, n, end in zip(row["doc_ids"], row["n_tokens"], row["ends"]):
        ids = np.frombuffer(unpacker.decompress(row["data"][begin:end]), kind).astype(np.uint32)
        if len(ids) != n:
            raise ValueError(f"document {doc_id} has {len(ids)} ids, its index says {n}")
        yield doc_id, before, ids
        begin, before = end, before + n


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files at ``path``: ``READ``, computed from the ids read back."""
    book, before = _opened(spark, path)
    kind = arrow_schema(READ)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = _unpacker(book)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "doc_id": doc_id,
                            "start": before[row["shard"]] + start,
                            "n_tokens": len(ids),
                            "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()),
                        }
                        for doc_id, start, ids in _documents(row, book, unpacker)
                    ],
                    schema=kind,
                )

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(decode, READ)


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """The ids of a few documents: the index finds their blocks, and only their frames are read."""
    book, _ = _opened(spark, path)
    wanted = F.array(*[F.lit(i).cast("bigint") for i in doc_ids])
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    hit = blocks.filter(F.arrays_overlap("doc_ids", wanted))
    frame = hit.select("*", F.posexplode("doc_ids").alias("i", "doc_id")).filter(
        F.array_contains(wanted, F.col("doc_id"))
    )
    begin = F.when(F.col("i") == 0, F.lit(0)).otherwise(F.get("ends", F.col("i") - 1))
    size = F.get("ends", F.col("i")) - begin
    cut = frame.select("doc_id", F.substring("data", (begin + 1).cast("int"), size.cast("int")).alias("f"))
    unpacker, kind = _unpacker(book), np.uint16 if book["width"] == 2 else np.uint32
    return {
        row["doc_id"]: np.frombuffer(unpacker.decompress(bytes(row["f"])), kind).astype(np.uint32)
        for row in cut.collect()
    }
