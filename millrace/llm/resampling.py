"""Importance resampling towards a target distribution of hashed word n-grams.

Features are all runs of one to three words; a feature's bucket is the CRC-32 of its bytes modulo
10,000.  The features of a batch are made distinct by the numbers of their words, grouped by equal
length into matrices of bytes, one row a byte position, and the CRCs of a matrix advance together,
position by position; buckets are then scattered back to all places of their features.

A first pass counts buckets over all documents and all target texts, the second sums the gains of
each document.  What travels is at most 10,000 counts a task and five numbers a document.  The
gains (10,000 integers) are what tasks are sent, whatever the size of the data.  Draws are ranked
in ranges of (score, id), so no task sees all documents.

Defined cases: a null or empty text has no words, no features and weight 0; a document of fewer than
20 words is scored and never drawn; a null ``doc_id`` hashes as empty and comes after equal scores
with ids; repeated ids share their random part and are told apart by the hashes of their texts;
an empty target leaves gains to the documents' counts alone; an empty table gives no rows; other
columns play no part.  Very long texts are worked on in slices of ``SLICE`` words, whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.ranking import ranked, stored
from millrace.llm.rows import add_struct, bytes_of, chunks
from millrace.llm.spans import Words, fold_table
from millrace.scratch import fresh_dir

BUCKETS = 10_000
GRAMS = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
SLICE = 1 << 20
LONG_FEATURE = 1 << 10  # longer ones are too few a length to be worth a matrix
MATRIX_BYTES = 8 << 20

WORD_TABLE = fold_table(lambda b: b >= 128 or chr(b).isalnum())
SPACE = 32


def _crc_table() -> np.ndarray:
    """What eight shifts of the reflected CRC-32 polynomial make of every byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


TABLE = _crc_table()


def span_crcs(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes, by matrices of spans of one length."""
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(sizes, kind="stable")
    lengths, first = np.unique(sizes[order], return_index=True)
    for length, low, high in zip(lengths.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
        if length > LONG_FEATURE:
            for i in order[low:high].tolist():
                out[i] = zlib.crc32(buf[starts[i] : starts[i] + length])
            continue
        rows = max(1, MATRIX_BYTES // length)
        for at in range(low, high, rows):
            chosen = order[at : min(at + rows, high)]
            matrix = buf[starts[chosen] + np.arange(length)[:, None]]
            crcs = np.full(len(chosen), 0xFFFFFFFF, np.uint32)
            for column in matrix:
                crcs = TABLE[(crcs ^ column) & 0xFF] ^ (crcs >> np.uint32(8))
            out[chosen] = ~crcs
    return out


def _same(buf: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> bool:
    """Whether the spans at ``a`` hold the bytes of those at ``b``, of the same sizes."""
    firsts = np.cumsum(sizes) - sizes
    inside = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
    return bool((buf[np.repeat(a, sizes) + inside] == buf[np.repeat(b, sizes) + inside]).all())


def word_numbers(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal bytes only: hashes decide and bytes confirm."""
    _, first, numbers = np.unique(hashes, return_index=True, return_inverse=True)
    like = first[numbers]
    if (sizes == sizes[like]).all() and _same(buf, starts, starts[like], sizes):
        return numbers
    known: dict[bytes, int] = {}
    spans = zip(starts.tolist(), sizes.tolist())
    return np.array([known.setdefault(buf[s : s + n].tobytes(), len(known)) for s, n in spans], np.int64)


def buckets(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each slice and each number of words: first words of features, and the features' buckets."""
    ends = words.ends_of_texts
    for low in range(0, len(words.starts), SLICE):
        high = min(low + SLICE, len(words.starts))
        span = slice(low, min(high + GRAMS - 1, len(words.starts)))
        sizes = words.ends[span] - words.starts[span]
        at = np.cumsum(sizes + 1) - sizes - 1
        inside = np.arange(int(sizes.sum()) + len(sizes)) - np.repeat(at, sizes + 1)
        buf = words.bytes[np.minimum(np.repeat(words.starts[span], sizes + 1) + inside, len(words.bytes) - 1)]
        buf[at + sizes] = SPACE
        numbers = word_numbers(buf, at, sizes, words.hashes[span]).astype(np.int64)
        count = int(numbers.max()) + 1
        places = np.arange(low, high)
        keys = numbers[: high - low]
        for n in range(1, GRAMS + 1):
            if n > 1:
                inside_text = places + n <= ends[places]
                places, keys = places[inside_text], keys[inside_text]
                keys = keys * count + numbers[places - low + n - 1]
            if not len(places):
                break
            # Renumbered, so that the keys of the next length stay below 2**63.
            _, first, keys = np.unique(keys, return_index=True, return_inverse=True)
            sample = places[first] - low
            crcs = span_crcs(buf, at[sample], at[sample + n - 1] + sizes[sample + n - 1] - at[sample])
            yield places, (crcs % np.uint32(BUCKETS)).astype(np.int64)[keys]


def bucket_counts(texts: DataFrame) -> DataFrame:
    """``bucket`` and ``n`` of the features of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in chunks(batch):
                for _, found in buckets(Words(bytes_of(part.column(0)), WORD_TABLE)):
                    total += np.bincount(found, minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    counted = texts.select("text").mapInArrow(run, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of every bucket: 1,000 times the log of the target's share over the documents', floored."""
    own, wanted = np.zeros(BUCKETS, object), np.zeros(BUCKETS, object)
    for counts, table in ((own, docs), (wanted, target)):
        for bucket, n in bucket_counts(table).collect():  # at most BUCKETS rows
            counts[bucket] = n
    own_total, wanted_total = float(own.sum() + BUCKETS), float(wanted.sum() + BUCKETS)
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * own_total / ((s + 1.0) * wanted_total))) for s, t in zip(own, wanted)],
        np.int64,
    )


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``row`` (the columns of ``docs``) and ``out``: ``n_words``, ``n_features``, ``weight``."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def work(rows: pa.RecordBatch) -> list[dict]:
        words = Words(bytes_of(rows.column("text")), WORD_TABLE)
        sums = np.zeros(len(words.starts) + 1, np.int64)
        for places, found in buckets(words):
            sums[places + 1] += shared.value[found]  # a place has one feature of a length
        sums = np.cumsum(sums)
        weights = sums[words.first + words.counts] - sums[words.first]
        features = sum(np.maximum(words.counts - n, 0) for n in range(GRAMS))
        triples = zip(words.counts.tolist(), features.tolist(), weights.tolist())
        return [{"n_words": a, "n_features": b, "weight": c} for a, b, c in triples]

    return add_struct(docs, work, T.StructType.fromDDL("n_words bigint, n_features bigint, weight bigint"))


def _random_part(doc_id: Column, seed: int) -> Column:
    """A Gumbel variate, in thousandths, that follows from seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    uniform = (h + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(uniform))).cast("bigint")


def draw(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` of
    every document; ``rank`` is null for those that are not drawn."""
    work = fresh_dir(docs.sparkSession, "resampling")
    found = weighed(docs.select("doc_id", "text"), gains(docs, target))
    scored = found.select(
        "row.doc_id",
        F.xxhash64("row.text").alias("text_hash"),
        "out.*",
        (F.col("out.weight") + _random_part(F.col("row.doc_id"), seed)).alias("score"),
        F.monotonically_increasing_id().alias("_row"),
    )
    scored = stored(scored, f"{work}/scored")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("text_hash").asc()]
    eligible = ranked(scored.filter(F.col("n_words") >= least_words), order, f"{work}/ordered")
    drawn = F.col("place") < F.floor(F.lit(percent) * F.col("total") / 100)
    eligible = eligible.withColumn("rank", F.when(drawn, F.col("place") + 1)).drop("place", "total")
    others = scored.filter(F.col("n_words") < least_words).drop("_row")
    return eligible.unionByName(others.withColumn("rank", F.lit(None).cast("bigint")))


def drawn_rows(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents, all columns as they were; copies of a drawn row with its id stay together."""
    chosen = draw(docs, target, **options).filter("rank IS NOT NULL").select("doc_id", "text_hash").distinct()
    same = docs["doc_id"].eqNullSafe(chosen["doc_id"]) & (F.xxhash64(docs["text"]) == chosen["text_hash"])
    return docs.join(chosen, same, "left_semi")


def report(drawn: DataFrame) -> DataFrame:
    """The digest columns of ``draw``."""
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
