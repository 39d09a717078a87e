"""Best-fit packing of token sequences, certified by lower bounds.

Documents become pieces of at most ``capacity`` ids; only longer ones are cut, and the first
piece takes the remainder.  Full pieces are sequences of their own.  The others are dealt to
groups of a bounded number of pieces; each group is packed best-fit decreasing, and dual
feasible functions give a number of sequences below which no packing of the group can go.  A
group that meets its bound is done.  Those with a gap exchange the pieces of all sequences
that are not full, in new and mixed groups, and are packed again, as long as that helps.

Defined cases: a null or empty text has the end id alone and is packed; repeated rows are
packed each; equal lengths are taken in the order of a hash; an empty table has no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.rows import bytes_of, chunks
from millrace.llm.tokens import encoder
from millrace.scratch import fresh_dir

GROUP_PIECES = 100_000
ROUNDS = 4

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = f"{PIECES}, sequence_id bigint, offset bigint"


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """``PIECES`` of every document: its ids and the end id, cut where they exceed ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                rows = []
                ids_of = encoder(vocabulary).encode(bytes_of(part.column(1)))
                for doc_id, ids in zip(part.column(0).to_pylist(), ids_of):
                    ids = np.append(ids, end_id).astype("<u4")
                    first = len(ids) % capacity or capacity
                    starts = [0, *range(first, len(ids), capacity)]
                    for number, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                        rows.append((doc_id, number, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                frame["piece"] = frame["piece"].astype("int32")
                yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, longest first, each into the fullest bin that takes it.

    Bins wait in one stack per free room.  An integer with a bit per non-empty stack tells the
    smallest room that is large enough, so a length costs a few operations.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, made = 0, 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        above = mask >> length
        if above:
            room = length + (above & -above).bit_length() - 1
            number = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room, number, made = capacity, made, made + 1
        bins[i], offsets[i] = number, capacity - room
        rest = room - length
        if rest:
            rooms[rest].append(number)
            mask |= 1 << rest
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound that three families of dual feasible functions give.

    A function is dual feasible if it takes every set of numbers that sums to at most one to
    numbers that do so too; the sum of the images is then a bound on the bins.  Lengths are
    counted first, so the work does not grow with their number.
    """
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    for e in range(1, capacity // 2 + 1):
        kept = np.where(x > capacity - e, capacity, np.where(x >= e, x, 0))
        best = max(best, -(-int((count * kept).sum()) // capacity))
        middle = capacity // e
        large = np.where(2 * x > capacity, 2 * (middle - (capacity - x) // e), 2 * (x // e))
        large = np.where(2 * x == capacity, middle, large)
        best = max(best, -(-int((count * large).sum()) // (2 * middle)))
    for k in range(1, 100):
        scaled = (k + 1) * x
        image = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * image).sum()) // (capacity * k)))
    return best


def _pack_group(capacity: int, group: str):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "_order"], ascending=[False, True], kind="stable")
        lengths = frame["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        used, bound = int(bins.max()) + 1, lower_bound(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        return frame.assign(
            sequence_id=(frame[group].to_numpy() << 32) + bins,
            offset=offsets,
            _open=(used > bound) & (fill[bins] < capacity),
            _gap=used - bound,
        )

    return run


def pack(found: DataFrame, capacity: int, rounds: int = ROUNDS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``PACKED``: each of ``PIECES`` with its sequence and its place there, gapless from 0."""
    spark, work = found.sparkSession, fresh_dir(found.sparkSession, "packing")
    found.write.parquet(f"{work}/pieces")
    found = spark.read.schema(PIECES).parquet(f"{work}/pieces")
    own = F.xxhash64("doc_id", "piece", "ids_crc32")
    numbered = F.monotonically_increasing_id()
    whole = found.filter(F.col("length") == capacity)
    done = [whole.select("*", (-1 - numbered).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))]
    waiting = found.filter(F.col("length") < capacity).withColumn("_order", own)
    schema = f"{PIECES}, _order bigint, _group bigint, sequence_id bigint, offset bigint, _open boolean, _gap bigint"
    names = [c.split()[0] for c in PIECES.split(", ")]
    base, earlier, used = 0, None, 0
    for turn in range(rounds):
        groups = max(1, -(-waiting.count() // group_pieces))
        dealt = F.floor(F.rand(turn) * groups) + F.lit(base)
        path = f"{work}/round-{turn}"
        waiting.withColumn("_group", dealt.cast("bigint")).groupBy("_group").applyInPandas(
            _pack_group(capacity, "_group"), schema
        ).write.parquet(path)
        packed = spark.read.schema(schema).parquet(path)
        made, left = packed.agg(
            F.countDistinct("sequence_id"), F.countDistinct(F.when(F.col("_open"), F.col("sequence_id")))
        ).first()
        if earlier is not None and made >= used:  # the exchange saved nothing
            done.append(earlier)
            break
        done.append(packed.filter("NOT _open"))
        earlier, used, base = packed.filter("_open"), left, base + groups
        if left < 2 or turn + 1 == rounds:
            done.append(earlier)
            break
        waiting = earlier.select(*names, "_order")
    columns = [c.split()[0] for c in PACKED.split(", ")]
    result = done[0].select(columns)
    for part in done[1:]:
        result = result.unionByName(part.select(columns))
    return result


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """Every piece of ``docs`` (``doc_id``, ``text``) with its place in a sequence."""
    return pack(pieces(docs, vocabulary, capacity, end_id), capacity)
