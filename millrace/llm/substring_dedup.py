"""Removal of byte strings that occur earlier in the corpus, by suffix arrays of shards.

A string of ``span`` bytes that occurs twice has the same anchor both times: the k-gram with the
smallest hash within it.  The starts that share an anchor form a cell, a short run of starts.

1. Each document is cut into cells where it lies.  Only anchors travel: one row per anchor and
   task, so an anchor that is everywhere stays bounded.  Cells whose anchor occurs once hold
   no repeat and are done.
2. The bytes of the other cells are told apart by a 128-bit hash, and copies are settled within
   the task.  What is left of an anchor meets in a shard; an anchor with very many different
   cells is dealt over several shards.
3. A shard writes its cells one after the other and sorts their suffixes by induced sorting;
   suffixes that share ``span`` bytes with their neighbours form classes.  All members but the
   earliest repeat it.  Anchors that span shards compare their classes' earliest members.
4. The repeats go back to their documents, which drop every byte that one covers.

Defined cases: a null text is empty; texts below ``span`` bytes lose nothing; rows that share
a ``doc_id`` are ordered by their texts' hashes, and a null one comes last; matches never cross
documents; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.rows import arrow_schema, bytes_of, chunks, numbered
from millrace.llm.spans import BASES, mixed
from millrace.llm.suffix_array import long_common_prefixes, suffix_array
from millrace.scratch import fresh_dir

SPAN = 100
K = 32
WINDOW = 1 << 20  # places a window counts in twenty bits
FLUSH_CELLS = 1_000_000
SHARD_BYTES = 8 << 20
HOT_CELLS = 20_000
PARTS_PER_PARTITION = 4
SMALL_ROWS = 100_000

ENTRY = np.dtype([("h", "<u8"), ("doc", "<i8"), ("s", "<u4"), ("n", "<u4"), ("told", "u1")])
ANCHORS = "part int, entries binary, doc bigint, s bigint, n int, h bigint"
FLAGGED = "doc bigint, s bigint, n int, h bigint"
CELLS = "h bigint, dg1 bigint, dg2 bigint, doc bigint, s bigint, n int, bytes binary"
SHARED = "doc bigint, s bigint, n int, g1 bigint, g2 bigint"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)
    return up, np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64), dtype=np.uint64)


UP, DOWN = _powers(BASES[0], WINDOW + 1)


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of the bytes' hashes before each place."""
    value = (x.astype(np.uint64) + np.uint64(1)) * UP[: len(x)]
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive keys: least so far and least to come, by blocks."""
    n = len(keys) - width + 1
    size = -(-len(keys) // width) * width
    blocks = np.full(size, np.uint64(2**64 - 1))
    blocks[: len(keys)] = keys
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


def window_cells(x: np.ndarray, last_start: np.ndarray, span: int, k: int) -> tuple[np.ndarray, ...]:
    """First start, number of starts and anchor hash of each cell of a window of bytes.

    ``last_start``: for each start the last one of its document, so that none crosses its end.
    """
    if len(x) < span:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    sums = _sums(x)
    grams = mixed((sums[k:] - sums[:-k]) * DOWN[: len(x) - k + 1])
    place = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64(20)
    anchor = _least((grams >> low) << low | place, span - k + 1) & np.uint64(WINDOW - 1)
    starts = np.flatnonzero(np.arange(len(anchor)) <= last_start[: len(anchor)])
    if not len(starts):
        return starts, starts, np.empty(0, np.uint64)
    anchor = anchor[starts]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (np.diff(starts) > 1))
    first = np.flatnonzero(new)
    return starts[first], np.diff(np.append(first, len(starts))), grams[anchor[first].astype(np.int64)]


def cells(texts: list[bytes], span: int, k: int) -> tuple[np.ndarray, ...]:
    """Text number, first start, number of starts and anchor hash of every cell of the texts.

    Texts share windows; a longer text is cut into windows that overlap, each start in one.
    """
    found = []
    group: list[int] = []
    held = 0

    def close() -> None:
        nonlocal group, held
        if group:
            sizes = np.array([len(texts[i]) for i in group])
            ends = np.cumsum(sizes)
            x = np.frombuffer(b"".join([texts[i] for i in group]), np.uint8)
            s, n, h = window_cells(x, np.repeat(ends - span, sizes), span, k)
            owner = np.searchsorted(ends, s, "right")
            found.append((np.array(group)[owner], s - (ends - sizes)[owner], n, h))
        group, held = [], 0

    for i, text in enumerate(texts):
        if len(text) < span:
            continue
        if held + len(text) > WINDOW:
            close()
        if len(text) <= WINDOW:
            group.append(i)
            held += len(text)
            continue
        for at in range(0, len(text) - span + 1, WINDOW - span + 1):
            x = np.frombuffer(text[at : at + WINDOW], np.uint8)
            s, n, h = window_cells(x, np.full(len(x), len(x) - span), span, k)
            found.append((np.full(len(s), i), s + at, n, h))
    close()
    if not found:
        return tuple(np.empty(0, kind) for kind in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(column) for column in zip(*found))


def _packed(entries: np.ndarray) -> bytes:
    """Entries column by column, documents as differences, compressed."""
    entries = entries[np.argsort(entries["doc"], kind="stable")]
    columns = [np.diff(entries["doc"], prepend=0), entries["s"], entries["n"], entries["told"], entries["h"]]
    return zstandard.compress(len(entries).to_bytes(8, "little") + b"".join([c.tobytes() for c in columns]), 1)


def _unpacked(data: bytes) -> np.ndarray:
    raw = zstandard.decompress(data)
    out, at = np.empty(int.from_bytes(raw[:8], "little"), ENTRY), 8
    for name in ("doc", "s", "n", "told", "h"):
        kind = ENTRY[name]
        out[name] = np.frombuffer(raw, kind, len(out), at)
        at += len(out) * kind.itemsize
    out["doc"] = np.cumsum(out["doc"])
    return out


def _column(values, kind: pa.DataType, n: int) -> pa.Array:
    return pa.nulls(n, kind) if values is None else pa.array(values, kind)


def _batch(schema: pa.Schema, rows: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_column(columns.get(f.name), f.type, rows) for f in schema], schema=schema)


def _anchor_rows(docs: DataFrame, span: int, k: int, parts: int) -> DataFrame:
    """``ANCHORS``: cells whose anchor repeats in the task, and by part one entry per anchor."""
    schema = arrow_schema(ANCHORS)

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        entries = np.empty(sum(len(part[0]) for part in held), ENTRY)
        for name, column in zip(("doc", "s", "n", "h"), zip(*held)):
            entries[name] = np.concatenate(column)
        entries = entries[np.argsort(entries["h"], kind="stable")]
        new = np.append(True, entries["h"][1:] != entries["h"][:-1])
        first = np.flatnonzero(new)
        again = np.repeat(np.diff(np.append(first, len(entries))) > 1, np.diff(np.append(first, len(entries))))
        entries["told"] = again
        told = entries[again]
        yield _batch(
            schema, len(told), doc=told["doc"], s=told["s"].astype(np.int64), n=told["n"].astype(np.int32), h=told["h"].view(np.int64)
        )
        one = entries[first]
        part = (one["h"] % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        where = np.searchsorted(part[order], np.arange(parts + 1))
        for number in range(parts):
            if where[number] < where[number + 1]:
                own = one[order[where[number] : where[number + 1]]]
                yield _batch(schema, 1, part=[number], entries=[_packed(own)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in chunks(batch):
                text, s, n, h = cells(bytes_of(part.column(1)), span, k)
                if len(s):
                    held.append((part.column(0).to_numpy()[text], s, n, h))
                    size += len(s)
                if size >= FLUSH_CELLS:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return docs.select("doc", "text").mapInArrow(run, ANCHORS)


def _repeated(anchors: DataFrame) -> DataFrame:
    """``FLAGGED``: the cells whose anchor another cell has, wherever it lies."""
    schema = arrow_schema(FLAGGED)

    def run(table: pa.Table) -> pa.Table:
        entries = np.concatenate([_unpacked(data) for data in table.column("entries").to_pylist()])
        entries = entries[np.argsort(entries["h"], kind="stable")]
        first = np.flatnonzero(np.append(True, entries["h"][1:] != entries["h"][:-1]))
        sizes = np.diff(np.append(first, len(entries)))
        out = entries[np.repeat(sizes > 1, sizes) & (entries["told"] == 0)]
        columns = [out["doc"], out["s"].astype(np.int64), out["n"].astype(np.int32), out["h"].view(np.int64)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    blobs = anchors.filter("part IS NOT NULL").select("part", "entries")
    near = anchors.filter("part IS NULL").select("doc", "s", "n", "h")
    return near.unionByName(blobs.groupBy("part").applyInArrow(run, FLAGGED))


def _compressed(docs: DataFrame) -> DataFrame:
    """``doc``, ``doc_id``, ``text`` as a compressed value, for the joins that move texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in chunks(batch):
                texts = [packer.compress(text) for text in bytes_of(part.column(2))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.binary())], ["doc", "doc_id", "text"]
                )

    return docs.select("doc", "doc_id", "text").mapInArrow(run, "doc bigint, doc_id bigint, text binary")


def _opened(column: pa.Array) -> list[bytes]:
    unpacker = zstandard.ZstdDecompressor()
    return [unpacker.decompress(text, max_output_size=1 << 31) if text else b"" for text in column.to_pylist()]


def _cut(docs: DataFrame, flagged: DataFrame, span: int) -> DataFrame:
    """``CELLS`` of the flagged cells: the first of equal ones in a task with its bytes, and of the
    others, which repeat it, only where they are."""
    schema = arrow_schema(CELLS)
    lists = flagged.groupBy("doc").agg(F.collect_list(F.struct("s", "n", "h")).alias("cells"))
    wanted = docs.join(lists, "doc").select("doc", "text", "cells")

    def flush(held: list[dict]) -> Iterator[pa.RecordBatch]:
        rows = {name: np.concatenate([part[name] for part in held]) for name in ("doc", "s", "n", "h", "dg1", "dg2")}
        data = [value for part in held for value in part["bytes"]]
        order = np.lexsort((rows["s"], rows["doc"], rows["dg2"], rows["dg1"]))
        rows = {name: values[order] for name, values in rows.items()}
        new = np.append(
            True, (rows["dg1"][1:] != rows["dg1"][:-1]) | (rows["dg2"][1:] != rows["dg2"][:-1])
        )
        # In the order of the texts, neighbours overlap and compress well.
        kept = np.flatnonzero(new)
        kept = kept[np.lexsort((rows["s"][kept], rows["doc"][kept]))]
        for at in range(0, len(kept), 8192):
            some = kept[at : at + 8192]
            own = [data[i] for i in order[some].tolist()]
            yield _batch(schema, len(own), **{name: values[some] for name, values in rows.items()}, bytes=own)
        again = {name: rows[name][~new] for name in ("doc", "s", "n")}
        yield _batch(schema, len(again["s"]), **again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in chunks(batch, 1 << 20):
                texts = _opened(part.column(1))
                lists_of = part.column(2)
                counts = np.diff(lists_of.offsets.to_numpy())
                flat = lists_of.flatten()
                s, n, h = (flat.field(name).to_numpy(zero_copy_only=False) for name in ("s", "n", "h"))
                doc = np.repeat(part.column(0).to_numpy(), counts)
                data, dg, at = [], [], 0
                for text, count in zip(texts, counts.tolist()):
                    for a, m in zip(s[at : at + count].tolist(), n[at : at + count].tolist()):
                        data.append(text[a : a + m + span - 1])
                    at += count
                dg = np.frombuffer(b"".join([_digest(value) for value in data]), np.int64).reshape(-1, 2)
                held.append({"doc": doc, "s": s, "n": n, "h": h, "dg1": dg[:, 0], "dg2": dg[:, 1], "bytes": data})
                size += len(data)
                if size >= FLUSH_CELLS // 8:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return wanted.mapInArrow(run, CELLS)


def _digest(value: bytes) -> bytes:
    return sha256(value).digest()[:16]


def shard_repeats(frame: dict[str, np.ndarray], data: list[bytes], span: int, hot: np.ndarray) -> tuple[dict, dict]:
    """Repeats within a shard, and of hot anchors the earliest members of all classes.

    ``frame``: ``h``, ``dg1``, ``dg2``, ``doc``, ``s``, ``n`` of the shard's cells.
    """
    order = np.lexsort((frame["s"], frame["doc"], frame["dg2"], frame["dg1"]))
    f = {name: values[order] for name, values in frame.items()}
    hot = hot[order]
    new = np.append(True, (f["dg1"][1:] != f["dg1"][:-1]) | (f["dg2"][1:] != f["dg2"][:-1]))
    again = {name: f[name][~new] for name in ("doc", "s", "n")}
    keep = np.flatnonzero(new)
    # Cells that stand alone under their anchor repeat nothing.
    _, group, size = np.unique(f["h"][keep], return_inverse=True, return_counts=True)
    keep = keep[(size[group] > 1) | hot[keep]]
    nothing = {name: np.empty(0, np.int64) for name in ("doc", "s", "n", "g1", "g2")}
    if not len(keep):
        return again, nothing
    texts = [data[i] for i in order[keep].tolist()]
    x = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)
    sizes = np.array([len(t) for t in texts]) + 1
    begin = np.cumsum(sizes) - sizes
    sa = suffix_array(x, span)
    same = long_common_prefixes(x, sa, span)
    member = np.cumsum(~same[sa])  # the class of each suffix, in order
    n = f["n"][keep].astype(np.int64)
    owner = np.repeat(np.arange(len(keep)), n)
    place = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    start = place - begin[owner] + f["s"][keep][owner]
    doc = f["doc"][keep][owner]
    kind = np.empty(len(x), np.int64)
    kind[sa] = member
    kind = kind[place]
    order = np.lexsort((start, doc, kind))
    first = np.append(True, kind[order][1:] != kind[order][:-1])
    late = np.zeros(len(order), bool)
    late[order[~first]] = True
    # Late starts of a cell that follow each other are one run.
    at = np.flatnonzero(late)
    edge = np.append(True, (np.diff(at) > 1) | (owner[at][1:] != owner[at][:-1])) if len(at) else np.empty(0, bool)
    runs = at[edge]
    length = np.diff(np.append(np.flatnonzero(edge), len(at)))
    again = {
        "doc": np.concatenate((again["doc"], doc[runs])),
        "s": np.concatenate((again["s"], start[runs])),
        "n": np.concatenate((again["n"], length)),
    }
    told = order[first]
    told = told[hot[keep][owner[told]]]
    if not len(told):
        return again, nothing
    raw = x.tobytes()
    dg = np.frombuffer(b"".join([_digest(raw[a : a + span]) for a in place[told].tolist()]), np.int64).reshape(-1, 2)
    return again, {"doc": doc[told], "s": start[told], "n": np.ones(len(told), np.int64), "g1": dg[:, 0], "g2": dg[:, 1]}


def _shards(cut: DataFrame, span: int, shard_bytes: int, hot_cells: int, small_rows: int) -> DataFrame:
    """``SHARED``: repeats that shards find, and with a digest the classes of hot anchors."""
    schema = arrow_schema(SHARED)
    spark = cut.sparkSession
    counted = cut.groupBy("h").agg(F.count("*").alias("c"))
    place = fresh_dir(spark, "hot-anchors")
    counted.filter(F.col("c") > hot_cells).select("h", F.ceil(F.col("c") / hot_cells).alias("deals")).write.parquet(place)
    hot = spark.read.schema("h bigint, deals bigint").parquet(place)
    few = hot.count() <= small_rows
    size = cut.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    # No more shards than bytes ask for, no fewer than partitions.
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    dealt = cut.join(F.broadcast(hot) if few else hot, "h", "left").withColumn(
        "shard",
        F.pmod(F.xxhash64("h", F.pmod("dg1", F.coalesce("deals", F.lit(1)))), F.lit(shards)),
    )

    def run(table: pa.Table) -> pa.Table:
        frame = {name: table.column(name).to_numpy() for name in ("h", "dg1", "dg2", "doc", "s", "n")}
        hot_rows = np.asarray(table.column("deals").is_valid())
        data = table.column("bytes").to_pylist()
        again, told = shard_repeats(frame, data, span, hot_rows)
        parts = [
            _batch(schema, len(again["s"]), **again),
            _batch(schema, len(told["s"]), **told),
        ]
        return pa.Table.from_batches(parts, schema)

    return dealt.groupBy("shard").applyInArrow(run, SHARED)


def _result(docs: DataFrame, repeats: DataFrame, span: int) -> DataFrame:
    """``RESULT`` for every document, from its repeats (``doc``, ``s``, ``n``)."""
    schema = arrow_schema(RESULT)
    lists = repeats.groupBy("doc").agg(F.collect_list(F.struct("s", "n")).alias("runs"))
    joined = docs.join(lists, "doc", "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1 << 20):
                out = []
                runs_of = part.column(2).to_pylist()
                for doc_id, text, runs in zip(part.column(0).to_pylist(), _opened(part.column(1)), runs_of):
                    kept, spans = removed(text, [(r["s"], r["s"] + r["n"] + span - 1) for r in runs or ()])
                    out.append((doc_id, len(text), len(text) - len(kept), spans, sha256(kept).hexdigest()))
                columns = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return joined.mapInArrow(run, RESULT)


def removed(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without the bytes of the spans, and how many runs they form."""
    kept, at, runs, end = [], 0, 0, -1
    for a, b in sorted(spans):
        if a > end:
            runs += 1
            kept.append(text[at:a])
        end = max(end, b)
        at = end
    kept.append(text[at:] if runs else text)
    return b"".join(kept), runs


def deduplicate(
    docs: DataFrame,
    span: int = SPAN,
    k: int = K,
    shard_bytes: int = SHARD_BYTES,
    hot_cells: int = HOT_CELLS,
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """``RESULT`` for every row of ``docs`` (``doc_id``, ``text``)."""
    spark: SparkSession = docs.sparkSession
    work = fresh_dir(spark, "substring-dedup")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    docs, _ = numbered(docs.select("doc_id", "text"), work)
    docs = docs.select("doc", F.col("row.doc_id").cast("bigint").alias("doc_id"), F.col("row.text").alias("text"))
    parts = PARTS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    anchors = stored(_anchor_rows(docs, span, k, parts), "anchors")
    flagged = _repeated(anchors)
    packed = _compressed(docs)
    cut = stored(_cut(packed, flagged, span), "cells")
    settled = cut.filter("bytes IS NULL").select("doc", "s", "n")
    shared = stored(_shards(cut.filter("bytes IS NOT NULL"), span, shard_bytes, hot_cells, small_rows), "shared")
    found = shared.filter("g1 IS NULL").select("doc", "s", "n")
    classes = shared.filter("g1 IS NOT NULL")
    earliest = classes.groupBy("g1", "g2").agg(F.min(F.struct("doc", "s")).alias("first"))
    later = classes.join(earliest, ["g1", "g2"]).filter(F.struct("doc", "s") != F.col("first")).select("doc", "s", "n")
    return _result(packed, settled.unionByName(found).unionByName(later), span)
