"""Running a function of Arrow batches over rows without touching their other columns.

The row travels as one struct, so its columns cannot clash with what is added, whatever
their names.  Batches are cut by bytes before a function sees them, so memory follows the
longest text and not the number of rows Spark puts into a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

CHUNK_BYTES = 4 << 20


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string; for the driver, since workers cannot parse DDL."""
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def texts_of(column: pa.Array) -> list[str]:
    """Texts as Python strings, null as empty."""
    return ["" if text is None else text for text in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if text is None else text for text in column.cast(kind).to_pylist()]


def chunks(batch: pa.RecordBatch, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of about ``limit`` bytes; a longer row is a slice of its own."""
    rows = max(1, int(batch.num_rows * limit / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        if part.num_rows > 1 and part.nbytes > 2 * limit:
            yield from chunks(part, limit)
        else:
            yield part


def add_struct(
    rows: DataFrame, work: Callable[[pa.RecordBatch], list[dict]], added: T.StructType
) -> DataFrame:
    """``row`` (all columns of ``rows``) and ``out``: what ``work`` gives for each row."""
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    schema = T.StructType([packed.schema["row"], T.StructField("out", added)])
    arrow = to_arrow_type(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                inner = pa.RecordBatch.from_struct_array(part.column(0))
                out = pa.array(work(inner), type=arrow)
                yield pa.RecordBatch.from_arrays([part.column(0), out], ["row", "out"])

    return packed.mapInArrow(run, schema)


def map_parts(
    rows: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: T.StructType
) -> DataFrame:
    """What ``work`` gives for each slice of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield from work(part)

    return rows.mapInArrow(run, schema)


def numbered(docs: DataFrame, work: str) -> tuple[DataFrame, bool]:
    """``doc`` (a number per row, in the order of ``doc_id``, null last) and ``row`` (all columns).

    Where every row has an id of its own, that is its number, and the second value is true;
    else rows are numbered in a written table, those of one id by their texts' hashes.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    odd = docs.groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.count("*").alias("c"))
    if odd.filter("c > 1 OR id IS NULL").isEmpty():
        return packed.select(F.col("row.doc_id").cast("bigint").alias("doc"), "row"), True
    order = [F.col("row.doc_id").cast("bigint").asc_nulls_last(), F.xxhash64("row.text")]
    ranged = packed.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select(F.monotonically_increasing_id().alias("doc"), "row").write.parquet(f"{work}/numbered")
    return docs.sparkSession.read.parquet(f"{work}/numbered"), False
