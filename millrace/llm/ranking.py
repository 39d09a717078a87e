"""Places of rows in a stated order, over any number of rows and without a task that sees all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_BITS = 33  # how monotonically_increasing_id packs a partition and a row


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written at ``path`` and read with its own schema, so an empty one can be read too."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(rows: DataFrame, order: Sequence[Column], path: str, group: str | None = None) -> DataFrame:
    """``rows`` with ``place`` (from 0) in their ``group`` and ``total``, the rows of that group.

    The rows are written in ranges of (group, order), so a group may hold most rows: it only
    spans more ranges.  Counts of a range and group are joined back, at most one row for each range
    and one for each group more.  Rows that agree in ``order`` are told apart by ``_row``, which
    the caller stored with them.
    """
    keys = [group] if group else []
    by = [F.col(k).asc() for k in keys] + [*order, F.col("_row").asc()]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), path)
    ranged = ranged.withColumn("_part", F.shiftrightunsigned("_at", PART_BITS))
    sizes = ranged.groupBy("_part", *keys).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    inside = Window.partitionBy(*keys)
    earlier = inside.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part",
        *keys,
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(inside).alias("total"),
    )
    joined = ranged.join(offsets, ["_part", *keys])
    return joined.withColumn("place", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift", "_row")
