"""Rows that may be among wanted ones, told by bitmaps of a fixed size.

Wide rows are tested where they lie: at most ``BITMAPS`` rows of 4,096 bytes are broadcast, whatever the
number of wanted rows.  Two to the 23rd bits stand for the wanted values' hashes, so of other rows
about one in 8.4 million passes for each value wanted; a caller that must be exact joins what passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 15  # of one row of Spark's bitmap aggregate
BITMAPS = 1 << 8


def _slot(columns: tuple[str, ...]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BITS * BITMAPS))


def _bucket(slot: Column) -> Column:
    return F.floor(slot / BITS).cast("bigint")


def bitmaps_of(wanted: DataFrame, *columns: str) -> DataFrame:
    """``_probe_bucket`` and ``_probe_bits`` of the values that ``columns`` have in ``wanted``."""
    slot = F.col("_probe_slot")
    slots = wanted.select(_slot(columns).alias("_probe_slot"))
    return slots.groupBy(_bucket(slot).alias("_probe_bucket")).agg(F.bitmap_construct_agg(slot % BITS).alias("_probe_bits"))


def probed(rows: DataFrame, bitmaps: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with ``_may``: whether their values may be among those of ``bitmaps``."""
    slot = F.col("_probe_slot")
    bit = slot % BITS
    octet = F.substring("_probe_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))
    octet = F.conv(F.hex(octet), 16, 10).cast("int")
    told = rows.select("*", _slot(columns).alias("_probe_slot")).select("*", _bucket(slot).alias("_probe_bucket"))
    told = told.join(F.broadcast(bitmaps), "_probe_bucket", "left")
    may = F.coalesce(F.getbit(octet, (bit % 8).cast("int")) == 1, F.lit(False)).alias("_may")
    return told.select(*[F.col(f"`{name}`") for name in rows.columns], may)


def possible(rows: DataFrame, bitmaps: DataFrame, *columns: str) -> DataFrame:
    """The rows whose values may be among those of ``bitmaps``."""
    return probed(rows, bitmaps, *columns).filter("_may").drop("_may")


def without(rows: DataFrame, dropped: DataFrame, *columns: str) -> DataFrame:
    """``rows`` whose values are not among those of ``dropped`` (stored): rows that surely are not stay where
    they lie, and only the others are joined."""
    told = probed(rows, bitmaps_of(dropped, *columns), *columns)
    unsure = told.filter("_may").join(dropped.select(*columns), [*columns], "left_anti").select(*told.columns)
    return told.filter("NOT _may").drop("_may").unionByName(unsure.drop("_may"))
