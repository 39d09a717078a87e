"""Decoding topic records.  The same functions serve batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE_SCHEMA = T.StructType([T.StructField("message", T.StringType(), True)])


def as_text(value: Column) -> Column:
    """Record bytes as UTF-8 text."""
    return value.cast("string")


def raw_messages(records: DataFrame, name: str = "msg") -> DataFrame:
    """One text column per record, nothing decoded."""
    return records.select(as_text(F.col("value")).alias(name))


def decode_json(
    records: DataFrame,
    schema: T.StructType = MESSAGE_SCHEMA,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Decode ``value`` permissively and expand the fields to columns.

    A record that does not decode stays as a row of NULLs.  ``keep`` carries
    record columns (offset, timestamp ...) along.
    """
    decoded = records.select(*keep, F.from_json(as_text(F.col("value")), schema).alias("js"))
    return decoded.select(*keep, "js.*")


def encode_json(*columns: Column | str) -> Column:
    """The named columns as one JSON object string; NULL fields are kept as nulls."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
