"""Ranges and literal rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import words
from millrace.functions.urls import normalize_url


def integer_range(spark: SparkSession, start: int, stop: int) -> DataFrame:
    """``id`` for every integer from ``start`` up to, not including, ``stop``."""
    return spark.range(start, stop)


def literal_rows(
    spark: SparkSession, rows: Iterable[Sequence], schema: list[str] | str | T.StructType
) -> DataFrame:
    """A small table written out in code."""
    return spark.createDataFrame(list(rows), schema)


def literal_elements(spark: SparkSession, values: Iterable[str]) -> DataFrame:
    """A small collection of strings as the column ``element``."""
    return spark.createDataFrame([(v,) for v in values], "element string")


def seed_urls(texts: DataFrame, column: str = "seeds") -> DataFrame:
    """Normalised start addresses at depth 0 from white-space-separated text.

    ``texts`` may hold any number of rows; words that are no address are dropped, and
    an address given twice is one seed.
    """
    keys = F.filter(F.transform(words(F.col(column)), normalize_url), lambda url: url.isNotNull())
    return texts.select(F.explode(keys).alias("url")).distinct().withColumn("depth", F.lit(0))
