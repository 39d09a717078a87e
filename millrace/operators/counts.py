"""Counting.  All of these combine before the exchange, so a hot value costs no more."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import key_count


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    """One row: how many rows there are."""
    return df.agg(F.count(F.lit(1)).alias(name))


def element_counts(df: DataFrame, element: Column | str, name: str = "n") -> DataFrame:
    """``element`` and how often it occurs."""
    column = F.col(element) if isinstance(element, str) else element
    return df.groupBy(column.alias("element")).agg(F.count(F.lit(1)).alias(name))


def element_count_lines(df: DataFrame, element: Column | str) -> DataFrame:
    """``element:count`` lines in the column ``line``."""
    return element_counts(df, element).select(key_count("element", "n").alias("line"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name`` and ``n`` for several tables in one job."""
    parts = [
        row_count(df).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def lines_per_file(lines: DataFrame) -> DataFrame:
    """``file`` and ``n`` for a frame read from text files."""
    return lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("n")
    )
