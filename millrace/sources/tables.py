"""Files and tables read as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def parquet(spark: SparkSession, *paths: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*paths)


def versioned_table(spark: SparkSession, path: str, fmt: str = "delta") -> DataFrame:
    """Latest version of a table stored at ``path``; ``fmt="parquet"`` needs no extra jar."""
    return spark.read.format(fmt).load(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object per line, with the schema stated so nothing is inferred."""
    return spark.read.schema(schema).json(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line under ``path`` as the column ``value``."""
    return spark.read.text(path)
