"""Named SELECTs stored as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.sinks.files import managed_table


def materialize(spark: SparkSession, name: str, select: str, path: str, fmt: str = "parquet") -> DataFrame:
    """Run a SELECT, store its rows as the table ``name`` at ``path``, and read that table."""
    managed_table(spark.sql(select), name, path, fmt)
    return spark.table(name)
