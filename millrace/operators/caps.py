"""Exact caps on ordered rows, whatever their number."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.scratch import fresh_dir

SORTED_ROWS = 10_000


def first_rows(df: DataFrame, by: str, n: int, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """The ``n`` rows with the smallest ``by`` (a column without repeats).

    The rows are written range-partitioned and the partitions counted: whole partitions are
    kept up to the one in which row ``n`` lies, and that one is ranged again until no more than
    ``n`` rows, or ``sorted_rows`` if those are more, are left to sort in one task.
    """
    spark = df.sparkSession
    schema = df.schema
    partitions = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept = df.limit(0)
    while n > 0:
        path = fresh_dir(spark, "ranged")
        ranged = df.repartitionByRange(partitions, by).withColumn("_part", F.spark_partition_id())
        ranged.write.parquet(path)
        ranged = spark.read.schema(ranged.schema).parquet(path)
        sizes = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())
        ends = list(accumulate(size for _, size in sizes))
        cut = next((i for i, end in enumerate(ends) if end >= n), None)
        if cut is None:
            return kept.unionByName(ranged.select(schema.names))
        part, size = sizes[cut]
        kept = kept.unionByName(ranged.filter(F.col("_part") < part).select(schema.names))
        df = ranged.filter(F.col("_part") == part).select(schema.names)
        n -= ends[cut] - size
        if n == size:
            return kept.unionByName(df)
        if size <= max(n, sorted_rows):
            return kept.unionByName(df.orderBy(by).limit(n))
    return kept


def head(df: DataFrame, by: str, n: int) -> DataFrame:
    """A preview: the first ``n`` rows in the stated order."""
    return df.orderBy(by).limit(n)
