"""Connected components of a graph too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame, work: str, name: str) -> DataFrame:
    """``node``, ``component`` for every node of ``links`` (``a``, ``b``): the smallest node it reaches.

    Each turn hangs a node's larger neighbours on its smallest one, then its smaller ones; the
    number of turns follows the logarithm of the longest path.  A turn is a written table, which
    cuts the lineage; the driver sees a count and a checksum.  Hubs are on the side of a join
    that can be split, against one row per node.
    """
    spark = links.sparkSession
    kind = "u bigint, v bigint"

    def stored(df: DataFrame, step: str) -> DataFrame:
        df.write.parquet(f"{work}/components-{name}-{step}")
        return spark.read.schema(kind).parquet(f"{work}/components-{name}-{step}")

    def directed(df: DataFrame) -> DataFrame:
        return df.select("u", "v").unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def hung(df: DataFrame, step: str) -> DataFrame:
        """``df`` with the smallest of each ``u`` and its neighbours.

        These are written first: an aggregate below a join would keep a hub's rows in one task.
        """
        least = df.groupBy("u").agg(F.min(F.least("u", "v")).alias("v"))
        return df.join(stored(least, f"{step}-least").withColumnRenamed("v", "m"), "u")

    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = stored(edges.distinct(), "0")
    turn, before = 0, None
    while True:
        turn += 1
        large = hung(directed(edges), f"{turn}-up").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u <> v").distinct(), f"{turn}-large")
        small = hung(large, f"{turn}-down")  # u > v already
        near = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = small.select("u", F.col("m").alias("v"))
        edges = stored(near.unionByName(own).distinct(), str(turn))
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    own = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return own.unionByName(roots.join(own.select("node"), "node", "left_anti"))
