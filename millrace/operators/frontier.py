"""Set algebra on addresses: what a crawl does between two levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def link_edges(pages: DataFrame) -> DataFrame:
    """``(src_url, dst_url)`` for every link of every page of ``sources.web.read_pages``."""
    return pages.select(F.col("url").alias("src_url"), F.explode("links").alias("dst_url"))


def first_visits(candidates: DataFrame) -> DataFrame:
    """Each ``url`` once, at its smallest ``depth``."""
    return candidates.groupBy("url").agg(F.min("depth").alias("depth"))


def first_parents(candidates: DataFrame) -> DataFrame:
    """Each ``url`` once with the ``depth`` and ``src_url`` that reach it first.

    The smallest (depth, src_url) is taken by an aggregate, which combines before the
    exchange; ranking a window would bring every link to a popular address into one task.
    """
    first = F.min(F.struct("depth", "src_url"))
    return candidates.groupBy("url").agg(first.alias("first")).select("url", "first.*")


def unseen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates whose ``url`` has not been attempted."""
    return candidates.join(seen.select("url"), "url", "left_anti")


def with_seen(seen: DataFrame, visited: DataFrame) -> DataFrame:
    """The seen set grown by newly attempted addresses."""
    return seen.unionByName(visited.select(*seen.columns))


def linked(fetched: DataFrame) -> DataFrame:
    """The addresses that fetched pages link to, repeats included, one level deeper."""
    return fetched.select(F.explode("links").alias("url"), (F.col("depth") + 1).alias("depth"))
