"""Keeping addresses whose host an allowlist table covers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.urls import HOST_CHARS, host_suffixes, url_host
from millrace.scratch import fresh_dir

BROADCAST_DOMAINS = 200_000
SALTS = 64


def _outermost(domains: DataFrame) -> DataFrame:
    """Distinct lower-case domains without those below another one of the list.

    A host then falls under at most one entry, so a join with the entries cannot
    repeat a row.
    """
    distinct = domains.select(F.lower("domain").alias("domain")).filter(
        F.length("domain").between(1, HOST_CHARS)
    ).distinct()
    suffixes = host_suffixes(F.col("domain"))
    parents = distinct.select(
        "domain", F.explode(F.array_except(suffixes, F.array("domain"))).alias("parent")
    )
    covered = parents.join(distinct.withColumnRenamed("domain", "parent"), "parent", "left_semi")
    return distinct.join(covered, "domain", "left_anti")


@dataclass(frozen=True)
class Allowlist:
    """Stored, outermost domains, and whether they are few enough to broadcast."""

    entries: DataFrame
    small: bool

    @staticmethod
    def store(domains: DataFrame, broadcast_domains: int = BROADCAST_DOMAINS) -> Allowlist:
        spark = domains.sparkSession
        path = fresh_dir(spark, "allowlist")
        _outermost(domains).write.parquet(path)
        entries = spark.read.schema("domain string").parquet(path)
        return Allowlist(entries, entries.count() <= broadcast_domains)

    def keep(self, urls: DataFrame, column: str = "url", salts: int = SALTS) -> DataFrame:
        """Rows of ``urls`` whose host is an entry or below one.

        Only distinct hosts are expanded to their parents, so no row of ``urls`` is copied; the
        suffix test becomes an equality.  A long list is shuffled; since nearly all hosts may share
        one parent, each parent is spread over ``salts`` keys and the list repeated for each.  A
        host that most rows share is on the side of a join that can be split.
        """
        entries = self.entries.withColumnRenamed("domain", "_parent")
        hosts = urls.select(url_host(F.col(column)).alias("_host")).distinct()
        expanded = hosts.withColumn("_parent", F.explode(host_suffixes(F.col("_host"))))
        if self.small:
            inside = expanded.join(F.broadcast(entries), "_parent", "left_semi")
        else:
            salted = expanded.withColumn("_salt", F.pmod(F.xxhash64("_host"), F.lit(salts)).cast("int"))
            all_salts = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
            spread = entries.withColumn("_salt", all_salts)
            inside = salted.join(spread, ["_parent", "_salt"], "left_semi")
        allowed = inside.select("_host").distinct()
        return urls.withColumn("_host", url_host(F.col(column))).join(allowed, "_host", "left_semi").drop("_host")


def semi_join_allowed(
    urls: DataFrame,
    domains: DataFrame,
    column: str = "url",
    broadcast_domains: int = BROADCAST_DOMAINS,
    salts: int = SALTS,
) -> DataFrame:
    """Rows of ``urls`` whose host is a ``domain`` of the other table or below one."""
    return Allowlist.store(domains, broadcast_domains).keep(urls, column, salts)
