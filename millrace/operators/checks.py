"""Checks on results, as rows ``(check, expected, actual, ok)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AT_LEAST = "at_least"
EXACTLY = "exactly"


def _verdict(name: str, expected: Column, actual: DataFrame, rule: str) -> DataFrame:
    met = F.col("actual") >= F.col("expected") if rule == AT_LEAST else F.col("actual") == F.col("expected")
    return (
        actual.withColumn("expected", expected.cast("bigint"))
        .select(F.lit(name).alias("check"), "expected", "actual")
        .withColumn("ok", met)
    )


def row_count_is(df: DataFrame, n: int, name: str) -> DataFrame:
    return _verdict(name, F.lit(n), df.agg(F.count(F.lit(1)).alias("actual")), EXACTLY)


def row_count_at_least(df: DataFrame, n: int, name: str) -> DataFrame:
    return _verdict(name, F.lit(n), df.agg(F.count(F.lit(1)).alias("actual")), AT_LEAST)


def has_row(df: DataFrame, condition: Column, name: str) -> DataFrame:
    """Whether at least one row meets ``condition``; ``actual`` is how many do."""
    found = df.agg(F.count_if(condition).alias("actual"))
    return _verdict(name, F.lit(1), found, AT_LEAST)


def same_rows(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Whether two frames hold the same rows equally often; ``actual`` counts differences."""
    sides = left.withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(-1)))
    balance = sides.groupBy(*left.columns).agg(F.sum("_side").alias("_balance"))
    differences = balance.agg(
        F.coalesce(F.sum(F.abs("_balance")), F.lit(0)).cast("bigint").alias("actual")
    )
    return _verdict(name, F.lit(0), differences, EXACTLY)


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def require(checks: DataFrame) -> None:
    """Raise if a check failed.  A report has as many rows as there are checks."""
    failed = checks.filter(~F.col("ok")).collect()
    if failed:
        raise AssertionError("; ".join(f"{r['check']}: {r['actual']} vs {r['expected']}" for r in failed))
