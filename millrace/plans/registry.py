"""The registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.tables import parquet

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}

# Fixed value: the tables every data folder holds.
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def query(sql: str) -> Callable[[Plan], Plan]:
    """Register a plan under its function name, with the SQL that gives the same rows."""

    def register(plan: Plan) -> Plan:
        PLANS[plan.__name__] = plan
        ORACLES[plan.__name__] = sql
        return plan

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return parquet(spark, f"{sf_dir}/{name}.parquet")
