"""Python functions applied to columns in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def apply_parallel(function: Callable[[pd.Series], pd.Series], returns: str):
    """Wrap a series-to-series function so that Spark runs it over every batch in parallel."""

    def run(values: pd.Series) -> pd.Series:
        return function(values)

    return F.pandas_udf(run, returns)


def plus_one(column: Column) -> Column:
    """Each value plus one, computed in Python workers."""
    return apply_parallel(lambda values: values + 1, "bigint")(column.cast("bigint"))
