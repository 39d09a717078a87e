"""Naming an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it.

    Spark shares repeated sub-expressions of a projection, but not inside the lambdas of
    array functions; there, a long expression would be evaluated once per mention.
    """
    return F.element_at(F.transform(F.array(value), use), 1)
