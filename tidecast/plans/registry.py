"""Named queries, each with DuckDB SQL for its result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Register a query under its function's name; ``views`` are those the SQL reads."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql, *views)
        return f

    return add


#: Below this, a double times a power of ten up to a million is a whole number that doubles hold exactly.
ROUNDED_BELOW = 1e9


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, halves away from zero: sums may be added up in any order.

    By multiplying, as DuckDB does it: Spark's ``round`` makes decimal objects of each value, which took most of the time of wide tables.
    """
    unit = float(10**digits)

    def short(c: str) -> Column:
        x = F.col(c)
        near = F.signum(x) * F.floor(F.abs(x) * unit + 0.5) / unit
        return F.when(F.abs(x) < ROUNDED_BELOW, near).otherwise(F.round(x, digits)) + F.lit(0.0)

    return df.select(*(short(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
