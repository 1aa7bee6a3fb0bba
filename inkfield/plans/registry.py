"""The registry every query module fills: a query by name and the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

SQL: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DIGITS = 6


def query(function):
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Float columns to a fixed number of digits.

    The nudge moves exact halves off the rounding edge, where engines differ.
    """
    return df.select(
        *(
            (F.round(F.col(f.name).cast("double") + 1e-9, digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
            for f in df.schema.fields
        )
    )
