"""Helpers for expressions over arrays inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once.

    An outer expression used inside a lambda is evaluated again for every
    element; as the lambda's own variable it is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
