"""Pieces that other column expressions are made of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used: columns are
    expressions, and one used ten times would be computed ten times."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
