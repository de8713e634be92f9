"""All queries of the core, by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mossgrid.plans import problems, records, reference  # noqa: F401  (records adds to reference.Q)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return reference.Q | problems.QUERIES


def sql() -> dict[str, str]:
    return reference.SQL | problems.SQL
