"""How complete extracted records are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORE = ("title", "price", "url")


def answered(c: str, kind: str) -> Column:
    """A value that says something: not null, not empty, not zero."""
    col = F.col(c)
    if kind == "string":
        return F.coalesce(col != "", F.lit(False))
    if kind.startswith("array") or kind.startswith("map"):
        return F.coalesce(F.size(col) > 0, F.lit(False))
    if kind == "boolean":
        return F.coalesce(col, F.lit(False))
    return F.coalesce(col != 0, F.lit(False)) if kind.split("(")[0] in ("decimal", "double", "float", "int", "bigint", "smallint", "tinyint") else col.isNotNull()


def usable(df: DataFrame, core: Sequence[str] = CORE) -> Column:
    kinds = dict(df.dtypes)
    out = F.lit(True)
    for c in core:
        out &= answered(c, kinds[c])
    return out


def coverage(df: DataFrame, by: Sequence[str] = (), core: Sequence[str] = CORE) -> DataFrame:
    """Rows, usable rows and the share of rows that answer each core field, rounded half
    to even; an empty table gives one row of zeros where no group is asked for."""
    kinds = dict(df.dtypes)
    share = lambda c: F.coalesce(F.bround(F.avg(answered(c, kinds[c]).cast("double")), 3), F.lit(0.0))
    return df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(usable(df, core)).alias("usable"), *[share(c).alias(c) for c in core])


def meets(df: DataFrame, threshold: float, by: Sequence[str] = (), core: Sequence[str] = CORE) -> DataFrame:
    """The share of usable rows, and whether it reaches the threshold; no rows have a share of 0."""
    c = df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(usable(df, core)).alias("usable"))
    ratio = F.when(F.col("total") > 0, F.col("usable") / F.col("total")).otherwise(F.lit(0.0))
    return c.select(*by, ratio.alias("usable_ratio"), (ratio >= threshold).alias("meets"))


def answered_fields(df: DataFrame, fields: Sequence[str]) -> Column:
    """The number of fields that answer, as one expression."""
    kinds = dict(df.dtypes)
    return sum((answered(f, kinds[f]).cast("int") for f in fields), F.lit(0))


def fuller(static: DataFrame, rendered: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Of two readings of a page the fuller one; the rendered one where they tie."""
    a = static.select(key, F.struct(*fields).alias("a"), answered_fields(static, fields).alias("na"))
    b = rendered.select(key, F.struct(*fields).alias("b"), answered_fields(rendered, fields).alias("nb"))
    both = a.join(b, key, "full")
    return both.select(key, F.when(F.col("b").isNull() | (F.col("na") > F.col("nb")), F.col("a")).otherwise(F.col("b")).alias("r")).select(key, "r.*")
