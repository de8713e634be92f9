"""Rolling totals over trailing periods, by block decomposition.

A key's calendar is cut into blocks as long as the period. In each block run a
prefix sum (from the block's first day) and a suffix sum (from its last day); the
trailing total of a day is the prefix sum of that day plus the suffix sum that
begins ``span - 1`` days earlier, in the block before. Each day costs one addition
whatever the period's length.

Defined results
* a flush delivered again (same ``flush_id``) counts once; rows without ``flush_id``
  cannot be told apart and each counts;
* null counts are 0; rows without key or with a day that is no date are left out;
* an empty table gives an empty result; columns beyond the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPANS = (7, 30)
MEASURES = ("records", "syntheses")


def daily_totals(usage: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """One row per key and active day, each flush counted once.

    A hot key is summed before any of its rows meet in one task: both aggregations
    are partial first, and what is left of a key is at most one row per day.
    """
    rows = usage.select(
        F.col("key_id"),
        F.expr("try_to_date(day, 'yyyy-MM-dd')").alias("date"),
        F.col("flush_id"),
        *[F.coalesce(F.col(m), F.lit(0)).cast("long").alias(m) for m in measures],
    ).where("key_id is not null and date is not null")
    named = rows.where("flush_id is not null").groupBy("key_id", "date", "flush_id").agg(*[F.max(m).alias(m) for m in measures])
    bare = rows.where("flush_id is null").select(*named.columns)
    return named.unionByName(bare).groupBy("key_id", "date").agg(*[F.sum(m).alias(m) for m in measures])


def dense_calendar(daily: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """``daily`` with every day from a key's first to its last; idle days hold 0.

    Each active day also fills the gap up to the next one, so no join is needed.
    """
    following = F.lead("date").over(Window.partitionBy("key_id").orderBy("date"))
    last = F.coalesce(F.date_sub(following, 1), F.col("date"))
    first = F.min("date").over(Window.partitionBy("key_id"))
    return (
        daily.select("*", last.alias("_last"), first.alias("_first"))
        .select("*", F.explode(F.sequence("date", "_last")).alias("_day"))
        .select(
            "key_id",
            F.col("_day").alias("date"),
            F.datediff("_day", "_first").alias("n"),
            *[F.when(F.col("_day") == F.col("date"), F.col(m)).otherwise(F.lit(0)).cast("long").alias(m) for m in measures],
        )
    )


def trailing_totals(calendar: DataFrame, spans: Sequence[int] = SPANS, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Adds ``{measure}_{span}``, the trailing totals, to a dense calendar."""
    out = calendar
    key = Window.partitionBy("key_id").orderBy("n")
    for span in spans:
        block = F.floor(F.col("n") / span)
        head = Window.partitionBy("key_id", "_block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
        tail = Window.partitionBy("key_id", "_block").orderBy("n").rowsBetween(0, Window.unboundedFollowing)
        out = out.withColumn("_block", block)
        out = out.select("*", *[F.sum(m).over(head).alias(f"_head_{m}") for m in measures], *[F.sum(m).over(tail).alias(f"_tail_{m}") for m in measures])
        whole = F.col("n") % span == span - 1

        def total(m: str, whole: Column = whole, span: int = span) -> Column:
            before = F.coalesce(F.lag(f"_tail_{m}", span - 1).over(key), F.lit(0)) if span > 1 else F.lit(0)
            return (F.col(f"_head_{m}") + F.when(whole, F.lit(0)).otherwise(before)).cast("long").alias(f"{m}_{span}")

        out = out.select("*", *[total(m) for m in measures]).drop("_block", *[f"_head_{m}" for m in measures], *[f"_tail_{m}" for m in measures])
    return out


def rolling(usage: DataFrame, spans: Sequence[int] = SPANS, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Totals and daily averages of every key and calendar day: one row each with
    ``{measure}_{span}`` and ``{measure}_avg_{span}`` (total / span)."""
    totals = trailing_totals(dense_calendar(daily_totals(usage, measures), measures), spans, measures)
    return totals.select(
        "key_id",
        F.date_format("date", "yyyy-MM-dd").alias("day"),
        *[F.col(f"{m}_{s}") for s in spans for m in measures],
        *[(F.col(f"{m}_{s}") / F.lit(float(s))).alias(f"{m}_avg_{s}") for s in spans for m in measures],
    )


def peaks(usage: DataFrame, spans: Sequence[int] = SPANS, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Days whose trailing total equals the highest of the key's calendar and is above 0."""
    totals = trailing_totals(dense_calendar(daily_totals(usage, measures), measures), spans, measures)
    every = Window.partitionBy("key_id")
    names = [(m, s) for s in spans for m in measures]
    best = totals.select("key_id", "date", *[F.when((F.col(f"{m}_{s}") > 0) & (F.col(f"{m}_{s}") == F.max(f"{m}_{s}").over(every)), F.struct(F.lit(s).cast("long").alias("span_days"), F.lit(m).alias("measure"))).alias(f"p{i}") for i, (m, s) in enumerate(names)])
    return (
        best.select("key_id", F.date_format("date", "yyyy-MM-dd").alias("day"), F.explode(F.array(*[f"p{i}" for i in range(len(names))])).alias("hit"))
        .where("hit is not null")
        .select("key_id", "day", "hit.span_days", "hit.measure")
    )
