"""Queries of the general training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mossgrid.operators import rolling, units
from mossgrid.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return rolling.peaks(table(spark, d, "usage_days"))


def p2_rolling(spark: SparkSession, d: str) -> DataFrame:
    return rolling.rolling(table(spark, d, "usage_days"))


def p5_amounts(spark: SparkSession, d: str) -> DataFrame:
    return units.recorded_units(table(spark, d, "products"), table(spark, d, "sites"), table(spark, d, "price_units"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_amounts(spark, d).where("unit_id <> 'eur'").select("product_id", "unit_id").distinct()


QUERIES = {"p2_found": p2_found, "p2_rolling": p2_rolling, "p5_found": p5_found, "p5_amounts": p5_amounts}

_DENSE = """
with named as (select key_id, cast(day as date) as d, flush_id, max(coalesce(records, 0)) as r, max(coalesce(syntheses, 0)) as s
               from usage_days where key_id is not null group by all),
daily as (select key_id, d, sum(r) as r, sum(s) as s from named group by all),
span as (select key_id, min(d) as a, max(d) as b from daily group by all),
calendar as (select key_id, cast(unnest(generate_series(a, b, interval 1 day)) as date) as d from span),
dense as (select c.key_id, c.d, coalesce(r, 0) as r, coalesce(s, 0) as s from calendar c left join daily y on c.key_id = y.key_id and c.d = y.d),
total as (select key_id, d,
    cast(sum(r) over week as bigint) as r7, cast(sum(s) over week as bigint) as s7,
    cast(sum(r) over month as bigint) as r30, cast(sum(s) over month as bigint) as s30
  from dense window week as (partition by key_id order by d rows between 6 preceding and current row),
                    month as (partition by key_id order by d rows between 29 preceding and current row))
"""

SQL = {
    "p2_rolling": _DENSE
    + """select key_id, strftime(d, '%Y-%m-%d') as day, r7 as records_7, s7 as syntheses_7, r30 as records_30, s30 as syntheses_30,
    r7 / 7.0::double as records_avg_7, s7 / 7.0::double as syntheses_avg_7, r30 / 30.0::double as records_avg_30, s30 / 30.0::double as syntheses_avg_30 from total""",
    "p2_found": _DENSE
    + """, long as (select key_id, d, 7::bigint as span_days, 'records' as measure, r7 as v from total
    union all select key_id, d, 7, 'syntheses', s7 from total
    union all select key_id, d, 30, 'records', r30 from total
    union all select key_id, d, 30, 'syntheses', s30 from total),
best as (select *, max(v) over (partition by key_id, span_days, measure) as top from long)
select key_id, strftime(d, '%Y-%m-%d') as day, span_days, measure from best where v = top and v > 0""",
}
