import datetime as dt
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from mossgrid.operators import rolling

SCHEMA = "key_id string, day string, requests long, syntheses long, records long, flush_id string, arrived_at string, n long, date string"


def brute(rows, spans=(7, 30)):
    seen, daily = set(), {}
    for k, d, _, s, r, f, *_ in rows:
        try:
            day = dt.date.fromisoformat(d)
        except (TypeError, ValueError):
            continue
        if k is None or f is not None and f in seen:
            continue
        if f is not None:
            seen.add(f)
        a = daily.setdefault(k, {}).setdefault(day, [0, 0])
        a[0] += r or 0
        a[1] += s or 0
    out = {}
    for k, days in daily.items():
        day, last = min(days), max(days)
        while day <= last:
            back = [[days.get(day - dt.timedelta(i), (0, 0))[m] for i in range(span)] for span in spans for m in (0, 1)]
            out[k, day.isoformat()] = tuple(map(sum, back))
            day += dt.timedelta(1)
    return out


def run(spark, rows):
    df = rolling.rolling(spark.createDataFrame(rows, SCHEMA))
    return {(r["key_id"], r["day"]): (r["records_7"], r["syntheses_7"], r["records_30"], r["syntheses_30"]) for r in df.collect()}


def test_repeats_nulls_gaps_and_clashing_columns(spark):
    rows = [
        ("a", "2025-01-01", 1, 2, 10, "f1", "x", 9, "zz"),
        ("a", "2025-01-01", 1, 2, 10, "f1", "later", 9, "zz"),
        ("a", "2025-01-01", 1, None, 5, "f2", "x", 9, None),
        ("a", "2025-03-15", 1, 1, None, "f3", "x", 9, None),
        ("a", "no day", 1, 1, 7, "f4", "x", 9, None),
        ("a", None, 1, 1, 7, "f5", "x", 9, None),
        (None, "2025-01-01", 1, 1, 7, "f6", "x", 9, None),
        ("b", "2025-02-28", 1, 3, 4, None, "x", 9, None),
        ("b", "2025-02-28", 1, 3, 4, None, "x", 9, None),
    ]
    got = run(spark, rows)
    assert got == brute(rows)
    assert got["b", "2025-02-28"] == (8, 6, 8, 6)
    assert len([k for k in got if k[0] == "a"]) == 74


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rolling.rolling(empty).count() == 0
    assert rolling.peaks(empty).count() == 0


def test_peaks_keep_ties_and_leave_out_zero(spark):
    rows = [("a", "2025-01-01", 0, 0, 5, "1", "", 0, ""), ("a", "2025-01-20", 0, 0, 5, "2", "", 0, ""), ("z", "2025-01-01", 0, 0, 0, "3", "", 0, "")]
    got = {(r["day"], r["span_days"]) for r in rolling.peaks(spark.createDataFrame(rows, SCHEMA)).collect() if r["measure"] == "records"}
    week = {(f"2025-01-0{i}", 7) for i in range(1, 8)} | {("2025-01-20", 7)}
    assert got == week | {("2025-01-20", 30)}


def test_a_hot_key_and_partitions_do_not_matter(spark):
    random.seed(3)
    rows = [("hot" if random.random() < 0.5 else random.choice("abc"), f"2025-0{random.randint(1, 6)}-{random.randint(1, 28):02d}", 1, random.randint(0, 3), random.choice([None, 4, 9]), f"f{i // 2}", "", 0, "") for i in range(600)]
    rows = [r if i % 2 == 0 else (*rows[i - 1][:6], "again", 0, "") for i, r in enumerate(rows)]
    want = brute(rows)
    assert run(spark, rows) == want
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert run(spark, rows) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 90), st.integers(0, 9)), min_size=1, max_size=12), st.integers(1, 40))
def test_any_span(spark, events, span):
    rows = [(k, (dt.date(2025, 1, 1) + dt.timedelta(d)).isoformat(), 0, 0, n, f"f{i}", "", 0, "") for i, (k, d, n) in enumerate(events)]
    df = rolling.rolling(spark.createDataFrame(rows, SCHEMA), spans=(span,))
    got = {(r["key_id"], r["day"]): r[f"records_{span}"] for r in df.collect()}
    assert got == {k: v[0] for k, v in brute(rows, (span,)).items()}
