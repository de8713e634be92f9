"""Balances, idempotent appends and usage of an append-only ledger, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_entries(ledger: DataFrame) -> DataFrame:
    """Exact repeats once; of the entries with one idempotency key the first. Entries
    without a key are told apart by id alone.

    Only keyed entries are ranked, by their own key; the null keys never meet in one task.
    """
    once = ledger.dropDuplicates(["id"])
    keyed = once.where("idempotency_key is not null").groupBy("idempotency_key").agg(F.min_by(F.struct(*[c for c in ledger.columns]), F.struct("created_at", "id")).alias("e")).select("e.*")
    return keyed.unionByName(once.where("idempotency_key is null"))


def balances(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("key_id").agg(F.sum("delta").cast("long").alias("balance"), F.count("*").alias("entries"))


def running_balances(ledger: DataFrame) -> DataFrame:
    order = Window.partitionBy("key_id").orderBy("created_at", "id")
    return ledger.select("*", F.sum("delta").over(order).cast("long").alias("balance"))


def newest_entries(ledger: DataFrame, per_key: int) -> DataFrame:
    """The newest entries of each key (a top-k report; the rank filter prunes before the shuffle)."""
    rank = F.row_number().over(Window.partitionBy("key_id").orderBy(F.desc("created_at"), F.desc("id")))
    return ledger.withColumn("place", rank).where(F.col("place") <= per_key)


def append_once(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """Those rows of ``new`` that may be appended: their key is not in the ledger and
    is the first of its kind; rows without a key always."""
    first = new.where("idempotency_key is not null").groupBy("idempotency_key").agg(F.min_by(F.struct(*new.columns), F.struct("created_at", "id")).alias("e")).select("e.*")
    known = ledger.where("idempotency_key is not null").select("idempotency_key").distinct()
    return first.join(known, "idempotency_key", "left_anti").select(*new.columns).unionByName(new.where("idempotency_key is null"))


def topped_up(ledger: DataFrame) -> DataFrame:
    """Keys with a positive entry that is no free allowance."""
    paid = (F.col("delta") > 0) & ~F.coalesce(F.col("idempotency_key").startswith("free:"), F.lit(False))
    return ledger.groupBy("key_id").agg(F.bool_or(paid).alias("topped_up"))


def live_keys_by_identity(keys: DataFrame) -> DataFrame:
    """The newest key of each identity that is not revoked."""
    live = keys.where("revoked_at is null and email_hash is not null")
    return live.groupBy("email_hash").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


def moved_balance(ledger: DataFrame, pairs: DataFrame) -> DataFrame:
    """The two entries that move each old key's positive balance to its new key, never twice.

    ``pairs(old_id, new_id)``; the grant carries a key made of both ids."""
    owed = balances(ledger).where("balance > 0").select(F.col("key_id").alias("old_id"), "balance")
    move = pairs.join(owed, "old_id").withColumn("tag", F.concat(F.lit("move:"), "old_id", F.lit(":"), "new_id"))
    move = move.join(ledger.where("idempotency_key is not null").select(F.col("idempotency_key").alias("tag")).distinct(), "tag", "left_anti")
    out = move.select(F.col("old_id").alias("key_id"), (-F.col("balance")).alias("delta"), F.lit(None).cast("string").alias("idempotency_key"))
    return out.unionByName(move.select(F.col("new_id").alias("key_id"), F.col("balance").alias("delta"), F.col("tag").alias("idempotency_key")))


def reconciled(payments: DataFrame, ledger: DataFrame, keys: DataFrame) -> DataFrame:
    """One outcome per payment: applied (granted now), recovered (granted through the
    identity's newest live key), already, orphaned or ignored (not paid).

    ``payments(session_id, payment_status, key_id?, amount, email_hash?)``
    """
    granted = ledger.where("idempotency_key is not null").select(F.col("idempotency_key").alias("session_id")).distinct().withColumn("done", F.lit(True))
    own = keys.where("revoked_at is null").select(F.col("id").alias("key_id"), F.col("id").alias("own_id"))
    other = live_keys_by_identity(keys).select("email_hash", F.col("id").alias("other_id"))
    p = payments.join(granted, "session_id", "left").join(own, "key_id", "left").join(other, "email_hash", "left")
    outcome = (
        F.when(F.coalesce(F.col("payment_status"), F.lit("")) != "paid", "ignored")
        .when(F.col("done"), "already")
        .when(F.col("own_id").isNotNull(), "applied")
        .when(F.col("other_id").isNotNull(), "recovered")
        .otherwise("orphaned")
    )
    return p.select("session_id", "amount", outcome.alias("outcome"), F.when(outcome == "applied", F.col("own_id")).when(outcome == "recovered", F.col("other_id")).alias("key_id"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Payments and amounts by outcome."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("payments"), F.sum("amount").cast("long").alias("amount"))


def usage_by_day(usage: DataFrame, measures: tuple[str, ...] = ("requests", "pages", "renders", "syntheses", "records")) -> DataFrame:
    """Sums by key and day, each flush once, null counts as 0."""
    once = usage.where("key_id is not null").dropDuplicates(["flush_id"])
    return once.groupBy("key_id", "day").agg(*[F.sum(F.coalesce(F.col(m), F.lit(0))).cast("long").alias(m) for m in measures])


def usage_by_month(usage: DataFrame, measures: tuple[str, ...] = ("requests", "pages", "renders", "syntheses", "records")) -> DataFrame:
    """Partial sums by day are re-aggregated, so a hot key moves one row per day."""
    daily = usage_by_day(usage, measures).withColumn("month", F.substring("day", 1, 7))
    return daily.groupBy("key_id", "month").agg(*[F.sum(m).cast("long").alias(m) for m in measures])


def recent_count(events: DataFrame, key: str, kind: str, ts: str, hours: int) -> DataFrame:
    """Each event with the count of its key's and kind's events in the hours up to it."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    span = Window.partitionBy(key, kind).orderBy(seconds).rangeBetween(-hours * 3_600_000_000, 0)
    return events.select("*", F.count("*").over(span).alias("recent"))


def within_budget(df: DataFrame, key: str, order: list[Column], cap: int | Column) -> DataFrame:
    """The first ``cap`` rows of each key."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_place") <= cap).drop("_place")
