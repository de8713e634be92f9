"""Behaviour over time as streaming queries: usage by day, windows of compiles, failures
that are forgotten, records held until they can be mended, and grants made once."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mossgrid.operators import ledger
from mossgrid.operators.governance import DAY, FAILURE_DAYS

LATE = "1 hour"


def usage_by_day(stream: DataFrame, late: str = "21 days", measures: tuple[str, ...] = ("requests", "pages", "renders", "syntheses", "records")) -> DataFrame:
    """A stream of flushes (``usage_days`` rows) summed by key and day; a flush delivered again
    within the watermark counts once. Flushes arrive weeks late, hence the wide watermark."""
    once = stream.where("key_id is not null").withColumn("arrived", F.col("arrived_at").cast("timestamp")).withWatermark("arrived", late).dropDuplicatesWithinWatermark(["flush_id"])
    return once.groupBy("key_id", "day").agg(*[F.sum(F.coalesce(F.col(m), F.lit(0))).cast("long").alias(m) for m in measures])


def events_by_window(stream: DataFrame, ts: str = "ts", width: str = "1 day", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts by tumbling window; rows later than an hour are dropped by the watermark."""
    return stream.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", LATE).groupBy(F.window("at", width), *keys).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """Sessions of a key that end after a gap (an extension; nothing else here needs them)."""
    return stream.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", LATE).groupBy(key, F.session_window("at", gap)).agg(F.count("*").alias("n"))


def _timed(stream: DataFrame, late: str = LATE) -> DataFrame:
    """``stream`` with a watermark on its epoch seconds, by which state that is over is let go."""
    return stream.withColumn("_time", F.timestamp_seconds("at")).withWatermark("_time", late)


def _expire(state: GroupState, at: float) -> None:
    """Lets the state go when the watermark has passed ``at`` (epoch seconds)."""
    state.setTimeoutTimestamp(max(int(at * 1000), state.getCurrentWatermarkMs() + 1))


def compile_windows(stream: DataFrame, cap: int = 2) -> DataFrame:
    """``stream(key, at)`` (epoch seconds) to ``(key, at, n, allowed)``: the count in the day that
    began with a key's first event; the next event after that day begins a new one."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        since, n = state.get if state.exists else (0.0, 0)
        out = []
        for at in sorted(a for pdf in batches for a in pdf["at"]):
            since, n = (at, 1) if n == 0 or at - since >= DAY else (since, n + 1)
            out.append((key[0], at, n, n <= cap))
        state.update((since, n))
        _expire(state, since + DAY)
        yield pd.DataFrame(out, columns=["key", "at", "n", "allowed"])

    return _timed(stream).groupBy("key").applyInPandasWithState(step, "key string, at double, n int, allowed boolean", "since double, n int", "append", GroupStateTimeout.EventTimeTimeout)


def failure_notes(stream: DataFrame) -> DataFrame:
    """``stream(page_key, at, ok, mode)`` to the note after each event: null once a success clears
    it or a week has passed; a browser's failure is not weakened by a later static one."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        note = state.get if state.exists else None
        out = []
        for at, ok, mode in sorted((r for pdf in batches for r in zip(pdf["at"], pdf["ok"], pdf["mode"])), key=lambda r: r[0]):
            if note is not None and at - note[0] >= FAILURE_DAYS * DAY:
                note = None
            if ok:
                note = None
            else:
                note = (at, "js" if mode == "js" or note is not None and note[1] == "js" else "static")
            out.append((key[0], at, note[1] if note else None))
        if note is None:
            if state.exists:
                state.remove()
        else:
            state.update(note)
            _expire(state, note[0] + FAILURE_DAYS * DAY)
        yield pd.DataFrame(out, columns=["page_key", "at", "note"])

    return _timed(stream).groupBy("page_key").applyInPandasWithState(step, "page_key string, at double, note string", "at double, note string", "append", GroupStateTimeout.EventTimeTimeout)


def merged(old: dict, fields: dict, modes: dict) -> dict:
    """A recipe as it stands after one more compile: new selectors first, old ones as alternates."""
    out = {"fields": dict(fields), "modes": dict(modes), "alternates": {}}
    for name in dict.fromkeys([*old.get("fields", {}), *old.get("alternates", {})]):
        known = [old.get("fields", {}).get(name), *old.get("alternates", {}).get(name, [])]
        rest = [s for s in dict.fromkeys(known) if s and s != out["fields"].get(name)]
        if name not in out["fields"] and rest:
            out["fields"][name] = rest.pop(0)
            if name in old.get("modes", {}):
                out["modes"].setdefault(name, old["modes"][name])
        if rest:
            out["alternates"][name] = rest
    return out


def recipes_learned(stream: DataFrame) -> DataFrame:
    """``stream(recipe_key, at, fields, modes)`` of compiles to the recipe after each of them; the
    table they form is what pages are replayed with."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recipe = json.loads(state.get[0]) if state.exists else {}
        out = []
        for at, fields, modes in sorted((r for pdf in batches for r in zip(pdf["at"], pdf["fields"], pdf["modes"])), key=lambda r: r[0]):
            recipe = merged(recipe, dict(fields or {}), dict(modes or {}))
            out.append((key[0], at, dict(recipe["fields"]), dict(recipe["modes"]), dict(recipe["alternates"])))
        state.update((json.dumps(recipe),))
        yield pd.DataFrame(out, columns=["recipe_key", "at", "fields", "modes", "alternates"])

    return stream.groupBy("recipe_key").applyInPandasWithState(step, "recipe_key string, at double, fields map<string,string>, modes map<string,string>, alternates map<string,array<string>>", "recipe string", "append", GroupStateTimeout.NoTimeout)


def mended(stream: DataFrame, fields: list[str], hold: int = 8, least: int = 3) -> DataFrame:
    """``stream(recipe_key, pos, url, has array)`` to ``(recipe_key, url, missing)``: a record that lacks a
    field that the key's records up to it have is held, at most ``hold`` of them; complete ones pass.
    When ``least`` are held, the one that lacks most is given out once to be compiled again."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, urls, lacks, done = state.get if state.exists else ([], [], [], False)
        seen, held = set(seen), list(zip(urls, (set(x.split("\x1f")) - {""} for x in lacks)))
        out = []
        for _, url, has in sorted((r for pdf in batches for r in zip(pdf["pos"], pdf["url"], pdf["has"])), key=lambda r: r[0]):
            seen |= set(has)
            lacking = [f for f in fields if f in seen and f not in has]
            if done or not lacking or len(held) >= hold:
                continue
            held.append((url, set(has)))
            if len(held) >= least:
                missing = [(u, [f for f in fields if f in seen and f not in h]) for u, h in held]
                best = max(missing, key=lambda m: len(m[1]))
                out.append((key[0], best[0], best[1]))
                held, done = [], True
        state.update((sorted(seen), [u for u, _ in held], ["\x1f".join(sorted(h)) for _, h in held], done))
        yield pd.DataFrame(out, columns=["recipe_key", "url", "missing"])

    return stream.groupBy("recipe_key").applyInPandasWithState(step, "recipe_key string, url string, missing array<string>", "seen array<string>, urls array<string>, lacks array<string>, done boolean", "append", GroupStateTimeout.NoTimeout)


#: Folders of a ledger that grants are appended to, by a hash of their keys.
BUCKETS = 64


def append_grants(stream: DataFrame, path: str, checkpoint: str):
    """A started query that appends each batch's entries to the ledger at ``path`` unless their key is
    already there; the ledger itself is the memory, so keys are never forgotten. The ledger lies in
    folders by a hash of the key and by batch: a batch reads only the folders of its own keys, and one
    that is run again after a failure replaces what it wrote, entries without a key included."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)
        new = df.withColumn("bucket", F.expr(f"cast(pmod(xxhash64(idempotency_key), {BUCKETS}) as int)"))
        mine = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        schema = new.withColumn("batch", F.lit(0).cast("long")).schema
        known = spark.read.schema(schema).parquet(path).where(F.col("bucket").isin(mine) & (F.col("batch") != number)) if there and mine else new.limit(0)
        out = ledger.append_once(known, new).withColumn("batch", F.lit(number).cast("long"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
