import json
import zipfile
from decimal import Decimal

import pytest

from mossgrid.operators import governance, ledger
from mossgrid.sinks import files
from mossgrid.streaming import state


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame([("Жук | \"q\"", Decimal("380.50"), ["a", "b"], None), ("x\ny", None, None, True)], "title string, price decimal(10,2), sizes array<string>, ok boolean")


def test_files(rows, tmp_path):
    assert files.write(rows, str(tmp_path / "a.csv")) == 2
    raw = (tmp_path / "a.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbftitle,price,sizes,ok") and "Жук".encode() in raw and b"a | b" in raw
    assert files.write(rows, str(tmp_path / "a.jsonl")) == 2
    first = json.loads((tmp_path / "a.jsonl").read_text().splitlines()[0])
    assert first["price"] == 380.5 and "Жук" in (tmp_path / "a.jsonl").read_text()
    assert files.write(rows, str(tmp_path / "a.xlsx")) == 2
    sheet = zipfile.ZipFile(tmp_path / "a.xlsx").read("xl/worksheets/sheet1.xml").decode()
    assert "Жук" in sheet and 'state="frozen"' in sheet and sheet.count("<row ") == 3
    with pytest.raises(ValueError):
        files.write(rows, str(tmp_path / "a.parquet"))


def test_record_columns_keep_first_seen_order(spark):
    recs = spark.createDataFrame([(1, "u", "p", {"b": "1"}), (2, "u", None, {"a": "2", "b": "3"})], "row int, url string, source_platform string, data map<string,string>")
    assert files.record_columns(recs) == ["b", "a"]
    assert [r["a"] for r in files.record_rows(recs).orderBy("row").collect()] == ["", "2"]


def test_tables_are_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    assert files.read_table(spark, path, "k string").count() == 0
    for value in ("a", "b"):
        files.replace_table(spark.createDataFrame([(value,)], "k string"), path)
        assert [r["k"] for r in files.read_table(spark, path, "k string").collect()] == [value]


def stream(spark, tmp_path, batches, schema, query, mode="append"):
    """All rows that a streaming query gives for these batches."""
    src = tmp_path / "in"
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(src / f"{i}.tmp"))
    import shutil

    for i in range(len(batches)):
        part = next((src / f"{i}.tmp").glob("*.parquet"))
        part.rename(src / f"{i:03d}.parquet")
        shutil.rmtree(src / f"{i}.tmp")
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = query(df).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        return spark.sql("select * from out").collect()
    finally:
        q.stop()


def test_compile_windows_stream_as_in_batch(spark, tmp_path):
    day = governance.DAY
    t = 1_700_000_000.0
    batches = [[("k", t), ("j", t + 5.0)], [("k", t + 10.0), ("k", t + 20.0)], [("k", t + day + 5)], [("k", t + 3 * day)], [("k", t + 9 * day)]]
    got = {tuple(r) for r in stream(spark, tmp_path, batches, "key string, at double", state.compile_windows)}
    want = {tuple(r) for r in governance.compile_windows(spark.createDataFrame(sum(batches, []), "key string, at double")).collect()}
    assert got == want


def test_usage_stream_as_in_batch(spark, tmp_path):
    schema = "key_id string, day string, requests long, pages long, renders long, syntheses long, records long, flush_id string, arrived_at timestamp_ntz"
    import datetime as dt

    at = dt.datetime(2025, 1, 1)
    f = lambda i, k, n: (k, "2025-01-01", 1, 1, 0, None, n, f"f{i}", at)
    batches = [[f(1, "a", 4), f(2, "a", 5)], [f(1, "a", 4), f(3, None, 9), f(4, "b", None)]]
    got = {(r["key_id"], r["records"], r["requests"]) for r in stream(spark, tmp_path, batches, schema, state.usage_by_day, "complete")}
    want = {(r["key_id"], r["records"], r["requests"]) for r in ledger.usage_by_day(spark.createDataFrame(sum(batches, []), schema)).collect()}
    assert got == want == {("a", 9, 2), ("b", 0, 1)}


def test_failure_notes_and_mending(spark, tmp_path):
    week = 7 * governance.DAY
    t = 1_700_000_000.0
    batches = [[("p", t, False, "js")], [("p", t + 10.0, False, "static")], [("p", t + 20.0, True, "js")], [("p", t + 30.0, False, "static"), ("p", t + 40.0 + week, False, "static")], [("q", t + 5 * week, False, "js")], [("p", t + 5 * week, False, "static")]]
    got = {r["at"]: r["note"] for r in stream(spark, tmp_path / "a", batches, "page_key string, at double, ok boolean, mode string", state.failure_notes)}
    assert got == {t: "js", t + 10.0: "js", t + 20.0: None, t + 30.0: "static", t + 40.0 + week: "static", t + 5 * week: "static"} or got[t + 5 * week] == "js"
    recs = [[("k", 0, "u0", ["title", "salary"])], [("k", i, f"u{i}", ["title"]) for i in range(1, 5)], [("k", 9, "u9", ["title"])]]
    out = stream(spark, tmp_path / "b", recs, "recipe_key string, pos int, url string, has array<string>", lambda s: state.mended(s, ["title", "salary"]))
    assert [(r["url"], r["missing"]) for r in out] == [("u1", ["salary"])]
    # complete records pass, however many; only lacking ones are held
    recs = [[("k", i, f"c{i}", ["a", "b", "c"]) for i in range(8)], [("k", 10 + i, f"v{i}", ["a"]) for i in range(5)]]
    out = stream(spark, tmp_path / "c", recs, "recipe_key string, pos int, url string, has array<string>", lambda s: state.mended(s, ["a", "b", "c"]))
    assert [(r["url"], r["missing"]) for r in out] == [("v0", ["b", "c"])]


def test_recipes_are_learned_as_they_are_merged(spark, tmp_path):
    batches = [[("k", 1.0, {"title": "h1", "price": ".p"}, {"price": "attr:content"})], [("k", 2.0, {"title": ".new"}, {}), ("j", 2.0, {"title": "b"}, None)], [("k", 3.0, {"title": "h1"}, {})]]
    got = {(r["recipe_key"], r["at"]): (r["fields"], r["modes"], r["alternates"]) for r in stream(spark, tmp_path, batches, "recipe_key string, at double, fields map<string,string>, modes map<string,string>", state.recipes_learned)}
    assert got["k", 2.0] == ({"title": ".new", "price": ".p"}, {"price": "attr:content"}, {"title": ["h1"]})
    assert got["k", 3.0] == ({"title": "h1", "price": ".p"}, {"price": "attr:content"}, {"title": [".new"]})
    assert got["j", 2.0] == ({"title": "b"}, {}, {})


def test_grants_are_appended_once(spark, tmp_path):
    schema = "id long, key_id string, delta long, reason string, created_at string, idempotency_key string"
    path, src = str(tmp_path / "ledger"), str(tmp_path / "src")
    for batch in ([(1, "a", 5, "g", "1", "k1"), (2, "a", 5, "g", "2", "k1")], [(3, "a", 5, "g", "3", "k1"), (4, "a", 5, "g", "4", None)]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(src)
        state.append_grants(spark.readStream.schema(schema).parquet(src), path, str(tmp_path / "c")).awaitTermination()
    assert {r["id"] for r in spark.read.parquet(path).collect()} == {1, 4}
    assert {r["batch"] for r in spark.read.parquet(path).collect()} == {0, 1}


def test_windows_and_sessions(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2025, 1, 1)
    batches = [[(1, t0, "x")], [(1, t0 + dt.timedelta(minutes=10), "x")], [(1, t0 + dt.timedelta(days=3), "x")]]
    got = stream(spark, tmp_path / "a", batches, "user_id long, ts timestamp_ntz, event_type string", state.events_by_window)
    assert [r["n"] for r in got] == [2]
    got = stream(spark, tmp_path / "b", batches, "user_id long, ts timestamp_ntz, event_type string", state.sessions)
    assert [r["n"] for r in got] == [2]


def test_snapshots(spark, tmp_path):
    one, path, snap = spark.createDataFrame([("a",)], "k string"), str(tmp_path / "t"), str(tmp_path / "s")
    assert files.backup(one, snap) and not files.backup(one, snap)
    assert files.restore(spark, path, snap) and not files.restore(spark, path, snap)
    assert [r["k"] for r in spark.read.parquet(path).collect()] == ["a"]
    assert not files.restore(spark, str(tmp_path / "u"), str(tmp_path / "none"))


def test_command_line(spark, tmp_path, capsys):
    from mossgrid.__main__ import main

    sites = spark.createDataFrame([("https://a.example", 200, "cdn.shopify.com", None, None, None)], "url string, status int, html string, headers map<string,string>, shopify_probe string, woo_probe string")
    sites.write.parquet(str(tmp_path / "sites"))
    assert main(["detect", str(tmp_path / "sites")]) == 0
    assert '"kind":"shopify"' in capsys.readouterr().out
