import pytest
from pyspark.sql import functions as F

from mossgrid.functions import urls


def values(spark, rows, column, names=("a", "b")):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names))
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_domains_and_keys(spark):
    rows = [("https://www.Antonioli.eu/products/x", "product"), ("site.example.com/a?b#c", "job"), ("http://h.example:8080/p#top", "product"), (None, "job")]
    assert values(spark, rows, urls.domain_of("a")) == ["antonioli.eu", "site.example.com", "h.example:8080", None]
    assert values(spark, rows, urls.cache_key("a", F.col("b"))) == ["antonioli.eu", "site.example.com#job", "h.example:8080", None]
    assert values(spark, rows, urls.failure_key("a", F.col("b")))[2] == "http://h.example:8080/p|product"
    assert values(spark, rows, urls.base_of("a"))[:3] == ["https://www.Antonioli.eu", "https://site.example.com", "http://h.example:8080"]


def test_item_paths_and_ancestors(spark):
    rows = [("https://a.example/occasions/voertuig/56896140/volkswagen-taigo", ""), ("https://a.example/thing/index.html", ""), ("https://a.example", "")]
    assert values(spark, rows, urls.item_path("a")) == ["/occasions/voertuig/56896140/volkswagen-taigo", "/thing", "/"]
    assert values(spark, rows, urls.ancestors("a"))[0] == ["https://a.example/occasions/voertuig/56896140", "https://a.example/occasions/voertuig", "https://a.example/occasions", "https://a.example/"]
    assert values(spark, rows, urls.ancestors("a"))[1:] == [["https://a.example/"], ["https://a.example/"]]


def test_shapes(spark):
    e = "https://a.example/products/blue-lamp"
    rows = [(e, "https://a.example/products/red-chair"), (e, "https://a.example/products/x/y"), (e, "https://a.example/items/x"), (e, "https://b.example/products/x"), (e, e), (e, "https://a.example/products/123"), ("https://a.example/d?id=1", "https://a.example/d?id=2"), ("https://a.example/d?id=1", "https://a.example/d?x=2"), (e, "ftp://a.example/products/z")]
    assert values(spark, rows, urls.same_shape("b", urls.url_shape("a"))) == [True, False, False, False, False, False, True, False, False]


def test_redirects_canonical_and_next(spark):
    rows = [("https://a.example/s/car/1", "https://a.example/s"), ("https://a.example/s/car/1", "https://b.example/"), ("http://a.example/s/car", "https://www.a.example/s/car/"), ("https://a.example/", "https://a.example/"), ("https://a.example/s/car/1", "https://a.example/t")]
    assert values(spark, rows, urls.redirected_away("a", "b")) == [True, True, False, False, False]
    rows = [("https://a.example/p/?share=x&id=3#t", ""), ("https://a.example?x=", "")]
    assert values(spark, rows, urls.canonical("a", F.array(F.lit("id")))) == ["https://a.example/p?id=3", "https://a.example/"]
    assert values(spark, [("https://a.example/l?q=&page=1&x=2#f", "")], urls.next_page_guess("a", F.lit(2))) == ["https://a.example/l?q=&x=2&page=2"]


def test_joining_and_networks(spark):
    rows = [("https://a.example/x/y", "../z"), ("https://a.example/x", "//b.example/q"), (None, "z"), ("https://a.example", None), ("https://[", "z")]
    assert values(spark, rows, urls.joined("a", "b")) == ["https://a.example/z", "https://b.example/q", None, None, None]
    assert values(spark, [("10.1.2.3", ""), ("2001:db8:1:2:3::4", ""), ("name", ""), (None, "")], urls.network_of("a")) == ["10.1.2.0/24", "2001:db8:1:2::/64", "name", None]


@pytest.mark.parametrize("url, why", [("https://8.8.8.8/", None), ("http://127.0.0.1/", "not public"), ("http://0177.0.0.1/", "not public"), ("http://2130706433/", "not public"), ("http://127.1/", "not public"), ("http://[::ffff:10.0.0.1]/", "not public"), ("http://169.254.169.254/", "not public"), ("ftp://a.example/", "scheme"), ("https:///x", "host"), ("", "empty"), ("https://shop.example/", None)])
def test_refusals(spark, url, why):
    df = spark.createDataFrame([(url, None)], "a string, k array<string>")
    assert df.select(urls.refusal("a", "k").alias("v")).first()["v"] == why


def test_resolved_names_must_all_be_public(spark):
    df = spark.createDataFrame([("https://x.example/", ["8.8.8.8"]), ("https://x.example/", ["8.8.8.8", "10.0.0.1"])], "a string, k array<string>")
    assert [r["v"] for r in df.select(urls.refusal("a", "k").alias("v")).collect()] == [None, "not public"]
