from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from mossgrid.functions import pages
from mossgrid.html.extract import Recipe
from mossgrid.operators import coverage, detect, frontier, governance, ledger
from mossgrid.operators.schema import PRODUCT, Field, Schema, spec_id
from mossgrid.sources import feeds, web


def test_schemas():
    s = Schema.of(["title", "salary:number", "tags:list"])
    assert s.name == spec_id("title:text|salary:number|tags:list") and s.required == ("title",) and s.expected == ("title", "salary", "tags")
    assert PRODUCT.expected == ("title", "price")
    assert [f.name for f in s.struct_type().fields] == ["title", "salary", "salary_text", "salary_note", "tags"]
    with pytest.raises(ValueError):
        Field("a", "what")


def test_coercion(spark):
    s = Schema.of(["salary:number", "note", "tags:list"])
    df = spark.createDataFrame([({"salary": "€72,000", "note": "Label:x", "tags": "a\x1fb"},), ({"salary": "call us"},), ({"salary": "4.5"},), (None,)], "read map<string,string>")
    rows = s.typed(df).collect()
    assert (rows[0]["salary"], rows[0]["salary_text"], rows[0]["note"], rows[0]["tags"]) == (Decimal(72000), "€72,000", "x", ["a", "b"])
    assert (rows[1]["salary"], rows[1]["salary_note"]) == (None, "call us")
    assert (rows[2]["salary"], rows[2]["salary_text"]) == (Decimal("4.5"), None)
    assert rows[3]["salary"] is None


def test_page_kinds(spark):
    html = ['<div id="root"></div>', "<p>" + "text " * 200 + "</p><div id='app'></div>", "", None, "Just a moment... ", "<p>camper Verkocht!</p>", "<nav>verkochte campers</nav>", "<script>sold verkocht</script>"]
    df = spark.createDataFrame(list(enumerate(html)), "i int, h string")
    rows = df.select("i", pages.looks_js_shelled("h").alias("s"), pages.challenge_marker("h").alias("c"), pages.sold_marker("h").alias("g")).orderBy("i").collect()
    assert [r["s"] for r in rows] == [True, False, True, True, False, False, False, False]
    assert rows[4]["c"] == "just a moment..." and rows[0]["c"] is None
    assert [r["g"] for r in rows[5:]] == ["verkocht", None, None]
    body = spark.createDataFrame([(bytearray("né".encode()),), (bytearray("né".encode("latin-1")),)], "b binary")
    assert [r["t"] for r in body.select(pages.decoded("b").alias("t")).collect()] == ["né", "né"]
    heights = spark.createDataFrame([([1, 2, 3, 3],), ([5],), ([],), ([1, 2, 3, 4],)], "h array<int>")
    assert [r["n"] for r in heights.select(pages.scroll_rounds("h", 2).alias("n")).collect()] == [2, 0, 0, 2]


def test_feeds(spark):
    shop = '{"products": [{"handle": "belas", "title": "Belas Trousers", "vendor": "Rick Owens", "body_html": "<p> x </p>", "variants": [{"title": "IT 48", "price": "890.00", "available": false}, {"title": "IT 50", "available": true}], "images": [{"src": "a"}, {"src": ""}]}, {"title": "bare"}]}'
    rows = feeds.shopify(spark.createDataFrame([("https://s.example", shop), ("https://s.example", "no json"), ("https://s.example", None)], "base string, payload string")).collect()
    assert len(rows) == 2
    r = rows[0]
    assert (r["url"], r["brand"], float(r["price"]), r["available"], r["sizes"], r["images"], r["description"]) == ("https://s.example/products/belas", "Rick Owens", 890.0, True, ["IT 48", "IT 50"], ["a"], "x")
    assert rows[1]["available"] is None and rows[1]["price"] is None
    woo = '[{"permalink": "u", "name": "Jacket", "prices": {"price": "24500", "currency_minor_unit": 2, "currency_code": "EUR"}, "short_description": "<b>Slim field jacket.</b>"}, {"name": "x", "prices": {"price": "n/a"}}]'
    rows = feeds.woocommerce(spark.createDataFrame([(woo,)], "payload string")).collect()
    assert (float(rows[0]["price"]), rows[0]["currency"], rows[0]["description"]) == (245.0, "EUR", "Slim field jacket.") and rows[1]["price"] is None
    walk = spark.createDataFrame([("s", 1, 250), ("s", 2, 250), ("s", 3, 10), ("s", 4, 250), ("t", 1, 0)], "site string, page int, n int")
    assert {(r["site"], r["page"]) for r in feeds.full_pages(walk, "site", "page", "n", 250).collect()} == {("s", 1), ("s", 2), ("s", 3), ("t", 1)}


def test_sitemaps_robots_redirects(spark):
    assert web.sitemap_locations("<not xml") == [] and web.sitemap_locations(None) == []
    ns = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> a </loc></url></urlset>'
    assert web.sitemap_locations(ns) == [("a", False)]
    import gzip

    assert web.sitemap_text(gzip.compress(b"x")) == "x" and web.sitemap_text(b"\x1f\x8bbroken") is None
    maps = spark.createDataFrame([("o", "o/sitemap.xml", "<sitemapindex><sitemap><loc>o/a.xml</loc></sitemap><sitemap><loc>o/sitemap.xml</loc></sitemap></sitemapindex>"), ("o", "o/a.xml", ns), ("o", "o/other.xml", ns.replace(" a ", "b"))], "origin string, url string, xml string")
    assert [tuple(r) for r in web.sitemap_pages(maps).collect()] == [("o", "o/a.xml", "a")]
    robots = spark.createDataFrame([("https://a.example", 200, "User-agent: *\nDisallow: /p\nCrawl-delay: 3"), ("https://b.example", 503, None), ("https://c.example", 404, None)], "origin string, status int, body string")
    u = spark.createDataFrame([("https://a.example/p/1",), ("https://a.example/q",), ("https://b.example/q",), ("https://c.example/q",), ("https://d.example/q",)], "url string")
    assert {r["url"]: (r["allowed"], r["crawl_delay"]) for r in web.robots_allow(u, robots, "bot").collect()} == {"https://a.example/p/1": (False, 3.0), "https://a.example/q": (True, 3.0), "https://b.example/q": (False, None), "https://c.example/q": (True, None), "https://d.example/q": (False, None)}
    moves = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "url string, location string")
    got = {r["url"]: r["final_url"] for r in web.resolved_redirects(spark.createDataFrame([("a",), ("x",), ("z",)], "url string"), moves).collect()}
    assert got == {"a": "c", "x": None, "z": "z"}
    two = spark.createDataFrame([("https://a.example", 1.0, 200, "User-agent: *\nDisallow: /"), ("https://a.example", 2.0, 200, "User-agent: *\nAllow: /p/a b\nDisallow: /p")], "origin string, at double, status int, body string")
    u = spark.createDataFrame([("https://a.example/p/a%20b",), ("https://a.example/p/c",), ("https://a.example",), (None,)], "url string")
    assert {r["url"]: r["allowed"] for r in web.robots_allow(u, two, "bot").collect()} == {"https://a.example/p/a%20b": True, "https://a.example/p/c": False, "https://a.example": True, None: False}
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>o/{i}.xml</loc></sitemap>" for i in range(9)) + "</sitemapindex>"
    many = spark.createDataFrame([("o", "o/sitemap.xml", index)] + [("o", f"o/{i}.xml", ns.replace(" a ", f"p{i}")) for i in range(9)], "origin string, url string, xml string")
    assert {r["loc"] for r in web.sitemap_pages(many, 4).collect()} == {"p0", "p1", "p2"}


def test_more_of_the_web(spark):
    fetches = spark.createDataFrame([("a", 0.0, 200, "x"), ("a", 10.0, None, None), ("b", 0.0, 503, None), ("c", 0.0, 404, None)], "origin string, at double, status int, body string")
    assert {r["origin"]: r["due"] for r in web.standing_rules(fetches, 305.0).collect()} == {"a": False, "b": True, "c": False}
    named = spark.createDataFrame([("o", 200, "Sitemap: o/x.xml\nUser-agent: *\nsitemap:  o/sitemap.xml"), ("p", 404, "Sitemap: no")], "origin string, status int, body string")
    assert {tuple(r) for r in web.sitemap_addresses(named).collect()} == {("o", "o/x.xml"), ("o", "o/sitemap.xml"), ("p", "p/sitemap.xml")}
    pages_ = spark.createDataFrame([(None, "r"), ("<div id='root'></div>", "r"), ("text " * 300, "r"), ("", None)], "s string, r string")
    assert [r["v"] for r in pages_.select(web.readable_page(F.col("s"), F.col("r")).alias("v")).collect()] == ["r", "r", "text " * 300, ""]
    import gzip

    body = spark.createDataFrame([(bytearray(gzip.compress(b"<x/>")),), (bytearray(b"<y/>"),), (None,)], "b binary")
    assert [r["t"] for r in body.select(web.unzipped("b").alias("t")).collect()] == ["<x/>", "<y/>", None]


def test_detection(spark):
    rows = [("https://a.example/x", 200, '<script src="https://CDN.shopify.com/x">', None, None, None), ("https://b.example", 200, "", {"X-Wix-Request-Id": "1"}, None, None), ("https://c.example", 403, "wixstatic.com", None, None, None), ("d.example", 200, "plain", None, None, "[]"), ("https://e.example", 200, "wixstatic.com app.ecwid.com", None, '{"products": []}', None), ("https://f.example", 200, None, None, '{"products": 3}', "{}")]
    df = spark.createDataFrame(rows, "url string, status int, html string, headers map<string,string>, shopify_probe string, woo_probe string")
    got = [(r["kind"], r["strategy"], r["likely_needs_js"], r["matched"]) for r in detect.detected(df).collect()]
    assert got == [("shopify", "crawl", False, ["shopify"]), ("wix", "crawl+js", True, ["wix"]), ("blocked", "blocked", False, []), ("woocommerce", "catalog", False, ["woocommerce"]), ("shopify", "catalog", False, ["shopify"]), ("generic", "crawl", False, [])]
    assert detect.platforms(spark).count() == 12


def test_item_links(spark):
    def links(page, hrefs):
        return [(page, i, h, img) for i, (h, img) in enumerate(hrefs)]

    p, q = "https://s.example/l1", "https://s.example/l2"
    rows = links(p, [("https://s.example/products/a", False), ("https://s.example/products/a", True), ("https://s.example/products/b/index.html", False), ("https://x.example/products/c", False), ("https://s.example/l1?page=2", False)])
    rows += links(q, [("https://s.example/shop/1", True), ("https://s.example/journal/1", True), ("https://s.example/shop/2", True), ("https://s.example/shop/3", True)])
    rows += links("https://s.example/l3", [("https://s.example/shop/1", True), ("https://s.example/shop/2", True)])
    df = spark.createDataFrame(rows, "page string, pos int, href string, has_image boolean")
    got = {(r["page"], r["href"]) for r in frontier.item_links(df).collect()}
    assert got == {(p, "https://s.example/products/a"), (p, "https://s.example/products/b/index.html"), *((q, f"https://s.example/shop/{i}") for i in (1, 2, 3))}


def test_siblings_and_kin(spark):
    e = "https://s.example/occasions/voertuig/1/audi-a4"
    cars = [f"https://s.example/occasions/voertuig/{i}/{n}" for i, n in ((2, "bmw"), (3, "opel"), (4, "vw"))]
    rest = ["https://s.example/over/team/jan/bio", "https://s.example/occasions", "https://x.example/occasions/voertuig/9/z"]
    df = spark.createDataFrame([("l", e, h) for h in cars + rest], "listing string, example string, href string")
    assert {r["href"] for r in frontier.siblings(df).collect()} == set(cars)
    assert {r["href"] for r in frontier.siblings(df.where("href like '%bmw' or href like '%over%'")).collect()} == set()
    kin = spark.createDataFrame([("https://s.example/camper/1/", "https://s.example/campers"), ("https://s.example/camper/1/", "https://s.example/camper"), ("https://s.example/camper/1/", "https://s.example/campers/x")], "example string, href string")
    assert [r["href"] for r in frontier.kin_listings(kin).collect()] == ["https://s.example/campers"]
    ex = spark.createDataFrame([("https://s.example/a/b/c", None, ["https://s.example/as"], ["https://s.example/a", "https://s.example/q"])], "example string, named string, kin array<string>, crumbs array<string>")
    assert [r["listing"] for r in frontier.listing_candidates(ex).orderBy("rank").collect()] == ["https://s.example/as", "https://s.example/a/b", "https://s.example/a", "https://s.example/", "https://s.example/q"]


def test_graph_and_rows(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("a", "b")], "src string, dst string")
    got = {r["page"]: r["hop"] for r in frontier.reachable(spark.createDataFrame([("a",)], "page string"), edges, 3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}
    rows = spark.createDataFrame([("s", 1, 0, {"t": "x"}), ("s", 1, 1, {"t": "x"}), ("s", 2, 0, {"t": "y"}), ("s", 3, 0, {"t": "x"}), ("s", 4, 0, {"t": "z"})], "site string, page_no int, card int, data map<string,string>")
    assert {(r["page_no"], r["card"]) for r in frontier.fresh_rows(rows).collect()} == {(1, 0), (2, 0)}
    a = spark.createDataFrame([("e", "u1", 0), ("e", "u2", 1)], "example string, url string, pos int")
    b = spark.createDataFrame([("e", "u2", 0), ("e", "u3", 1)], "example string, url string, pos int")
    assert [r["url"] for r in frontier.by_source([a, b], 2).orderBy("place").collect()] == ["u1", "u2"]


def test_recipes(spark):
    t = "domain string, schema_name string, fields map<string,string>, modes map<string,string>, alternates map<string,array<string>>, item string, needs_js boolean, origin string, compiled_at double"
    old = spark.createDataFrame([("d", "product", {"title": "h1", "price": ".p"}, {"price": "attr:content"}, {"title": ["h2"]}, "", True, None, 1.0)], t)
    new = spark.createDataFrame([("d", "product", {"title": ".new"}, {}, {}, None, False, None, 2.0)], t)
    r = governance.merged_recipes(old, new).first()
    assert (r["fields"], r["modes"], r["alternates"], r["needs_js"]) == ({"title": ".new", "price": ".p"}, {"price": "attr:content"}, {"title": ["h1", "h2"]}, True)
    pages_ = spark.createDataFrame([("https://www.d/x",), ("https://e/x",)], "url string")
    got = {r["url"]: r["fields"] for r in governance.with_recipe(pages_, old.unionByName(new)).collect()}
    assert got == {"https://www.d/x": {"title": ".new"}, "https://e/x": None}
    sale = {"p.price ins .woocommerce-Price-amount": "p.price .woocommerce-Price-amount", ".summary ins.amount": ".summary .amount", ".price .sale-prijs": ".price", "p.price": None, ".sale": None}
    df = spark.createDataFrame([(k,) for k in sale], "s string")
    assert [r["w"] for r in df.select(governance.widened(F.col("s")).alias("w")).collect()] == list(sale.values())
    schema = Schema.of(["price:number", "stock", "cls"])
    html = '<meta name=d content="words only"><i class=p>9 €</i><button class=s>Add</button><b class="c">x</b>'
    assert governance.sound_fields(Recipe({"price": "meta", "stock": ".s", "cls": "b"}, {"price": "attr:content", "cls": "attr:class"}), schema, html, "") == {}
    assert governance.sound_fields(Recipe({"price": ".p", "stock": ".none"}), schema, html, "") == {"price": ".p", "stock": ".none"}
    request = '<i class=p>price on request</i><i class=q>call us</i>'
    assert governance.sound_fields(Recipe({"price": ".p"}), schema, request, "") == {"price": ".p"} and governance.sound_fields(Recipe({"price": ".q"}), schema, request, "") == {}
    sample = spark.createDataFrame([("k", "u", html, {"price": "meta", "stock": ".none"}, {"price": "attr:content", "stock": "text"}, {})], "recipe_key string, url string, html string, fields map<string,string>, modes map<string,string>, alternates map<string,array<string>>")
    r = governance.pruned(sample, schema).first()
    assert (r["fields"], r["modes"]) == ({"stock": ".none"}, {"stock": "text"})
    text = spark.createDataFrame([('Sure: {"fields": {"title": "h1", "price": null}, "item": ".c"} done',), ('{"title": "h1", "price": 3}',), ("no",), (None,)], "t string")
    assert [(r["r"]["fields"], r["r"]["item"]) for r in text.select(governance.recipe_from_text("t").alias("r")).collect()] == [({"title": "h1"}, ".c"), ({"title": "h1"}, None), (None, None), (None, None)]


def test_failures_windows_and_mending(spark):
    day = governance.DAY
    pages_ = spark.createDataFrame([(f"u{i}",) for i in range(4)], "url string")
    failures = spark.createDataFrame([("u0|product", 100.0, "r", "static"), ("u1|product", 100.0, "r", "js"), ("u2|product", 100.0 - 8 * day, "r", "js")], "page_key string, at double, reason string, mode string")
    assert {r["url"] for r in governance.admitted(pages_, failures, 200.0, True).collect()} == {"u0", "u2", "u3"}
    assert {r["url"] for r in governance.admitted(pages_, failures, 200.0, False).collect()} == {"u2", "u3"}
    events = [("k", 0.0), ("k", 10.0), ("k", 20.0), ("k", day + 5), ("k", day + 6)]
    got = [(r["at"], r["n"], r["allowed"]) for r in governance.compile_windows(spark.createDataFrame(events, "key string, at double")).orderBy("at").collect()]
    assert got == [(0.0, 1, True), (10.0, 2, True), (20.0, 3, False), (day + 5, 1, True), (day + 6, 2, True)]
    recs = [("k", i, f"u{i}", {"title": "t"} if i else {"title": "t", "salary": "1"}) for i in range(5)]
    r = governance.to_mend(spark.createDataFrame(recs, "recipe_key string, pos int, url string, read map<string,string>"), ("title", "salary")).collect()
    assert [(x["url"], x["missing"], x["held"]) for x in r] == [("u1", ["salary"], 4)]


def test_ledger(spark):
    t = "id long, key_id string, delta long, reason string, created_at string, idempotency_key string"
    rows = [(1, "a", 10000, "g", "1", "k1"), (1, "a", 10000, "g", "1", "k1"), (2, "a", 10000, "g", "2", "k1"), (3, "a", -350, "s", "3", None), (4, "b", 50, "f", "4", "free:x:2025-01"), (5, "c", -300, "s", "5", None)]
    led = ledger.distinct_entries(spark.createDataFrame(rows, t))
    assert {r["key_id"]: r["balance"] for r in ledger.balances(led).collect()} == {"a": 9650, "b": 50, "c": -300}
    assert {r["key_id"]: r["topped_up"] for r in ledger.topped_up(led).collect()} == {"a": True, "b": False, "c": False}
    assert [r["balance"] for r in ledger.running_balances(led).where("key_id = 'a'").orderBy("id").collect()] == [10000, 9650]
    new = spark.createDataFrame([(9, "a", 1, "g", "9", "k1"), (10, "a", 1, "g", "9", "k2"), (11, "a", 1, "g", "9", "k2"), (12, "a", 1, "g", "9", None), (13, "a", 1, "g", "9", None)], t)
    assert {r["id"] for r in ledger.append_once(led, new).collect()} == {10, 12, 13}
    moved = ledger.moved_balance(led, spark.createDataFrame([("a", "z"), ("c", "z")], "old_id string, new_id string")).collect()
    assert sorted((r["key_id"], r["delta"]) for r in moved) == [("a", -9650), ("z", 9650)]
    keys = spark.createDataFrame([("k", "1", None, "e"), ("l", "2", None, "e"), ("m", "3", "x", "e")], "id string, created_at string, revoked_at string, email_hash string")
    assert ledger.live_keys_by_identity(keys).first()["id"] == "l"
    pay = spark.createDataFrame([("s1", "paid", "k", 5, None), ("k1", "paid", "k", 5, None), ("s2", "open", "k", 5, None), ("s3", "paid", "gone", 5, "e"), ("s4", "paid", None, 5, None)], "session_id string, payment_status string, key_id string, amount long, email_hash string")
    got = {r["session_id"]: (r["outcome"], r["key_id"]) for r in ledger.reconciled(pay, led, keys).collect()}
    assert got == {"s1": ("applied", "k"), "k1": ("already", None), "s2": ("ignored", None), "s3": ("recovered", "l"), "s4": ("orphaned", None)}


def test_coverage(spark):
    df = spark.createDataFrame([("t", Decimal(1), "u"), ("t", None, "u"), ("t", Decimal(2), "u")], "title string, price decimal(10,2), url string")
    assert coverage.coverage(df).first().asDict() == {"total": 3, "usable": 2, "title": 1.0, "price": 0.667, "url": 1.0}
    assert coverage.coverage(df.limit(0)).first()["total"] == 0
    a = spark.createDataFrame([("k", "x", None), ("m", "x", None)], "id string, p string, q string")
    b = spark.createDataFrame([("k", "y", None), ("n", "z", "z")], "id string, p string, q string")
    assert {r["id"]: r["p"] for r in coverage.fuller(a, b, "id", ["p", "q"]).collect()} == {"k": "y", "m": "x", "n": "z"}
