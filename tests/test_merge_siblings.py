from mossgrid.plans import registry

RECIPE = "domain string, schema_name string, fields map<string,string>, modes map<string,string>, alternates map<string,array<string>>, item string, needs_js boolean, origin string, compiled_at double"


def test_merge_of_halves(spark, tmp_path):
    row = ("a.example", "product", {"title": "h1", "images": ".pics img", "sku": ".code"}, {"images": "attr:src", "sku": "text"}, {"title": ["h1.t"]}, None, False, None, 1.0)
    spark.createDataFrame([row], RECIPE).write.parquet(f"{tmp_path}/recipes.parquet")
    (got,) = registry.queries()["recipe_merge_halves"](spark, str(tmp_path)).collect()
    assert got["fields"] == "images=.pics img;sku=body .code;title=h1"
    assert got["modes"] == "images=attr:src;sku=text"
    assert got["alternates"] == "title=h1.t|body h1"


def test_small_hosts_keep_the_shape_of_the_example(spark, tmp_path):
    urls = ["https://b.example/p/a", "https://b.example/p/b", "https://c.example/p/a", "https://c.example/q/r/s"] + [f"https://d.example/p/{i}" for i in range(5)]
    spark.createDataFrame([(u,) for u in urls], "url string").write.parquet(f"{tmp_path}/products.parquet")
    got = {r["href"] for r in registry.queries()["siblings_modal"](spark, str(tmp_path)).collect()}
    assert got - {urls[0], urls[2]} == {urls[1], *urls[4:]}
