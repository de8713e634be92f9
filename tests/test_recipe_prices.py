"""Prices read by recipes, against known values."""

import time

import pytest
from pyspark.sql import functions as F

from mossgrid.html import extract
from mossgrid.operators.schema import PRODUCT
from mossgrid.plans import registry

PRICES = {
    "96,90": 96.9, "13.791": 13791, "792 EUR": 792, "1.234,56 Euro inkl. 19% MwSt.": 1234.56, "€ 31.850,-excl. BTW": 31850, "13 330,12": 13330.12, "1,073.65": 1073.65, "Angebot102,67 Euro": 102.67, "Preis:98,20 EUR": 98.2,
    "2,999,-1,899,-": None, "682 333,21 SEK": None, "€ 0,00": None, "Preis auf Anfrage": None, None: None,
}
HTML = {
    '<p class="val"><del>1.299,00 €</del><ins>999,00 €</ins></p>': 999, '<p class="val"><span class="old-price">149,90</span> 99,90</p>': 99.9, '<del class="val">1.299,00</del><b class="val">999,00</b>': 999,
    '<p class="val">1.299,00 € 999,00 €</p>': None, '<p class="val">792&nbsp;000</p>': 792000, '<p class="val">1.234,56 incl. 21% btw</p>': 1234.56,
}


def test_every_price_text(spark, tmp_path):
    rows = [(i, f"https://shop.example/p/{i}", "t", p, "d", "s", "b") for i, p in enumerate(PRICES)]
    spark.createDataFrame(rows, "product_id long, url string, title string, price_text string, description string, sku string, brand string").write.parquet(f"{tmp_path}/products.parquet")
    recipe = [("shop.example", "product", {"price": "p.sum .val"}, {}, {}, None, False, time.time())]
    spark.createDataFrame(recipe, "domain string, schema_name string, fields map<string,string>, modes map<string,string>, alternates map<string,array<string>>, item string, needs_js boolean, compiled_at double").write.parquet(f"{tmp_path}/recipes.parquet")
    got = {r["product_id"]: r["price"] for r in registry.queries()["recipe_prices"](spark, str(tmp_path)).collect()}
    assert {p: got[i] for i, p in enumerate(PRICES)} == {p: None if v is None else pytest.approx(v) for p, v in PRICES.items()}


def test_struck_and_double_prices(spark):
    pages = spark.createDataFrame([(i, "https://shop.example", h) for i, h in enumerate(HTML)], "i int, url string, html string")
    recipe = pages.withColumns({"fields": F.create_map(F.lit("price"), F.lit(".val")), "modes": F.create_map().cast("map<string,string>"), "alternates": F.create_map().cast("map<string,array<string>>")})
    got = PRODUCT.typed(extract.replayed(recipe, PRODUCT).select("i", "read")).select("i", F.col("price").cast("double").alias("price")).collect()
    assert {h: {r["i"]: r["price"] for r in got}[i] for i, h in enumerate(HTML)} == HTML
