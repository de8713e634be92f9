"""Catalogue feeds (JSON payloads) as product rows, by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mossgrid.functions.money import DECIMAL, parse_price
from mossgrid.functions.pages import strip_html

_SHOPIFY = (
    "products array<struct<handle:string,title:string,vendor:string,body_html:string,"
    "variants:array<struct<title:string,price:string,sku:string,available:boolean>>,images:array<struct<src:string>>>>"
)
_WOO_ITEM = (
    "struct<permalink:string,name:string,sku:string,short_description:string,description:string,is_in_stock:boolean,"
    "prices:struct<price:string,currency_code:string,currency_minor_unit:string>,images:array<struct<src:string>>>"
)
COLUMNS = ("url", "title", "brand", "price", "currency", "available", "images", "sizes", "description", "sku", "source_platform")


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _sources(images: Column) -> Column:
    return F.coalesce(F.filter(F.transform(images, lambda i: i["src"]), lambda s: F.coalesce(s != "", F.lit(False))), F.array().cast("array<string>"))


def shopify(feed: DataFrame) -> DataFrame:
    """``feed(base, payload)`` to products: price and sku of the first variant, available
    if any variant is, sizes the variants' titles. A payload that is no feed gives no row."""
    p = feed.select("base", F.explode(F.from_json("payload", _SHOPIFY)["products"]).alias("p"))
    variants = F.col("p.variants")
    first = F.get(variants, F.lit(0))
    return p.select(
        F.concat("base", F.lit("/products/"), F.coalesce("p.handle", F.lit(""))).alias("url"),
        F.coalesce("p.title", F.lit("")).alias("title"),
        _filled(F.col("p.vendor")).alias("brand"),
        parse_price(first["price"]).alias("price"),
        F.lit(None).cast("string").alias("currency"),
        F.when(F.size(variants) > 0, F.exists(variants, lambda v: F.coalesce(v["available"], F.lit(False)))).alias("available"),
        _sources(F.col("p.images")).alias("images"),
        F.coalesce(F.filter(F.transform(variants, lambda v: v["title"]), lambda t: F.coalesce((t != "") & (t != "Default Title"), F.lit(False))), F.array().cast("array<string>")).alias("sizes"),
        strip_html("p.body_html").alias("description"),
        _filled(first["sku"]).alias("sku"),
        F.lit("shopify").alias("source_platform"),
    )


def minor_price(price: Column, minor_unit: Column) -> Column:
    """A price in minor units as a decimal; null where either is no whole number."""
    units = price.try_cast("decimal(28,0)")
    digits = F.coalesce(minor_unit.try_cast("int"), F.when(minor_unit.isNull(), F.lit(2)))
    steps = F.coalesce(*[F.when(digits == n, F.lit(10**-n).cast("decimal(9,8)") if n else F.lit(1).cast("decimal(9,8)")) for n in range(5)])
    return F.when(price.rlike(r"^\s*[+-]?\d+\s*$"), units * steps).cast(DECIMAL)


def woocommerce(feed: DataFrame) -> DataFrame:
    """``feed(payload)`` (a JSON array) to products: prices come in minor units."""
    p = feed.select(F.explode(F.from_json("payload", f"array<{_WOO_ITEM}>")).alias("p"))
    return p.select(
        F.coalesce("p.permalink", F.lit("")).alias("url"),
        F.coalesce("p.name", F.lit("")).alias("title"),
        F.lit(None).cast("string").alias("brand"),
        minor_price(F.col("p.prices.price"), F.col("p.prices.currency_minor_unit")).alias("price"),
        _filled(F.col("p.prices.currency_code")).alias("currency"),
        F.col("p.is_in_stock").alias("available"),
        _sources(F.col("p.images")).alias("images"),
        F.array().cast("array<string>").alias("sizes"),
        strip_html(F.coalesce(_filled(F.col("p.short_description")), F.col("p.description"))).alias("description"),
        _filled(F.col("p.sku")).alias("sku"),
        F.lit("woocommerce").alias("source_platform"),
    )


def full_pages(pages: DataFrame, key: str, number: str, items: str, limit: int, most: int = 20) -> DataFrame:
    """The pages a walk through a paged feed reads: up to the first that is not full, at most ``most``."""
    from pyspark.sql import Window

    before = Window.partitionBy(key).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    n = F.size(F.col(items)) if dict(pages.dtypes)[items].startswith("array") else F.col(items)
    return pages.withColumn("_short", F.coalesce(F.bool_or(n < limit).over(before), F.lit(False))).where(~F.col("_short") & (F.col(number) <= most)).drop("_short")
