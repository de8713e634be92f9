"""Platforms of sites, told from catalogue probes and marks in their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mossgrid.functions.pages import is_blocked
from mossgrid.functions.urls import base_of

#: Name; catalogue path; marks in pages; marks in headers; drawn in the browser.
PLATFORMS = (
    ("shopify", "/products.json", ("cdn.shopify.com", "Shopify.theme", "shopify-features"), ("x-shopify-stage", "x-shopid"), False),
    ("woocommerce", "/wp-json/wc/store/products", ("woocommerce", "wp-content/plugins/woocommerce"), (), False),
    ("magento", None, ("magento_", "/static/version", "mage/cookies", 'data-role="main-css-loader"'), ("x-magento-vary", "x-magento-cache-debug"), False),
    ("bigcommerce", None, ("cdn11.bigcommerce.com", "bigcommerce.com/s-", "stencil-utils"), (), False),
    ("salesforce-commerce", None, ("/on/demandware.store/", "demandware.static", "dwvar_"), (), False),
    ("squarespace", None, ("static1.squarespace.com", "squarespace-cdn.com", "squarespace.afterbodyload", "sqs-block"), (), False),
    ("wix", None, ("wixstatic.com", "wix-warmup-data", "_wixcidx", "wixsite.com"), ("x-wix-request-id",), True),
    ("webflow", None, ("data-wf-site", "webflow.js", "assets.website-files.com", "cdn.prod.website-files.com"), (), False),
    ("prestashop", None, ("prestashop", "/modules/ps_", "js/jquery/plugins"), (), False),
    ("shopware", None, ("/bundles/storefront/", "shopware.config", "csrf/generate"), (), False),
    ("ecwid", None, ("app.ecwid.com", "ecwid.com/script.js", "ecwid_"), (), True),
    ("opencart", None, ("catalog/view/theme", "index.php?route=product"), (), False),
)


def platforms(spark: SparkSession) -> DataFrame:
    """The registry as a table of twelve rows."""
    rows = [(i, n, c, list(m), list(h), js) for i, (n, c, m, h, js) in enumerate(PLATFORMS)]
    return spark.createDataFrame(rows, "place int, name string, catalog_path string, marks array<string>, header_marks array<string>, client_side boolean")


def matched(html: Column | str, headers: Column | None = None) -> Column:
    """Names of the platforms whose marks a page or its headers hold, in the registry's order.

    The registry is fixed, so the theta join is unrolled into one expression per row of it."""
    low = F.lower(F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit("")))
    blob = F.lit("")
    if headers is not None:
        blob = F.lower(F.coalesce(F.array_join(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), " "), F.lit("")))
    hits = []
    for name, _, marks, header_marks, _ in PLATFORMS:
        hit = F.lit(False)
        for m in marks:
            hit = hit | low.contains(m.lower())
        for m in header_marks:
            hit = hit | blob.contains(m.lower())
        hits.append(F.when(hit, F.lit(name)))
    return F.filter(F.array(*hits), lambda n: n.isNotNull())


def valid_catalog(payload: Column, platform: str) -> Column:
    """A probe's payload is this platform's catalogue: an object with a list of products, or a list."""
    v = F.try_parse_json(payload)
    if platform == "shopify":
        return F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.products", "variant")).startswith("ARRAY"), F.lit(False))
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def detected(sites: DataFrame) -> DataFrame:
    """``sites(url, status, html, headers, shopify_probe, woo_probe)`` with ``kind``, ``base``,
    ``catalog_endpoint``, ``strategy``, ``likely_needs_js`` and ``matched``. Probes decide, then
    a refusal, then marks."""
    base = base_of("url")
    shop, woo = valid_catalog(F.col("shopify_probe"), "shopify"), valid_catalog(F.col("woo_probe"), "woocommerce")
    df = sites.withColumn("_m", matched("html", F.col("headers"))).withColumn("base", base).withColumn("_shop", shop).withColumn("_woo", woo)
    probed = F.col("_shop") | F.col("_woo")
    client = [n for n, *_, js in PLATFORMS if js]
    js = ~probed & ~is_blocked("status") & F.arrays_overlap("_m", F.array(*map(F.lit, client)))
    kind = F.when(F.col("_shop"), "shopify").when(F.col("_woo"), "woocommerce").when(is_blocked("status"), "blocked").otherwise(F.coalesce(F.get("_m", F.lit(0)), F.lit("generic")))
    return df.select(
        *sites.columns,
        "base",
        kind.alias("kind"),
        F.when(F.col("_shop"), F.concat("base", F.lit("/products.json"))).when(F.col("_woo"), F.concat("base", F.lit("/wp-json/wc/store/products"))).alias("catalog_endpoint"),
        F.when(probed, "catalog").when(is_blocked("status"), "blocked").when(js, "crawl+js").otherwise("crawl").alias("strategy"),
        F.coalesce(js, F.lit(False)).alias("likely_needs_js"),
        F.when(probed, F.array(kind)).when(is_blocked("status"), F.array().cast("array<string>")).otherwise(F.col("_m")).alias("matched"),
    )
