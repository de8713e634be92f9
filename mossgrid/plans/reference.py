"""Queries of the record-extraction operators over the test tables, each with SQL that must
give the same rows. Pages are made from product rows by one template; extraction has to
give the rows back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mossgrid.functions import money, pages, urls
from mossgrid.html import extract
from mossgrid.operators import coverage, detect, frontier, governance, ledger
from mossgrid.operators.schema import PRODUCT, spec_id_column
from mossgrid.session import spread, table
from mossgrid.sinks import files
from mossgrid.sources import feeds, web

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# ── shared pieces of SQL ──────────────────────────────────────────────────────────────────
_P = "(select distinct * from products)"
_CLEANED = "regexp_replace({0}, '[^0-9.,]', '', 'g')"
_PLAIN = """case when {0} like '%,%' and {0} like '%.%' and regexp_matches({0}, ',[^.]*$') then replace(replace({0}, '.', ''), ',', '.')
 when {0} like '%,%' and {0} like '%.%' then replace({0}, ',', '')
 when regexp_matches({0}, '[.,].*[.,]') or regexp_matches({0}, '^[0-9]+[.,][0-9]{{3}}$') then regexp_replace({0}, '[.,]', '', 'g')
 else replace({0}, ',', '.') end"""


def _number(expr: str) -> str:
    """The value of an amount in SQL, as ``functions.money.parse_price`` reads it."""
    return f"try_cast({_PLAIN.format(_CLEANED.format(expr))} as double)"


_TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}\x{{1c}}-\x{{1f}}\x{{85}}]+|[\s\p{{Z}}\x{{1c}}-\x{{1f}}\x{{85}}]+$', '', 'g')"
_HOST = "regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
_PATH = "regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
_DOMAIN = "regexp_replace(lower(" + _HOST + "), '^www\\.', '')"
_ITEM = "case when regexp_replace(regexp_replace(" + _PATH + ", '/+$', ''), '(?i)/index\\.[a-z0-9]{{1,5}}$', '') = '' then '/' else regexp_replace(regexp_replace(" + _PATH + ", '/+$', ''), '(?i)/index\\.[a-z0-9]{{1,5}}$', '') end"
_LABEL = "regexp_replace({0}, '^\\s*[^:\\d]{{1,20}}:([^\\s/])', '\\1')"


def _products(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").dropDuplicates(["product_id"])


# ── money ─────────────────────────────────────────────────────────────────────────────────
@query("price_parse", f"select product_id, {_number('price_text')} as amount from {_P}")
def price_parse(spark, d):
    return _products(spark, d).select("product_id", money.parse_price("price_text").cast("double").alias("amount"))


@query("two_prices", f"""select product_id, len(list_filter(regexp_extract_all(coalesce(price_text, '') || ' ' || coalesce(cast(price as varchar), ''), '([0-9][0-9.,]*[0-9]|[0-9])'), lambda t: coalesce({_number('t')} >= 100, false))) >= 2 as two from {_P}""")
def two_prices(spark, d):
    text = F.concat(F.coalesce("price_text", F.lit("")), F.lit(" "), F.coalesce(F.col("price").cast("string"), F.lit("")))
    return _products(spark, d).select("product_id", money.holds_two_prices(text).alias("two"))


_CUR = r"(?:€|\$|£|¥|₽|zł|kr|CHF|EUR|USD|GBP|PLN|SEK|NOK|DKK)"
_AMT = r"(?:[0-9]{1,3}(?:[ \x{a0}\x{202f}][0-9]{3})+(?:[.,][0-9]{1,2})?|[0-9][0-9.,]*[0-9]|[0-9])"
_NOTE = r"(?i)(?:in[ck]l\.?|ex[ck]l\.?|zzgl\.?|plus|\+)\s*(?:[0-9]+[.,]?[0-9]*\s*%\s*)?(?:btw|vat|mwst|ust|iva|tva|tax|moms)\b\.?"
_MONEY = rf"(?i)(?:{_CUR}\s*)?{_AMT}(?:[,.]-)?(?:\s*{_CUR})?"


@query("money_clean", rf"""with n as (select product_id, price_text as t, regexp_extract(price_text, '{_NOTE}') as note from {_P}),
b as (select *, case when note = '' then t else replace(t, note, '') end as body from n),
m as (select *, regexp_extract_all(body, '{_MONEY}') as all_ from b),
v as (select *, trim(regexp_replace(coalesce(list_filter(all_, lambda a: regexp_matches(a, '(?i)^{_CUR}|{_CUR}$|[,.]-(\s|$|€|\$|£)'))[1], all_[1]), '\s+', ' ', 'g')) as val from m)
select product_id, case when coalesce({_number('val')} = 0, false) then null else val end as amount,
 case when t is null then null when val is null then coalesce(nullif(trim(regexp_replace(note, '\s+', ' ', 'g')), ''), nullif({_TRIM.format('t')}, ''))
      when coalesce({_number('val')} = 0, false) then coalesce(nullif(note, ''), 'price on request') else nullif(trim(regexp_replace(note, '\s+', ' ', 'g')), '') end as note from v""")
def money_clean(spark, d):
    return _products(spark, d).select("product_id", money.clean_money("price_text").alias("m")).select("product_id", F.col("m.value").alias("amount"), "m.note")


@query("label_strip", f"select product_id, {_TRIM.format(_LABEL.format('price_text'))} as stripped from {_P}")
def label_strip(spark, d):
    return _products(spark, d).select("product_id", money.strip_label("price_text").alias("stripped"))


# ── addresses ─────────────────────────────────────────────────────────────────────────────
@query("domain_rollup", f"select {_DOMAIN.format('url')} as domain, count(*) as listings, count(distinct sku) as skus, cast(avg(length(coalesce(description, ''))) as double) as avg_chars from {_P} group by 1")
def domain_rollup(spark, d):
    return _products(spark, d).groupBy(urls.domain_of("url").alias("domain")).agg(F.count("*").alias("listings"), F.count_distinct("sku").alias("skus"), F.avg(F.length(F.coalesce("description", F.lit("")))).alias("avg_chars"))


@query("recipe_keys", f"select product_id, {_DOMAIN.format('url')} || '#job' as cache_key, split_part(url, '#', 1) || '|product' as failure_key, regexp_extract(url, '^([a-z]+)://', 1) || '://' || {_HOST.format('url')} as base from {_P}")
def recipe_keys(spark, d):
    return _products(spark, d).select("product_id", urls.cache_key("url", F.lit("job")).alias("cache_key"), urls.failure_key("url", F.lit("product")).alias("failure_key"), urls.base_of("url").alias("base"))


@query("item_path", f"select product_id, {_ITEM.format('url')} as item_path, regexp_matches({_ITEM.format('url')}, '(?i)/(products?|item|itm|prod|p)/[^/?#]+/?$') as is_product from {_P}")
def item_path(spark, d):
    return _products(spark, d).select("product_id", urls.item_path("url").alias("item_path"), urls.is_product_path("url").alias("is_product"))


@query("ancestor_listings", f"""with p as (select product_id, regexp_extract(url, '^([a-z]+)://', 1) || '://' || {_HOST.format('url')} || '/' as origin, string_split(trim({_ITEM.format('url')}, '/'), '/') as s from {_P}),
a as (select product_id, origin, s, unnest(range(0, len(s))) as up from p)
select product_id, cast(up as integer) as place, case when up = len(s) - 1 then origin else origin || array_to_string(s[1:len(s) - 1 - up], '/') end as listing from a""")
def ancestor_listings(spark, d):
    return _products(spark, d).select("product_id", F.posexplode(urls.ancestors("url")).alias("place", "listing"))


@query("url_shapes", f"""with p as (select {_HOST.format('url')} as host, string_split({_ITEM.format('url')}, '/') as s from {_P})
select host, array_to_string(s[1:len(s) - 1], '/') as prefix, cast(len(s) as integer) as depth, regexp_matches(s[-1], '^[0-9]+$') as tail_is_numeric, count(*) as pages from p group by all""")
def url_shapes(spark, d):
    shape = _products(spark, d).select(urls.url_shape("url").alias("u"))
    return shape.groupBy(F.col("u.host").alias("host"), F.array_join("u.prefix", "/").alias("prefix"), F.col("u.depth").alias("depth"), F.col("u.tail_is_numeric").alias("tail_is_numeric")).agg(F.count("*").alias("pages"))


@query("canonical_dedupe", f"""with p as (select distinct url, regexp_extract(url, '^([a-z]+)://', 1) || '://' || {_HOST.format('url')} as base, regexp_replace({_PATH.format('url')}, '/+$', '') as path,
 array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: regexp_matches(x, '^variant=.+')), '&') as kept from products)
select base || case when path = '' then '/' else path end || case when kept <> '' then '?' || kept else '' end as canonical, count(*) as spellings from p group by 1""")
def canonical_dedupe(spark, d):
    return table(spark, d, "products").select("url").distinct().groupBy(urls.canonical("url", F.array(F.lit("variant"))).alias("canonical")).agg(F.count("*").alias("spellings"))


@query("redirected_away", f"""with p as (select product_id, list_filter(string_split({_PATH.format('url')}, '/'), lambda s: s <> '') as want, list_filter(string_split({_PATH.format("regexp_replace(url, '/[^/?#]+([?#].*)?$', '')")}, '/'), lambda s: s <> '') as got from {_P})
select product_id, len(want) > len(got) and (len(got) = 0 or want[1:len(got)] = got) as gone from p""")
def redirected_away(spark, d):
    final = F.regexp_replace("url", r"/[^/?#]+([?#].*)?$", "")
    return _products(spark, d).select("product_id", urls.redirected_away(F.col("url"), final).alias("gone"))


@query("next_page_guess", """with p as (select distinct url, split_part(split_part(url, '#', 1), '?', 1) as head, list_filter(string_split(regexp_extract(split_part(url, '#', 1), '\\?(.*)$', 1), '&'), lambda x: x <> '' and split_part(x, '=', 1) <> 'page') as kept from products)
select url, head || '?' || array_to_string(list_append(kept, 'page=2'), '&') as next_page from p""")
def next_page_guess(spark, d):
    return table(spark, d, "products").select("url").distinct().select("url", urls.next_page_guess("url", F.lit(2)).alias("next_page"))


@query("siblings_modal", f"""with l as (select distinct {_HOST.format('url')} as host, url, string_split({_ITEM.format('url')}, '/') as s, {_ITEM.format('url')} as p, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) as q from products),
k as (select *, list_sort(list_distinct(list_transform(list_filter(string_split(q, '&'), lambda x: regexp_matches(x, '^[^=]+=.+')), lambda x: split_part(x, '=', 1)))) as keys from l),
e as (select host, min(url) as example from l group by 1), es as (select e.host, e.example, l.s as es, l.p as ep, l.q as eq, l.keys as ekeys from e join k l on l.url = e.example and l.host = e.host),
sc as (select l.*, es.*, case when len(l.s) = len(es.es) then len(list_filter(range(1, len(l.s) + 1), lambda i: l.s[i] = es.es[i])) end as score from k l join es using (host)),
c as (select host, score, count(*) as n from sc where score is not null group by all), m as (select host, arg_max(score, n * 1000 + score) as crowd from c group by 1),
z as (select c.host, sum(n) as size from c join m using (host) where score >= crowd group by 1)
select sc.host as listing, url as href from sc join m using (host) join z using (host)
where case when size >= 3 then coalesce(score >= crowd, false)
 else not (p = ep and q = eq) and case when len(ekeys) > 0 then p = ep and keys = ekeys
  else len(s) = len(es) and s[1:len(s) - 1] = es[1:len(es) - 1] and s[-1] <> '' and regexp_matches(s[-1], '^[0-9]+$') = regexp_matches(es[-1], '^[0-9]+$') end end""")
def siblings_modal(spark, d):
    """Links of the example's kind; hosts with few of them fall back to the example's exact shape."""
    pages_ = table(spark, d, "products").select("url").distinct().withColumn("listing", urls.host("url"))
    example = pages_.groupBy("listing").agg(F.min("url").alias("example"))
    return frontier.siblings(pages_.join(example, "listing").select("listing", "example", F.col("url").alias("href"))).select("listing", "href")


# ── pages ─────────────────────────────────────────────────────────────────────────────────
def _escaped(c: str) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def made_pages(spark: SparkSession, d: str, listings: DataFrame | None = None, kept: tuple[str, ...] = ()) -> DataFrame:
    """One page per listing, holding its fields under every selector that the recipes use."""
    e = _escaped
    html = F.concat(
        F.lit("<html><head><title>"), e("title"), F.lit('</title><style>.x{}</style><script>var a="</p>";</script></head><body><nav class="breadcrumb"><a href="/">Home</a><a href="/all">All</a></nav><div class="head"><h1 class="t-main item-head">'), e("title"),
        F.lit('</h1></div><p class="sum"><del>9.999,-</del><span class="val">'), e("price_text"), F.lit('</span></p><div class="cost"><b>'), e("price_text"), F.lit('</b></div><span class="amount-now" data-cost>'), e("price_text"),
        F.lit('</span><section id="text"><div class="about"><p class="long">'), e("description"), F.lit('</p></div></section><table><tr><td class="code"><span class="art-no">'), e("sku"),
        F.lit('</span></td></tr></table><div class="pics"><img class="shot" src="/img/a.jpg"><img class="shot" src="/img/b.jpg"></div><ul><li class="mk"><a class="by" href="/b"><span class="maker">'), e("brand"), F.lit("</span></a></li></ul></body></html>"),
    )
    p = (listings if listings is not None else _products(spark, d)).select("product_id", "url", "title", "price_text", "description", "sku", "brand", *kept)
    return spread(p).select("product_id", "url", "price_text", html.alias("html"), *kept)


def replayable_pages(spark: SparkSession, d: str, known: str) -> DataFrame:
    """The pages of listings whose site has a recipe for which ``known`` holds: the others are not built."""
    held = governance.with_recipe(_products(spark, d), table(spark, d, "recipes")).where(known)
    return made_pages(spark, d, held, ("fields", "modes", "alternates"))


_TEXTS = _TRIM.format(r"regexp_replace(coalesce({0}, ''), '', '')")


@query("visible_text", rf"""with h as (select product_id, '<p>' || replace(replace(coalesce(description, ''), '&', '&amp;'), '<', '&lt;') || '</p> <script>x</script><div id="app">' || '</div>' as html from {_P}),
t as (select product_id, html, {_TRIM.format(r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[\s\p{{Z}}\x{{1c}}-\x{{1f}}\x{{85}}]+', ' ', 'g')").replace('{{','{').replace('}}','}')} as text from h)
select product_id, cast(length(text) as integer) as chars, length(text) < 600 as shelled from t""")
def visible_text(spark, d):
    body = F.replace(F.replace(F.coalesce("description", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    df = _products(spark, d).select("product_id", F.concat(F.lit("<p>"), body, F.lit('</p> <script>x</script><div id="app"></div>')).alias("html"))
    return df.select("product_id", pages.visible_text_length("html").alias("chars"), pages.looks_js_shelled("html").alias("shelled"))


@query("sold_mark", r"""with w as (select product_id, ' ' || regexp_replace(lower(regexp_replace(case when product_id % 7 = 0 then description || ' <b>Verkocht!</b>' else description end, '<[^>]+>', ' ', 'g')), '[^\p{L}\p{N}]', ' ', 'g') || ' ' as w from (select distinct product_id, description from products))
select product_id, case """ + " ".join(f"when w like '% {m} %' then '{m}'" for m in pages.SOLD) + " end as marker from w")
def sold_mark(spark, d):
    html = F.when(F.col("product_id") % 7 == 0, F.concat("description", F.lit(" <b>Verkocht!</b>"))).otherwise(F.col("description"))
    return _products(spark, d).select("product_id", pages.sold_marker(html).alias("marker"))


_MARKS = " ".join(f"when '{n}' then '{m[0].lower()}'" for n, _, m, _, _ in detect.PLATFORMS)


@query("platform_match", f"select site, case when platform in ({', '.join(repr(n) for n, *_ in detect.PLATFORMS)}) then platform else 'generic' end as kind, platform in ('wix', 'ecwid') is true as likely_needs_js from sites")
def platform_match(spark, d):
    mark = F.coalesce(*[F.when(F.col("platform") == n, F.lit(m[0])) for n, _, m, _, _ in detect.PLATFORMS], F.lit("none"))
    sites = table(spark, d, "sites").select("site", F.concat(F.lit("https://"), "site").alias("url"), F.lit(200).alias("status"), F.concat(F.lit('<html><script src="//'), mark, F.lit('/x.js"></script></html>')).alias("html"), F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast("string").alias("shopify_probe"), F.lit("{}").alias("woo_probe"))
    return detect.detected(sites).select("site", "kind", "likely_needs_js")


@query("page_features", f"select product_id, {_TRIM.format('title')} as title, 2 + 1 as links, 'https://' || {_HOST.format('url')} || '/all' as nearest from {_P}".replace("'https://' ||", "regexp_extract(url, '^([a-z]+)://', 1) || '://' ||"))
def page_features(spark, d):
    f = made_pages(spark, d).withColumn("f", extract.page_features(F.col("html"), F.col("url"), ("title", "links", "crumbs")))
    return f.select("product_id", F.col("f.title").alias("title"), F.size("f.links").alias("links"), F.get("f.crumbs", F.lit(0)).alias("nearest"))


_REPLAY = f"""with r as (select regexp_replace(lower(domain), '^www\\.', '') as domain, arg_max(fields, compiled_at) as fields from recipes where schema_name = 'product' group by 1)
select product_id, case when fields['title'] is not null then nullif({_TRIM.format(_LABEL.format(_TRIM.format('title')))}, '') end as title,
 case when fields['description'] is not null then nullif({_TRIM.format(_LABEL.format(_TRIM.format('description')))}, '') end as description,
 case when fields['sku'] is not null then nullif({_TRIM.format(_LABEL.format(_TRIM.format('sku')))}, '') end as sku,
 case when fields['brand'] is not null then nullif({_TRIM.format(_LABEL.format(_TRIM.format('brand')))}, '') end as brand,
 case when fields['images'] is not null then 2 else 0 end as images
from {_P} p join r on {_DOMAIN.format('p.url')} = r.domain"""


@query("recipe_replay", _REPLAY)
def recipe_replay(spark, d):
    typed = PRODUCT.typed(extract.replayed(replayable_pages(spark, d, "fields is not null"), PRODUCT).select("product_id", "read"))
    empty = lambda c: F.nullif(c, F.lit("")).alias(c)
    return typed.select("product_id", empty("title"), empty("description"), empty("sku"), empty("brand"), F.coalesce(F.size("images"), F.lit(0)).alias("images"))


@query("recipe_prices", f"""with r as (select regexp_replace(lower(domain), '^www\\.', '') as domain, arg_max(fields, compiled_at) as fields from recipes where schema_name = 'product' group by 1),
m as ({SQL["money_clean"]})
select p.product_id, case when len(list_filter(regexp_extract_all(coalesce(price_text, ''), '([0-9][0-9.,]*[0-9]|[0-9])'), lambda t: coalesce({_number('t')} >= 100, false))) < 2 then nullif({_number('m.amount')}, 0) end as price
from {_P} p join r on {_DOMAIN.format('p.url')} = r.domain join m on m.product_id = p.product_id where fields['price'] is not null""")
def recipe_prices(spark, d):
    """The price of every page; a text that holds two prices is left open."""
    typed = PRODUCT.typed(extract.replayed(replayable_pages(spark, d, "fields['price'] is not null"), PRODUCT).select("product_id", "read"))
    return typed.select("product_id", F.nullif(F.col("price").cast("double"), F.lit(0.0)).alias("price"))


@query("rows_mode", f"""with p as (select site, product_id, title, row_number() over (partition by site order by product_id) - 1 as card from {_P})
select site, cast(card as integer) as card, nullif({_TRIM.format(_LABEL.format(_TRIM.format('title')))}, '') as title from p where regexp_matches(title, '\\S')""")
def rows_mode(spark, d):
    card = F.concat(F.lit('<article class="card"><h2 class="n">'), _escaped("title"), F.lit("</h2></article>"))
    shop = _products(spark, d).withColumn("place", F.row_number().over(_by("site", "product_id"))).withColumn("url", F.concat(F.lit("https://"), "site"))
    # a listing page of 50 cards; a site of any size is a row of such pages
    shop = shop.withColumn("page_no", F.floor((F.col("place") - 1) / 50))
    listing = shop.groupBy("site", "url", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", card.alias("c")))), lambda x: x["c"]), "").alias("html"))
    listing = listing.select(F.concat("url", F.lit("/list?page="), "page_no").alias("url"), "html", F.create_map(F.lit("title"), F.lit("article.card .n")).alias("fields"), F.create_map().cast("map<string,string>").alias("modes"), F.create_map().cast("map<string,array<string>>").alias("alternates"), F.lit("article.card").alias("item"))
    rows = extract.replayed_rows(listing, PRODUCT)
    return rows.select(F.regexp_extract("url", "//([^/]*)/", 1).alias("site"), (F.regexp_extract("url", r"page=(\d+)", 1).cast("int") * 50 + F.col("card")).alias("card"), F.nullif(money.strip_label(F.col("read")["title"]), F.lit("")).alias("title"))


def _by(key: str, order: str | None):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(order) if order else Window.partitionBy(key)


@query("json_ld", f"select product_id, coalesce(title, '') as title, nullif(brand, '') as brand, cast(price as double) as price, nullif(currency, '') as currency, available, nullif(sku, '') as sku, cast(len(coalesce(images, [])) as integer) as images from {_P}")
def json_ld(spark, d):
    p = spread(_products(spark, d))
    offer = F.struct(F.col("price").cast("string").alias("price"), F.col("currency").alias("priceCurrency"), F.when(F.col("available"), F.lit("https://schema.org/InStock")).when(~F.col("available"), F.lit("https://schema.org/OutOfStock")).alias("availability"))
    node = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("title").alias("name"), F.struct(F.col("brand").alias("name")).alias("brand"), offer.alias("offers"), F.col("sku").alias("sku"), F.col("images").alias("image")))
    html = F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"@type": "Thing"}, '), F.replace(node, F.lit("</"), F.lit("<\\/")), F.lit("]}</script>"))
    f = p.select("product_id", extract.page_features(html, F.col("url"), ("product", "images")).alias("f"))
    v = F.col("f.product")
    return f.select("product_id", v["title"].alias("title"), v["brand"].alias("brand"), v["price"].try_cast("double").alias("price"), v["currency"].alias("currency"), v["available"].cast("boolean").alias("available"), v["sku"].alias("sku"), F.coalesce(F.size("f.images"), F.lit(0)).alias("images"))


# ── feeds and sources ─────────────────────────────────────────────────────────────────────
@query("woo_feed", f"""select product_id, cast(cast(json_extract_string(raw, '$.prices.price') as decimal(28,0)) / pow(10, cast(json_extract_string(raw, '$.prices.currency_minor_unit') as integer)) as double) as price, json_extract_string(raw, '$.prices.currency_code') as currency from {_P} where raw is not null""")
def woo_feed(spark, d):
    p = _products(spark, d).where("raw is not null")
    item = F.concat(F.lit('[{"permalink": "'), F.col("product_id").cast("string"), F.lit('", '), F.substr("raw", F.lit(2)), F.lit("]"))
    made = feeds.woocommerce(p.select(item.alias("payload")))
    return made.select(F.col("url").cast("long").alias("product_id"), F.col("price").cast("double").alias("price"), "currency")


@query("shopify_feed", f"select 'https://' || site || '/products/' || cast(product_id as varchar) as url, title, nullif(brand, '') as brand, cast(cast(price as decimal(18,2)) as double) as price, available, nullif(sku, '') as sku, sizes from {_P}")
def shopify_feed(spark, d):
    p = _products(spark, d)
    variants = F.transform(F.when(F.size("sizes") > 0, F.col("sizes")).otherwise(F.array(F.lit("Default Title"))), lambda s: F.struct(s.alias("title"), F.col("price").cast("decimal(18,2)").cast("string").alias("price"), F.col("sku").alias("sku"), F.col("available").alias("available")))
    body = F.to_json(F.struct(F.array(F.struct(F.col("product_id").cast("string").alias("handle"), F.col("title").alias("title"), F.col("brand").alias("vendor"), variants.alias("variants"))).alias("products")))
    made = feeds.shopify(p.select(F.concat(F.lit("https://"), "site").alias("base"), body.alias("payload")))
    stock = p.select(F.concat(F.lit("https://"), "site", F.lit("/products/"), F.col("product_id").cast("string")).alias("url"), F.col("available").isNull().alias("open"))
    return made.join(stock, "url").select("url", "title", "brand", F.col("price").cast("double").alias("price"), F.when(~F.col("open"), F.col("available")).alias("available"), "sku", "sizes")


@query("sitemap_pages", f"select distinct 'https://' || site as origin, url as loc from products where url <> ''")
def sitemap_pages(spark, d):
    """Each shop's pages in sitemaps of 100, under an index."""
    shop = table(spark, d, "products").select("site", "url").distinct().withColumn("origin", F.concat(F.lit("https://"), "site"))
    shop = shop.withColumn("part", F.floor((F.row_number().over(_by("site", "url")) - 1) / 100))
    loc = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    parts = shop.groupBy("origin", "part").agg(F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.collect_list(loc), ""), F.lit("</urlset>")).alias("xml")).select("origin", F.concat("origin", F.lit("/map-"), "part", F.lit(".xml")).alias("url"), "xml")
    index = parts.groupBy("origin").agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("xml")).select("origin", F.concat("origin", F.lit("/sitemap.xml")).alias("url"), "xml")
    return web.sitemap_pages(parts.unionByName(index)).select("origin", "loc").distinct()


@query("redirect_chains", """with n as (select site, row_number() over (order by site) - 1 as n from (select distinct site from sites)),
c as (select site, n, max(n) over (partition by n // 13) as last from n)
select c.site as url, case when c.last - c.n <= 10 then e.site end as final_url from c join n e on e.n = c.last""")
def redirect_chains(spark, d):
    """Every site in order moved to the next, in chains of up to 12 hops; beyond 10 the end stays open."""
    from pyspark.sql import Window

    sites = table(spark, d, "sites").select(F.col("site").alias("url")).distinct()
    sites = sites.withColumn("chain", F.floor((F.row_number().over(Window.orderBy("url")) - 1) / 13))
    moves = sites.withColumn("location", F.lead("url").over(_by("chain", "url"))).where("location is not null")
    return web.resolved_redirects(sites.select("url"), moves.select("url", "location"))


@query("item_links", f"""with l as (select distinct site as page, 'https://' || site || regexp_replace(url, '^[a-z]+://[^/]*', '') as href from products),
y as (select page, href, regexp_matches({_ITEM.format('href')}, '(?i)/(products?|item|itm|prod|p)/[^/?#]+/?$') as prod, regexp_replace({_ITEM.format('href')}, '/[^/]*$', '') as parent from l),
d as (select page, bool_or(prod) as direct from y group by 1),
g as (select page, parent, count(*) as n, min(href) as first from y join d using (page) where not direct group by all),
b as (select page, parent, n, row_number() over (partition by page order by n desc, first) as place from g)
select page, href from y join d using (page) where direct and prod
union all select y.page, y.href from y join b using (page, parent) where b.place = 1 and b.n >= 3""")
def item_links(spark, d):
    """The item links of each shop's listing, which holds all its addresses in order."""
    from pyspark.sql import Window

    href = F.concat(F.lit("https://"), "site", F.regexp_replace("url", "^[a-z]+://[^/]*", ""))
    p = table(spark, d, "products").select("site", href.alias("href")).distinct()
    links = p.select(F.concat(F.lit("https://"), "site", F.lit("/list")).alias("page"), F.row_number().over(Window.partitionBy("site").orderBy("href")).alias("pos"), "href", F.lit(True).alias("has_image"))
    return frontier.item_links(links).select(F.regexp_extract("page", "//([^/]*)/", 1).alias("page"), "href")


@query("sitemap_addresses", "select 'https://' || site as origin, unnest(case when platform is null then ['https://' || site || '/sitemap.xml'] else ['https://' || site || '/' || platform || '.xml', 'https://' || site || '/sitemap.xml'] end) as url from sites")
def sitemap_addresses(spark, d):
    origin = F.concat(F.lit("https://"), "site")
    robots = table(spark, d, "sites").select(origin.alias("origin"), F.lit(200).alias("status"), F.when(F.col("platform").isNotNull(), F.concat(F.lit("User-agent: *\nSitemap: "), origin, F.lit("/"), "platform", F.lit(".xml\n"))).alias("body"))
    return web.sitemap_addresses(robots)


@query("page_choice", f"select product_id, case when coalesce(description, '') = '' then 'rendered' else description end as html from {_P}")
def page_choice(spark, d):
    return _products(spark, d).select("product_id", web.readable_page(F.col("description"), F.lit("rendered")).alias("html"))


@query("job_labels", f"select product_id, regexp_replace({_DOMAIN.format('url')} || '-rows-' || strftime(fetched_at, '%Y-%m-%d'), '[^A-Za-z0-9.-]+', '-', 'g') as label from {_P}")
def job_labels(spark, d):
    return _products(spark, d).select("product_id", urls.job_label("url", F.lit("rows"), F.date_format("fetched_at", "yyyy-MM-dd")).alias("label"))


@query("event_windows", "select event_type, date_trunc('day', ts) as day, count(*) as n from events group by all")
def event_windows(spark, d):
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    return table(spark, d, "events").groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("day"), "n")


# ── coverage, export ──────────────────────────────────────────────────────────────────────
@query("coverage_report", f"""select site, count(*) as total, count(*) filter (where coalesce(title <> '', false) and coalesce(price <> 0, false) and coalesce(url <> '', false)) as usable,
 round_even(avg(case when coalesce(title <> '', false) then 1.0 else 0.0 end), 3) as title, round_even(avg(case when coalesce(price <> 0, false) then 1.0 else 0.0 end), 3) as price, round_even(avg(case when coalesce(url <> '', false) then 1.0 else 0.0 end), 3) as url from {_P} group by site""")
def coverage_report(spark, d):
    return coverage.coverage(_products(spark, d), ["site"])


@query("export_rows", f"""select coalesce(title, '') as title, coalesce(brand, '') as brand, coalesce(regexp_replace(regexp_replace(cast(price as varchar), '(\\.[0-9]*?[1-9])0+$', '\\1'), '\\.0+$', ''), '') as price, coalesce(currency, '') as currency,
 case when available then 'True' when not available then 'False' else '' end as available, coalesce(url, '') as url, coalesce(sku, '') as sku, coalesce(array_to_string(sizes, ' | '), '') as sizes, coalesce(array_to_string(images, ' | '), '') as images, coalesce(description, '') as description, coalesce(source_platform, '') as source_platform from {_P}""")
def export_rows(spark, d):
    return files.product_rows(_products(spark, d))


@query("row_dedupe", f"select site, title, brand, min(product_id) as product_id from {_P} group by site, title, brand")
def row_dedupe(spark, d):
    """Rows of a walk with equal values once, where they came first."""
    data = F.create_map(F.lit("title"), F.coalesce("title", F.lit("")), F.lit("brand"), F.coalesce("brand", F.lit("")), F.lit("t"), F.col("title").isNull().cast("string"), F.lit("b"), F.col("brand").isNull().cast("string"))
    rows = _products(spark, d).select("site", "product_id", "title", "brand", frontier.row_fingerprint(data).alias("f"))
    return rows.groupBy("site", "f").agg(F.min_by(F.struct("title", "brand", "product_id"), "product_id").alias("r")).select("site", "r.title", "r.brand", "r.product_id")


@query("schema_ids", "select distinct 'custom-' || substr(sha256(site || ':text|price:number'), 1, 10) as schema_id, site from sites")
def schema_ids(spark, d):
    return table(spark, d, "sites").select(spec_id_column(F.concat("site", F.lit(":text|price:number"))).alias("schema_id"), "site").distinct()


@query("event_json", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def event_json(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


# ── ledger, usage, keys ───────────────────────────────────────────────────────────────────
_LEDGER = """(with once as (select distinct * from credit_ledger) select * from once where idempotency_key is null
 union all select unnest(e) from (select arg_min(o, created_at || lpad(cast(id as varchar), 20, '0')) as e from (select o, id, created_at, idempotency_key from once o) where idempotency_key is not null group by idempotency_key))"""


def _ledger(spark, d):
    return ledger.distinct_entries(table(spark, d, "credit_ledger"))


@query("ledger_balance", f"select key_id, cast(sum(delta) as bigint) as balance, count(*) as entries from {_LEDGER} group by 1")
def ledger_balance(spark, d):
    return ledger.balances(_ledger(spark, d))


@query("ledger_running", f"select id, key_id, delta, cast(sum(delta) over (partition by key_id order by created_at, id) as bigint) as balance from {_LEDGER}")
def ledger_running(spark, d):
    return ledger.running_balances(_ledger(spark, d)).select("id", "key_id", "delta", "balance")


@query("ledger_newest", f"select key_id, id, delta, place from (select *, row_number() over (partition by key_id order by created_at desc, id desc) as place from {_LEDGER}) where place <= 50")
def ledger_newest(spark, d):
    return ledger.newest_entries(_ledger(spark, d), 50).select("key_id", "id", "delta", "place")


@query("topped_up", f"select key_id, bool_or(delta > 0 and not coalesce(idempotency_key like 'free:%', false)) as topped_up from {_LEDGER} group by 1")
def topped_up(spark, d):
    return ledger.topped_up(_ledger(spark, d))


@query("idempotent_append", f"""with old as (select distinct * from credit_ledger where created_at < '2025-07'), new as (select distinct * from credit_ledger where created_at >= '2025-07'),
first as (select idempotency_key, arg_min(id, created_at || lpad(cast(id as varchar), 20, '0')) as id from new where idempotency_key is not null and idempotency_key not in (select idempotency_key from old where idempotency_key is not null) group by 1)
select id from first union all select id from new where idempotency_key is null""")
def idempotent_append(spark, d):
    every = table(spark, d, "credit_ledger").dropDuplicates(["id"])
    return ledger.append_once(every.where("created_at < '2025-07'"), every.where("created_at >= '2025-07'")).select("id")


_FLUSH = "(select distinct on (flush_id) * from usage_days where key_id is not null)"
_SUMS = ", ".join(f"cast(sum(coalesce({m}, 0)) as bigint) as {m}" for m in ("requests", "pages", "renders", "syntheses", "records"))


@query("usage_daily", f"select key_id, day, {_SUMS} from {_FLUSH} group by 1, 2")
def usage_daily(spark, d):
    return ledger.usage_by_day(table(spark, d, "usage_days"))


@query("usage_monthly", f"select key_id, substr(day, 1, 7) as month, {_SUMS} from {_FLUSH} group by 1, 2")
def usage_monthly(spark, d):
    return ledger.usage_by_month(table(spark, d, "usage_days"))


@query("newest_key", "select email_hash, arg_max(id, created_at || id) as id from api_keys where revoked_at is null and email_hash is not null group by 1")
def newest_key(spark, d):
    return ledger.live_keys_by_identity(table(spark, d, "api_keys"))


_PAID = """(select 'cs_' || cast(id as varchar) as session_id, case when id % 5 = 0 then 'open' else 'paid' end as payment_status, case when id % 3 = 0 then null else key_id end as key_id, delta as amount, k.email_hash, idempotency_key
 from (select distinct * from credit_ledger) l left join (select id as kid, email_hash from api_keys) k on k.kid = l.key_id where delta > 0)"""


@query("payment_reconcile", f"""with p as {_PAID}, live as (select id from api_keys where revoked_at is null),
other as (select email_hash, arg_max(id, created_at || id) as other from api_keys where revoked_at is null and email_hash is not null group by 1),
done as (select 'cs_' || cast(id as varchar) as session_id from (select distinct id from credit_ledger where delta > 0 and id % 4 = 0)),
o as (select p.session_id, amount, live.id as own, other, case when payment_status <> 'paid' then 'ignored' when done.session_id is not null then 'already' when live.id is not null then 'applied' when other is not null then 'recovered' else 'orphaned' end as outcome
 from p left join live on live.id = p.key_id left join other on other.email_hash = p.email_hash left join done on done.session_id = p.session_id)
select session_id, amount, outcome, case outcome when 'applied' then own when 'recovered' then other end as key_id from o""")
def payment_reconcile(spark, d):
    keys = table(spark, d, "api_keys")
    paid = table(spark, d, "credit_ledger").dropDuplicates(["id"]).where("delta > 0").join(keys.select(F.col("id").alias("key_id"), "email_hash"), "key_id", "left")
    session = F.concat(F.lit("cs_"), F.col("id").cast("string"))
    payments = paid.select(session.alias("session_id"), F.when(F.col("id") % 5 == 0, "open").otherwise("paid").alias("payment_status"), F.when(F.col("id") % 3 != 0, F.col("key_id")).alias("key_id"), F.col("delta").alias("amount"), "email_hash")
    granted = paid.where("id % 4 = 0").select(session.alias("idempotency_key"))
    return ledger.reconciled(payments, granted, keys)


@query("rate_limit_24h", "select event_id, count(*) over (partition by user_id, event_type order by ts range between interval 24 hours preceding and current row) as recent from events")
def rate_limit_24h(spark, d):
    return ledger.recent_count(table(spark, d, "events"), "user_id", "event_type", "ts", 24).select("event_id", "recent")


@query("budget_rows", "select event_id from (select *, row_number() over (partition by user_id order by ts, event_id) as n from events) where n <= 3")
def budget_rows(spark, d):
    """The first three events of each user: a budget per key."""
    return ledger.within_budget(table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], 3).select("event_id")


@query("failure_filter", """with f as (select user_id, max(epoch(ts)) as last_at, arg_max(case when event_id % 2 = 0 then 'js' else 'static' end, epoch(ts)) as mode from events where event_type = 'error' group by 1),
u as (select distinct user_id from events), n as (select max(epoch(ts)) as now_at from events)
select u.user_id from u left join f using (user_id), n where not coalesce(now_at - last_at < 604800 and not (mode = 'static'), false)""")
def failure_filter(spark, d):
    e = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    now = e.agg(F.max("at")).first()[0] or 0.0
    pages_ = e.select("user_id").distinct().withColumn("url", F.concat(F.lit("https://u.example/"), F.col("user_id").cast("string")))
    failures = e.where("event_type = 'error'").select(urls.failure_key(F.concat(F.lit("https://u.example/"), F.col("user_id").cast("string")), F.lit("product")).alias("page_key"), "at", F.when(F.col("event_id") % 2 == 0, "js").otherwise("static").alias("mode"))
    last = failures.groupBy("page_key").agg(F.max_by(F.struct("at", "mode"), "at").alias("f"))
    joined = pages_.withColumn("page_key", urls.failure_key("url", F.lit("product"))).join(last, "page_key", "left")
    return joined.where(~governance.recently_failed(F.col("f.at"), F.col("f.mode"), F.lit(now), F.lit(True))).select("user_id")


@query("site_graph", """with recursive e as (select distinct site as src, lead(site, 1, site) over (order by site) as dst from sites union select site, lead(site, 7, site) over (order by site) from sites),
r as (select (select min(site) from sites) as page, 0 as hop union select e.dst, r.hop + 1 from r join e on e.src = r.page where r.hop < 5)
select page, cast(min(hop) as integer) as hop from r group by 1""")
def site_graph(spark, d):
    """Pages within five hops of the first site, each site linking to the next and the seventh after it."""
    from pyspark.sql import Window

    s = table(spark, d, "sites").select("site")
    order = Window.orderBy("site")
    edges = s.select("site", F.lead("site", 1).over(order).alias("a"), F.lead("site", 7).over(order).alias("b")).select(F.col("site").alias("src"), F.explode(F.array("a", "b")).alias("dst")).where("dst is not null")
    return frontier.reachable(s.agg(F.min("site").alias("page")), edges, 5)
