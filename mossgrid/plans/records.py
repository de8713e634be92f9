"""More queries of the record operators, each with SQL that must give the same rows: coercion,
by-example discovery, walks of pages, recipes proved wrong, refusals, ceilings and mending."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mossgrid.functions import money, pages, urls
from mossgrid.html import extract
from mossgrid.operators import coverage, detect, frontier, governance, ledger
from mossgrid.operators.schema import PRODUCT, Schema
from mossgrid.plans.reference import _CLEANED, _DOMAIN, _HOST, _ITEM, _LABEL, _LEDGER, _P, _PATH, _PLAIN, _TRIM, SQL, _ledger, _number, _products, query
from mossgrid.session import spread, table
from mossgrid.sinks import files
from mossgrid.sources import web

_MONEY = f"({SQL['money_clean']})"
_ORIGIN = "regexp_extract({0}, '^([a-z]+)://', 1) || '://' || " + _HOST


def _cases(column: str, *values: str) -> str:
    """SQL that picks one of ``values`` by the remainder of a column."""
    return f"case {column} % {len(values)} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


def _pick(column: str, *values) -> F.Column:
    n = F.col(column) % len(values)
    return F.coalesce(*[F.when(n == i, v if not isinstance(v, str) else F.lit(v)) for i, v in enumerate(values)])


# ── fields ────────────────────────────────────────────────────────────────────────────────
_PRICE_OF = f"(select product_id, amount, note, {_number('amount')} as number, {_PLAIN.format(_CLEANED.format('amount'))} as plain from {_MONEY})"


@query("coerced_prices", f"""select product_id, number as price, case when number is not null and {_TRIM.format('amount')} <> plain then amount end as price_text, note as price_note, {_TRIM.format(_LABEL.format('currency'))} as stock
from {_PRICE_OF} join (select product_id as pid, currency from {_P}) on pid = product_id""")
def coerced_prices(spark, d):
    """Money with its text and note, and a stock text, as a schema coerces them."""
    read = F.create_map(F.lit("price"), F.col("price_text"), F.lit("stock"), F.col("currency"))
    typed = Schema.of(["price:number", "stock"]).typed(_products(spark, d).select("product_id", read.alias("read")))
    return typed.select("product_id", F.col("price").cast("double").alias("price"), "price_text", "price_note", "stock")


@query("satisfied", f"""select m.product_id, coalesce({_TRIM.format(_LABEL.format('title'))} <> '', false) and (coalesce(number <> 0, false) or coalesce(note <> '', false)) as ok
from {_PRICE_OF} m join (select product_id, title from {_P}) p on p.product_id = m.product_id""")
def satisfied(spark, d):
    """Rows whose required fields answer; a note answers for a price."""
    read = F.create_map(F.lit("title"), F.col("title"), F.lit("price"), F.col("price_text"))
    typed = PRODUCT.typed(_products(spark, d).select("product_id", read.alias("read")))
    return typed.select("product_id", PRODUCT.satisfied(typed).alias("ok"))


@query("stripped_html", f"select product_id, nullif({_TRIM.format("regexp_replace('<p class=\"a\">' || description || '</p><br/>', '<[^>]+>', '', 'g')")}, '') as text from {_P}")
def stripped_html(spark, d):
    html = F.concat(F.lit('<p class="a">'), "description", F.lit("</p><br/>"))
    return _products(spark, d).select("product_id", pages.strip_html(html).alias("text"))


@query("stated_prices", f"select product_id, cast(cast(price as decimal(18,2)) as double) as price from {_P}")
def stated_prices(spark, d):
    """A visible price without its cents, beside the machine-readable one that agrees with it."""
    exact = F.col("price").cast("decimal(18,2)")
    html = F.concat(F.lit('<div data-price="'), exact.cast("string"), F.lit('"><b>Now</b><span class="v">€ '), F.floor(exact).cast("string"), F.lit("</span></div>"))
    p = spread(_products(spark, d)).select("product_id", F.lit("https://s.example").alias("url"), html.alias("html"), F.create_map(F.lit("price"), F.lit(".v")).alias("fields"), F.create_map().cast("map<string,string>").alias("modes"), F.create_map().cast("map<string,array<string>>").alias("alternates"))
    return PRODUCT.typed(extract.replayed(p, PRODUCT).select("product_id", "read")).select("product_id", F.col("price").cast("double").alias("price"))


# ── kinds of pages ────────────────────────────────────────────────────────────────────────
_PHRASES = (*pages.CHALLENGES, "a plain page")


@query("challenge_phrases", f"select product_id, {_cases('product_id', *[f"'{p}'" for p in pages.CHALLENGES], 'null')} as marker from {_P} where title is not null and not regexp_matches(lower(title), '{'|'.join(p.replace('.', '.').replace('|', '.') for p in pages.CHALLENGES)}')")
def challenge_phrases(spark, d):
    """Every phrase of challenge pages, in capitals too, beside titles that hold none."""
    held = F.coalesce(*[F.lower("title").contains(p) for p in pages.CHALLENGES[:1]])
    for p in pages.CHALLENGES[1:]:
        held = held | F.lower("title").contains(p)
    html = F.concat(F.lit("<p>"), "title", F.lit("</p>"), _pick("product_id", *[F.lit(p.upper() if i % 2 else p) for i, p in enumerate(_PHRASES)]))
    return _products(spark, d).where(F.col("title").isNotNull() & ~held).select("product_id", pages.challenge_marker(html).alias("marker"))


@query("declared_charsets", f"select product_id, case when product_id % 3 = 0 or not regexp_matches(title, '^[\\x00-\\x{{ff}}]*$') then title when product_id % 3 = 1 then title else title || 'é ' end as text from {_P} where title is not null")
def declared_charsets(spark, d):
    """UTF-8 without a charset, ISO-8859-1 with one, and ISO-8859-1 bytes that are no UTF-8 without one."""
    latin, kind = F.col("title").rlike(r"^[\x00-\xff]*$"), F.col("product_id") % 3
    body = F.when(~latin | (kind == 0), F.encode("title", "UTF-8")).when(kind == 1, F.encode(F.when(latin, F.col("title")), "ISO-8859-1")).otherwise(F.encode(F.when(latin, F.concat("title", F.lit("é "))), "ISO-8859-1"))
    declared = F.when(latin & (kind == 1), F.lit("iso-8859-1"))
    return _products(spark, d).where("title is not null").select("product_id", pages.decoded(body, declared).alias("text"))


@query("blocked_statuses", "select event_id, (400 + event_id % 40) in (401, 403, 429) as blocked from events")
def blocked_statuses(spark, d):
    return table(spark, d, "events").select("event_id", pages.is_blocked(F.lit(400) + F.col("event_id") % 40).alias("blocked"))


@query("scroll_rounds", """with h as (select user_id, list(cast(floor(value) as bigint) order by event_id) as h from events group by 1)
select user_id, cast(least(coalesce(list_min(list_filter(range(1, len(h)), lambda i: h[i + 1] <= h[i])), greatest(len(h) - 1, 0)), 12) as integer) as rounds from h""")
def scroll_rounds(spark, d):
    """Rounds until a page's height, here the values of a user's events in order, grows no more."""
    h = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.floor("value").alias("v")))), lambda x: x["v"]).alias("h"))
    return h.select("user_id", pages.scroll_rounds("h", 12).cast("int").alias("rounds"))


@query("catalog_probes", """with s as (select site, length(site) as n from sites)
select site, case when n % 4 = 0 then 'shopify' when n % 4 = 1 then 'woocommerce' when n % 5 = 0 then 'blocked' else 'wix' end as kind,
 case when n % 4 = 0 then 'https://' || site || '/products.json' when n % 4 = 1 then 'https://' || site || '/wp-json/wc/store/products' end as catalog_endpoint,
 case when n % 4 < 2 then 'catalog' when n % 5 = 0 then 'blocked' else 'crawl+js' end as strategy from s""")
def catalog_probes(spark, d):
    """Catalogues found by their probes, refused sites, and payloads that are no catalogue."""
    n = F.length("site")
    sites = table(spark, d, "sites").select(
        "site", F.concat(F.lit("https://"), "site").alias("url"), F.when(n % 5 == 0, 403).otherwise(200).alias("status"), F.lit("<p>x</p>").alias("html"), F.create_map(F.lit("X-Wix-Request-Id"), F.lit("1")).alias("headers"),
        F.when(n % 4 == 0, '{"products": [{"id": 1}]}').when(n % 4 == 2, '{"products": 3}').alias("shopify_probe"), F.when(n % 4 == 1, '[{"id": 1}]').when(n % 4 == 3, '{"code": "no"}').alias("woo_probe"),
    )
    return detect.detected(sites).select("site", "kind", "catalog_endpoint", "strategy")


@query("page_links", f"""with p as (select product_id, {_ORIGIN.format('url')} as origin from {_P})
select product_id, case when product_id % 4 < 3 then origin || '/n/' || cast(product_id as varchar) end as next_page, case when product_id % 3 > 0 then origin || '/c/' || cast(product_id as varchar) end as canonical, cast(case when product_id % 4 = 0 then 2 else 3 end - case when product_id % 4 = 3 then 1 else 0 end as integer) as links from p""")
def page_links(spark, d):
    """Next pages by a declared link, a marked link and a labelled one; declared canonical addresses."""
    to = F.concat(F.lit('href="/n/'), F.col("product_id").cast("string"), F.lit('"'))
    nxt = _pick("product_id", F.concat(F.lit('<link rel="next" '), to, F.lit(">")), F.concat(F.lit("<a "), to, F.lit(' rel="nofollow next">2</a>')), F.concat(F.lit("<a "), to, F.lit("> Older </a>")), "")
    own = F.when(F.col("product_id") % 3 > 0, F.concat(F.lit('<link rel="canonical" href=" /c/'), F.col("product_id").cast("string"), F.lit('#top ">'))).otherwise(F.lit(""))
    html = F.concat(own, F.lit('<a href="/a">A</a><a href="/a#x">again</a>'), nxt, F.lit('<a href="/b"><img src="i"></a>'))
    p = spread(_products(spark, d)).select("product_id", "url", html.alias("html")).select("product_id", extract.page_features("html", "url", ("next_page", "canonical", "links")).alias("f"))
    return p.select("product_id", "f.next_page", "f.canonical", F.size("f.links").alias("links"))


# ── addresses ─────────────────────────────────────────────────────────────────────────────
@query("joined_addresses", f"""with p as (select product_id, url, {_ORIGIN.format('url')} as origin, {_PATH.format('url')} as path from {_P})
select product_id, {_cases('product_id', "origin || '/x/y?z=1'", "'https://o.example/z'", "origin || path || '?q=1'", "origin || regexp_replace(path, '[^/]*$', '') || 'leaf'", "null")} as address from p where path <> ''""")
def joined_addresses(spark, d):
    href = _pick("product_id", "/x/y?z=1", "https://o.example/z", "?q=1", "leaf", F.lit(None).cast("string"))
    return _products(spark, d).where(urls.path("url") != "").select("product_id", urls.joined(F.col("url"), href).alias("address"))


_DOUBTFUL = (
    ("https://a.example/x", None), ("http://127.0.0.1/", "not public"), ("http://10.1.2.3/a", "not public"), ("http://[::1]/", "not public"), ("http://0x7f.1/", "not public"), ("ftp://a.example", "scheme"), ("http:///x", "host"), ("http://8.8.8.8/", None),
    ("http://2130706433/", "not public"), ("http://169.254.169.254/latest", "not public"), ("http://0177.0.0.1/", "not public"), ("", "empty"), ("https://b.example/", "not public"), ("https://c.example/", None), ("http://192.168.0.1", "not public"), ("http://[fd00::1]/", "not public"),
)


@query("refused_addresses", f"select product_id, {_cases('product_id', *[f"'{w}'" if w else 'null' for _, w in _DOUBTFUL])} as refusal from {_P}")
def refused_addresses(spark, d):
    """Addresses that must not be fetched, by syntax, by number in any spelling and by what they resolve to."""
    url = _pick("product_id", *[u for u, _ in _DOUBTFUL])
    known = F.when(url == "https://b.example/", F.array(F.lit("93.184.216.34"), F.lit("10.0.0.1"))).when(url == "https://c.example/", F.array(F.lit("93.184.216.34")))
    return _products(spark, d).select("product_id", urls.refusal(url, known).alias("refusal"))


@query("networks", "select event_id, case event_id % 3 when 0 then cast(event_id % 223 + 1 as varchar) || '.' || cast(user_id % 256 as varchar) || '.7.0/24' when 1 then '2001:db8:' || format('{:x}', 1 + event_id % 4000) || '::/64' else 'no address' end as network from events")
def networks(spark, d):
    four = F.concat_ws(".", (F.col("event_id") % 223 + 1).cast("string"), (F.col("user_id") % 256).cast("string"), F.lit("7"), (F.col("event_id") % 256).cast("string"))
    six = F.concat(F.lit("2001:db8:"), F.lower(F.hex(F.lit(1) + F.col("event_id") % 4000)), F.lit("::"), F.lower(F.hex(F.lit(1) + F.col("event_id") % 999)))
    return table(spark, d, "events").select("event_id", urls.network_of(_pick("event_id", four, six, "no address")).alias("network"))


# ── discovery by example ──────────────────────────────────────────────────────────────────
@query("kin_listings", f"""with l as (select distinct {_HOST.format('url')} as host, url from products), e as (select host, min(url) as example from l group by 1),
h as (select e.example, l.url as href from l join e using (host) union select e.example, regexp_extract(l.url, '^[a-z]+://[^/]+/[^/?#]+') || 's' from l join e using (host)),
s as (select example, href, list_filter(string_split({_PATH.format('href')}, '/'), lambda x: x <> '') as seg, lower(list_filter(string_split({_ITEM.format('example')}, '/'), lambda x: x <> '')[1]) as first from h where {_HOST.format('href')} = {_HOST.format('example')})
select distinct example, href from s where len(seg) = 1 and first is not null and starts_with(lower(seg[1]), first) and lower(seg[1]) <> first""")
def kin_listings(spark, d):
    p = table(spark, d, "products").select("url").distinct().withColumn("host", urls.host("url"))
    e = p.groupBy("host").agg(F.min("url").alias("example"))
    every = F.explode(F.array(F.col("url"), F.concat(F.regexp_extract("url", "^[a-z]+://[^/]+/[^/?#]+", 0), F.lit("s"))))
    return frontier.kin_listings(p.join(e, "host").select("example", every.alias("href")))


@query("listing_candidates", f"""with u as (select distinct url, {_ORIGIN.format('url')} as origin, string_split(trim({_ITEM.format('url')}, '/'), '/') as s from products),
a as (select url, list_concat(case when length(url) % 3 = 0 then [origin || '/all'] else [] end, [origin || '/kin'], list_transform(range(1, len(s)), lambda i: origin || '/' || array_to_string(s[1:len(s) - i], '/')), [origin || '/'], [origin || '/', origin || '/c']) as every from u),
x as (select url, every[i] as listing, i from (select url, every, unnest(range(1, len(every) + 1)) as i from a)),
m as (select url, listing, row_number() over (partition by url order by min(i)) - 1 as rank from x group by url, listing)
select url as example, cast(rank as integer) as rank, listing from m where rank < 8""")
def listing_candidates(spark, d):
    origin = urls.base_of("url")
    ex = table(spark, d, "products").select("url").distinct().select(
        F.col("url").alias("example"), F.when(F.length("url") % 3 == 0, F.concat(origin, F.lit("/all"))).alias("named"), F.array(F.concat(origin, F.lit("/kin"))).alias("kin"), F.array(F.concat(origin, F.lit("/")), F.concat(origin, F.lit("/c"))).alias("crumbs")
    )
    return frontier.listing_candidates(ex)


@query("by_source", f"""with t as (select site, url, 0 as source, product_id as pos from {_P} where price is not null union all select site, url, 1, product_id from {_P} where sku <> '' union all select site, url, 2, 0 from {_P}),
o as (select site, url, min(source * 100000000000 + pos) as first_at from t group by all)
select site, url, cast(first_at // 100000000000 as integer) as source, cast(place as integer) as place from (select *, row_number() over (partition by site order by first_at, url) as place from o) where place <= 20""")
def by_source(spark, d):
    """Addresses of three sources in order of trust, the first twenty of each shop."""
    p = _products(spark, d).select("site", "url", "price", "sku", F.col("product_id").alias("pos"))
    return frontier.by_source([p.where("price is not null"), p.where("sku <> ''"), p.drop("pos")], 20, "site").select("site", "url", "source", "place")


_WALK = f"(select site, coalesce(title, '') as t, row_number() over (partition by site order by product_id) - 1 as n from {_P})"


@query("fresh_rows", f"""with f as (select site, t, min(n) as n from {_WALK} group by all), g as (select site, n // 20 as page_no, count(*) as fresh from f group by all), a as (select distinct site, n // 20 as page_no from {_WALK}),
k as (select a.site, a.page_no, bool_and(coalesce(fresh, 0) > 0) over (partition by a.site order by a.page_no) as going from a left join g on g.site = a.site and g.page_no = a.page_no)
select f.site, cast(f.n // 20 as integer) as page_no, cast(f.n % 20 as integer) as card, t as title from f join k on k.site = f.site and k.page_no = f.n // 20 where going""")
def fresh_rows(spark, d):
    """A walk through each shop's listing, twenty rows a page, until a page brings nothing new."""
    n = F.row_number().over(Window.partitionBy("site").orderBy("product_id")) - 1
    rows = _products(spark, d).select("site", n.alias("n"), F.create_map(F.lit("title"), F.coalesce("title", F.lit(""))).alias("data"))
    walk = rows.select("site", F.floor(F.col("n") / 20).cast("int").alias("page_no"), (F.col("n") % 20).alias("card"), "data")
    return frontier.fresh_rows(walk).select("site", "page_no", "card", F.col("data")["title"].alias("title"))


# ── records ───────────────────────────────────────────────────────────────────────────────
@query("fuller_records", f"""with s as (select product_id, title, case when product_id % 2 = 0 then null else brand end as brand, sku from {_P} where product_id % 5 > 0), r as (select product_id, title, brand, case when product_id % 3 = 0 then '' else sku end as sku from {_P} where product_id % 7 > 0),
n as (select coalesce(s.product_id, r.product_id) as product_id, s.product_id is null as no_s, r.product_id is null as no_r, s.title as st, s.brand as sb, s.sku as ss, r.title as rt, r.brand as rb, r.sku as rs,
 (coalesce(s.title, '') <> '')::int + (coalesce(s.brand, '') <> '')::int + (coalesce(s.sku, '') <> '')::int as ns, (coalesce(r.title, '') <> '')::int + (coalesce(r.brand, '') <> '')::int + (coalesce(r.sku, '') <> '')::int as nr from s full join r on s.product_id = r.product_id)
select product_id, case when no_r or not no_s and ns > nr then st else rt end as title, case when no_r or not no_s and ns > nr then sb else rb end as brand, case when no_r or not no_s and ns > nr then ss else rs end as sku from n""")
def fuller_records(spark, d):
    p = _products(spark, d)
    static = p.where("product_id % 5 > 0").select("product_id", "title", F.when(F.col("product_id") % 2 != 0, F.col("brand")).alias("brand"), "sku")
    rendered = p.where("product_id % 7 > 0").select("product_id", "title", "brand", F.when(F.col("product_id") % 3 == 0, F.lit("")).otherwise(F.col("sku")).alias("sku"))
    return coverage.fuller(static, rendered, "product_id", ["title", "brand", "sku"])


@query("record_columns", f"""with f as (select product_id, list_filter(['sku', 'title', 'brand', 'description'], lambda k: coalesce(map {{'sku': sku, 'title': title, 'brand': brand, 'description': description}}[k], '') <> '') as keys from {_P}),
k as (select keys[i] as field, min(product_id * 10 + i) as first_at from (select product_id, keys, unnest(range(1, len(keys) + 1)) as i from f) group by 1)
select field, cast(row_number() over (order by first_at) - 1 as integer) as place from k""")
def record_columns(spark, d):
    """The fields of records in the order in which they first come up."""
    read = F.create_map(*[x for c in ("sku", "title", "brand", "description") for x in (F.lit(c), F.coalesce(c, F.lit("")))])
    names = files.record_columns(_products(spark, d).select(F.col("product_id").alias("row"), F.map_filter(read, lambda _, v: v != "").alias("data")))
    return spark.createDataFrame(list(zip(names, range(len(names)))), "field string, place int")


@query("coverage_met", f"select site, coalesce(count(*) filter (where title <> '' and price <> 0 and url <> '')::double / count(*), 0.0) as usable_ratio, coalesce(count(*) filter (where title <> '' and price <> 0 and url <> '')::double / count(*), 0.0) >= 0.9 as meets from {_P} group by site")
def coverage_met(spark, d):
    return coverage.meets(_products(spark, d), 0.9, ["site"])


# ── recipes ───────────────────────────────────────────────────────────────────────────────
_JOINED = "array_to_string(list_sort(list_transform(map_entries({0}), lambda e: e.key || '=' || e.value)), ';')"


def _joined(c) -> F.Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


@query("covers_enough", "select domain, schema_name, len(list_filter(['title', 'price'], lambda f: list_contains(map_keys(fields), f))) >= 1 as enough from recipes")
def covers_enough(spark, d):
    return table(spark, d, "recipes").select("domain", "schema_name", governance.covers_enough(F.col("fields"), PRODUCT).alias("enough"))


@query("recipe_domains", "select distinct regexp_replace(lower(domain), '^www\\.', '') as domain from recipes")
def recipe_domains(spark, d):
    return governance.known_domains(table(spark, d, "recipes"))


@query("recipes_from_text", f"select domain, schema_name, {_JOINED.format('fields')} as fields, 'article.card' as item from recipes where len(map_keys(fields)) > 0")
def recipes_from_text(spark, d):
    """Recipes out of a compiler's prose, nested and flat."""
    r = table(spark, d, "recipes").where(F.size("fields") > 0)
    nested = F.concat(F.lit('Sure:\n```json\n{"fields": '), F.to_json("fields"), F.lit(', "modes": {}, "item": "article.card"}\n```'))
    flat = F.concat(F.regexp_replace(F.to_json("fields"), r"\}$", ""), F.lit(', "item": "article.card"} as asked'))
    said = governance.recipe_from_text(F.when(F.length("domain") % 2 == 0, nested).otherwise(flat))
    return r.select("domain", "schema_name", said.alias("r")).select("domain", "schema_name", _joined("r.fields").alias("fields"), "r.item")


@query("recipe_merge_halves", """with r as (select * from recipes where schema_name = 'product'),
k as (select domain, fields, modes, alternates, unnest(list_distinct(list_concat(map_keys(fields), coalesce(map_keys(alternates), [])))) as k from r),
t as (select domain, k, modes[k] as mode, list_filter(list_concat(case when k in ('title', 'price', 'images') then [fields[k]] else [] end, coalesce(alternates[k], []), case when k <> 'images' then ['body ' || fields[k]] else [] end), lambda x: x is not null and x <> '') as every from k),
s as (select domain, k, mode, list_filter(every, lambda x, i: list_position(every, x) = i) as sel from t)
select domain, array_to_string(list(k || '=' || sel[1] order by k || '=' || sel[1]), ';') as fields, coalesce(array_to_string(list(k || '=' || mode order by k || '=' || mode) filter (where mode is not null), ';'), '') as modes,
 coalesce(array_to_string(list(k || '=' || array_to_string(sel[2:], '|') order by k || '=' || array_to_string(sel[2:], '|')) filter (where len(sel) > 1), ';'), '') as alternates from s where len(sel) > 0 group by domain""")
def recipe_merge_halves(spark, d):
    """Each recipe's title, price and images merged over its other fields and older selectors."""
    r = table(spark, d, "recipes").where("schema_name = 'product'")
    new = r.withColumn("fields", F.map_filter("fields", lambda k, _: k.isin("title", "price", "images")))
    old = r.withColumn("fields", F.transform_values(F.map_filter("fields", lambda k, _: k != "images"), lambda _, v: F.concat(F.lit("body "), v)))
    merged = governance.merged_recipes(old, new)
    return merged.select("domain", _joined("fields").alias("fields"), _joined("modes").alias("modes"), _joined(F.transform_values("alternates", lambda _, v: F.array_join(v, "|"))).alias("alternates"))


@query("selectors_widened", "select domain, e.key as field, case when length(e.value) % 3 < 2 then e.value end as selector from (select domain, unnest(map_entries(fields)) as e from recipes where schema_name = 'product')")
def selectors_widened(spark, d):
    """Selectors with a part that only matches on sale, before or behind; those without one are left alone."""
    r = table(spark, d, "recipes").where("schema_name = 'product'").select("domain", F.explode("fields").alias("field", "selector"))
    n = F.length("selector") % 3
    sale = F.when(n == 0, F.concat(F.lit(".sale-box "), "selector")).when(n == 1, F.concat("selector", F.lit(" ins"))).otherwise(F.col("selector"))
    return r.select("domain", "field", governance.widened(sale).alias("selector"))


@query("pruned_recipes", f"select product_id, {_cases('product_id', "'price,stock'", "'price,stock'", "'stock'", "'price'", "'price'", "'price,stock'")} as fields, {_cases('product_id', "'stock'", "'stock'", "'stock'", "''", "''", "'stock'")} as modes from {_P}")
def pruned_recipes(spark, d):
    """Selectors that their sample page proves wrong: words for a price, a button or a long text for stock."""
    price = _pick("product_id", "12,00 €", "price on request", "words only", "12", "12", "")
    stock = _pick("product_id", '<i class="s">2 left</i>', '<i class="s">In stock</i>', '<i class="s">1</i>', '<button class="s">Add</button>', '<i class="s">' + "long " * 30 + "</i>", "")
    html = F.concat(F.lit('<b class="p">'), price, F.lit('</b><em class="c">x</em>'), stock)
    fields = F.create_map(F.lit("price"), F.lit(".p"), F.lit("stock"), F.lit(".s"), F.lit("cls"), F.lit(".c"))
    modes = F.create_map(F.lit("stock"), F.lit("text"), F.lit("cls"), F.lit("attr:class"))
    p = spread(_products(spark, d)).select("product_id", "url", html.alias("html"), fields.alias("fields"), modes.alias("modes"), F.create_map().cast("map<string,array<string>>").alias("alternates"))
    done = governance.pruned(p, Schema.of(["price:number", "stock", "cls"]))
    return done.select("product_id", F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("fields"), F.array_join(F.array_sort(F.map_keys("modes")), ",").alias("modes"))


_OUTCOMES = ("refused", "gone", "recipe", "json_ld", "sold", "needs_synthesis", "empty")


@query("page_outcomes", f"select product_id, {_cases('product_id', *[f"'{o}'" for o in _OUTCOMES])} as outcome from {_P} where {_PATH.format('url')} like '/%/%'")
def page_outcomes(spark, d):
    """What comes of a page, step by step: refused, gone, read by a recipe or from JSON-LD, sold, empty, or left to synthesis."""
    html = _pick("product_id", "<p>Just a moment...</p>", "<h1>x</h1>", '<h1 class="t">x</h1>', '<script type="application/ld+json">{"@type": "Product", "name": "x", "offers": {"price": "5"}}</script>', "<p>Helaas verkocht.</p>", "<p>words</p>", "")
    p = spread(_products(spark, d)).where(urls.path("url").like("/%/%")).select("product_id", "url", html.alias("html"), F.when(F.col("product_id") % 7 == 1, F.concat(urls.base_of("url"), F.lit("/"))).otherwise(F.col("url")).alias("final_url"))
    p = p.withColumn("f", extract.page_features("html", "url", ("product",)))
    return p.select("product_id", governance.outcome(p, F.col("product_id") % 7 == 2, declared=F.col("f.product").isNotNull()).alias("outcome"))


# ── ceilings, rules, mending ──────────────────────────────────────────────────────────────
@query("compile_ceiling", """with recursive e as (select cast(user_id as varchar) as key, epoch(ts)::double as moment from events),
w as (select key, min(moment) as since from e group by key union all select w.key, min(e.moment) as since from w join e on e.key = w.key and e.moment - w.since >= 86400 group by w.key),
p as (select e.key, e.moment, max(w.since) as since from e join w on w.key = e.key and w.since <= e.moment group by all),
c as (select e.key, e.moment, p.since from e join p on p.key = e.key and p.moment = e.moment),
n as (select key, moment, row_number() over (partition by key, since order by moment) as n from c)
select key, moment, cast(n as integer) as n, n <= 2 as allowed from n""")
def compile_ceiling(spark, d):
    """Windows that begin with a key's first event; the next event after a window begins a new one."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return governance.compile_windows(e).withColumnRenamed("at", "moment")


@query("standing_rules", """with f as (select user_id % 50 as origin, epoch(ts)::double as moment, event_id, case event_id % 4 when 0 then null when 1 then 503 when 2 then 200 else 404 end as status from events),
n as (select max(moment) as now from f), l as (select origin, max(moment) as moment from f group by 1), s as (select l.origin, l.moment, max(coalesce(status, -1)) as status from l join f on f.origin = l.origin and f.moment = l.moment group by all)
select origin, nullif(status, -1) as status, status = -1 and now - moment >= 60 or status >= 500 and now - moment >= 60 as due from s, n""")
def standing_rules(spark, d):
    """Each origin's newest fetch of its robots rules, and whether one that failed is due again."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, d, "events").select((F.col("user_id") % 50).alias("origin"), at.alias("at"), F.coalesce(F.when(F.col("event_id") % 4 == 1, 503), F.when(F.col("event_id") % 4 == 2, 200), F.when(F.col("event_id") % 4 == 3, 404)).alias("status"), F.lit(None).cast("string").alias("body"))
    # of fetches in one moment the one with the greatest status
    e = e.groupBy("origin", "at").agg(F.max("status").alias("status"), F.max("body").alias("body"))
    now = e.agg(F.max("at")).first()[0] or 0.0
    return web.standing_rules(e, now, 60.0).select("origin", "status", "due")


@query("robots_rules", f"""with p as (select product_id, length(site) % 5 as k, {_PATH.format('url')} as path from {_P})
select product_id, case k when 0 then false when 1 then true when 2 then not path like '/p/%' when 3 then path like '/p/1%' or not path like '/p/%' else true end as allowed, case k when 2 then 2.0 end as crawl_delay from p""")
def robots_rules(spark, d):
    """Rules of several kinds: servers in trouble, none, prefixes, exceptions, other agents."""
    s = table(spark, d, "sites").withColumn("k", F.length("site") % 5)
    body = F.coalesce(F.when(F.col("k") == 2, "User-agent: *\nDisallow: /p/\nCrawl-delay: 2\n"), F.when(F.col("k") == 3, "User-agent: *\nAllow: /p/1\nDisallow: /p/\n"), F.lit("User-agent: other\nDisallow: /\n"))
    status = F.when(F.col("k") == 0, 503).when(F.col("k") == 1, 404).otherwise(200)
    robots = s.select(F.explode(F.array(*[F.concat(F.lit(x), "site") for x in ("https://", "http://", "https://www.", "http://www.")])).alias("origin"), status.alias("status"), body.alias("body"))
    return web.robots_allow(_products(spark, d).select("product_id", "url"), robots, "mossgrid").select("product_id", "allowed", "crawl_delay")


@query("mend_candidates", f"""with r as (select site as recipe_key, product_id, url, list_filter(['brand', 'sku', 'description'], lambda k: coalesce(map {{'brand': brand, 'sku': sku, 'description': description}}[k], '') <> '') as has from {_P}),
s as (select recipe_key, list(distinct f) as seen from (select recipe_key, unnest(has) as f from r) group by 1),
m as (select r.*, list_filter(['brand', 'sku', 'description'], lambda k: list_contains(seen, k) and not list_contains(has, k)) as missing from r join s using (recipe_key)),
l as (select * from m where len(missing) > 0), b as (select recipe_key, count(*) as held, arg_max(product_id, len(missing) * 100000000000 - product_id) as best from l group by 1)
select b.recipe_key, held, url, array_to_string(missing, ',') as missing from b join l on l.recipe_key = b.recipe_key and l.product_id = best where held >= 3""")
def mend_candidates(spark, d):
    """Of each shop's records that lack a field others have, the one to compile again."""
    p = _products(spark, d).select(F.col("site").alias("recipe_key"), F.col("product_id").alias("pos"), "url", F.create_map(F.lit("brand"), F.coalesce("brand", F.lit("")), F.lit("sku"), F.coalesce("sku", F.lit("")), F.lit("description"), F.coalesce("description", F.lit(""))).alias("read"))
    return governance.to_mend(p, ("brand", "sku", "description")).select("recipe_key", "held", "url", F.array_join("missing", ",").alias("missing"))


# ── ledger ────────────────────────────────────────────────────────────────────────────────
_NEWEST = "(select email_hash, arg_max(id, created_at || id) as new_id from api_keys where revoked_at is null and email_hash is not null group by 1)"


@query("moved_balances", f"""with b as (select key_id, cast(sum(delta) as bigint) as balance from {_LEDGER} group by 1), p as (select k.id as old_id, new_id from api_keys k join {_NEWEST} n on n.email_hash = k.email_hash where k.id <> new_id),
m as (select old_id, new_id, balance from p join b on b.key_id = old_id where balance > 0)
select old_id as key_id, -balance as delta, null as idempotency_key from m union all select new_id, balance, 'move:' || old_id || ':' || new_id from m""")
def moved_balances(spark, d):
    """The balances of older keys moved to their owner's newest key."""
    keys = table(spark, d, "api_keys")
    newest = ledger.live_keys_by_identity(keys).select("email_hash", F.col("id").alias("new_id"))
    pairs = keys.select(F.col("id").alias("old_id"), "email_hash").join(newest, "email_hash").where("old_id <> new_id").select("old_id", "new_id")
    return ledger.moved_balance(_ledger(spark, d), pairs)


@query("outcome_counts", f"select outcome, count(*) as payments, cast(sum(amount) as bigint) as amount from ({SQL['payment_reconcile']}) group by 1")
def outcome_counts(spark, d):
    from mossgrid.plans.reference import payment_reconcile

    return ledger.outcome_counts(payment_reconcile(spark, d))
