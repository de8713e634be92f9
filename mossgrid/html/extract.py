"""Values read from pages by recipes: one parse per page, all fields at once."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import escape
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mossgrid.html.css import SelectorError, select
from mossgrid.html.dom import VOID, Node, parse
from mossgrid.operators.schema import Schema

#: Attributes that describe markup; signs of struck prices, of carts, of stated prices.
PLUMBING = frozenset(("class", "id", "style", "role", "rel", "target", "data-id", "data-elementor-type"))
STRUCK_TAGS = frozenset(("del", "s", "strike"))
STRUCK_CLASS = re.compile(r"old|was|regular|normal|normale|previous|compare|strike|van[-_]?prijs|oude[-_]?prijs|list[-_]?price", re.IGNORECASE)
CART = re.compile(r"add[-_]?to[-_]?(?:cart|basket|bag)|cart|basket|warenkorb|winkelwagen|panier|carrito|carrello|koszyk|kurv", re.IGNORECASE)
STATED_ATTRS = ("data-price", "data-product-price", "data-amount", "content")
STATED_NAME = re.compile(r"^(?:price|product:price:amount|og:price:amount|lowPrice)$", re.IGNORECASE)
NEXT_LABELS = frozenset(("next", "next page", "›", "»", "→", ">", "older"))
PRICE_FLOOR = 100
MAX_STOCK_TEXT = 80
_TOKEN = re.compile(r"\d[\d.,]*\d|\d")
LIST_JOIN = "\x1f"


def amount(text: str | None) -> float | None:
    """The value of an amount, by the rules of ``functions.money.parse_price``."""
    s = re.sub("[^0-9.,]", "", text or "")
    kinds = {c for c in s if c in ".,"}
    if len(kinds) == 2:
        last = max(s.rfind(","), s.rfind("."))
        other = "." if s[last] == "," else ","
        s = s.replace(other, "").replace(",", ".")
    elif kinds and (len(re.findall("[.,]", s)) > 1 or re.fullmatch(r"\d+[.,]\d{3}", s)):
        s = re.sub("[.,]", "", s)
    else:
        s = s.replace(",", ".")
    try:
        return float(s)
    except ValueError:
        return None


def two_prices(text: str) -> bool:
    return sum((amount(t) or 0) >= PRICE_FLOOR for t in _TOKEN.findall(text)) > 1


def is_struck(node: Node) -> bool:
    """Inside a struck tag, or named like an old price here or up to two levels above."""
    return any(n.name in STRUCK_TAGS or depth < 3 and n.classes and STRUCK_CLASS.search(" ".join(n.classes)) for depth, n in enumerate(node.up()))


def is_cart(node: Node) -> bool:
    """A control one presses, here or up to two levels above."""
    for n, _ in zip(node.up(), range(3)):
        if n.name == "button" or n.name == "input" and (n.get("type") or "").lower() in ("submit", "button") or CART.search(" ".join(n.classes) + " " + (n.get("id") or "")):
            return True
    return False


def _unstruck_text(node: Node) -> str:
    parts, stack = [], [node]
    struck = lambda n: n.name in STRUCK_TAGS or n.classes and STRUCK_CLASS.search(" ".join(n.classes))
    if struck(node):
        return ""
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            parts.append(n.strip())
        elif n is node or not struck(n):
            stack.extend(reversed(n.children))
    return "".join(parts)


def current_price(node: Node) -> str | None:
    """What is to be paid, from an element that may hold the old price too; None where that is open."""
    text = node.text()
    rest = _unstruck_text(node)
    if rest and rest != text and not two_prices(rest):
        return rest
    return text if text and not two_prices(text) else None


def stated_price(node: Node, visible: str) -> str | None:
    """A machine-readable price here or up to two levels above that agrees with the visible one in its whole units."""
    seen = amount(visible)
    if seen is None:
        return None
    for n, _ in zip(node.up(), range(3)):
        for a in STATED_ATTRS:
            raw = n.get(a)
            if raw and (a != "content" or any(STATED_NAME.match(n.get(k) or "") for k in ("itemprop", "property", "name"))):
                value = amount(raw)
                if value is not None and int(value) == int(seen) and value != seen:
                    return raw
    return None


def read(node: Node | None, mode: str) -> str | None:
    if node is None:
        return None
    if mode == "text":
        return node.text() or None
    return node.get(mode[5:]) or None if mode.startswith("attr:") else None


def _own_attr(node: Node) -> str:
    return "src" if node.name in ("img", "source") else "href" if node.name == "a" and node.get("href") else "text"


def _chosen(nodes: list[Node], field, mode: str) -> Node | None:
    """Of the matches a price that is not struck, a stock text that is no cart, else the first."""
    if mode == "text" and field is not None and field.is_money:
        return next((n for n in nodes if not is_struck(n)), nodes[0] if nodes else None)
    if mode == "text" and field is not None and field.is_stock:
        return next((n for n in nodes if not is_cart(n)), None)
    return nodes[0] if nodes else None


class Recipe:
    """Selectors by field with their modes and alternates; ``item`` names the cards of a listing."""

    def __init__(self, fields: dict | None, modes: dict | None = None, alternates: dict | None = None, item: str | None = None) -> None:
        self.fields, self.modes = {k: v for k, v in (fields or {}).items() if v}, modes or {}
        self.alternates, self.item = {k: list(v) for k, v in (alternates or {}).items() if v is not None}, item or ""

    def names(self) -> list[str]:
        return list(dict.fromkeys([*self.fields, *self.alternates]))

    def selectors(self, name: str) -> list[str]:
        return [s for s in dict.fromkeys([self.fields.get(name), *self.alternates.get(name, ())]) if s]

    def mode(self, name: str) -> str:
        return self.modes.get(name) or "text"


def _safe(root: Node, selector: str) -> list[Node]:
    try:
        return select(root, selector)
    except SelectorError:
        return []


def page_values(root: Node, recipe: Recipe, schema: Schema, url: str) -> dict[str, str | list[str]]:
    """Per field the first selector that answers."""
    kinds = {f.name: f for f in schema.fields}
    out: dict[str, str | list[str]] = {}
    for name in recipe.names():
        mode, field = recipe.mode(name), kinds.get(name)
        attr = mode.partition(":")[2].strip()
        if attr.lower() in PLUMBING:
            continue
        for selector in recipe.selectors(name):
            nodes = _safe(root, selector)
            if name in schema.lists or mode.startswith("attr_all:"):
                many = []
                for n in nodes:
                    a = attr or _own_attr(n)
                    if raw := n.text() if a == "text" else n.get(a):
                        many.append(urljoin(url, raw) if a in ("src", "href") else raw)
                if many:
                    out[name] = many
                    break
                continue
            node = _chosen(nodes, field, mode)
            value = read(node, mode)
            if value and mode == "text" and field is not None and field.is_money:
                value = current_price(node)
                value = value and (stated_price(node, value) or value)
            if value:
                out[name] = value
                break
    return out


def card_values(card: Node, recipe: Recipe, schema: Schema, url: str) -> dict[str, str]:
    """The fields of one card; a selector that finds nothing inside is tried again by its last part."""
    kinds = {f.name: f for f in schema.fields}
    out: dict[str, str] = {}
    for name in recipe.names():
        mode, field = recipe.mode(name), kinds.get(name)
        for selector in recipe.selectors(name):
            if selector == recipe.item:
                continue
            nodes = _safe(card, selector) or (_safe(card, selector.split()[-1]) if " " in selector else [])
            node = _chosen(nodes, field, mode)
            value = read(node, mode)
            if value and mode == "text" and field is not None and field.is_money:
                value = current_price(node)
            if value:
                out[name] = urljoin(url, value) if mode in ("attr:src", "attr:href") else value
                break
    return out


def product_node(root: Node) -> dict | None:
    """The first schema.org product among the page's JSON-LD blocks."""

    def nodes(x) -> Iterator[dict]:
        if isinstance(x, list):
            for y in x:
                yield from nodes(y)
        elif isinstance(x, dict):
            if isinstance(x.get("@graph"), list):
                yield from nodes(x["@graph"])
            else:
                yield x

    for n in root.walk():
        if n.name == "script" and n.get("type") == "application/ld+json":
            try:
                payload = json.loads("".join(n.strings()))
            except (ValueError, RecursionError):
                continue
            for node in nodes(payload):
                kinds = node.get("@type")
                if any(str(k).lower() == "product" for k in (kinds if isinstance(kinds, list) else [kinds])):
                    return node
    return None


def _word(x) -> str | None:
    if isinstance(x, list):
        return _word(x[0]) if x else None
    if isinstance(x, dict):
        return _word(x.get("name"))
    return str(x) if x else None


def _pictures(x) -> list[str]:
    if isinstance(x, list):
        return [p for y in x for p in _pictures(y)]
    if isinstance(x, dict):
        return [str(x["url"])] if x.get("url") else []
    return [x] if isinstance(x, str) and x else []


def product_values(node: dict, url: str) -> dict[str, str | list[str] | None]:
    offers = node.get("offers")
    offer = (offers[0] if offers else {}) if isinstance(offers, list) else offers
    offer = offer if isinstance(offer, dict) else {}
    there = str(offer.get("availability") or "").lower()
    price = offer.get("price") or offer.get("lowPrice")
    return {
        "url": _word(node.get("url")) or url, "title": _word(node.get("name")) or "", "brand": _word(node.get("brand")), "price": None if price is None else str(price), "currency": _word(offer.get("priceCurrency")),
        "available": None if not there else str("instock" in there).lower(), "images": _pictures(node.get("image")), "description": _word(node.get("description")), "sku": _word(node.get("sku")),
    }


def links(root: Node, url: str) -> list[tuple[str, bool, str]]:
    """``(address, holds an image, text)`` of the page's links, each address once, in order."""
    out: dict[str, tuple[str, bool, str]] = {}
    for a in root.walk():
        if a.name == "a" and a.get("href") is not None:
            try:
                full = urljoin(url, a.get("href").split("#")[0])
            except ValueError:
                continue
            if full not in out:
                out[full] = (full, any(n.name == "img" for n in a.walk()), a.text())
    return list(out.values())


def next_page(root: Node, url: str) -> str | None:
    """The page after this one: a declared link, then a link marked so, then one labelled so."""
    found: dict[int, str] = {}
    for n in root.walk():
        if n.name in ("link", "a") and n.get("href"):
            if "next" in (n.get("rel") or "").split():
                found.setdefault(0 if n.name == "link" else 1, n.get("href"))
            elif n.name == "a" and n.text().lower() in NEXT_LABELS:
                found.setdefault(2, n.get("href"))
    return urljoin(url, found[min(found)]) if found else None


def declared_canonical(root: Node, url: str) -> str | None:
    for n in root.walk():
        if n.name == "link" and "canonical" in (n.get("rel") or "").split() and (n.get("href") or "").strip():
            return urljoin(url, n.get("href").strip().split("#")[0])
    return None


def is_trail(n: Node) -> bool:
    """Named like a trail of breadcrumbs."""
    return "breadcrumb" in (n.get("class") or "") or "breadcrumb" in (n.get("id") or "") or n.name == "nav" and "readcrumb" in (n.get("aria-label") or "")


def _trails(boxes: list[Node], url: str, most: int = 8) -> list[str]:
    out: dict[str, None] = {}
    for box in boxes:
        anchors = [n for n in box.walk() if n.name == "a" and n.get("href") is not None]
        if 0 < len(anchors) <= most:
            for a in anchors:
                full = urljoin(url, a.get("href").split("#")[0])
                if urlsplit(full).netloc == urlsplit(url).netloc:
                    out.setdefault(full)
    return list(reversed(out))


def breadcrumbs(root: Node, url: str, most: int = 8) -> list[str]:
    """Addresses of the page's breadcrumbs, the nearest first; longer lists are no trails."""
    return _trails([n for n in root.walk() if is_trail(n)], url, most)


#: Fixed values for reducing a page before it is shown to a compiler of recipes: elements and
#: blocks without an item's own data, attributes without meaning, elements kept though empty.
_NOISE = frozenset("script style svg noscript template iframe nav footer aside picture source link".split())
_ASIDE = re.compile(r"related|recommend|upsell|cross[-_]?sell|also[-_](?:bought|viewed|like)|similar[-_]product|breadcrumb|cookie|cmplz|newsletter|subscribe|(?:^|[-_ ])(?:menu|megamenu)(?:[-_ ]|$)", re.IGNORECASE)
_DROP = frozenset("srcset data-srcset sizes style title loading decoding width height target rel tabindex aria-describedby aria-labelledby".split())
_KEPT_EMPTY = frozenset(("img", "input", "meta", "title"))


def reduced(root: Node, cap: int = 200_000, attr_cap: int = 120) -> str:
    """The markup that matters: no noise, asides, comments or empty elements, short attributes."""

    # elements are written when their end is reached; open ones wait on a stack with what they
    # hold and whether that is worth keeping
    open_: list[list] = [[None, iter(root.children), [], False]]
    while True:
        node, rest, parts, _ = open_[-1]
        for child in rest:
            if isinstance(child, str):
                parts.append(escape(child, quote=False))
                open_[-1][3] |= bool(child.strip())
            elif child.name not in _NOISE and not _ASIDE.search(" ".join(child.classes) + " " + (child.get("id") or "")):
                open_.append([child, iter(child.children), [], child.name in _KEPT_EMPTY])
                break
        else:
            held = open_.pop()[3]
            inner = "".join(parts)
            if node is None:
                return re.sub(r"\s+", " ", inner)[:cap]
            if held:
                attrs = "".join(f' {k}="{escape(v[:attr_cap])}"' for k, v in node.attrs.items() if k not in _DROP)
                open_[-1][2].append(f"<{node.name}{attrs}/>" if node.name in VOID else f"<{node.name}{attrs}>{inner}</{node.name}>")
                open_[-1][3] = True


_PARTS = {
    "title": "string", "canonical": "string", "next_page": "string", "links": "array<struct<href:string,has_image:boolean,text:string>>", "crumbs": "array<string>", "product": "map<string,string>", "images": "array<string>", "diet": "int",
}


def page_parts(root: Node, url: str, want: frozenset[str]) -> dict:
    """The parts of a page that are wanted, from one walk of its tree."""
    title = canonical = None
    nexts: dict[int, str] = {}
    anchors: list[Node] = []
    boxes: list[Node] = []
    pictured: set[int] = set()
    for n in root.walk():
        name = n.name
        if name == "a":
            anchors.append(n)
        elif name == "img":
            for up in n.up():
                if up.name == "a":
                    pictured.add(id(up))
        elif name == "title" and title is None:
            title = n.text()
        elif name == "link" and n.get("href"):
            kinds = (n.get("rel") or "").split()
            if "next" in kinds:
                nexts.setdefault(0, n.get("href"))
            if canonical is None and "canonical" in kinds and n.get("href").strip():
                canonical = urljoin(url, n.get("href").strip().split("#")[0])
        if is_trail(n):
            boxes.append(n)
    texts = [a.text() for a in anchors] if want & {"links", "next_page"} else []
    out: dict = {"title": title, "canonical": canonical}
    if "next_page" in want:
        for a, text in zip(anchors, texts):
            if a.get("href"):
                if "next" in (a.get("rel") or "").split():
                    nexts.setdefault(1, a.get("href"))
                elif text.lower() in NEXT_LABELS:
                    nexts.setdefault(2, a.get("href"))
        out["next_page"] = urljoin(url, nexts[min(nexts)]) if nexts else None
    if "links" in want:
        found: dict[str, dict] = {}
        for a, text in zip(anchors, texts):
            if a.get("href") is not None:
                try:
                    full = urljoin(url, a.get("href").split("#")[0])
                except ValueError:
                    continue
                found.setdefault(full, {"href": full, "has_image": id(a) in pictured, "text": text})
        out["links"] = list(found.values())
    if "crumbs" in want:
        out["crumbs"] = _trails(boxes, url)
    if want & {"product", "images"}:
        node = product_node(root)
        values = product_values(node, url) if node is not None else None
        out["images"] = values.pop("images") if values else None
        out["product"] = values
    if "diet" in want:
        out["diet"] = len(reduced(root))
    return out


def page_features(html: Column | str, url: Column | str, want: tuple[str, ...] = tuple(_PARTS)) -> Column:
    """The parts of a page that are asked for, from one parse."""
    asked = frozenset(want)

    @F.pandas_udf(", ".join(f"{p} {_PARTS[p]}" for p in want))
    def run(htmls: pd.Series, urls: pd.Series) -> pd.DataFrame:
        out = []
        for h, u in zip(htmls, urls):
            parts = page_parts(parse(h), u or "", asked)
            out.append(tuple(parts[p] for p in want))
        return pd.DataFrame(out, columns=list(want))

    return run(html, url)


def replayed(pages: DataFrame, schema: Schema) -> DataFrame:
    """``pages`` (with the columns of their recipe beside ``url`` and ``html``) plus ``read``,
    a map of the values as read; lists are joined by U+001F. Pages without a recipe give null."""

    @F.pandas_udf("map<string,string>")
    def run(htmls: pd.Series, urls: pd.Series, fields: pd.Series, modes: pd.Series, alternates: pd.Series) -> pd.Series:
        out = []
        for h, u, f, m, a in zip(htmls, urls, fields, modes, alternates):
            if not f and not a:
                out.append(None)
                continue
            values = page_values(parse(h), Recipe(_dict(f), _dict(m), _dict(a)), schema, u or "")
            out.append({k: LIST_JOIN.join(v) if isinstance(v, list) else v for k, v in values.items()})
        return pd.Series(out)

    return pages.withColumn("read", run("html", "url", "fields", "modes", "alternates"))


def _dict(x) -> dict:
    return dict(x) if x is not None else {}


def replayed_rows(pages: DataFrame, schema: Schema) -> DataFrame:
    """One row per card: ``url``, ``card`` (its place on the page) and ``read``."""

    @F.pandas_udf("array<map<string,string>>")
    def run(htmls: pd.Series, urls: pd.Series, fields: pd.Series, modes: pd.Series, alternates: pd.Series, items: pd.Series) -> pd.Series:
        out = []
        for h, u, f, m, a, i in zip(htmls, urls, fields, modes, alternates, items):
            recipe, root = Recipe(_dict(f), _dict(m), _dict(a), i), parse(h)
            if recipe.item:
                rows = [card_values(c, recipe, schema, u or "") for c in _safe(root, recipe.item)]
            else:
                rows = [{k: LIST_JOIN.join(v) if isinstance(v, list) else v for k, v in page_values(root, recipe, schema, u or "").items()}]
            out.append([r for r in rows if r])
        return pd.Series(out)

    return pages.select("url", F.posexplode(run("html", "url", "fields", "modes", "alternates", "item")).alias("card", "read"))
