"""Addresses as column expressions; joining by RFC 3986 is an Arrow UDF."""

from __future__ import annotations

import ipaddress
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mossgrid.functions.base import let

#: Path shapes of product pages, and directory index files.
PRODUCT_PATH = "(?i)/(?:products?|item|itm|prod|p)/[^/?#]+/?$"
INDEX_FILE = r"(?i)/index\.[a-z0-9]{1,5}$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(url: Column | str) -> Column:
    """The host with its port, as written; empty where there is none."""
    return F.regexp_extract(_c(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path(url: Column | str) -> Column:
    return F.regexp_extract(_c(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column | str) -> Column:
    return F.regexp_extract(_c(url), r"^[^?#]*\?([^#]*)", 1)


def without_fragment(url: Column | str) -> Column:
    return F.substring_index(_c(url), "#", 1)


def domain_of(url: Column | str) -> Column:
    """Lower-case host and port without a leading "www."; a scheme is assumed where missing."""
    u = _c(url)
    full = F.when(u.contains("://"), u).otherwise(F.concat(F.lit("https://"), u))
    return F.regexp_replace(F.lower(host(full)), r"^www\.", "")


def base_of(url: Column | str) -> Column:
    """``scheme://host``, with https assumed."""
    u = _c(url)
    full = F.when(u.contains("://"), u).otherwise(F.concat(F.lit("https://"), u))
    return F.concat(F.coalesce(F.nullif(scheme(full), F.lit("")), F.lit("https")), F.lit("://"), host(full))


def cache_key(url: Column | str, schema: Column) -> Column:
    """The key of a recipe: the domain, with the schema's name where it is not "product"."""
    return F.concat(domain_of(url), F.when(schema == "product", F.lit("")).otherwise(F.concat(F.lit("#"), schema)))


def failure_key(url: Column | str, schema: Column) -> Column:
    return F.concat(without_fragment(url), F.lit("|"), schema)


def item_path(url: Column | str) -> Column:
    """The path that names an item: no trailing slash, no directory index; "/" where nothing is left."""
    p = F.regexp_replace(F.regexp_replace(path(url), "/+$", ""), INDEX_FILE, "")
    return F.when(p == "", F.lit("/")).otherwise(p)


def is_product_path(url: Column | str) -> Column:
    return item_path(url).rlike(PRODUCT_PATH)


def segments(url: Column | str) -> Column:
    """Path segments that are not empty."""
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def redirected_away(requested: Column | str, final: Column | str) -> Column:
    """A redirect that landed on an ancestor of the path asked for; hosts do not matter."""
    want, got = segments(requested), segments(final)
    return (F.size(want) > F.size(got)) & (F.when(F.size(got) == 0, F.lit(True)).otherwise(F.slice(want, 1, F.greatest(F.size(got), F.lit(1))) == got))


def ancestors(url: Column | str) -> Column:
    """Every directory above an item, nearest first, the root last."""
    steps = F.split(F.regexp_replace(item_path(url), "^/+|/+$", ""), "/")
    origin = F.concat(scheme(url), F.lit("://"), host(url), F.lit("/"))
    up = F.when(F.size(steps) > 1, F.transform(F.sequence(F.size(steps) - 1, F.lit(1), F.lit(-1)), lambda n: F.concat(origin, F.array_join(F.slice(steps, F.lit(1), n), "/")))).otherwise(F.array().cast("array<string>"))
    return F.concat(up, F.array(origin))


def query_keys(url: Column | str) -> Column:
    """The sorted names of query parameters that have a value."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: p.rlike("^[^=]+=.+"))
    return F.array_sort(F.array_distinct(F.transform(pairs, lambda p: F.substring_index(p, "=", 1))))


def url_shape(url: Column | str) -> Column:
    """``struct(host, path, prefix, depth, query, query_keys, tail_is_numeric)``."""
    p = item_path(url)
    steps = F.split(p, "/")
    return F.struct(
        host(url).alias("host"),
        p.alias("path"),
        F.slice(steps, F.lit(1), F.size(steps) - 1).alias("prefix"),
        F.size(steps).alias("depth"),
        query(url).alias("query"),
        query_keys(url).alias("query_keys"),
        F.element_at(steps, -1).rlike(r"^\d+$").alias("tail_is_numeric"),
    )


def same_shape(url: Column | str, shape: Column) -> Column:
    """The address is of the example's kind and not the example itself."""

    def alike(t: Column) -> Column:
        own, want = t["own"], t["want"]
        by_query = (own["path"] == want["path"]) & (own["query_keys"] == want["query_keys"])
        tail = F.substring_index(own["path"], "/", -1)
        by_path = (own["depth"] == want["depth"]) & (own["prefix"] == want["prefix"]) & (tail != "") & (own["tail_is_numeric"] == want["tail_is_numeric"])
        itself = (own["path"] == want["path"]) & (own["query"] == want["query"])
        return (own["host"] == want["host"]) & t["scheme"].isin("http", "https") & ~itself & F.when(F.size(want["query_keys"]) > 0, by_query).otherwise(by_path)

    return let(F.struct(url_shape(url).alias("own"), shape.alias("want"), scheme(url).alias("scheme")), alike)


def canonical(url: Column | str, keep: Column | None = None) -> Column:
    """One name per page: no fragment, no trailing slash, only the query parameters in ``keep``."""
    u = _c(url)
    p = F.regexp_replace(path(u), "/+$", "")
    kept = F.lit("")
    if keep is not None:
        pairs = F.filter(F.split(query(u), "&"), lambda x: x.rlike("^[^=]+=.+") & F.array_contains(keep, F.substring_index(x, "=", 1)))
        kept = F.array_join(pairs, "&")
    return F.concat(scheme(u), F.lit("://"), host(u), F.when(p == "", F.lit("/")).otherwise(p), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def next_page_guess(url: Column | str, page: Column) -> Column:
    """The address with ``page`` set to a number, the other parameters kept."""
    u = without_fragment(url)
    pairs = F.filter(F.split(query(u), "&"), lambda p: (p != "") & (F.substring_index(p, "=", 1) != "page"))
    return F.concat(F.substring_index(u, "?", 1), F.lit("?"), F.array_join(F.concat(pairs, F.array(F.concat(F.lit("page="), page.cast("string")))), "&"))


def job_label(url: Column | str, mode: Column, day: Column) -> Column:
    """A file name for a job: host, mode and day, other signs than letters, digits, "." and "-" replaced."""
    return F.regexp_replace(F.concat_ws("-", domain_of(url), mode, day.cast("string")), r"[^A-Za-z0-9.-]+", "-")


@F.pandas_udf(T.StringType())
def joined(base: pd.Series, href: pd.Series) -> pd.Series:
    """``href`` as found on the page ``base``; null where either is null or cannot be joined."""

    def one(b, h):
        try:
            return urljoin(b, h) if b is not None and h is not None else None
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href)])


def syntax_problem(url: str | None) -> str | None:
    """Why an address cannot be fetched: its scheme, a missing or unencodable host."""
    if not url:
        return "empty"
    try:
        parts = urlsplit(url)
        name = parts.hostname
    except ValueError:
        return "unreadable"
    if parts.scheme not in ("http", "https"):
        return "scheme"
    if not name:
        return "host"
    try:
        name.encode("idna")
    except UnicodeError:
        return "host"
    return None


def literal_address(name: str) -> ipaddress.IPv4Address | ipaddress.IPv6Address | None:
    """A host that is a number: dotted, short, octal, hexadecimal or whole, as resolvers read them."""
    try:
        return ipaddress.ip_address(name.strip("[]").partition("%")[0])
    except ValueError:
        pass
    parts = name.rstrip(".").split(".")
    if not 1 <= len(parts) <= 4:
        return None
    numbers = []
    for p in parts:
        try:
            numbers.append(int(p, 16) if p.lower().startswith("0x") else int(p, 8) if p.startswith("0") and p != "0" else int(p, 10) if p.isdecimal() else None)
        except ValueError:
            return None
    if None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1]
    for i, n in enumerate(numbers[:-1]):
        value += n << (24 - 8 * i)
    return ipaddress.IPv4Address(value)


def is_public_address(address: str) -> bool:
    a = ipaddress.ip_address(address)
    a = getattr(a, "ipv4_mapped", None) or a
    return not (a.is_private or a.is_loopback or a.is_link_local or a.is_reserved or a.is_multicast or a.is_unspecified)


@F.pandas_udf(T.StringType())
def refusal(url: pd.Series, addresses: pd.Series) -> pd.Series:
    """Why an address must not be fetched, null where it may: bad syntax, or a host that
    is or resolves to (``addresses``, from a table of names) a network that is not public."""

    def one(u, known):
        if why := syntax_problem(u):
            return why
        literal = literal_address(urlsplit(u).hostname)
        every = [str(literal)] if literal else list(known) if known is not None else []
        try:
            return None if all(map(is_public_address, every)) else "not public"
        except ValueError:
            return "not public"

    return pd.Series([one(u, k) for u, k in zip(url, addresses)])


@F.pandas_udf(T.StringType())
def network_of(address: pd.Series) -> pd.Series:
    """The /24 or /64 of an address; the text itself where it is none."""

    def one(a):
        if a is None:
            return None
        try:
            ip = ipaddress.ip_address(a)
        except ValueError:
            return a
        return str(ipaddress.ip_network(f"{a}/{24 if ip.version == 4 else 64}", strict=False))

    return pd.Series([one(a) for a in address])
