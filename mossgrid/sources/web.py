"""Sitemaps, robots rules and redirects held in tables."""

from __future__ import annotations

import gzip
import xml.etree.ElementTree as ET
from urllib.parse import quote, unquote, urlparse, urlunparse
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mossgrid.functions.urls import base_of
from mossgrid.session import cut

MAX_SITEMAP_BYTES = 12_000_000


def sitemap_text(body: bytes | None) -> str | None:
    """A sitemap's text: unpacked where it is gzip, null where it is too large or broken."""
    if body is None or len(body) > MAX_SITEMAP_BYTES:
        return None
    if body[:2] == b"\x1f\x8b":
        try:
            body = gzip.decompress(body)
        except (OSError, EOFError):
            return None
    return body.decode("utf-8", "replace")


def sitemap_locations(xml: str | None) -> list[tuple[str, bool]]:
    """``(address, is a further sitemap)``; nothing for text that is no XML."""
    try:
        root = ET.fromstring(xml or "")
    except (ET.ParseError, ValueError):
        return []
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    further = local(root) == "sitemapindex"
    return [(e.text.strip(), further) for e in root.iter() if local(e) == "loc" and (e.text or "").strip()]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("loc", T.StringType()), T.StructField("is_nested", T.BooleanType())])))
def locations(xml: pd.Series) -> pd.Series:
    return pd.Series([[{"loc": a, "is_nested": b} for a, b in sitemap_locations(x)] for x in xml])


def sitemap_pages(sitemaps: DataFrame, most: int = 25) -> DataFrame:
    """``sitemaps(origin, url, xml)`` to ``(origin, url, loc)``: pages reachable from each origin's
    ``/sitemap.xml`` through sitemap indexes, each map once, level by level; of an origin at most
    ``most`` maps are read, nearer ones and those that an index names first."""
    each = sitemaps.select("origin", "url", F.posexplode(locations("xml")).alias("pos", "l"))
    parsed = cut(each.select("origin", "url", "pos", "l.loc", "l.is_nested"))
    level = sitemaps.where(F.col("url") == F.concat("origin", F.lit("/sitemap.xml"))).select("origin", "url").distinct().withColumn("place", F.lit(1).cast("long"))
    seen = level
    while True:
        named = parsed.where("is_nested").join(level, ["origin", "url"]).groupBy("origin", F.col("loc").alias("url")).agg(F.min(F.struct("place", "pos")).alias("at")).join(seen, ["origin", "url"], "left_anti")
        held = seen.groupBy("origin").agg(F.count("*").alias("held"))
        placed = named.withColumn("n", F.row_number().over(Window.partitionBy("origin").orderBy("at", "url"))).join(held, "origin")
        level = cut(placed.where(F.col("n") + F.col("held") <= most).select("origin", "url", (F.col("n") + F.col("held")).alias("place")))
        if level.isEmpty():
            break
        seen = cut(seen.unionByName(level))
    return parsed.where("not is_nested").join(seen, ["origin", "url"], "left_semi").select("origin", "url", "loc")


def sitemap_addresses(robots: DataFrame, most: int = 25) -> DataFrame:
    """``robots(origin, status, body)`` to ``(origin, url)``: the sitemaps an origin names, then its
    ``/sitemap.xml``, each once, at most ``most`` of an origin."""
    named = F.regexp_extract_all(F.coalesce(F.when(F.col("status") == 200, F.col("body")), F.lit("")), F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))
    every = F.array_distinct(F.concat(named, F.array(F.concat("origin", F.lit("/sitemap.xml")))))
    return robots.select("origin", F.explode(F.slice(every, 1, most)).alias("url"))


def readable_page(static: Column, rendered: Column, has_items: Column | None = None) -> Column:
    """The page to read: the static one unless it is missing, an empty shell or, where
    ``has_items`` tells, without items; then the rendered one if there is one."""
    from mossgrid.functions.pages import looks_js_shelled

    poor = static.isNull() | looks_js_shelled(static)
    if has_items is not None:
        poor = poor | ~F.coalesce(has_items, F.lit(False))
    return F.when(poor, F.coalesce(rendered, static)).otherwise(static)


def standing_rules(fetches: DataFrame, now: float, retry: float = 300.0) -> DataFrame:
    """``fetches(origin, at, status, body)`` to each origin's newest fetch with ``due``: an origin
    that could not be read is denied until it is tried again after ``retry`` seconds."""
    newest = fetches.groupBy("origin").agg(F.max_by(F.struct("at", "status", "body"), "at").alias("f")).select("origin", "f.*")
    unread = F.col("status").isNull() | (F.col("status") >= 500)
    return newest.withColumn("due", unread & (F.lit(now) - F.col("at") >= retry))


_RULE = T.StructType([T.StructField("path", T.StringType()), T.StructField("allow", T.BooleanType())])


@F.pandas_udf(T.StructType([T.StructField("rules", T.ArrayType(_RULE)), T.StructField("delay", T.DoubleType())]))
def _rules(body: pd.Series, agent: pd.Series) -> pd.DataFrame:
    """The rules of one robots file for an agent, in order; each file is parsed here once."""
    out = []
    for b, a in zip(body, agent):
        parser = RobotFileParser()
        parser.parse((b or "").splitlines())
        entry = next((e for e in parser.entries if e.applies_to(a)), parser.default_entry)
        delay = parser.crawl_delay(a)
        out.append(([{"path": r.path, "allow": r.allowance} for r in entry.rulelines] if entry else [], None if delay is None else float(delay)))
    return pd.DataFrame(out, columns=["rules", "delay"]).astype({"delay": "float64"})


@F.pandas_udf(T.StringType())
def _robots_path(url: pd.Series) -> pd.Series:
    """An address as robots rules are held against it: quoted, without scheme and host."""

    def one(u: str | None) -> str | None:
        if u is None:
            return None
        try:
            p = urlparse(unquote(u))
        except ValueError:
            return "/"
        return quote(urlunparse(("", "", p.path, p.params, p.query, p.fragment))) or "/"

    return pd.Series([one(u) for u in url])


def robots_allow(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """``urls(url)`` with ``allowed`` and ``crawl_delay`` from ``robots(origin, status, body, at?)``.

    A server error (status null or 5xx) denies all, any other failure allows all; an
    origin without a row denies all, for nothing is known of it. Of several rows of an
    origin the newest by ``at`` holds, else the greatest. Each file is parsed once; only
    its short rules, not its body, meet the addresses.
    """
    body = F.when(F.col("status") == 200, F.col("body"))
    newest = ([F.col("at")] if "at" in robots.columns else []) + [F.col("status"), F.col("body")]
    held = robots.groupBy("origin").agg(F.max_by(F.struct("status", body.alias("body")), F.struct(*newest)).alias("r")).select("origin", "r.*")
    rules = held.select("origin", "status", F.lit(True).alias("known"), _rules("body", F.lit(agent)).alias("r")).select("origin", "status", "known", "r.*")
    joined = urls.withColumn("origin", base_of("url")).join(rules, "origin", "left").withColumn("_path", _robots_path("url"))
    first = F.get(F.filter("rules", lambda r: (r["path"] == "*") | F.col("_path").startswith(r["path"])), F.lit(0))
    readable = F.col("known") & F.coalesce(F.col("status") < 500, F.lit(False))
    allowed = F.coalesce(readable, F.lit(False)) & F.coalesce(first["allow"], F.lit(True))
    return joined.select(*urls.columns, allowed.alias("allowed"), F.when(readable, F.col("delay")).alias("crawl_delay"))


def resolved_redirects(requests: DataFrame, redirects: DataFrame, most: int = 10) -> DataFrame:
    """``requests(url)`` with ``final_url`` after following ``redirects(url, location)``; null where
    more than ``most`` hops do not end. One join a hop, with the addresses still moving alone:
    those that have ended are set aside, and the walk ends when none moves."""
    hop = cut(redirects.groupBy(F.col("url").alias("at")).agg(F.min("location").alias("location")))
    now, done = requests.select("url").distinct().withColumn("at", F.col("url")), None
    for _ in range(most + 1):
        step = cut(now.join(hop, "at", "left").select("url", "at", "location"))
        ended = step.where("location is null").select("url", F.col("at").alias("final_url"))
        done = ended if done is None else done.unionByName(ended)
        now = step.where("location is not null").select("url", F.col("location").alias("at"))
        if now.isEmpty():
            break
    return done.unionByName(now.select("url", F.lit(None).cast("string").alias("final_url")))


def with_origin(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("origin", base_of(url))


def unzipped(body: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(bodies: pd.Series) -> pd.Series:
        return pd.Series([sitemap_text(b) for b in bodies])

    return run(body)
