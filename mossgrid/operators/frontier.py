"""Item pages found from listings, examples and link graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mossgrid.functions import urls
from mossgrid.session import cut

MIN_GROUP = 3


def item_links(links: DataFrame) -> DataFrame:
    """``links(page, pos, href, has_image)`` to the item links of each listing: those with a
    product path, else the largest group of image links under one parent path, if it has three.

    Of groups of one size the first on the page is taken."""
    own = links.where((urls.host("href") == urls.host("page")) & (urls.path("href") != F.coalesce(F.nullif(urls.path("page"), F.lit("")), F.lit("/"))))
    own = own.groupBy("page", "href").agg(F.min("pos").alias("pos"), F.max_by("has_image", -F.col("pos")).alias("has_image"))
    own = own.withColumn("is_product", urls.is_product_path("href")).withColumn("parent", F.regexp_replace(urls.item_path("href"), "/[^/]*$", ""))
    direct = F.max("is_product").over(Window.partitionBy("page"))
    own = own.withColumn("direct", direct)
    groups = own.where("not direct and has_image").groupBy("page", "parent").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = groups.groupBy("page").agg(F.max_by("parent", F.struct("n", -F.col("first"))).alias("parent"), F.max("n").alias("n")).where(F.col("n") >= MIN_GROUP)
    return own.where("direct and is_product").select("page", "pos", "href").unionByName(own.where("not direct and has_image").join(best, ["page", "parent"], "left_semi").select("page", "pos", "href"))


def agreement(steps: Column, example_steps: Column) -> Column:
    """Path segments that agree with the example's in place; null where the depth differs."""
    same = F.filter(F.arrays_zip(steps.alias("a"), example_steps.alias("b")), lambda z: z["a"] == z["b"])
    return F.when(F.size(steps) == F.size(example_steps), F.size(same))


def siblings(links: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """``links(listing, example, href)`` to the links of the example's kind: those that agree
    with it at least as much as most do (of equal crowds the one that agrees more), if they
    make a group; else those of its exact shape."""
    paths = links.select("listing", "example", "href", (urls.host("href") == urls.host("example")).alias("_same"), F.split(urls.item_path("href"), "/").alias("_a"), F.split(urls.item_path("example"), "/").alias("_b"))
    scored = paths.select("listing", "example", "href", F.when(F.col("_same"), agreement(F.col("_a"), F.col("_b"))).alias("score"))
    counts = scored.where("score is not null").groupBy("listing", "example", "score").agg(F.count("*").alias("n"))
    # what follows runs over the few different scores of a listing, not over its links
    own = Window.partitionBy("listing", "example")
    counts = counts.withColumn("crowd", F.max_by("score", F.struct("n", "score")).over(own))
    size = counts.groupBy("listing", "example").agg(F.sum(F.when(F.col("score") >= F.col("crowd"), F.col("n"))).alias("size"), F.first("crowd").alias("crowd"))
    judged = scored.join(size, ["listing", "example"], "left")
    grouped = F.coalesce(F.col("size") >= min_group, F.lit(False))
    strict = urls.same_shape(F.col("href"), urls.url_shape(F.col("example")))
    return judged.where(F.when(grouped, F.coalesce(F.col("score") >= F.col("crowd"), F.lit(False))).otherwise(strict)).select("listing", "example", "href")


def kin_listings(links: DataFrame) -> DataFrame:
    """``links(example, href)`` to shallow links whose one segment begins with the example's first and is longer."""
    steps = urls.segments("href")
    first = F.lower(F.get(F.filter(F.split(urls.item_path("example"), "/"), lambda s: s != ""), F.lit(0)))
    head = F.lower(F.get(steps, F.lit(0)))
    return links.where((urls.host("href") == urls.host("example")) & (F.size(steps) == 1) & first.isNotNull() & head.startswith(first) & (head != first)).select("example", "href").distinct()


def listing_candidates(examples: DataFrame, most: int = 8) -> DataFrame:
    """``examples(example, named?, kin array, crumbs array)`` to ``(example, rank, listing)``: the named
    listing, kin, ancestors, breadcrumbs, each once, at most ``most``."""
    every = F.array_distinct(F.filter(F.concat(F.array("named"), F.coalesce("kin", F.array().cast("array<string>")), urls.ancestors("example"), F.coalesce("crumbs", F.array().cast("array<string>"))), lambda u: u.isNotNull()))
    return examples.select("example", F.posexplode(F.slice(every, 1, most)).alias("rank", "listing"))


def reachable(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """``(page, hop)``: pages within ``hops`` steps of the seeds along ``edges(src, dst)``, each at
    its least distance. One join a hop with the newest level only, anti-joined to what is seen;
    every level is cut off into the shared folder, so the plan does not grow."""
    edges = edges.select("src", "dst").distinct()
    level = seeds.select("page").distinct().withColumn("hop", F.lit(0))
    seen = level
    for hop in range(1, hops + 1):
        found = level.join(edges, level["page"] == edges["src"]).select(F.col("dst").alias("page")).distinct()
        level = cut(found.join(seen, "page", "left_anti").withColumn("hop", F.lit(hop)))
        if level.isEmpty():
            break
        seen = cut(seen.unionByName(level))
    return seen


def by_source(sources: list[DataFrame], limit: int, key: str = "example") -> DataFrame:
    """``(key, url)`` of several sources in order of trust: each address once, the first ``limit`` of a key."""
    tagged = [s.select(key, "url", F.lit(i).alias("source"), F.col("pos") if "pos" in s.columns else F.lit(0).alias("pos")) for i, s in enumerate(sources)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    once = every.groupBy(key, "url").agg(F.min(F.struct("source", "pos")).alias("at"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("at.source", "at.pos", "url"))
    return once.withColumn("place", place).where(F.col("place") <= limit).select(key, "place", "url", "at.source")


def row_fingerprint(data: Column | str) -> Column:
    """One hash for the values of a row, whatever their order."""
    data = F.col(data) if isinstance(data, str) else data
    return F.sha2(F.to_json(F.array_sort(F.map_entries(data))), 256)


def fresh_rows(rows: DataFrame) -> DataFrame:
    """``rows(site, page_no, card, data)``: each distinct row of a walk once, where it came first,
    up to the page before the first that brings nothing new."""
    marked = rows.withColumn("fingerprint", row_fingerprint("data"))
    firsts = marked.groupBy("site", "fingerprint").agg(F.min_by(F.struct("page_no", "card", "data"), F.struct("page_no", "card")).alias("r")).select("site", "r.*", "fingerprint")
    pages = rows.select("site", "page_no").distinct().join(firsts.groupBy("site", "page_no").agg(F.count("*").alias("n")), ["site", "page_no"], "left")
    going = F.bool_and(F.coalesce(F.col("n"), F.lit(0)) > 0).over(Window.partitionBy("site").orderBy("page_no"))
    kept = pages.withColumn("going", going).where("going").select("site", "page_no")
    return firsts.join(kept, ["site", "page_no"], "left_semi")
