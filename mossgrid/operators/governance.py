"""Recipes kept, merged and mended; failures remembered for a while."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mossgrid.functions.money import ON_REQUEST
from mossgrid.functions.urls import cache_key, failure_key
from mossgrid.html import extract
from mossgrid.html.dom import parse
from mossgrid.operators.schema import Schema

FAILURE_DAYS = 7
DAY = 86_400.0
#: Fixed value: parts of a selector that only match while a thing is on sale.
SALE_PART = r"(?i)^(?:ins|[.#][\w-]*(?:sale|current|now|special|actie|aanbieding|oferta|angebot|rebaja)[\w-]*)$"


def with_recipe(pages: DataFrame, recipes: DataFrame, schema: str = "product") -> DataFrame:
    """``pages(url, …)`` with the newest recipe of their domain and schema beside them; null where none is known."""
    key = F.concat(F.regexp_replace(F.lower("domain"), r"^www\.", ""), F.when(F.col("schema_name") == "product", F.lit("")).otherwise(F.concat(F.lit("#"), "schema_name")))
    body = F.struct("fields", "modes", "alternates", "item", "needs_js", "compiled_at")
    newest = recipes.where(F.col("schema_name") == schema).groupBy(key.alias("recipe_key")).agg(F.max_by(body, "compiled_at").alias("r"))
    return pages.withColumn("recipe_key", cache_key("url", F.lit(schema))).join(newest, "recipe_key", "left").select(*pages.columns, "recipe_key", "r.*")


def known_domains(recipes: DataFrame) -> DataFrame:
    """The domains that have a recipe, each once."""
    return recipes.select(F.regexp_replace(F.lower("domain"), r"^www\.", "").alias("domain")).distinct()


def recently_failed(at: Column, mode: Column, now: Column, can_js: Column) -> Column:
    """A failure younger than a week, unless it was a static one and a browser is at hand."""
    return F.coalesce((now - at < FAILURE_DAYS * DAY) & ~(can_js & (mode == "static")), F.lit(False))


def admitted(pages: DataFrame, failures: DataFrame, now: float, can_js: bool, schema: str = "product") -> DataFrame:
    """Pages whose failure, if any, does not bar them."""
    last = failures.groupBy("page_key").agg(F.max_by(F.struct("at", "mode"), "at").alias("f"))
    joined = pages.withColumn("page_key", failure_key("url", F.lit(schema))).join(last, "page_key", "left")
    return joined.where(~recently_failed(F.col("f.at"), F.col("f.mode"), F.lit(now), F.lit(can_js))).select(*pages.columns)


def compile_windows(compiles: DataFrame, cap: int = 2) -> DataFrame:
    """``compiles(key, at)`` (seconds) with ``n``, the count in the day that began with its first
    event, and ``allowed``. A window opens at the first event after the last one ended, so a
    key's events are folded in order: they pass through one task sorted, and only the open
    window is held. Events without key or time are left out."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, since, n = None, 0.0, 0
        for pdf in batches:
            counts = []
            for k, at in zip(pdf["key"], pdf["at"]):
                if k != key or at - since >= DAY:
                    key, since, n = k, at, 0
                n += 1
                counts.append(n)
            yield pd.DataFrame({"key": pdf["key"], "at": pdf["at"], "n": counts, "allowed": [c <= cap for c in counts]})

    kind = dict(compiles.dtypes)["key"]
    ordered = compiles.select("key", "at").where("key is not null and at is not null").repartition("key").sortWithinPartitions("key", "at")
    return ordered.mapInPandas(fold, f"key {kind}, at double, n int, allowed boolean")


def widened(selector: Column) -> Column:
    """The selector without the parts that only match on sale; null where it has none or nothing is left."""
    parts = F.filter(F.split(F.trim(selector), r"\s+"), lambda p: p != "")
    kept = F.transform(F.filter(parts, lambda p: ~p.rlike(SALE_PART)), lambda p: F.regexp_replace(p, r"^ins(?=[.#\[])", ""))
    joined = F.array_join(kept, " ")
    return F.when((F.size(kept) > 0) & (joined != F.array_join(parts, " ")), joined)


def selectors_of(fields: Column, alternates: Column, name: Column) -> Column:
    """A field's selectors in order, each once."""
    every = F.concat(F.array(fields[name]), F.coalesce(alternates[name], F.array().cast("array<string>")))
    return F.array_distinct(F.filter(every, lambda s: F.coalesce(s != "", F.lit(False))))


def merged_recipes(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("domain", "schema_name")) -> DataFrame:
    """Recipes with the new selectors first and the old ones as alternates; a field only the old
    recipe knows keeps its selector and mode; a browser is needed if either needs it."""
    empty_map, empty = F.create_map().cast("map<string,string>"), F.create_map().cast("map<string,array<string>>")
    m = lambda c, e: F.coalesce(F.col(c), e)
    both = new.select(*keys, *[F.col(c).alias(f"n_{c}") for c in ("fields", "modes", "alternates", "item", "needs_js", "origin", "compiled_at")]).join(
        old.select(*keys, *[F.col(c).alias(f"o_{c}") for c in ("fields", "modes", "alternates", "item", "needs_js", "origin", "compiled_at")]), list(keys), "full"
    )
    nf, of, na, oa = m("n_fields", empty_map), m("o_fields", empty_map), m("n_alternates", empty), m("o_alternates", empty)
    nm, om = m("n_modes", empty_map), m("o_modes", empty_map)
    names = F.array_distinct(F.concat(F.map_keys(nf), F.map_keys(na), F.map_keys(of), F.map_keys(oa)))
    every = F.transform(names, lambda k: F.struct(k.alias("k"), F.array_distinct(F.concat(selectors_of(nf, na, k), selectors_of(of, oa, k))).alias("s"), F.coalesce(nm[k], F.when(nf[k].isNull(), om[k])).alias("m")))
    every = F.filter(every, lambda e: F.size(e["s"]) > 0)
    return both.select(
        *keys,
        F.map_from_entries(F.transform(every, lambda e: F.struct(e["k"], F.get(e["s"], F.lit(0))))).alias("fields"),
        F.map_from_entries(F.transform(F.filter(every, lambda e: e["m"].isNotNull()), lambda e: F.struct(e["k"], e["m"]))).alias("modes"),
        F.map_from_entries(F.transform(F.filter(every, lambda e: F.size(e["s"]) > 1), lambda e: F.struct(e["k"], F.slice(e["s"], F.lit(2), F.size(e["s"]) - 1)))).alias("alternates"),
        F.coalesce("n_item", "o_item").alias("item"),
        (F.coalesce("n_needs_js", F.lit(False)) | F.coalesce("o_needs_js", F.lit(False))).alias("needs_js"),
        F.coalesce("n_origin", "o_origin").alias("origin"),
        F.greatest("n_compiled_at", "o_compiled_at").alias("compiled_at"),
    )


def covers_enough(fields: Column, schema: Schema, share: float = 0.5) -> Column:
    """A recipe knows enough of the schema's expected fields."""
    expected = F.array(*map(F.lit, schema.expected))
    return F.size(F.array_intersect(F.map_keys(fields), expected)) / F.size(expected) >= share


def sound_fields(recipe: extract.Recipe, schema: Schema, html: str, url: str) -> dict[str, str]:
    """The recipe's selectors that its sample page does not prove wrong: none that read markup
    attributes, stock fields that only find a cart or a long text, or money fields that find
    words without a digit, unless they say that the price is on request. A selector without a
    match proves nothing."""
    root = parse(html)
    kept = {k: s for k, s in recipe.fields.items() if recipe.mode(k).partition(":")[2].strip().lower() not in extract.PLUMBING}
    values = extract.page_values(root, recipe, schema, url)
    for f in schema.fields:
        said = values.get(f.name)
        said = " ".join(said) if isinstance(said, list) else said
        if f.name not in kept:
            continue
        if f.is_stock:
            found = extract._safe(root, kept[f.name])
            if found and all(map(extract.is_cart, found)) or len(said or "") > extract.MAX_STOCK_TEXT:
                del kept[f.name]
        elif f.is_money and said and not re.search(r"\d", said) and said.strip() != ON_REQUEST:
            del kept[f.name]
    return kept


def pruned(samples: DataFrame, schema: Schema) -> DataFrame:
    """``samples(recipe_key, url, html, fields, modes, alternates)`` with ``fields`` reduced to the sound
    ones, and ``modes`` without those of the fields that went."""

    @F.pandas_udf("map<string,string>")
    def run(html: pd.Series, url: pd.Series, fields: pd.Series, modes: pd.Series, alternates: pd.Series) -> pd.Series:
        d = extract._dict
        return pd.Series([sound_fields(extract.Recipe(d(f), d(m), d(a)), schema, h, u) for h, u, f, m, a in zip(html, url, fields, modes, alternates)])

    gone = F.array_except(F.map_keys("fields"), F.map_keys("_sound"))
    modes = F.map_filter("modes", lambda k, _: ~F.coalesce(F.array_contains(gone, k), F.lit(False)))
    return samples.withColumn("_sound", run("html", "url", "fields", "modes", "alternates")).withColumn("modes", modes).withColumn("fields", F.col("_sound")).drop("_sound")


def to_mend(records: DataFrame, fields: tuple[str, ...], least: int = 3) -> DataFrame:
    """Of each key whose held records lack fields others have, the page that lacks most: the one
    to compile again. ``records(recipe_key, pos, url, read map)``; keys with fewer than ``least``
    incomplete records wait."""
    named = F.array(*map(F.lit, fields))
    has = F.map_keys(F.map_filter("read", lambda k, v: F.coalesce(v != "", F.lit(False))))
    seen = records.select("recipe_key", F.explode(has).alias("f")).distinct().groupBy("recipe_key").agg(F.collect_set("f").alias("seen"))
    lacking = records.withColumn("has", has).join(seen, "recipe_key").withColumn("missing", F.array_except(F.array_intersect(named, "seen"), "has")).where(F.size("missing") > 0)
    return lacking.groupBy("recipe_key").agg(F.count("*").alias("held"), F.max_by(F.struct("url", "missing"), F.struct(F.size("missing"), -F.col("pos"))).alias("r")).where(F.col("held") >= least).select("recipe_key", "held", "r.*")


def outcome(df: DataFrame, satisfied: Column, html: str = "html", final: str | None = "final_url", declared: Column | None = None) -> Column:
    """What came of a page: refused, gone, recipe, json_ld (``declared``), sold, empty or needs_synthesis."""
    from mossgrid.functions import pages, urls

    gone = urls.redirected_away("url", final) if final in df.columns else F.lit(False)
    return (
        F.when(pages.challenge_marker(html).isNotNull(), "refused")
        .when(F.coalesce(gone, F.lit(False)), "gone")
        .when(F.coalesce(satisfied, F.lit(False)), "recipe")
        .when(F.coalesce(declared, F.lit(False)) if declared is not None else F.lit(False), "json_ld")
        .when(pages.sold_marker(html).isNotNull(), "sold")
        .when(F.coalesce(F.length(html), F.lit(0)) == 0, "empty")
        .otherwise("needs_synthesis")
    )


_MAP = T.MapType(T.StringType(), T.StringType())


@F.pandas_udf(T.StructType([T.StructField("fields", _MAP), T.StructField("modes", _MAP), T.StructField("item", T.StringType())]))
def recipe_from_text(text: pd.Series) -> pd.DataFrame:
    """The recipe in a compiler's answer: the outermost object in the text, nested under
    "fields" or flat; selectors that are no text are dropped; null where nothing is left."""
    out = []
    for t in text:
        m = re.search(r"\{.*\}", t or "", re.DOTALL)
        try:
            said = json.loads(m[0]) if m else None
        except ValueError:
            said = None
        nested = isinstance(said, dict) and isinstance(said.get("fields"), dict)
        named = (said["fields"] if nested else {k: v for k, v in said.items() if k not in ("modes", "item")}) if isinstance(said, dict) else {}
        fields = {k: v.strip() for k, v in named.items() if isinstance(v, str) and v.strip()}
        modes = {k: v for k, v in (said.get("modes") or {}).items() if isinstance(v, str)} if fields and isinstance(said.get("modes"), dict) else {}
        out.append((fields, modes, said.get("item") if isinstance(said.get("item"), str) else None) if fields else (None, None, None))
    return pd.DataFrame(out, columns=["fields", "modes", "item"])
