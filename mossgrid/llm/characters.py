"""Visually identical text with different characters, brought to one form.

1. Forms that stand for plain characters whatever the context are folded: full-width
   and mathematical letters, ligatures, decomposed accents, invisible characters,
   fixed-width and no-break spaces, plain hyphens.
2. Look-alike letters: each word's dominant script is found; letters of another script
   are replaced by their twins only where a word mixes scripts and the result is a word
   of the corpus vocabulary (all titles, brands, descriptions and skus).

Defined results
* null stays null; empty, blank and plain texts are no case and come back unchanged;
* real letters of another script, composed accents, superscripts, fractions, trademark
  signs, typographic quotes and dashes and joiners inside emoji stay;
* a value that was decoded with a wrong encoding is no case (see ``encoding``);
* whole texts are read; repeated rows give one row per id and field.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossgrid.llm import encoding
from mossgrid.session import cut, spread

FIELDS = ("title", "brand", "description")
#: Letters that look alike, Latin beside Cyrillic and Latin beside Greek.
CYRILLIC_TWINS = dict(zip("аеорсухіјѕԁһԛԝАВЕЗІЈКМНОРСТУХЅԌ", "aeopcyxijsdhqwAB" + "E3IJKMHOPCTYXSG"))
GREEK_TWINS = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧΑανορυχικε", "ABEZHIKMNOPTYXAavopuxike"))
#: Invisible characters; spaces that look like a space; hyphens that look like "-".
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤﻿"
SPACES = "               　  "
HYPHENS = "‐‑﹣－"
CYRILLIC_TWINS.pop("З", None)
#: Letters of other scripts and of extended Latin that look like plain Latin ones.
OTHER_TWINS = dict(zip("օոսհցՕՍᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃɡɑϲϳѵӏӀ", "onuhgOU" + "ABCDEGHJKLMPRSTVWZ" + "gacjvlI"))
_TO_LATIN = CYRILLIC_TWINS | GREEK_TWINS | OTHER_TWINS
_FROM_LATIN = {"C": {v: k for k, v in CYRILLIC_TWINS.items() if k in "аеорсухАВЕКМНОРСТУХ"}, "G": {v: k for k, v in GREEK_TWINS.items()}, "A": {v: k for k, v in OTHER_TWINS.items() if "\u0530" <= k < "\u0590"}}
_EMOJI_JOIN = re.compile("(?<=[☀-➿️\U0001f300-\U0001faff])‍(?=[☀-➿️\U0001f300-\U0001faff])")
_WORD = re.compile("(?:[^\\W\\d_][\u0300-\u036f]*)+")
@lru_cache(maxsize=65536)
def _fold_char(c: str) -> str:
    o = ord(c)
    if o < 0xA0:
        return c
    if c in INVISIBLE:
        return ""
    if c in SPACES:
        return " "
    if c in HYPHENS:
        return "-"
    how = unicodedata.decomposition(c).partition(" ")[0]
    if how in ("<wide>", "<narrow>", "<font>"):
        return unicodedata.normalize("NFKC", c)
    if how == "<compat>" and (plain := unicodedata.normalize("NFKC", c)).isalpha() and len(plain) > 1 and o != 0x2116:
        return plain
    return c


def fold(text: str) -> str:
    """Step 1, for one text."""
    keep = _EMOJI_JOIN.sub("\x00", text)
    return unicodedata.normalize("NFC", "".join(map(_fold_char, keep))).replace("\x00", "\u200d")


def _script(c: str) -> str:
    o = ord(c)
    if c in _EXTENDED or 0x13A0 <= o < 0x1400:
        return "X"  # twins of Latin letters that make no word of their own here
    return "A" if 0x530 <= o < 0x590 else "M" if 0x300 <= o < 0x370 else "L" if o < 0x250 or 0x1E00 <= o < 0x1F00 else "C" if 0x400 <= o < 0x530 else "G" if 0x370 <= o < 0x400 else "O"


_EXTENDED = frozenset("ɡɑ")


@lru_cache(maxsize=1)
def _folded_ranges() -> list[tuple[int, int]]:
    """Every code point that :func:`fold` changes by itself, or that joins the one before it into
    one letter, as ranges: found by asking it, so that the prefilter leaves out nothing."""
    hits = set()
    for low, high in ((0xA0, 0xD800), (0xF900, 0x10000), (0x10000, 0x20000), (0x2F800, 0x2FA20)):
        for o in range(low, high):
            c = chr(o)
            if fold(c) != c:
                hits.add(o)
            parts = unicodedata.decomposition(c).split(" ")
            if len(parts) == 2 and parts[0][:1] != "<":
                hits.add(int(parts[1], 16))
    # Hangul jamo join by rule, not by table
    hits.update(range(0x1161, 0x1176)), hits.update(range(0x11A8, 0x11C3)), hits.update(range(0x300, 0x370))
    out: list[tuple[int, int]] = []
    for o in sorted(hits):
        if out and o == out[-1][1] + 1:
            out[-1] = (out[-1][0], o)
        else:
            out.append((o, o))
    return out


_LATIN = "A-Za-z\u00c0-\u024f"
_TWIN_SCRIPTS = "\u0370-\u058f\u13a0-\u13ff"


#: Letters and signs of ordinary texts, which the prefilter must pass over to be of use; between
#: other code points it may take in what it need not, for a short list of ranges is tested fast.
_ORDINARY = ((0xA1, 0xA7), (0xA9, 0xAC), (0xAE, 0xAE), (0xB0, 0xB3), (0xB5, 0x131), (0x134, 0x13E), (0x141, 0x148), (0x14A, 0x17E), (0x386, 0x3CE), (0x400, 0x481), (0x2013, 0x2027), (0x20AC, 0x20AC), (0x2122, 0x2122), (0x3041, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


@lru_cache(maxsize=1)
def _merged_ranges() -> list[tuple[int, int]]:
    """The ranges of :func:`_folded_ranges`, joined where nothing ordinary lies between them."""
    out: list[tuple[int, int]] = []
    for a, b in _folded_ranges():
        if out and not any(x < a and y > out[-1][1] for x, y in _ORDINARY):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


@lru_cache(maxsize=1)
def suspect() -> str:
    """JVM-side test: a value without a match needs no look. Marks over letters are in the first class, so
    that the second may ask for neighbours."""
    folded = "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in _merged_ranges())
    return rf"[{folded}ɡɑ]|[{_TWIN_SCRIPTS}](?:(?<=[{_LATIN}][{_TWIN_SCRIPTS}])|[{_LATIN}])"


@lru_cache(maxsize=1)
def suspect_chars() -> re.Pattern:
    """The same test for Python."""
    folded = "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in _folded_ranges())
    return re.compile(f"[{folded}ɡɑ]|[{_TWIN_SCRIPTS}][\u0300-\u036f]*[{_LATIN}]|[{_LATIN}][\u0300-\u036f]*[{_TWIN_SCRIPTS}]")


def twin_spellings(word: str) -> tuple[str, ...]:
    """Like :func:`_twins`; long words are not kept in memory."""
    return _twins(word) if len(word) <= 64 else _twins.__wrapped__(word)


@lru_cache(maxsize=65536)
def _twins(word: str) -> tuple[str, ...]:
    """The word in one script each, its dominant script first; none where it does not
    mix scripts or a letter has no twin."""
    if word.isascii():
        return ()
    word = unicodedata.normalize("NFD", word)
    scripts = [_script(c) for c in word]
    n = {s: scripts.count(s) for s in "LCGA"}
    if sum(v > 0 for v in n.values()) + ("X" in scripts) < 2 or "O" in scripts:
        return ()
    out = []
    for s in sorted((s for s in n if n[s]), key=lambda s: -n[s]):
        latin = "".join(c if a in (s, "M") else _TO_LATIN.get(c, c) if a != "L" else c for c, a in zip(word, scripts))
        new = latin if s == "L" else "".join(c if _script(c) in (s, "M") else _FROM_LATIN[s].get(c, c) for c in latin)
        if all(_script(c) in (s, "M") for c in new):
            out.append(unicodedata.normalize("NFC", new))
    return tuple(dict.fromkeys(out))


_SCHEMA = "field_name string, text string, folded string, changed boolean, words array<struct<word:string,result:string>>"


def _looked_at(products: DataFrame, fields: Sequence[str], key: str) -> DataFrame:
    """Suspect values: folded, with the mixed-script words and what they may stand for."""
    kind = dict(products.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, name, text in zip(pdf[key], pdf["field_name"], pdf["text"]):
                folded = fold(text)
                words = {w: t for w in _WORD.findall(folded) if (t := twin_spellings(w))}
                if folded == text and not words:
                    continue
                if name != "brand" and encoding.repair(text)[1]:
                    continue
                out.append((i, name, text, folded, folded != text, [{"word": w, "result": r} for w, rs in words.items() for r in rs]))
            yield pd.DataFrame(out, columns=[key, "field_name", "text", "folded", "changed", "words"])

    values = spread(products.where(F.col(key).isNotNull()).select(key, *fields)).select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.when(F.col(f).rlike(suspect()), F.col(f)).alias("text")) for f in fields])).alias("v"))
    return values.select(key, "v.*").where("text is not null").mapInPandas(run, f"{key} {kind}, {_SCHEMA}")


#: Words go to every task only up to this many; beyond, they meet the corpus by a shuffle.
BROADCAST_WORDS = 200_000


def vocabulary_hits(products: DataFrame, words: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Those of ``words(result)`` that occur as words of the corpus (case aside).

    Their number is counted first. Few of them filter the corpus words where these are read;
    many meet them by a shuffle, where each word of a task counts once.
    """
    text = F.lower(F.concat_ws(" ", *fields, *[c for c in ("sku",) if c in products.columns]))
    corpus = products.select(F.explode(F.split(text, r"[^\p{L}\p{M}]+")).alias("lower_result")).where("lower_result <> ''")
    wanted = words.select("result", F.lower("result").alias("lower_result")).distinct()
    keys = wanted.select("lower_result").distinct()
    if keys.count() <= BROADCAST_WORDS:
        corpus = corpus.join(F.broadcast(keys), "lower_result", "left_semi")
    return wanted.join(corpus.distinct(), "lower_result", "left_semi").select("result")


def consistent_form(products: DataFrame, fields: Sequence[str] = FIELDS, key: str = "product_id") -> DataFrame:
    """``(key, field_name, text, consistent)`` of every value that is not in the one form, once."""
    seen = _looked_at(products, fields, key).dropDuplicates([key, "field_name", "text"])
    seen = cut(seen)
    pairs = seen.select(key, "field_name", "text", F.posexplode("words").alias("at", "w")).select(key, "field_name", "text", "at", "w.word", "w.result")
    known = vocabulary_hits(products, pairs, fields)
    # of a word's spellings the first known one, that of its dominant script, holds
    taken = pairs.join(known, "result").groupBy(key, "field_name", "text", "word").agg(F.min_by("result", "at").alias("result"))
    taken = taken.groupBy(key, "field_name", "text").agg(F.map_from_entries(F.collect_list(F.struct("word", "result"))).alias("swap"))

    @F.pandas_udf("string")
    def apply(folded: pd.Series, swap: pd.Series) -> pd.Series:
        def one(t, m):
            m = dict(m) if m is not None else None
            return _WORD.sub(lambda w: m.get(w[0], w[0]), t) if m else t

        return pd.Series([one(t, m) for t, m in zip(folded, swap)])

    done = seen.join(taken, [key, "field_name", "text"], "left").where("changed or swap is not null")
    return done.select(key, "field_name", "text", apply("folded", "swap").alias("consistent"))


def inconsistent_fields(products: DataFrame, fields: Sequence[str] = FIELDS, key: str = "product_id") -> DataFrame:
    """``(key, field_name)`` of the values of :func:`consistent_form`."""
    seen = cut(_looked_at(products, fields, key).select(key, "field_name", "changed", F.when(~F.col("changed"), F.col("words")).alias("words")))
    pairs = seen.select(key, "field_name", F.explode("words").alias("w")).select(key, "field_name", "w.result")
    swapped = pairs.join(vocabulary_hits(products, pairs, fields), "result").select(key, "field_name")
    return seen.where("changed").select(key, "field_name").union(swapped).distinct()
