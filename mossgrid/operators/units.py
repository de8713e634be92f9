"""Amounts recorded in many units, brought to one.

The distinct spellings of units (the values of ``currency`` and what stands around
the number in ``price_text``) are mapped to units by an inverted index of character
n-grams and a weighted edit distance; the resulting alias dictionary is joined to
all rows. Numbers are read by built-in expressions.

Defined results
* an amount is ``price`` where filled, else the first number of ``price_text``;
  a listing without either has no row;
* a currency the row leaves open is the seller's home currency; a seller that is
  not in ``sites`` and a row that names no currency give no row;
* a row whose currency is spelled in a way that is not understood has no row, whatever
  the seller's home currency;
* a unit that is not in ``price_units`` gives no row;
* repeated rows give one row; null and empty texts say nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The unit spellings, by currency and scale. "kr" and "øre" are shared
#: by several currencies and stand for a family that the row's other columns decide.
MAIN = {
    "EUR": ["euro", "euros", "€"],
    "USD": ["$", "US$", "U.S. dollars", "US dollars", "dollars", "dollar"],
    "GBP": ["£", "UK£", "pounds", "pound", "pounds sterling"],
    "CHF": ["Fr.", "SFr.", "Franken", "francs suisses"],
    "SEK": ["kronor", "svenska kronor"],
    "NOK": ["norske kroner"],
    "DKK": ["danske kroner"],
    "KR": ["kr", "kr.", "kroner"],
    "PLN": ["zł", "złotych", "złoty", "złote"],
    "JPY": ["yen", "¥", "円"],
    "KZT": ["₸", "тенге"],
    "KWD": ["KD", "dinar", "dinars"],
}
MINOR = {
    "EUR": ["Cent", "ct", "EUR cent", "euro cent", "eurocent", "Cents"],
    "USD": ["US cents", "USc", "¢ (US)", "¢", "US cent"],
    "GBP": ["p", "pence", "penny", "GBX", "GBp"],
    "CHF": ["Rp.", "Rappen", "centimes"],
    "SEK": ["öre"],
    "KR": ["øre"],
    "PLN": ["gr", "groszy", "grosz", "gr."],
    "KWD": ["fils"],
}
#: Words for thousands.
THOUSAND = ["k", "K", "Tsd.", "Tausend", "thousand", "mille", "mil", "tys.", "tusen", "duizend", "тыс."]
#: Price labels and tax notes that stand beside an amount.
NOTES = [
    "Preis:", "Angebot", "Jetzt", "Prix :", "Prix:", "Pris", "Precio", "Cena:", "Цена:", "Price:", "from", "Now", "Nu", "Actieprijs", "Prijs:", "ab", "à partir de", "desde", "od", "от", "från", "vanaf",
    "inkl. MwSt.", "zzgl. MwSt.", "zzgl. Versand", "IVA incluido", "sin IVA", "TVA incluse", "TTC", "HT", "incl. VAT", "ex. VAT", "excl. VAT", "inkl. moms", "exkl. moms", "brutto", "netto", "incl. btw", "excl. btw", "с НДС", "без НДС",
]
FAMILY = {"KR": ("SEK", "NOK", "DKK")}
#: Digits after the decimal sign; all others have two.
DIGITS = {"JPY": 0, "KWD": 3}
#: Unit ids of minor units in price_units are found by rate, not by name: eur_per_unit × 10^digits.
MAX_COST = 0.3
GRAM = 2
#: Other currencies, known so that they are told apart from a spelling nobody
#: understands; without a row in price_units they give none.
OTHERS = {
    "CZK": ["Kč", "korun"], "HUF": ["Ft", "forint"], "RON": ["lei"], "INR": ["₹", "Rs."], "RUB": ["₽", "руб.", "рублей"], "BRL": ["R$", "reais"], "KRW": ["₩", "won"], "TRY": ["₺", "TL"], "UAH": ["₴", "грн"], "ILS": ["₪"], "CNY": ["元", "yuan", "RMB"],
    "THB": ["฿", "บาท"], "VND": ["₫"], "AUD": ["A$", "AU$"], "CAD": ["C$", "CA$"], "MXN": ["MX$"],
}


def _seeds() -> list[tuple[str, str, str]]:
    out = [(s, c, "main") for c, all_ in (MAIN | OTHERS).items() for s in all_]
    out += [(s, c, "minor") for c, all_ in MINOR.items() for s in all_]
    for code in MAIN | OTHERS:
        if code != "KR":
            out += [(s, code, "main") for s in (code, code.lower(), code.capitalize())]
    return out


def _plain(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)) or ch


def _swap(a: str, b: str) -> float:
    if a == b:
        return 0.0
    if a.casefold() == b.casefold():
        return 0.05
    if _plain(a).casefold() == _plain(b).casefold():
        return 0.15
    return 1.0


def _drop(a: str) -> float:
    return 0.1 if a.isspace() or not a.isalnum() and a not in "€$£¥₸¢" else 1.0


def weighted_distance(a: str, b: str) -> float:
    """Edit distance in which case, accents, spaces and punctuation weigh little."""
    row = [0.0]
    for y in b:
        row.append(row[-1] + _drop(y))
    for x in a:
        new = [row[0] + _drop(x)]
        for j, y in enumerate(b):
            new.append(min(row[j] + _swap(x, y), row[j + 1] + _drop(x), new[j] + _drop(y)))
        row = new
    return row[-1]


def _grams(s: str) -> set[str]:
    s = "^" + "".join(_plain(c).casefold() for c in s if not c.isspace() and c not in ".()") + "$"
    return {s[i : i + GRAM] for i in range(len(s) - GRAM + 1)}


class Speller:
    """Maps a spelling to ``(currency, scale)``; scale is main, minor or k."""

    def __init__(self) -> None:
        self.seeds = _seeds()
        self.index: dict[str, list[int]] = defaultdict(list)
        for i, (s, _, _) in enumerate(self.seeds):
            for g in _grams(s):
                self.index[g].append(i)
        self.exact = {s: (c, scale) for s, c, scale in self.seeds if scale == "main" and (not s[0].isalpha() or s.isupper() and len(s) == 3 or s in ("Kč", "zł", "R$", "US$", "A$", "C$", "AU$", "CA$", "MX$"))}
        self.notes = sorted({n.casefold() for n in NOTES}, key=len, reverse=True)
        self.unit = lru_cache(maxsize=4096)(self._unit)

    def _unit(self, s: str) -> tuple[str, str] | None:
        shared: dict[int, int] = defaultdict(int)
        grams = _grams(s)
        for g in grams:
            for i in self.index.get(g, ()):
                shared[i] += 1
        best: tuple[float, int] | None = None
        own = sum(map(_drop, s))
        for i, n in shared.items():
            seed = self.seeds[i][0]
            if 2 * n < min(len(grams), len(_grams(seed))):
                continue
            letters = min(len(s), len(seed))
            most = MAX_COST * letters if letters >= 4 else 0.25
            # what one spelling holds more than the other has to be dropped at least
            if abs(own - sum(map(_drop, seed))) > most + 1e-9:
                continue
            cost = weighted_distance(s, seed)
            if cost <= most and (best is None or (cost, i) < best):
                best = (cost, i)
        return self.seeds[best[1]][1:] if best else None

    def side(self, text: str) -> tuple[str, str] | None:
        """The unit in one side of an amount, labels and notes taken off."""
        s = " ".join(unicodedata.normalize("NFKC", text.replace("¢", "\0")).replace("\0", "¢").split())
        low = s.casefold()
        if len(low) == len(s):
            for n in self.notes:
                at = low.find(n)
                while at >= 0:
                    after, before = low[at + len(n) :], low[:at]
                    # a note is taken off at either end; a short one only as a whole word, but for one glued to the unit's end
                    if not before.strip() or not after.strip():
                        short = len(n) < 4 and n != "ttc" and (after[:1].isalpha() or before[-1:].isalpha())
                    else:
                        short = True
                    if not short:
                        s, low = s[:at] + " " + s[at + len(n) :], low[:at] + " " + low[at + len(n) :]
                        at = low.find(n)
                    else:
                        at = low.find(n, at + 1)
        s = " ".join(s.split()).strip(" :;,-–")
        if not s:
            return None
        if hit := self.unit(s):
            return hit
        for word in sorted(THOUSAND, key=len, reverse=True):
            for rest in (s[len(word) :] if s.startswith(word) else None, s[: -len(word)] if s.endswith(word) else None):
                if rest is not None:
                    rest = rest.strip()
                    if not rest:
                        return ("", "k")
                    if (hit := self.unit(rest)) and hit[1] == "main":
                        return (hit[0], "k")
        # among other words a currency's sign or code still tells, if only one is there
        named = {self.exact[w] for w in _SIGN.findall(s) if w in self.exact}
        return next(iter(named)) if len(named) == 1 else None

    def spelling(self, text: str) -> tuple[str | None, str | None, bool]:
        """The unit of a spelling, and whether it names one that is not understood; a number's two sides
        are parted by U+001E, and what stands without a number is a unit's name and nothing else."""
        currency = scale = None
        unread = False
        for part in text.split("\x1e"):
            if hit := self.side(part):
                currency = hit[0] or currency
                scale = "k" if "k" in (hit[1], scale) else scale if hit[1] == "main" and scale else hit[1]
            elif "\x1e" not in text and any(c.isalnum() for c in part) or any(unicodedata.category(c) == "Sc" for c in part):
                unread = True
        return currency, scale, unread and currency is None


def alias_dictionary(spellings: DataFrame) -> DataFrame:
    """``(spelling, said, scale)`` of each distinct spelling."""

    def run(batches):
        speller = Speller()
        for pdf in batches:
            hits = [speller.spelling(s) for s in pdf["spelling"]]
            yield pd.DataFrame({"spelling": pdf["spelling"], "said": [h[0] for h in hits], "scale": [h[1] for h in hits], "unread": [h[2] for h in hits]})

    return spellings.select("spelling").where("spelling is not null").distinct().mapInPandas(run, "spelling string, said string, scale string, unread boolean")


#: A currency's sign with the letters before it, or a word.
_SIGN = re.compile(r"[A-Z]{0,3}[€$£¥₸¢₹₽₩₺₴₪฿₫元円]|[^\W\d_]+")


_SPACES = r"[\s  -  　]+"
_NUMBER = r"^(\D*)(\d(?:[\d.,'’ ]*\d)?)(.*)$"


def text_number(number: Column, fraction: Column) -> Column:
    """The value of a written number. Of two kinds of separator the last is decimal; one
    kind alone groups thousands where it repeats or exactly three digits follow,
    unless ``fraction`` (the currency's decimal digits) is three."""
    digits = F.regexp_replace(number, r"[' ’]", "")
    both = digits.contains(".") & digits.contains(",")
    last_comma = F.length(digits) - F.length(F.substring_index(digits, ",", -1)) > F.length(digits) - F.length(F.substring_index(digits, ".", -1))
    dot = F.regexp_replace(digits, ",", "")
    comma = F.regexp_replace(F.regexp_replace(digits, r"\.", ""), ",", ".")
    one = F.regexp_replace(digits, ",", ".")
    grouped = one.rlike(r"\..*\.") | (one.rlike(r"^\d{1,3}\.\d{3}$") & (fraction != 3))
    plain = F.when(both & last_comma, comma).when(both, dot).when(grouped, F.regexp_replace(one, r"\.", "")).otherwise(one)
    return plain.try_cast("decimal(20,3)")


def recorded_units(products: DataFrame, sites: DataFrame, price_units: DataFrame) -> DataFrame:
    """``(product_id, amount, unit_id, amount_eur)`` of every listing with an amount."""
    text = F.regexp_replace("price_text", _SPACES, " ")
    raw = F.from_json("raw", "prices struct<price:string,currency_code:string,currency_minor_unit:int>")
    rows = (
        products.select("product_id", "site", F.col("price").cast("decimal(20,3)").alias("price"), text.alias("text"), F.nullif(F.trim("currency"), F.lit("")).alias("currency"), raw.alias("raw"))
        .where("product_id is not null and (price is not null or text rlike '[0-9]')")
        .select(
            "*",
            F.nullif(F.regexp_extract("text", _NUMBER, 2), F.lit("")).alias("number"),
            F.when(F.col("text").rlike(r"\d"), F.concat(F.trim(F.regexp_extract("text", _NUMBER, 1)), F.lit("\x1e"), F.trim(F.regexp_extract("text", _NUMBER, 3)))).alias("around"),
        )
    )
    distinct = rows.select(F.explode(F.array("currency", "around")).alias("spelling"))
    alias = alias_dictionary(distinct)
    column = alias.select(F.col("spelling").alias("currency"), F.col("said").alias("c_said"), F.col("scale").alias("c_scale"), F.col("unread").alias("c_unread"))
    beside = alias.select(F.col("spelling").alias("around"), F.col("said").alias("t_said"), F.col("scale").alias("t_scale"), F.col("unread").alias("t_unread"))
    home = sites.select("site", "home_currency").dropDuplicates(["site"])
    known = rows.join(column, "currency", "left").join(beside, "around", "left").join(home, "site", "left")

    said = F.coalesce("c_said", "t_said", "raw.prices.currency_code")
    kin = [F.col("c_said"), F.col("t_said"), F.col("raw.prices.currency_code"), F.col("home_currency")]
    family = list(FAMILY["KR"])
    # a unit that is named but not understood is no open one: the seller's own does not stand in for it
    unread = F.coalesce("c_unread", F.lit(False)) | F.coalesce("t_unread", F.lit(False))
    code = F.coalesce(F.when(said == "KR", F.coalesce(*[F.when(k.isin(family), k) for k in kin], F.lit(family[0]))), said, F.when(~unread, F.col("home_currency")))
    known = known.withColumn("code", code)
    fraction = F.coalesce(*[F.when(F.col("code") == c, F.lit(n)) for c, n in DIGITS.items()], F.lit(2))
    step = F.pow(F.lit(10.0), fraction)
    known = known.withColumn("shown", text_number(F.col("number"), fraction)).withColumn("step", step)
    scale_of = lambda c: F.when(F.col(c) == "minor", 1 / F.col("step")).when(F.col(c) == "k", F.lit(1000.0)).when(F.col(c) == "main", F.lit(1.0))
    ratio = F.col("shown").cast("double") / F.when(F.col("price") > 0, F.col("price").cast("double"))
    near = lambda x, y: F.abs(x / y - 1) < 0.002
    minor_shown = near(ratio, 1 / F.col("step")) & (F.col("step") > 1)
    by_text = F.when(F.col("t_scale").isNotNull(), scale_of("t_scale") * ratio).when(minor_shown, 1 / F.col("step"))
    raw_price = F.col("raw.prices.price").try_cast("decimal(20,3)")
    raw_step = F.pow(F.lit(10.0), F.col("raw.prices.currency_minor_unit"))
    by_raw = F.when(F.col("raw.prices.currency_minor_unit") > 0, F.when(F.col("price") == raw_price, 1 / raw_step).when(near(F.col("price").cast("double") * raw_step, raw_price.cast("double")), F.lit(1.0)))
    snap = lambda x: F.when(near(x, 1 / F.col("step")) & (F.col("step") > 1), F.lit("minor")).when(near(x, F.lit(1.0)), F.lit("main")).when(near(x, F.lit(1000.0)), F.lit("k"))
    scale = F.when(F.col("price").isNotNull(), F.coalesce(snap(by_text), F.when(F.col("c_scale") == "minor", F.lit("minor")), snap(by_raw), F.col("c_scale"), F.lit("main"))).otherwise(F.coalesce("t_scale", "c_scale", F.lit("main")))
    amounts = known.select("product_id", "code", scale.alias("scale"), F.coalesce("price", "shown").alias("amount"), "step").where("amount is not null")

    # price_units names its units; which is the main, minor or thousands unit follows from the rates
    units = price_units.select("unit_id", "currency_code", "eur_per_unit", F.max(F.when(F.lower("currency_code") == F.col("unit_id"), F.col("eur_per_unit").cast("double"))).over(Window.partitionBy("currency_code")).alias("main_rate"))
    rate = F.col("eur_per_unit").cast("double") / F.col("main_rate")
    kind = F.when(near(rate, F.lit(1.0)), F.lit("main")).when(near(rate, F.lit(1000.0)), F.lit("k")).when(rate < 1, F.lit("minor"))
    units = units.select("unit_id", F.col("currency_code").alias("code"), "eur_per_unit", kind.alias("scale"))
    return (
        amounts.join(units, ["code", "scale"])
        .select("product_id", "amount", "unit_id", (F.col("amount") * F.col("eur_per_unit")).cast("decimal(24,6)").alias("amount_eur"))
        .dropDuplicates(["product_id", "unit_id", "amount"])
    )

