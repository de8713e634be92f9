"""Amounts in text, as column expressions (no Python in the data path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mossgrid.functions.base import let

#: What counts as a currency sign, a tax note, and a field that holds money.
CURRENCY = "€|\\$|£|¥|₽|zł|kr|CHF|EUR|USD|GBP|PLN|SEK|NOK|DKK"
NOTE = r"(?:in[ck]l\.?|ex[ck]l\.?|zzgl\.?|plus|\+)\s*(?:\d+[.,]?\d*\s*%\s*)?(?:btw|vat|mwst|ust|iva|tva|tax|moms)\b\.?"
MONEY_FIELD = "price|prijs|preis|prix|cost|amount|bedrag"
ON_REQUEST = "price on request"
_GROUPED = "\\d{1,3}(?:[   ]\\d{3}(?!\\d))+(?:[.,]\\d{1,2})?"
_AMOUNT = rf"(?:{_GROUPED}|\d[\d.,]*\d|\d)"
_MONEY = rf"(?iuU)(?:(?:{CURRENCY})\s*)?{_AMOUNT}(?:[,.]-)?(?:\s*(?:{CURRENCY}))?"
_MARKED = rf"(?iu)^(?:{CURRENCY})|(?:{CURRENCY})$|[,.]-(?:\s|$|€|\$|£)"
DECIMAL = "decimal(38,9)"


def _text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: Column) -> Column:
    """Without white space of any script at either end (SQL's trim takes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def plain_number(c: Column | str) -> Column:
    """The digits of an amount with a decimal point: of two kinds of separator the last
    is decimal; one kind alone groups where it repeats or three digits follow it."""
    s = F.regexp_replace(_text(c), "[^0-9.,]", "")
    comma, dot = s.contains(","), s.contains(".")
    comma_last = s.rlike(r",[^.]*$")
    return (
        F.when(comma & dot & comma_last, F.regexp_replace(F.regexp_replace(s, r"\.", ""), ",", "."))
        .when(comma & dot, F.regexp_replace(s, ",", ""))
        .when(s.rlike(r"[.,].*[.,]") | s.rlike(r"^\d+[.,]\d{3}$"), F.regexp_replace(s, "[.,]", ""))
        .otherwise(F.regexp_replace(s, ",", "."))
    )


def parse_price(c: Column | str) -> Column:
    """The amount in a text; null where there is none or it cannot be read. The sign is not read."""
    return plain_number(c).try_cast(DECIMAL)


def holds_two_prices(c: Column | str, floor: int = 100) -> Column:
    """Two or more amounts of at least ``floor``: an old price and a new one in one text."""
    tokens = F.regexp_extract_all(_text(c), F.lit(r"(\d[\d.,]*\d|\d)"), F.lit(1))
    return F.size(F.filter(tokens, lambda t: F.coalesce(parse_price(t) >= floor, F.lit(False)))) >= 2


def clean_money(c: Column | str) -> Column:
    """``struct(value, note)``: an amount freed of label, call to action and tax note.

    The first amount that carries a currency or a dash is taken, else the first amount.
    An amount of zero says that the price is on request; a text without an amount is
    itself the note.
    """
    squeezed = lambda t, flags="": F.trim(F.regexp_replace(t, flags + r"\s+", " "))

    def parts(t: Column) -> Column:
        raw, found = t["raw"], t["found"]
        at = F.position(found, raw)
        body = F.when(found == "", raw).otherwise(F.concat(F.substr(raw, F.lit(1), at - 1), F.substr(raw, at + F.length(found))))
        return F.struct(raw.alias("raw"), F.nullif(squeezed(found), F.lit("")).alias("note"), F.regexp_extract_all(body, F.lit(_MONEY), F.lit(0)).alias("amounts"))

    def chosen(t: Column) -> Column:
        marked = F.get(F.filter(t["amounts"], lambda a: a.rlike(_MARKED)), F.lit(0))
        value = squeezed(F.coalesce(marked, F.get(t["amounts"], F.lit(0))), "(?U)")
        return F.struct(t["raw"].alias("raw"), t["note"].alias("note"), value.alias("value"))

    def answer(t: Column) -> Column:
        raw, note, value = t["raw"], t["note"], t["value"]
        # only a text without a digit above 0 can be zero
        zero = ~value.rlike("[1-9]") & F.coalesce(parse_price(value) == 0, F.lit(False))
        return F.struct(
            F.when(~zero, value).alias("value"),
            F.when(value.isNull(), F.coalesce(note, F.nullif(stripped(raw), F.lit("")))).when(zero, F.coalesce(note, F.lit(ON_REQUEST))).otherwise(note).alias("note"),
        )

    raw = _text(c)
    first = F.struct(raw.alias("raw"), F.regexp_extract(raw, f"(?iu){NOTE}", 0).alias("found"))
    return F.when(raw.isNotNull(), let(let(let(first, parts), chosen), answer))


def strip_label(c: Column | str) -> Column:
    """Without a caption glued to the front ("Estado:1 left"); "Nike: Air" and addresses stay."""
    return stripped(F.regexp_replace(_text(c), r"^\s*[^:\d]{1,20}:(?=[^\s/])", ""))
