from decimal import Decimal

import pytest

from mossgrid.operators import units

PRODUCTS = "product_id long, site string, price decimal(18,3), price_text string, currency string, raw string, code string, scale string, amount string"
SITES = "site string, home_currency string, code string"
UNITS = "unit_id string, currency_code string, eur_per_unit decimal(18,6)"
RATES = [("eur", "EUR", "1"), ("eur_cent", "EUR", "0.01"), ("eur_k", "EUR", "1000"), ("usd", "USD", "0.92"), ("usd_cent", "USD", "0.0092"), ("usd_k", "USD", "920"), ("gbp", "GBP", "1.17"), ("gbp_penny", "GBP", "0.0117"), ("sek", "SEK", "0.087"), ("sek_ore", "SEK", "0.00087"), ("nok", "NOK", "0.085"), ("nok_ore", "NOK", "0.00085"), ("jpy", "JPY", "0.0061"), ("kwd", "KWD", "3.02"), ("kwd_fils", "KWD", "0.00302"), ("pln", "PLN", "0.233"), ("pln_grosz", "PLN", "0.00233"), ("pln_k", "PLN", "233")]


@pytest.mark.parametrize(
    "spelling, want",
    [
        ("EUR ", ("EUR", "main")), ("euros", ("EUR", "main")), ("Euro", ("EUR", "main")), ("€", ("EUR", "main")), ("ct", ("EUR", "minor")), ("EUR cent", ("EUR", "minor")), ("Eurocents", ("EUR", "minor")),
        ("GBp", ("GBP", "minor")), ("gbp", ("GBP", "main")), ("GBX", ("GBP", "minor")), ("¢ (US)", ("USD", "minor")), ("U.S. dollars", ("USD", "main")), ("US  dollar", ("USD", "main")), ("SFr.", ("CHF", "main")),
        ("øre", ("KR", "minor")), ("öre", ("SEK", "minor")), ("złotych", ("PLN", "main")), ("zlotych", ("PLN", "main")), ("тенге", ("KZT", "main")), ("円", ("JPY", "main")), ("KD", ("KWD", "main")),
        ("Preis:\x1e€ inkl. MwSt.", ("EUR", "main")), ("Now GBP\x1eincl. VAT", ("GBP", "main")), ("\x1ekrinkl. moms", ("KR", "main")), ("\x1eTsd. EUR", ("EUR", "k")), ("€\x1ethousand", ("EUR", "k")), ("\x1ekEUR", ("EUR", "k")), ("\x1etys. zł", ("PLN", "k")),
        ("\x1e", (None, None)), ("", (None, None)), ("banana", (None, None)), ("x" * 5000, (None, None)),
    ],
)
def test_spellings(spelling, want):
    assert units.Speller().spelling(spelling)[:2] == want


def test_weighted_distance_is_small_for_case_accents_and_marks():
    assert units.weighted_distance("EUR", "eur") < 0.2
    assert units.weighted_distance("zlotych", "złotych") < 1.1
    assert units.weighted_distance("Fr.", "Fr") < 0.2
    assert units.weighted_distance("SEK", "NOK") >= 2


ROWS = [
    # id, site, price, text, currency, raw -> unit, eur
    (1, "de", "157.900", None, "EUR", None, "eur", "157.9"),
    (2, "de", "15790.000", "157,90 €", "EUR", None, "eur_cent", "157.9"),
    (3, "de", None, "46,6 Tsd. EUR", None, None, "eur_k", "46600"),
    (4, "us", "5.500", "5.5k USD", None, None, "usd_k", "5060"),
    (5, "us", "5500.000", "5.5k USD", None, None, "usd", "5060"),
    (6, "us", "11860.000", None, None, '{"prices": {"price": "11860", "currency_code": "USD", "currency_minor_unit": 2}}', "usd_cent", "109.112"),
    (7, "us", "118.600", None, None, '{"prices": {"price": "11860", "currency_code": "USD", "currency_minor_unit": 2}}', "usd", "109.112"),
    (8, "jp", "14773.000", "from14,773 円incl. VAT", "JPY", None, "jpy", "90.1153"),
    (9, "kw", None, "14.142 KWD", None, None, "kwd", "42.70884"),
    (10, "kw", "14142.000", "14.142 KWD", "KWD", None, "kwd_fils", "42.70884"),
    (11, "se", "191316.000", "1 913,16 kr inkl. moms", None, None, "sek_ore", "166.44492"),
    (12, "no", "100.000", None, "øre", None, "nok_ore", "0.085"),
    (13, "se", "100.000", None, None, None, "sek", "8.7"),
    (14, "gb", "9574.000", "9574 GBp", None, None, "gbp_penny", "112.0158"),
    (15, "pl", "13.400", "13,4 tys. PLN", "PLN", None, "pln_k", "3122.2"),
    (16, "de", None, "Preis auf Anfrage", "EUR", None, None, None),
    (17, "de", None, None, None, None, None, None),
    (18, "nowhere", "5.000", None, None, None, None, None),
    (19, "de", "5.000", "", "", "not json", "eur", "5"),
    (20, "de", "0.000", None, "EUR", None, "eur", "0"),
]


def test_units_and_amounts_of_rows(spark):
    rows = [(i, s, p and Decimal(p), t, c, r, "code", "scale", "amount") for i, s, p, t, c, r, *_ in ROWS]
    products = spark.createDataFrame([*rows, rows[1], (None, *rows[0][1:])], PRODUCTS)
    sites = spark.createDataFrame([(s, c, "x") for s, c in (("de", "EUR"), ("us", "USD"), ("jp", "JPY"), ("kw", "KWD"), ("se", "SEK"), ("no", "NOK"), ("gb", "GBP"), ("pl", "PLN"))], SITES)
    rates = spark.createDataFrame([(u, c, Decimal(x)) for u, c, x in RATES], UNITS)
    got = {r["product_id"]: (r["unit_id"], r["amount_eur"]) for r in units.recorded_units(products, sites, rates).collect()}
    want = {i: (u, Decimal(e)) for i, *_, u, e in ROWS if u}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < Decimal("0.001") for k in want)


def test_empty_tables(spark):
    e = lambda s: spark.createDataFrame([], s)
    assert units.recorded_units(e(PRODUCTS), e(SITES), e(UNITS)).count() == 0


@pytest.mark.parametrize("text, want", [("ca. €\x1e", "EUR"), ("Prezzo: €\x1e", "EUR"), ("\x1e€ pro Stück", "EUR"), ("\x1e€/Stk", "EUR"), ("R$\x1e", "BRL"), ("₹\x1e", "INR"), ("\x1eKč", "CZK"), ("\x1eEUR / Stück", "EUR")])
def test_units_among_other_words(text, want):
    assert units.Speller().spelling(text) == (want, "main", False)


@pytest.mark.parametrize("text, unread", [("foo bar", True), ("¤\x1e", True), ("x" * 5000, True), ("\x1eStück", False), ("", False), ("\x1e", False)])
def test_spellings_that_are_not_understood(text, unread):
    assert units.Speller().spelling(text) == (None, None, unread)
