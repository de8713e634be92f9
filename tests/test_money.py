from decimal import Decimal

from pyspark.sql import functions as F

from mossgrid.functions import money

PRICES = {
    "1,250.00": "1250", "1.250,00": "1250", "€1290": "1290", "380,50": "380.5", "": None, "sold out": None, None: None, "€ 5.950": "5950", "€ 129.900": "129900", "€1.234.567": "1234567", "1,234": "1234",
    "0.5": "0.5", "1234.5678": "1234.5678", "2,999,-": "2999", "1,234.567,89": None, "12.": "12", ".5": "0.5", ".": None, "-7": "7",
}
CLEAN = {
    "Precio de oferta€37,00": ("€37,00", None), "Angebot17,90€": ("17,90€", None), "Kopen voor € 31.000,-": ("€ 31.000,-", None), "€ 99.950Financieren?": ("€ 99.950", None), "€ 31.850,-excl. BTW": ("€ 31.850,-", "excl. BTW"),
    "1.234,56 incl. 21% btw": ("1.234,56", "incl. 21% btw"), "18.900 zzgl. MwSt.": ("18.900", "zzgl. MwSt."), "Audi A4 2.0 TFSI €24.950": ("€24.950", None), "€ 5 950 2026": ("€ 5 950", None), "Op aanvraag": (None, "Op aanvraag"),
    "€ 0": (None, "price on request"), "€ 0,00": (None, "price on request"), "0,00 €": (None, "price on request"), "€ 5 950": ("€ 5 950", None), None: None,
}
LABELS = {"Estado:1 disponibles": "1 disponibles", "Op voorraad:Ja": "Ja", "Nike: Air Max 90": "Nike: Air Max 90", "https://a.example/x": "https://a.example/x", "  x  ": "x", None: None}


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_parse_price(spark):
    got = values(spark, PRICES, money.parse_price)
    assert got == [None if v is None else Decimal(v) for v in PRICES.values()]


def test_clean_money(spark):
    got = [None if v is None else (v["value"], v["note"]) for v in values(spark, CLEAN, money.clean_money)]
    assert dict(zip(CLEAN, got)) == CLEAN


def test_strip_label(spark):
    assert values(spark, LABELS, money.strip_label) == list(LABELS.values())


def test_two_prices(spark):
    got = values(spark, ["2,999,-1,899,-", "€ 31.850 incl. 21% btw", "12 34"], money.holds_two_prices)
    assert got == [True, False, False]
