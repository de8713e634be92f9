import unicodedata

import pytest

from mossgrid.llm import characters

SCHEMA = "product_id long, title string, brand string, description string, sku string, text string, words string"
NB, ZW, SHY, BOM = chr(0xA0), chr(0x200B), chr(0xAD), chr(0xFEFF)


def wide(s):
    return "".join(chr(ord(c) + 0xFEE0) for c in s)


@pytest.mark.parametrize(
    "odd, plain",
    [
        (wide("Kettle"), "Kettle"), (f"a{NB}b{chr(0x2009)}c{chr(0x3000)}d", "a b c d"), (f"{BOM}ket{ZW}t{SHY}le", "kettle"), (unicodedata.normalize("NFD", "Küche légère"), "Küche légère"), (f"suf{chr(0xFB01)}x {chr(0xFB06)}e", "suffix ste"),
        (f"KRD{chr(0x2011)}1234", "KRD-1234"), ("".join(chr(0x1D670 + ord(c) - 65) for c in "PXT"), "PXT"), (f"gr{chr(0x133)}s", "grijs"),
    ],
)
def test_folding(odd, plain):
    assert characters.fold(odd) == plain


@pytest.mark.parametrize("text", ["m² ½ ™ ® № …", "“q” ‘q’ – —", "Ωmegrin Тайгана Łąkowiec", "👨‍👩‍👧 ❤️", "œuvre", ""])
def test_what_stays(text):
    assert characters.fold(text) == text


def test_twins():
    assert characters.twin_spellings("Wоlldеckе") == ("Wolldecke",)
    assert characters.twin_spellings("Tайгана") == ("Тайгана",)
    assert "BAR" in characters.twin_spellings("ΒΑR")
    assert characters.twin_spellings("Ωmegrin") == () and characters.twin_spellings("plain") == () and characters.twin_spellings("Тайгана") == ()


def test_only_words_of_the_vocabulary_are_substituted(spark):
    rows = [
        (1, "Wоlldecke blau", "Xandor", None, None, "t", "w"),
        (1, "Wоlldecke blau", "Xandor", None, None, "t", "w"),
        (2, "Wolldecke", None, "", "AB-1", None, None),
        (3, "qzхq rare", f"Xan{ZW}dor", None, None, None, None),
        (4, "KÃ¼che" + NB + "x", None, None, None, None, None),
        (5, None, None, "x" * 60_000 + NB, None, None, None),
        (None, "a" + NB, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["product_id"], r["field_name"]): r["consistent"] for r in characters.consistent_form(df).collect()}
    assert got == {(1, "title"): "Wolldecke blau", (3, "brand"): "Xandor", (5, "description"): "x" * 60_000 + " "}
    assert {tuple(r) for r in characters.inconsistent_fields(df).collect()} == set(got)
    empty = df.limit(0)
    assert characters.consistent_form(empty).count() == 0 and characters.inconsistent_fields(empty).count() == 0


def test_the_prefilter_leaves_out_nothing():
    # what fold changes, alone or after the letter before it, is looked at
    pattern = characters.suspect_chars()
    for o in [*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x2F800, 0x2FA20)]:
        c = chr(o)
        if characters.fold(c) != c:
            assert pattern.search(c), hex(o)
        split = unicodedata.normalize("NFD", c)
        if split != c and characters.fold(split) != split:
            assert pattern.search(split), hex(o)


@pytest.mark.parametrize("word, plain", [("Gօօgle", "Google"), ("Ꭺpple", "Apple"), ("Ꮪony", "Sony"), ("ɡoogle", "google"), ("pаpеr", "paper"), ("Αlpha", "Alpha")])
def test_twins_of_other_scripts(word, plain):
    assert plain in characters.twin_spellings(word)
    assert characters.suspect_chars().search(word)


def test_words_of_one_script_stay():
    for word in ("Բարեւ", "ᏣᎳᎩ", "Москва", "Αθήνα", "Straße"):
        assert characters.twin_spellings(word) == ()


def test_many_candidates_meet_the_corpus_by_a_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Pаper lamp", "x", None), (2, "paper", None, None)], "product_id long, title string, brand string, description string")
    few = {tuple(r) for r in characters.consistent_form(df).collect()}
    monkeypatch.setattr(characters, "BROADCAST_WORDS", 0)
    assert few == {tuple(r) for r in characters.consistent_form(df).collect()} == {(1, "title", "Pаper lamp", "Paper lamp")}
