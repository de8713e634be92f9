import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mossgrid.llm import encoding

SCHEMA = "product_id long, title string, description string, field_name string, text string, restored string"


def garble(text, written, read):
    return encoding_bytes(text.encode(written), read)


def encoding_bytes(raw, read):
    return "".join(bytes((b,)).decode(read, "ignore") or chr(b) for b in raw) if read == "cp1252" else raw.decode(read)


@pytest.mark.parametrize("text", ["Küche für große Räume", "boîte légère à fleurs", "Właśnie żółta łódź", "señora mañana", "бутылка для воды", "Čedrana – It’s"])
@pytest.mark.parametrize("read", ["cp1252", "latin-1", "mac_roman", "cp437", "cp1250"])
def test_round_trips(text, read):
    try:
        bad = garble(text, "utf-8", read)
    except UnicodeError:
        pytest.skip("not readable under this encoding")
    good, found = encoding.repair(bad)
    assert found
    assert good.replace(" ", "") == text.replace(" ", "")


def test_nested_layers_and_parts():
    once = garble("Küche für große Räume", "utf-8", "cp1252")
    assert encoding.repair(garble(once, "utf-8", "cp1252")) == ("Küche für große Räume", True)
    assert encoding.repair(f"Schöne {once} – neu") == ("Schöne Küche für große Räume – neu", True)


@pytest.mark.parametrize("bad, good", [("êóðòêà äîæäåâàÿ", "куртка дождевая"), ("Powierzchniê ³atwo wyczyœciæ wilgotn¹", "Powierzchnię łatwo wyczyścić wilgotną"), ("f\x81r t„glichen Ger„te", "für täglichen Geräte"), ("РџРѕРІРµСЂС…РЅРѕСЃС‚СЊ", "Поверхность")])
def test_other_code_pages(bad, good):
    assert encoding.repair(bad) == (good, True)


def test_lost_characters_are_found():
    assert encoding.repair("k�kskniv fr�n")[1]


@pytest.mark.parametrize("text", ["Ångström naïve Ørsholt Łąkowiec Ždárek", "RÅGMJÖL FRÅN KVARNEN PÅ HÖJDEN", "GRÃO FINO, MAÇÃ, SÃO-TELMO-Duft", "CHÊNE ÂME CÂBLE", "7 m², 40 dm³ ½ height, 30 °C, n° 5, 5 € ™ ®", "«Больше никогда!» — «¿Por qué?»", "Ωmegrin Тайгана Zażółcin", "Wоlldeсke", "plain", "", None, "漢字 ภาษาไทย हिन्दी"])
def test_honest_text_is_left_alone(text):
    assert encoding.repair(text) == (text, False)


def test_over_a_table(spark):
    rows = [(1, "FrÃ¼h", None, "x", "y", "z"), (1, "FrÃ¼h", None, "x", "y", "z"), (2, "", "ok", None, None, None), (3, None, "a" * 50_000 + " KÃ¼che", None, None, None), (None, "KÃ¼che", None, None, None, None)]
    got = {(r["product_id"], r["field_name"]): r["restored"] for r in encoding.garbled_fields(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, "title"): "Früh", (3, "description"): "a" * 50_000 + " Küche"}
    assert encoding.garbled_fields(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("bad, good", [("MEHL AUS DER MšHLE", "MEHL AUS DER MÜHLE"), ("DUFTKERZE FRšHLINGSWIESE", "DUFTKERZE FRÜHLINGSWIESE"), ("LAUTSPRECHER FšR DRAUSSEN", "LAUTSPRECHER FÜR DRAUSSEN")])
def test_small_letter_between_capitals(bad, good):
    assert encoding.repair(bad) == (good, True)


def test_harmless_texts_have_no_suspicious_piece():
    rng = random.Random(5)
    far = sorted(c for c in encoding._HARMLESS | encoding._CAPITALS if not c.isascii())
    texts = ["".join(c + "aZ-. 7"[: rng.randint(0, 6)] for c in rng.choices(far + list("abNZ ") * 9, k=rng.randint(1, 16))) for _ in range(40_000)]
    texts += ["".join(rng.choices(far + list("aZ .1-bQ") * 9, k=rng.randint(1, 12))) for _ in range(40_000)] + ["MšHLE", "a–b–c", "ä–ä–ä–ä", "â–", "ä-ö" * 4]
    assert [t for t in texts if encoding.harmless(t) and any(map(encoding.suspicious, encoding._PIECE.findall(t)))] == []
    assert sum(map(encoding.harmless, texts)) > 1000


def test_dashes_between_names_are_left_alone():
    assert encoding.repair("Mo–Fr–Sa") == ("Mo–Fr–Sa", False)


#: Texts, the encoding they were written in, and those they were read with.
WRITTEN = [
    ("Καφετιέρα εσπρέσο με αντλία", "iso8859-7"), ("Υψηλή ποιότητα για κάθε μέρα", "cp1253"), ("무선 청소기 필터 교체용", "euc-kr"), ("어린이용 자전거 헬멧", "cp949"), ("ステンレス製の水筒です", "shift_jis"), ("不锈钢保温杯 容量大", "gbk"), ("儿童自行车头盔", "gbk"), ("不鏽鋼保溫杯", "big5"),
    ("Чайник электрический белый", "cp1251"), ("Чайник электрический белый", "koi8-r"), ("Бутылка для воды красная", "cp1251"), ("กระเป๋าเดินทาง", "cp874"), ("mieć łóżko dębowe", "cp1250"), ("Küchenmesser mit Öse für Gäste", "cp850"), ("sac à dos de randonnée", "mac_roman"),
]


def test_exact_restorations():
    done = tried = 0
    for text, written in WRITTEN:
        for read in ("latin-1", "cp1252"):
            try:
                garbled = text.encode(written).decode(read)
            except UnicodeDecodeError:
                continue
            tried += 1
            done += encoding.repair(garbled) == (text, True)
    for text in [t for t, _ in WRITTEN]:
        for read in ("latin-1", "cp1252"):
            try:
                garbled = text.encode("utf-8").decode(read)
            except UnicodeDecodeError:
                continue
            tried += 1
            done += encoding.repair(garbled) == (text, True)
    assert tried > 30 and done >= 0.9 * tried, (done, tried)


def test_readings_as_good_as_each_other_leave_the_text_alone():
    garbled = "軽量".encode("euc-jp").decode("latin-1")
    text, found = encoding.repair(garbled)
    assert found and text in (garbled, "軽量")


def test_plain_texts_stay():
    for text, _ in WRITTEN:
        assert encoding.repair(text) == (text, False)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=sorted(encoding._PLAIN | set("éüßżÖ–’ ")), max_size=60))
def test_the_early_exit_leaves_out_nothing(text):
    if encoding.harmless(text):
        assert not any(map(encoding.suspicious, encoding._PIECE.findall(text)))
        assert encoding._other_cyrillic(text) is None
