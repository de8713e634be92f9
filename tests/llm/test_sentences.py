import itertools
import random

import pytest

from mossgrid.llm import sentences

UNITS = [
    ["Height 46 cm (without feet: 4.1 cm), width 3 ft. 4 in. overall.", "The Wumm! line sold out early.", "The shop (see Fig. 30!) closes at noon."],
    ["Mr. Vandrel wrote: “Never again.”", "He asked: “Which size?”", "Is it in stock?!", "Nobody knows."],
    ["“Does it fit a 2.5 in. rail?” asked one buyer.", "No. 42 in the list costs $1,309.00 incl. tax.", "Orders placed before 2 p.m. leave the depot the same day."],
    ["It needs a box of 25 pieces, i.e. one pallet...", "Wait ... the label is old.", "Read the notes at jesstad.example/help?page=40&lang=en first."],
    ["Die Orbello GmbH & Co. KG liefert innerhalb von 15 Tagen.", "Im 2. Stock der Werkstatt entstehen Lampen, Kessel usw. für den Handel.", "Am 14.65. kam die Ware an ...", "Teil Nr. 58.", "Die Marke Wumm! liefert nur samstags.", "Zubehör, z. B. Schrauben, liegt bei."],
    ["„Nie wieder!“, schrieb ein Käufer.", "Vgl. S. 79 ff. im Handbuch.", "Der Preis beträgt 1.649,00 € inkl. MwSt. und Versand."],
    ["Quelle bonne idée !", "« Il est parfait ! » écrit une cliente.", "Voir p. 37 de la notice, c.-à-d. le schéma.", "M. Kreutzig a relevé un prix."],
    ["Los EE. UU. quedan fuera del envío gratuito.", "Se devuelve gratis; después, no.", "¿Cabe en una mochila de 38 l?", "¡Qué buena compra!", "«¿Por qué no hay precio?», preguntó un cliente."],
    ["См. рис. 90 в инструкции.", "«Больше никогда!» — написал покупатель.", "Н. П. Vandrel проверил остаток на складе…", "Винты, ключ и т. д. в одной коробке.", "Цена в скобках (1,9 руб.), а фильтр теряет."],
    ["السعر 1,669.00 شاملاً الضريبة.", "«لماذا لا يظهر السعر؟» سأل أحد العملاء.", "هل يناسب الرف رقم 32؟", "قال د. Ilva إن التقييم جيد."],
    ["डॉ. Pellworm ने इसे 10 में से 7.5 अंक दिए।", "“दाम क्यों नहीं दिखता?” एक ग्राहक ने पूछा।", "क्या यह 40 सेमी की शेल्फ पर आएगा?"],
    ["กล่องนี้มีสกรูและประแจให้ครบ", "ก่อนจัดส่งตัวเครื่องส่งคืนราคา 8.3 บาทในวงเล็บ", "ความสูง 98.5 เซนติเมตรไม่รวมขา"],
]
CJK = [
    ["客服说：“明天发货。”", "“价格为什么不见了？”一位买家问道。", "版本2.66会跳过空行……但不会报错。", "第12页的价格是1,299.00元，含税。", "Nuvello的JB-703重约3.1公斤，容量29.5升。"],
    ["とても便利！", "店長は「明日届きます。」と言いました。", "「モーニング。」という名の色もあります。", "Ver. 2.84では空の行を読み飛ばします。", "この棚に合いますか？"],
]


def split(text):
    out, at = [], 0
    for e in sentences.unit_ends(text):
        out.append(text[at:e].strip())
        at = e
    return out


@pytest.mark.parametrize("units", UNITS)
@pytest.mark.parametrize("gap", [" ", "  ", " \t"])
def test_spaced(units, gap):
    assert split(gap.join(units)) == units


@pytest.mark.parametrize("units", CJK)
def test_spaceless(units):
    assert split("".join(units)) == units


def test_blocks_items_and_lines():
    text = "Heading\r\n\r\nOne line\nwrapped here. Next.\n \n1. first item\n2. second (approx. 1.5 m)\n* third\n\nEnd"
    assert split(text) == ["Heading", "One line\nwrapped here.", "Next.", "1. first item", "2. second (approx. 1.5 m)", "* third", "End"]
    assert split("He lost it\n– the end. Go on.Chap. 3.2 ends.") == ["He lost it\n– the end.", "Go on.", "Chap. 3.2 ends."]
    assert sentences.unit_ends(None) == sentences.unit_ends("") == sentences.unit_ends(" \n\t　") == []


def test_positions_cover_the_text_in_order():
    for units in [*UNITS, *CJK]:
        text = "  " + "\n\n".join(units) + " \n"
        ends = sentences.unit_ends(text)
        assert ends == sorted(set(ends)) and [text[:e].rstrip() for e in ends] == [text[:e] for e in ends]
        assert ends[-1] == len(text.rstrip())


def test_thai_lattice():
    phrase = "กล่องนี้มีสกรูและประแจให้ครบ"
    words = sentences.thai_words(phrase, sentences.Lexicon(["กล่อง", "นี้", "สกรู", "ประแจ"]))
    assert words == ("กล่อง", "นี้", "ม", "ี", "สกรู", "และ", "ประแจ", "ใ", "ห", "้", "ครบ")
    assert "".join(sentences.thai_words(phrase)) == phrase
    assert sentences.thai_words("") == ()


def test_over_a_table(spark):
    rows = [(1, "One. Two.", 7), (2, None, 7), (3, " ", 7), (4, "x " * 100_000, 7), (None, "One.", 7)]
    got = sorted(tuple(r) for r in sentences.sentence_units(spark.createDataFrame(rows, "doc_id long, text string, end_pos long")).collect())
    assert got == [(1, 4), (1, 9), (4, 199_999)]
    assert sentences.sentence_units(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_thai_words_decide_at_gaps():
    assert split("ผมไปตลาด แมวกินปลา") == ["ผมไปตลาด แมวกินปลา"]
    assert split("อร่อยมากครับ แต่แพง") == ["อร่อยมากครับ", "แต่แพง"]
    assert split("โคมไฟสว่างมาก และประหยัดไฟ") == ["โคมไฟสว่างมาก และประหยัดไฟ"]
    assert split("แมวกินปลา ถ้าหิว") == ["แมวกินปลา", "ถ้าหิว"]
    assert split("แมวหลับแล้ว หมากินข้าว") == ["แมวหลับแล้ว", "หมากินข้าว"]
    assert split("แมวกินปลา  หมากินข้าว") == ["แมวกินปลา", "หมากินข้าว"]


@pytest.mark.parametrize("opening, closing", ["()", "“”", "「」"])
def test_long_spans_hold_like_short_ones(opening, closing):
    for n in (2, 40):
        text = f"It came late {opening}as was said before. " + "Nobody knows why. " * n + f"So it goes{closing} and was sent back."
        assert split(text) == [text]
    assert len(split("(" * 300 + "One. Two" + ")" * 300 + " went on.")) == 1


def test_no_window_of_characters():
    for n in (1, 70, 700):
        assert split("It costs approx." + " " * n + "5 euros today.") == ["It costs approx." + " " * n + "5 euros today."]
        assert split("Geliefert am" + " " * n + "3. Mai in Kisten.") == ["Geliefert am" + " " * n + "3. Mai in Kisten."]
    text = "See https://x.example/" + "a" * 500 + ".Html for more. Next."
    assert split(text) == [text[: -len(" Next.")], "Next."]
    inner = "One thing. " * 40
    assert split(f"It (as {inner}said) came. Then it went.") == [f"It (as {inner}said) came.", "Then it went."]
    assert len(split('"' + "word " * 300 + 'end." Then.')) == 2


def test_khmer_and_burmese():
    assert split("ខ្ញុំទៅផ្សារ។ គាត់ទៅផ្ទះ។") == ["ខ្ញុំទៅផ្សារ។", "គាត់ទៅផ្ទះ។"]
    assert split("သူသွားတယ်။ ငါလာတယ်။") == ["သူသွားတယ်။", "ငါလာတယ်။"]
    assert split("今天天气很好了 我们去公园") == ["今天天气很好了", "我们去公园"]


def _value(block, cuts):
    """The score of one path: what is cut counts for it, what is passed over against it."""
    b = sentences._Block(block, sentences.Lexicon())
    total, start, wanted = 0.0, 0, list(cuts)
    for m in sentences._END.finditer(block):
        if m.start() < start:
            continue
        at, cut, _ = sentences._trim(b, start, m)
        score = b.terminator_score(start, cut)[0] - 6.0 * bool(b.inside[at])
        if at <= start or not any(c.isalnum() for c in block[start:at]):
            continue
        if wanted and wanted[0] == at:
            total, start = total + score, at
            wanted.pop(0)
        else:
            total -= score
    return total if not wanted else float("-inf")


def _greedy(block):
    b, out, start = sentences._Block(block, sentences.Lexicon()), [], 0
    for m in sentences._END.finditer(block):
        if m.start() < start:
            continue
        at, cut, _ = sentences._trim(b, start, m)
        if b.terminator_score(start, cut)[0] - 6.0 * bool(b.inside[at]) > 0 and any(c.isalnum() for c in block[start:at]):
            out.append(at)
            start = at
    return out


def test_the_path_is_the_best_one():
    pieces = ["“好!”", "他说……", "“好。”", "「是。」", "她走了。", "Dr. ", "No. 5 ", "“Stop!” ", "he said. ", "(see p. 3.) ", "Wait… ", "ОК. ", "т. д. ", "Yes! ", "«¿Qué?» ", "سأل. "]
    rng, better = random.Random(7), 0
    for _ in range(300):
        block = "".join(rng.choices(pieces, k=rng.randint(2, 6))).strip()
        got = sentences._cuts(block, 0)
        places = sorted({sentences._trim(sentences._Block(block, sentences.Lexicon()), s, m)[0] for m in sentences._END.finditer(block) for s in range(m.start())})
        best = max(_value(block, c) for n in range(len(places) + 1) for c in itertools.combinations(places, n))
        assert _value(block, got) == pytest.approx(best), block
        better += best > _value(block, _greedy(block)) + 1e-9
    assert better  # somewhere a cut that pays at once spoils the rest


def test_words_are_learned(spark):
    noun = ["แมว", "หมา", "ปลา", "นก", "ช้าง", "เสือ"]
    verb = ["กินข้าว", "นอนหลับ", "วิ่งเร็ว"]
    rows = [(i, f"{noun[i % 6]}{verb[i % 3]} {noun[(i + 2) % 6]}{verb[(i + i // 6) % 3]}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = sentences.learned(df)
    assert set(noun) <= set(lexicon.openings) and set(verb) <= set(lexicon.finals)
    assert sentences.unit_ends("แมวกินข้าว นกนอนหลับ", lexicon) == [10, 20]
    assert sentences.learned(df.limit(0)).words == sentences.Lexicon().words
