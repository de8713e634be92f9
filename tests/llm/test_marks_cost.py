"""What p6 reads of a text only once, or not at all, and that this changes no result."""

import random
import re

import pytest

from mossgrid.llm import articles as a
from mossgrid.llm import encoding, residue

INDEX = residue.Index({"please": 5, "page": 9, "error": 7}, 1000)
WORDS = ["kabel", "żółty", "blå,", "Größe", "L’étui", "цвет", "синий", "хороший", "товар", "日本語", "PLD-5625", "2,5", "kg", "Farbe:", "gelb.", "Colour :", "red", "Format:", "size", "200 cm", "EU", "39", "ø", "8 mm", "S21", "Ultra", "",
         "page", "not", "found", "Lorem", "ipsum", "404", "{{title}}", "{size}", "undefined", "T('x')", "__name__", "GrÃ¶ÃŸe", "Р¦РµРЅР°", "�", "ŰÎÎÍ", "ñÎÓÉÎÊ", "ÓÉÎÉÊ", "ПЛНТПЛ", "ＰＬＤ", "kаbel", "a\xa0b", "é", "x​y", "a\nb", "\tc", "ﬅ('", "İ", "ı", "\x85"]


def texts(count=3000, most=9):
    random.seed(7)
    return [random.choice([" ", " ", " ", "  "]).join(random.choices(WORDS, k=random.randint(0, most))) for _ in range(count)]


def test_ordinary_listings_are_not_read_for_traces(monkeypatch):
    calls = []
    for name in ("harmless", "repair"):
        monkeypatch.setattr(encoding, name, lambda t, f=getattr(encoding, name): calls.append(t) or f(t))
    for k in range(50):
        assert a.marks(f"Vintorp PLD-{5625 + k} Mini, żółty kabel", "Vintorp", None, "Kabel, żółty. Größe: L’étui 200 cm", "s1", INDEX)
    assert set(calls) <= {"Vintorp"}  # the brand, once


def test_quiet_texts_are_clean_and_hold_no_residue():
    quiet = 0
    for t in texts():
        if INDEX.quiet(t):
            quiet += 1
            assert residue._clean(t) == t and INDEX.judge(t.casefold(), frozenset(), True) is None
            assert INDEX.quiet(t)
    assert 100 < quiet < 2900
    assert all(INDEX.quiet(w) for w in ("kabel żółty 2,5 kg", "Größe L’étui", "хороший товар синий цвет", "", " "))
    assert not any(INDEX.quiet(w) for w in ("Lorem ipsum", "{{title}}", "GrÃ¶ÃŸe", "ＰＬＤ", "kаbel", "a\xa0b", "PAGE introuvable", "x" * 80 + "�"))


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(residue, "KNOWN", 10)
    index = residue.Index()
    for i in range(100):
        assert index.quiet(f"kabel {i} {'x' * 65}") and len(index.known) <= 13
        assert not any(len(w) > residue.KNOWN_LENGTH for w in index.known)


def test_marks_are_those_of_texts_read_in_full(monkeypatch):
    listings = [(x, "Vintorp", y, z, "s1") for x, y, z in zip(texts(1200), random.choices(["PLD5625MINI-053", None, "_12_3"], k=1200), reversed(texts(1200, 25)))]
    got = [a.marks(*x, INDEX) for x in listings]
    monkeypatch.setattr(residue.Index, "quiet", lambda self, t: False)
    assert got == [a.marks(*x, INDEX) for x in listings] and sum(x is not None for x in got) > 100


def test_patterns_find_what_the_plain_ones_find():
    plain_code, plain_label = re.compile(a._CODE.pattern.replace("{1,12}+", "{1,12}")), re.compile(r"([^\W\d_]+) ?$")
    assert plain_code.pattern != a._CODE.pattern
    for t in [*texts(), "abcdefghijklmnop12", "abcdefghijkl 12", "a" * 30 + ":1", "farbe\n:x", "ab \n:", "farbe  : x"]:
        assert [m.groups() for m in a._CODE.finditer(t)] == [m.groups() for m in plain_code.finditer(t)]
        for at in (m.start() for m in re.finditer(":", t)):
            old, new = plain_label.search(t, max(0, at - 24), at), a._LABEL.match(t[max(0, at - 24) : at][::-1])
            assert (old and old[1]) == (new and new[1][::-1])
        for pattern in (a._SIZE, a._MEASURE):
            for within in (0, 2, 5):
                assert [m.span() for m in a._found(pattern, t, within)] == [m.span() for m in pattern.finditer(t) if m.start() <= within]
        assert a._plain(t) == re.sub(r"[\W_]+", "", t)


def by_all_sizes(piece, read):
    """One layer of UTF-8 off a piece that is partly garbled, every size tried at every place."""
    out, at, hit = [], 0, False
    while at < len(piece):
        for size in (4, 3, 2) if ord(piece[at]) >= 0x80 else ():
            try:
                raw = encoding._bytes(piece[at : at + size], read)
                if len(piece) - at >= size and len(raw) == size and len(one := raw.decode("utf-8")) == 1 and encoding._kind(one) in "umCcgsqb":
                    out.append(one)
                    at, hit = at + size, True
                    break
            except UnicodeError:
                pass
        else:
            out.append(piece[at])
            at += 1
    return "".join(out) if hit else None


@pytest.mark.parametrize("read", [r for w, r in encoding.PAIRS if w == "utf-8"])
def test_utf8_layers(read):
    random.seed(3)
    for _ in range(300):
        good = "".join(random.choices("aGößeżółцен€—日😀é\x81", k=random.randint(1, 6)))
        piece = good.encode("utf-8").decode(read, random.choice(["ignore", "replace"])) + random.choice(["", "x", "Ω", "\x80", "Ã", "日"])
        try:
            want = encoding._bytes(piece, read).decode("utf-8")
        except UnicodeError:
            want = by_all_sizes(piece, read)
        assert encoding._step.__wrapped__(piece, "utf-8", read) == want


def test_a_piece_is_encoded_once(monkeypatch):
    piece = "Ã¤" * 20 + "Ωx"
    assert encoding._step.__wrapped__(piece, "utf-8", "cp1252") == "ä" * 20 + "Ωx"
    calls, plain = [], encoding._bytes
    monkeypatch.setattr(encoding, "_bytes", lambda *x: calls.append(x) or plain(*x))
    encoding._step.__wrapped__(piece, "utf-8", "cp1252")
    assert len(calls) == 1
