"""Text decoded with the wrong character encoding: found, and restored where it can be.

Round-trip repair. A garbled piece is encoded again under the encoding it was wrongly
read with and decoded strictly as the one it was written in; a step is kept when the
garbling cost of the piece drops, and steps repeat for nested layers. Pieces that lost
characters (U+FFFD) cannot be restored and are reported as they are.

Defined results
* null and empty texts are no case and come back unchanged;
* whole texts are read; what is not garbled keeps its characters;
* repeated rows give one row per id and field; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossgrid.session import spread

#: Fixed values: (encoding the text was written in, encoding it was read with).
PAIRS = (
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "cp1250"), ("utf-8", "iso8859-2"), ("utf-8", "cp1251"), ("utf-8", "koi8-r"), ("utf-8", "cp866"), ("utf-8", "cp1254"), ("utf-8", "cp1253"), ("utf-8", "cp1257"),
    ("cp1250", "cp1252"), ("iso8859-2", "cp1252"), ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("cp866", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp1253", "cp1252"), ("iso8859-5", "cp1252"),
    ("iso8859-7", "cp1252"), ("cp949", "cp1252"), ("cp932", "cp1252"), ("euc-jp", "cp1252"), ("gbk", "cp1252"), ("big5", "cp1252"), ("cp874", "cp1252"),
    ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "mac_roman"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1251", "cp850"), ("cp1251", "cp437"),
)
#: Letters beyond ASCII of the languages written in Latin script here.
LETTERS = frozenset("ÄÖÜäöüßÀÂÇÈÉÊËÎÏÔÙÛŒàâçèéêëîïôùûœÿÁÍÓÚÑáíóúñÅåØøÆæĄĆĘŁŃŚŹŻąćęłńśźżŠšŽžČčŘřĚěŮůÝýĎďŤťŇňĐđÕõÃãĂăȘșȚțŐőŰűİıĞğŞşÞþÐð")
#: Of those, letters that are rare in real words and frequent in garbled ones.
ODD = frozenset("ÃÂÐÞþðÝýÕõãÏÎĂăĞğŞşİıŐőŰűŤťĎďŢţĐđŇňŘÙÛËÊÔÈÌÒìòÿŸƒ")
RUSSIAN = frozenset("абвгдеёжзийклмнопрстуфхцчшщъыьэюяАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")
#: A piece of this cost is looked at; a step must lower a piece's cost by DROP, and a
#: change of code page the whole text's by SWAP_GAIN.
LEAST = 0.9
DROP = 0.7
VOWELS = frozenset("aeiouáéíóúüäöy")
STRANGE_AFTER_OE = frozenset("wkczlpbjæć")
#: Russian letters by frequency, and how often each comes in a thousand.
BY_FREQUENCY = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъ"
PER_MILLE = (110, 85, 80, 74, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 16, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 0.4)
#: Bits a letter that a change between two Cyrillic code pages must save, over so many letters.
SAVED_BITS = 0.5
CYRILLIC_LEAST = 6
#: Below so many bits a letter a text is Russian as it stands.
ORDINARY_BITS = 4.75
FREQUENT = frozenset("оеаинтсрвлкмдпуОЕАИНТСРВЛКМДПУ")
SWAP_GAIN = 0.75
LAYERS = 4
#: Cyrillic and Greek letters that look like Latin ones; mixed into Latin
#: words they are look-alikes, not traces of an encoding.
LATIN_TWINS = frozenset("aceopxyijshABCEHKMOPTXYISJ")
LOOKALIKE = frozenset("аеорсухіјѕԁһԛԝАВЕЗІЈКМНОРСТУХЅԌ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυχικε")
#: Lead letters that stand alone where a no-break space was lost.
LONE = frozenset("ÃÂÐ")
_LEAD = re.compile(r"([ÃÐ]) ( ?)")
_WORD = re.compile(r"[^\W\d_]+")
#: A piece: what stands between white space, of bounded length. Long runs are parted at
#: plain characters, between which no garbled sequence stretches.
_PIECE = re.compile(r"(?:[!-~]{0,48}[^\x00-\x7f]{1,160}){1,12}[!-~]{0,48}")


_OPEN = re.compile("[\x80-\x9f]")


def _bytes(text: str, encoding: str) -> bytes:
    """``text`` encoded; positions a Windows code page leaves open stand for themselves."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if not encoding.startswith("cp125") or not _OPEN.search(text):
            raise
        return b"".join(bytes((ord(c),)) if 0x80 <= ord(c) <= 0x9F else c.encode(encoding) for c in text)


@lru_cache(maxsize=None)
def _high_bytes(encoding: str) -> dict[str, int]:
    """The characters beyond ASCII that :func:`_bytes` makes one byte of, for an encoding of one byte a character."""
    out = {}
    for b in range(0x80, 0x100):
        for c in {chr(b), bytes((b,)).decode(encoding, "replace")}:
            try:
                out[c] = _bytes(c, encoding)[0]
            except UnicodeError:
                pass
    return out


@lru_cache(maxsize=65536)
def _kind(c: str) -> str:
    o = ord(c)
    if o < 0x80:
        return ("U" if c.isupper() else "l") if c.isalpha() else "d" if c.isdigit() else "."
    if o <= 0x9F or o == 0xFFFD:
        return "X"
    cat = unicodedata.category(c)
    if cat in ("Co", "Cn", "Cc", "Cs"):
        return "X"
    if cat[0] == "L":
        if o < 0x250:
            return ("u" if c.isupper() else "m") if c in LETTERS else "o"
        if 0x400 <= o < 0x530:
            return ("C" if c.isupper() else "c") if c in RUSSIAN else "k"
        if 0x370 <= o < 0x400:
            return "g"
        if 0x2B0 <= o < 0x370:
            return "x"
        return "L"
    if 0x2500 <= o < 0x2600 or c in "√∂∑∏∫∆≈≠≤≥∞◊⌐":
        return "b"
    if c in "–—‘’“”…•™     　­​‌‍‎⁠﻿‐‑":
        return "q"
    if o < 0x100 or cat in ("Sk", "Lm") or c in "†‡‚„‰‹›€":
        return "s"
    return "M" if cat[0] == "M" else "z"


@lru_cache(maxsize=1 << 17)
def cost(piece: str) -> float:
    """How garbled a piece (no white space inside) looks; 0 for common text."""
    total, n = 0.0, len(piece)
    kinds = [_kind(c) for c in piece]
    run, shouted, dashed = 0, "l" not in kinds and "m" not in kinds, False
    for i, (c, k) in enumerate(zip(piece, kinds)):
        before, after = kinds[i - 1] if i else " ", kinds[i + 1] if i + 1 < n else " "
        if k in "lUd.":
            run = 0
            continue
        if k == "X":
            total += 3
        elif k == "b":
            total += 2.5 if before != " " or after != " " else 1.0
        elif k in "um":
            follower = piece[i + 1 : i + 2].lower()
            if c in "ñÑ" and follower.isalpha() and follower not in VOWELS or c in "œŒ" and follower in STRANGE_AFTER_OE:
                total += 1.0
            elif c in "êÊ" and before in "lUum" and not follower.isalpha():
                total += 0.8
            elif k == "m" and before == "U" and after == "U":
                total += 1.2
            total += 0.12 if c not in ODD else 0.3 if k == "u" and (shouted and n > 1 or before in "Uu" and after in "Uu") else 0.9
            run += 1
            if run >= 4:
                total += 0.6
            if before == "g":
                total += 1.0
            if k == "u" and (before in "lm" or before == "u" and not shouted):
                total += 1.6 if before in "lm" else 0.9
        elif k == "o":
            total += 1.2 + (1.0 if c == "µ" and before in "lUum" and after in "lUum" else 0)
            run += 1
        elif k == "x":
            total += 1.5
        elif k in "Cc":
            total += (0.03 if c in FREQUENT else 0.1) + (1.6 if k == "C" and before in "clm" else 0) + (1.0 if before in "lUum" and c not in LOOKALIKE and piece[i - 1] not in LATIN_TWINS else 0)
        elif k == "k":
            total += (0.1 if c in LOOKALIKE else 1.5) + (1.6 if c.isupper() and before in "clm" else 0)
        elif k == "g":
            total += 0.1 + (1.0 if before in "lUums" and c not in LOOKALIKE else 0) + (0.3 if before == "s" else 0)
        elif k == "s":
            letter_before, letter_after = before in "lUumoCckgLs", after in "lUumoCckgLs"
            if c == "¿" and after == "m" or c == "¿" and piece[i + 1 : i + 2].islower() and not piece[:i].strip("«“(\""):
                total += 0.9
            elif c in "²³" and piece[i - 1 : i].lower() == "m" and not letter_after or c in "®©" and not letter_after or c in "¿¡" and not piece[i - 1 : i].isalpha() or c == "°" and piece[:i].lower() == "n" or c == "°" and (before in "d " and piece[i + 1 : i + 2] in ("", "C", "F", ".", ",", ")")):
                total += 0.1
            elif c in "«„‚‹" and (i == 0 or before == ".") or c in "»›" and not letter_after or c in "½¼¾" and before in "d " and not letter_after or c in "£€¥" and (before in "d . " and not letter_after or after == "d" and not letter_before) or c in "ªº" and before == "d":
                total += 0.2
            elif letter_before or letter_after:
                total += 2.0
            elif n == 1:
                total += 0.3
            else:
                total += 0.8
        elif k == "q":
            # a mark of typography inside a word or right after a garbled lead letter
            if c in "”“™…•" and after in "lUum" and (before in "lUum" or c == "™" and not i):
                total += 2.0
            elif c in "–—" and before in "lUum" and after in "lUum" and not dashed:
                # once a piece: dashes alone, as between three names, are no trace
                total, dashed = total + 0.6, True
            total += 1.0 if piece[i - 1 : i] in ("Ã", "Â", "â", "Å", "Ä", "Ð", "Ñ", "Î", "Ï", "Ĺ", "Ă", "ƒ") and i else 0.0
        elif k == "M":
            total += 0.3 if "\u0300" <= c <= "\u030c" or c in "\u0327\u0328\ufe0f" or not "\u0300" <= c <= "\u036f" else 1.5
        elif k == "z":
            total += 0.05
        elif k == "L":
            # letters of other scripts, beside a letter of these
            if (before in "lUumoCck" or after in "lUumoCck") and unicodedata.normalize("NFKC", c) == c:
                total += 1.55
    return total


@lru_cache(maxsize=1 << 17)
def _step(piece: str, written: str, read: str) -> str | None:
    """The piece with one layer taken off; for UTF-8 also inside a piece that is only partly garbled."""
    try:
        return _bytes(piece, read).decode(written)
    except UnicodeError:
        if written != "utf-8":
            return None
    out, at, hit = [], 0, False
    high = _high_bytes(read)
    while at < len(piece):
        done = 0
        # the first byte tells how many make one character, and all the others are beyond ASCII
        first = high.get(piece[at], 0)
        if size := 2 if 0xC2 <= first <= 0xDF else 3 if 0xE0 <= first <= 0xEF else 4 if 0xF0 <= first <= 0xF4 else 0:
            raw = [high.get(c, 0) for c in piece[at : at + size]]
            try:
                if len(raw) == size and _kind(one := bytes(raw).decode("utf-8")) in "umCcgsqb":
                    out.append(one)
                    done = size
            except UnicodeError:
                pass
        if done:
            at, hit = at + done, True
        else:
            out.append(piece[at])
            at += 1
    return "".join(out) if hit else None


@lru_cache(maxsize=1 << 17)
def suspicious(piece: str) -> bool:
    return cost(piece) >= LEAST


def cost_of(text: str) -> float:
    """Cost of a restored piece, which may hold white space."""
    return sum(map(cost, text.split(" "))) if " " in text else cost(text)


@lru_cache(maxsize=1 << 17)
def _peel(piece: str, layers: int = LAYERS) -> tuple[float, str]:
    """``(cost, text)`` of the piece after the chain of UTF-8 round trips that leaves the
    lowest cost; each step must lower it."""
    here = cost_of(piece)
    best = (here, piece)
    if layers and here >= LEAST:
        for written, read in PAIRS:
            if written == "utf-8":
                r = _step(piece, written, read)
                if r is not None and r != piece and cost_of(r) <= here - 0.4:
                    then = _peel(r, layers - 1)
                    if then[0] < best[0] - 1e-9:
                        best = then
    lost = 3 * piece.count("\ufffd")
    return best if here - best[0] >= DROP and best[0] - lost <= 0.45 * (here - lost) else (here, piece)


def _one_script(piece: str) -> bool:
    """No word of the piece mixes Latin with another script, and no new white space or control came up."""
    if any(c.isspace() or "\x7f" <= c <= "\x9f" for c in piece):
        return False
    return all(w.isascii() or all(ord(c) < 0x250 for c in w) or not any(ord(c) < 0x250 for c in w) for w in _WORD.findall(piece))


def _word_like(piece: str) -> bool:
    """Letters beyond ASCII are of one script and not most of a Latin word."""
    far = [_kind(c) for c in piece if ord(c) >= 0x80]
    near = sum(c.isascii() and c.isalpha() for c in piece)
    return all(k in "Cc" for k in far) or all(k in "um" for k in far) and len(far) <= near


#: Letters that cost 0.12 and marks that cost nothing, but where _DEAR finds them.
_HARMLESS = frozenset(map(chr, range(0x80))) | {c for c in LETTERS - ODD - set("ñêœ") if c.islower()} | set("–—’‘")
_CAPITALS = frozenset(c for c in LETTERS - ODD - set("ÑÊŒ") if c.isupper())
_LOWER = "".join(sorted(c for c in _HARMLESS if c.islower() and not c.isascii()))
_UPPER = "".join(sorted(_CAPITALS))
#: Where these characters cost more: a capital inside a word, a small letter between
#: capitals, a dash between letters, a mark after a lead letter, four in a run, eight in a piece.
_DEAR = re.compile(f"[^\\x00-\\x7f](?:(?<=[^\\W\\d_][{_UPPER}])|(?<=[A-Z][{_LOWER}])(?=[A-Z])|(?<=[^\\W\\d_][–—])(?=[^\\W\\d_])|(?<=[{_UPPER}â])[–—’‘]|[^\\x00-\\x7f]{{3}}|(?:[!-~]{{0,48}}[^\\x00-\\x7f]){{7}})")
_PLAIN = _HARMLESS | _CAPITALS


def harmless(text: str) -> bool:
    """No piece of the text can be suspicious; most texts leave here."""
    return text.isascii() or _PLAIN.issuperset(text) and not _DEAR.search(text)


_BITS = {c: -math.log2(n / 1000) for c, n in zip(BY_FREQUENCY, PER_MILLE)}
_CYRILLIC = re.compile("[\u0400-\u052f]+")
#: Words of Cyrillic alone; single letters inside Latin words are look-alikes.
_CYRILLIC_WORD = re.compile("(?<![^\\W\\d_])[\u0400-\u052f]{2,}(?![^\\W\\d_])")


def _bits(text: str) -> float:
    """Bits a letter of the text's Cyrillic, by Russian letter frequencies."""
    letters = Counter("".join(_CYRILLIC_WORD.findall(text)).lower().replace("ё", "е"))
    return sum(_BITS.get(c, 12.0) * n for c, n in letters.items()) / max(1, letters.total())


def _letters(text: str) -> int:
    return sum(map(len, _CYRILLIC_WORD.findall(text)))


def _other_cyrillic(text: str) -> str | None:
    """The text with one Cyrillic code page exchanged for another, where its letters are
    those of Russian only afterwards."""
    if not _CYRILLIC.search(text) or (letters := _letters(text)) < CYRILLIC_LEAST:
        return None
    before, best = _bits(text), None
    if before < ORDINARY_BITS:
        return None
    for written, read in (("koi8-r", "cp1251"), ("cp1251", "koi8-r")):
        try:
            out = _CYRILLIC.sub(lambda m: m[0].encode(read).decode(written), text)
        except UnicodeError:
            continue
        if _letters(out) >= 0.8 * letters and before - (now := _bits(out)) >= SAVED_BITS:
            before, best = now + SAVED_BITS, out
    return best


#: Greek letters by frequency, and how often each comes in a thousand.
GREEK_BY_FREQUENCY = "αοιετσνηυρπκμλςωγδχθφβξζψ"
GREEK_PER_MILLE = (120, 98, 93, 90, 91, 49, 79, 52, 43, 50, 50, 42, 44, 33, 30, 20, 20, 17, 14, 10, 8, 6, 6, 5, 2)
_GREEK_BITS = {c: -math.log2(n / 1000) for c, n in zip(GREEK_BY_FREQUENCY, GREEK_PER_MILLE)}
#: Bits a letter of other scripts: what is rare in their texts costs RARE_BITS, a capital after a small letter CASE_BITS more.
RARE_BITS, CASE_BITS, MIXED_BITS, PLAIN_BITS = 10.0, 6.0, 8.0, 4.5
#: Readings that win this share of the best one's gain are told apart by their letters, and left
#: alone where two scripts differ by less than TIE_BITS; a gain in cost saves GAIN_BITS.
CLOSE, TIE_BITS, GAIN_BITS = 0.6, 0.05, 0.3


#: Thai letters that hardly any word holds; what the national standards hold as common, by lead byte.
RARE_THAI = frozenset("ฃฅฆฌฎฏฐฑฒฬฤฦ")
COMMON_HAN = (("gb2312", 0xB0, 0xD7), ("euc-jp", 0xB0, 0xCF), ("big5", 0xA4, 0xC6))


@lru_cache(maxsize=1 << 16)
def _letter_bits(c: str) -> tuple[float, str] | None:
    """Bits of one letter beyond ASCII by how common it is in its script, and the script; None for what is no letter."""
    if not c.isalpha() or c.isascii():
        return None
    low = c.lower()
    if "\u0400" <= c < "\u0530":
        return _BITS.get(low.replace("ё", "е"), RARE_BITS), "cyrillic"
    if "\u0370" <= c < "\u0400":
        return RARE_BITS if low in "ΐΰ" else _GREEK_BITS.get(unicodedata.normalize("NFD", low)[0], RARE_BITS), "greek"
    if "\u0e00" <= c < "\u0e80":
        return RARE_BITS if c in RARE_THAI else 4.3, "thai"
    if "\uac00" <= c < "\ud7a4":
        try:
            # the standard holds what is in use, a narrower range than the others'; the codec spells out the rest
            return (PLAIN_BITS - 0.5 if len(c.encode("euc-kr")) == 2 else RARE_BITS), "hangul"
        except UnicodeEncodeError:
            return RARE_BITS, "hangul"
    if "\u3040" <= c < "\u3100":
        return 3.5 if c < "\u30a0" else 4.0, "han"
    if "\u4e00" <= c < "\ua000":
        return PLAIN_BITS, "han"  # whether it is common only the text's others tell
    return (PLAIN_BITS, "latin") if ord(c) < 0x250 else (RARE_BITS, "other")


_GREEK_WORD, _TONOS = re.compile("[\u0370-\u03ff]{4,}"), re.compile("[\u0300\u0301\u0342]")


def _main_script(text: str) -> str:
    scripts = Counter(x[1] for c in text if (x := _letter_bits(c)))
    return scripts.most_common(1)[0][0] if scripts else ""


@lru_cache(maxsize=1 << 16)
def _common_in(c: str) -> frozenset[str]:
    """The standards in which a Chinese character is one of the common ones."""
    out = set()
    for page, first, last in COMMON_HAN:
        try:
            if first <= c.encode(page)[0] <= last:
                out.add(page)
        except UnicodeEncodeError:
            pass
    return frozenset(out)


def reading_bits(text: str) -> float:
    """Bits a letter of a reading's letters beyond ASCII; capitals inside words, a final sigma before
    a letter and letters of a second script cost more."""
    total, before, scripts = 0.0, "", Counter()
    stray = 0
    for c in text:
        said = _letter_bits(c)
        if said is not None:
            total += said[0]
            scripts[said[1]] += 1
            if c.isupper() and before.islower() or before == "ς":
                total += CASE_BITS
        elif c >= "\u0370" and not (unicodedata.category(c)[0] == "M" and before.isalpha() and not before.isascii()) and not (c in "ー・、。" and before >= "\u3000") and not "\u2010" <= c <= "\u2122":
            # a mark without its letter, a digit or sign of another script
            stray += 1
            total += RARE_BITS
        before = c
    # a Greek word of several syllables has an accent
    total += CASE_BITS * sum(not _TONOS.search(unicodedata.normalize("NFD", w)) and not w.isupper() for w in _GREEK_WORD.findall(text))
    n = scripts.total() + stray
    if not scripts:
        return RARE_BITS if stray else PLAIN_BITS
    if han := [_common_in(c) for c in text if "\u4e00" <= c < "\ua000"]:
        # all characters of a text are common in one language
        total += (RARE_BITS - PLAIN_BITS) * (len(han) - max(sum(page in x for x in han) for page, *_ in COMMON_HAN))
    if n == 1 and not scripts["latin"]:
        total += MIXED_BITS  # one letter alone is no word of another script
    return (total + MIXED_BITS * (n - stray - max(scripts.values()))) / n


def repair(text: str | None) -> tuple[str | None, bool]:
    """``(text, found)``: the text with garbled pieces restored where possible, and whether any piece is garbled."""
    if not text or harmless(text):
        return text, False
    now = {p: p for p in _PIECE.findall(text) if suspicious(p)}
    if not now:
        other = _other_cyrillic(text)
        return (text, False) if other is None else (other, True)
    found = "\ufffd" in text
    found |= any("\x80" <= c <= "\x9f" for c in text) or not now.keys().isdisjoint(LONE)
    for _ in range(LAYERS):
        before = dict(now)
        for p, q in now.items():
            now[p] = _peel(q)[1]
        # one code page read as another: the same pair for the whole text, whichever helps most
        left = {p: q for p, q in now.items() if "\ufffd" not in q and q not in LONE and suspicious(q)}
        best, readings = None, []
        for pair in PAIRS:
            if pair[0] != "utf-8" and left:
                take, won = {}, 0.0
                for p, q in left.items():
                    r = _step(q, *pair)
                    if r is not None and r != q and _one_script(r) and (less := cost_of(q) - cost_of(r)) >= DROP and cost_of(r) <= cost_of(q) / 3:
                        take[p] = r
                        won += less
                if take and won > SWAP_GAIN + 1e-9:
                    readings.append((won, len(readings), take, pair))
        if readings:
            top = max(readings)[0]
            # what a reading leaves as it is counts against it
            far = {p: sum(c >= "\x80" for c in q) for p, q in left.items()}
            share = lambda take: sum(far[p] for p in take) / sum(far.values())
            close = sorted((reading_bits(" ".join(take.values())) * share(take) + RARE_BITS * (1 - share(take)) - GAIN_BITS * won, i, won, take, pair) for won, i, take, pair in readings if won >= CLOSE * top)
            bits, _, _, best, used = close[0]
            script = _main_script(" ".join(best.values()))
            if any(c[0] - bits < TIE_BITS and _main_script(" ".join(c[3].values())) not in ("", script) for c in close[1:]):
                found, best = True, None  # readings in two scripts are as good as each other: neither is taken
        if best:
            # the rest of the text was read the same way
            rest = set(_PIECE.findall(text)) - now.keys()
            for p in rest if len(rest) <= 2 * len(best) else ():
                r = _step(p, *used)
                if r is not None and r != p and _one_script(r) and _word_like(r) and cost_of(r) <= cost_of(p) + 0.01:
                    best[p] = r
            now |= best
        if now == before:
            break
        found = True
    if not found:
        other = _other_cyrillic(text)
        return (text, False) if other is None else (other, True)
    return _LEAD.sub(_lost_space, _PIECE.sub(lambda m: now.get(m[0], m[0]), text)), True


def _lost_space(m: re.Match) -> str:
    """A lead letter whose no-break space has become a space: "Ã " was "à"."""
    return (m[1] + "\xa0").encode("cp1252").decode("utf-8") + (" " if m[1] == "Ã" and not m[2] else "") + m[2]


def garbled_fields(products: DataFrame, fields: Sequence[str] = ("title", "description"), key: str = "product_id") -> DataFrame:
    """``(key, field_name, text, restored)`` of every garbled field value, once.

    ``restored`` still holds U+FFFD where characters are lost for good.
    """
    kind = dict(products.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, names, texts, restored = [], [], [], []
            for f in fields:
                for i, t in zip(pdf[key], pdf[f]):
                    if t:
                        new, hit = repair(t)
                        if hit:
                            ids.append(i), names.append(f), texts.append(t), restored.append(new)
            yield pd.DataFrame({key: ids, "field_name": names, "text": texts, "restored": restored})

    # only values with a character beyond ASCII can be garbled; the others stay in the JVM
    only = products.where(F.col(key).isNotNull()).select(key, *[F.when(F.col(f).rlike(r"[^\x00-\x7f]"), F.col(f)).alias(f) for f in fields]).where(" or ".join(f"`{f}` is not null" for f in fields))
    return spread(only).mapInPandas(run, f"{key} {kind}, field_name string, text string, restored string").dropDuplicates([key, "field_name", "text"])
