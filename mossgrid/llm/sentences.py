"""Sentence units of texts in many languages and scripts.

A text is cut into blocks at blank lines and before list items. Inside a block the
possible cuts form a lattice: its nodes are the places after terminators and, in scripts
written without spaces, the gaps between written phrases; an edge is a sentence from one
node to a later one. An edge's score says how well its end closes a sentence that began
where it begins: from what stands before the end (abbreviations, numbers, initials, final
particles), after it (case, opening words, speech tags), from quotes that opened with the
sentence, and from open quotes or brackets around the end. Dynamic programming finds the
path of highest total score, where a place passed over counts against it; a cut that helps
where it stands but spoils a later sentence is not taken.

Phrases of spaceless scripts are first segmented by the cheapest path through a word
lattice. Its dictionary is learned from the corpus (:func:`learned`): strings that occur
often and between many different letters, and the words that the corpus shows at the ends
and starts of blocks as final and opening words; lists of particles come with it. Without
a corpus the lists alone decide.

Defined results
* null, empty and blank texts have no unit;
* units are sentences, headings and list items with their marks; closing quotes and
  brackets belong to the sentence before them, white space after it does not;
* a blank line always ends a unit, a single line break only before a list item;
* ``end_pos`` counts code points of the text as given; whole texts are read;
* repeated rows give equal units once.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame

from mossgrid.session import spread

TERMINATORS = ".!?…。！？｡؟۔।॥։።។៕။"
CLOSERS = "”’»“›\"')]}）］】」』》〉"
OPENERS = "“„«‹‘¿¡\"'([{（［【「『《〈—–-"
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "„": "“”", "“": "”", "‹": "›"}
_MARK = re.compile("[" + re.escape("".join([*_PAIRS, *_PAIRS.values()])) + "]")
#: Abbreviations after which a sentence goes on, also before a capital or a number.
INSIDE = frozenset(
    "dr mr mrs ms prof st sr sra sres dña hr fr dhr mevr mw mme mlle mm me д-р г-н г-жа fig figs no nos nr vgl abb chap ver vers vol pp cf ca approx est e.g i.e z d bijv núm núms aprox env pág págs см рис стр ок т.е тыс rys por ok np tj tzn ul inkl exkl incl excl zzgl bzw ggf ggü evtl sog s.o s.u z.b d.h u.a m.a.w o.a c.-à-d p.ej ej vs jr ee u.s डॉ रु नं सं श्री د أ".split()
)
#: Abbreviations that may end a sentence, which the next word decides.
EITHER = frozenset("etc usw itp itd inc ltd co corp bros p.m a.m pm am шт руб т.д т.п др г гг szt ft in oz lb kg cm mm ml ff uu cía s.a jh n.chr m.w मी सेमी किग्रा มม".split())
#: Words before a number and a full stop that make it an ordinal.
ORDINAL_BEFORE = frozenset("im am vom zum beim der die das dem den des ab bis seit dnia dne".split())
#: What may follow an abbreviated company form.
COMPANY = frozenset("KG AG OHG SE Ltd LLC KGaA".split())
#: Verbs and words of speech tags in scripts without case.
SPEECH = ("问道", "说道", "写道", "回答", "问", "说", "喊道", "表示", "سأل", "قال", "كتب", "أجاب", "पूछा", "कहा", "लिखा", "बोला", "尋ね", "言い", "言っ", "答え", "書い", "聞い")
#: Words that open a Chinese clause going on after an ellipsis.
GOES_ON = ("但", "而", "可", "却", "不过", "然后", "所以", "因为", "又", "也", "就")
#: Japanese particles by which a quote becomes part of the sentence.
QUOTE_PARTICLES = ("と", "って", "という", "は", "が", "を", "に", "の", "も", "で", "や", "へ", "から", "など")
#: Thai words, by what they tell about a gap beside them. Particles end a
#: sentence whatever follows.
THAI_PARTICLES = frozenset("ครับ ค่ะ คะ นะ จ้ะ ไหม มั้ย หรือไม่ หรือเปล่า".split())
THAI_FINAL = "ครับ ค่ะ คะ นะ จ้ะ แล้ว ไหม หรือไม่ หรือเปล่า มั้ย เลย ด้วย ครบ".split()
THAI_OPENING = "ก่อน หลังจาก หลัง ตาม ใน เมื่อ ถ้า หาก กรุณา โปรด ทำไม นี่ ที่นี่ เขา เธอ เรา ผม ฉัน คุณ อย่างไรก็ตาม นอกจากนี้ ดังนั้น ความ ราคา".split()
THAI_BINDING = "และ หรือ แต่ ที่ ซึ่ง เพราะ โดย กับ ของ เพื่อ จึง ว่า อัน คือ เป็น ประมาณ ภายใน".split()
#: Particles that end a sentence in scripts written without spaces, besides Thai.
LAO_KHMER_BURMESE_FINAL = "ແລ້ວ ເດີ້ ບໍ່ ເນາະ ហើយ ទេ ណា ទៀត တယ် ပါတယ် မယ် ပါ ဘူး ပြီ လား သည် ၏".split()
#: Endings of Chinese and Japanese sentences before a blank without a terminator.
CJK_FINAL = ("了", "吗", "吧", "呢", "啊", "です", "ます", "ました", "ません", "でした", "だよ", "ですね", "ますか", "ですか")
_THAI = "ก-๎"
_SPACELESS = _THAI + "ກ-ໝក-៓က-႟"
_SPACELESS_GAP = re.compile("(?<=[" + _SPACELESS + "])[ \r\n\t\u00a0]+(?=[^\\W\\d_]|[" + _SPACELESS + "])")
_FOREIGN = re.compile("[^\\s" + _SPACELESS + ".!?…。！？؟।]+")
_CJK_GAP = re.compile("(?<=[぀-ヿ㐀-鿿])[ \\t\u3000]+(?=[぀-ヿ㐀-鿿])")
_SPACELESS_RUN = re.compile("[" + _SPACELESS + "]+")
_NONSPACE = re.compile(r"\S")
_AFTER_MARK = re.compile(f"[{re.escape(TERMINATORS)}]")
_LINE = re.compile("\r\n|[\n\r  \x85\v\f]")
_ITEM = re.compile(r"[﻿​ \t　 ]*(?:[*•·‣◦▪●○■-][ \t 　]+|(\d{1,3})[.)][ \t ]+)(?=\S)")
_END = re.compile(rf"[{re.escape(TERMINATORS)}]+(?:[   ]?[»›](?!\w)|[{re.escape(CLOSERS)}]+[{re.escape(TERMINATORS)}]*)*")
_TOKEN_BEFORE = re.compile(r"[^\s(\[{«„“\"（「¿¡]+$")
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿豈-﫿＀-￯]")
_CASELESS = re.compile(r"[֐-࿿က-႟ក-៿぀-ヿ㐀-鿿가-힯]")
BLANK = "﻿​ \t\r\n 　\f\v"


class Lexicon:
    """Words of spaceless scripts: ``words`` for the lattice, ``finals`` and ``openings`` that the
    corpus shows at the ends and starts of blocks; the lists of particles are always part of it."""

    def __init__(self, words: Iterable[str] = (), finals: Iterable[str] = (), openings: Iterable[str] = ()) -> None:
        self.finals = frozenset(THAI_FINAL) | frozenset(LAO_KHMER_BURMESE_FINAL) | frozenset(finals)
        self.openings = frozenset(THAI_OPENING) | frozenset(openings)
        self.binding = frozenset(THAI_BINDING)
        self.words = frozenset(words) | frozenset(THAI_FINAL) | frozenset(THAI_OPENING) | self.binding | frozenset(LAO_KHMER_BURMESE_FINAL)
        self.longest = max(map(len, self.words))
        self.segment = lru_cache(maxsize=8192)(self._segment)

    def _segment(self, phrase: str) -> tuple[str, ...]:
        """The cheapest path through the lattice of dictionary words; a letter that no word covers costs more."""
        n = len(phrase)
        best: list[tuple[float, int]] = [(0.0, 0)] + [(float("inf"), 0)] * n
        for i in range(n):
            base = best[i][0]
            for size in range(1, min(self.longest, n - i) + 1):
                c = base + (1.0 if phrase[i : i + size] in self.words else 1.6 if size == 1 else float("inf"))
                if c < best[i + size][0]:
                    best[i + size] = (c, i)
        out, at = [], n
        while at:
            out.append(phrase[best[at][1] : at])
            at = best[at][1]
        return tuple(reversed(out))


_PLAIN_LEXICON = Lexicon()


def thai_words(phrase: str, lexicon: Lexicon | None = None) -> tuple[str, ...]:
    return (lexicon or _PLAIN_LEXICON).segment(phrase)


def _is_spaceless(c: str) -> bool:
    return bool(c) and _SPACELESS_RUN.match(c) is not None


class _Block:
    """A block with what the scores ask of it, each thing found once: places of quotes, beginnings
    of tokens and of runs without white space."""

    def __init__(self, text: str, lexicon: Lexicon) -> None:
        self.text, self.lexicon = text, lexicon
        self.inside = _open_spans(text)
        self._places: dict[str, list[int]] = {}
        self._starts: list[int] | None = None
        self._web: dict[int, int] = {}

    def count(self, c: str, a: int, b: int) -> int:
        """How often the mark ``c`` stands in ``[a, b)``."""
        if c not in self._places:
            self._places[c] = [m.start() for m in re.finditer(re.escape(c), self.text)]
        return bisect_left(self._places[c], b) - bisect_left(self._places[c], a)

    def token_start(self, at: int) -> int:
        """Where the token that ends at ``at`` begins."""
        if self._starts is None:
            self._starts = [m.end() for m in _TOKEN_BREAK.finditer(self.text)]
        i = bisect_right(self._starts, at) - 1
        return self._starts[i] if i >= 0 else 0

    def in_address(self, at: int) -> bool:
        """The run without white space that ends at ``at`` is an address."""
        a = at
        while a and not self.text[a - 1].isspace() and at - a < 4096:
            a -= 1
        if a not in self._web:
            end = m.start() if (m := re.compile(r"\s").search(self.text, a)) else len(self.text)
            found = [p for p in (self.text.find(x, a, end) for x in ("://", "@", "www.")) if p >= 0]
            self._web[a] = min(found, default=len(self.text) + 1)
        return self._web[a] < at

    def last_before(self, at: int, begin: int) -> int:
        """The place of the last character before ``at`` that is no white space; ``begin - 1`` for none."""
        at -= 1
        while at >= begin and self.text[at].isspace():
            at -= 1
        return at

    def gap_score(self, a: int, b: int) -> float:
        """The gap ``[a, b)`` between two phrases: words on either side decide."""
        text = self.text
        if not _is_spaceless(text[b : b + 1]):
            # another script follows: a name inside the sentence, or a sentence of its own
            foreign = _FOREIGN_PART.match(text, b)[0]
            whole = len(_FOREIGN.findall(foreign)) >= 3 or len(_UNSPACED.findall(foreign)) >= 6
            return 1.5 if whole and not text[b].islower() else -3.0
        lex = self.lexicon
        before = a
        while before and _is_spaceless(text[before - 1]):
            before -= 1
        left = lex.segment(text[before:a])[-1]
        right = lex.segment(_SPACELESS_RUN.match(text, b)[0])[0]
        score = 0.5 * ("  " in text[a:b] or "\t" in text[a:b])
        if left in lex.finals:
            score += 3.0 if left in THAI_PARTICLES else 1.0
        if right in lex.openings:
            score += 1.0
        if right in lex.binding and right not in lex.openings or left in lex.binding and left not in lex.finals:
            score -= 2.5
        return score

    def gap_cut(self, begin: int, a: int, z: int) -> tuple[int, float]:
        """``(place, score)`` of the gap ``[a, z)``."""
        if _UNSPACED.match(self.text[a - 1]):
            score = 1.5 if self.text.endswith(CJK_FINAL, begin, a) else -3.0
        else:
            score = self.gap_score(a, z)
        return a, score - (6.0 if self.inside[a] else 0.0)

    def opened_first(self, begin: int) -> bool:
        """The sentence that began at ``begin`` opens with a quote."""
        m = _NONSPACE.search(self.text, begin)
        return m is not None and m[0] in "“„«「『\"‘‹"

    def terminator_score(self, begin: int, m: re.Match) -> tuple[float, bool]:
        """``(score, touched)`` of the cut after the terminators of ``m`` in a sentence that began at
        ``begin``; ``touched`` where an earlier beginning could change the score."""
        block = self.text
        at, end, marks = m.start(), m.end(), m[0]
        seen = _NONSPACE.search(block, end)
        if seen is None:
            return 9.0, False
        nxt_at = seen.start()
        gap, nxt, after = nxt_at - end, seen[0], block[nxt_at : nxt_at + 32]  # only its first words are compared
        closed = marks[-1] in CLOSERS
        quoted = closed and any(c in "”’»“›\"'」』" for c in marks)
        mark = marks.rstrip(CLOSERS + "   ")
        first, last = marks[0], mark[-1] if mark else marks[0]
        start = self.token_start(at)
        touched = start <= begin
        token = block[max(begin, start) : at].strip("﻿​")
        if nxt in ",;:،；：、،؛" or nxt in ")]}）":
            return -9.0, False
        if quoted and nxt in "—–-":
            return -5.0, False
        if nxt.islower():
            return -6.0, False
        if "。" in marks or "！" in marks or "？" in marks or "｡" in marks:
            if quoted or closed and marks[-1] in "）】》〉":
                if _UNSPACED.match(nxt) or nxt.isalpha():
                    if any(after.startswith(p) for p in QUOTE_PARTICLES):
                        return -5.0, False
                    if quoted:
                        if self.opened_first(begin):
                            stop = _AFTER_MARK.search(block, nxt_at)
                            clause = block[nxt_at : stop.start() if stop else len(block)]
                            return -5.0 if any(s in clause for s in SPEECH) else 2.0, True
                        return 5.0, True
            return 5.0, False
        if any(c in marks for c in "।॥؟۔។៕။"):
            if quoted and _CASELESS.match(nxt):
                return -5.0 if self.opened_first(begin) else 5.0, True
            return 5.0, False
        if not gap:
            # no white space: inside numbers, addresses, file names; or a lost space
            if closed and quoted and not nxt.isupper() and not _CASELESS.match(nxt):
                return 1.0 if nxt in OPENERS else -4.0, False
            if nxt.isdigit():
                return -6.0 if not closed else -2.0, False
            if _UNSPACED.match(nxt):
                if mark.endswith(("……", "…")):
                    return -4.0 if after.startswith(GOES_ON) else 1.5, False
                return -5.0 if token and token[-1].isascii() and token[-1].isalpha() else 3.0, touched
            if nxt.isupper() or nxt in "“„«¿¡「":
                if self.in_address(at):
                    return -5.0, False
                if last == "." and re.search(r"(?:^|\.)[^\W\d_]$", token) and not (token.islower() and after[1:2].islower()):
                    return -4.0, touched
                if last == "." and token.casefold().rstrip(".") in INSIDE:
                    return -4.0, touched
                return 3.0 if nxt in "“„«¿¡「" or len(after) > 1 and (after[1].islower() or after[1] in ". ’'") or closed or last in "!?…" or token[-1:].isdigit() else -1.0, touched
            return 2.0 if _CASELESS.match(nxt) and (closed or last in "!?…") else -3.0, False
        caseless = bool(_CASELESS.match(nxt))
        if quoted and caseless:
            if self.opened_first(begin):
                return -5.0, True
            touched = True
        if last in "!?":
            if last == "!" and len(marks) == 1 and token[:1].isupper() and token.isalpha():
                # a name written with "!": a model code or a word of another script follows
                if re.match(r"[A-Z]{2,4}-?\d|[A-Z]{2,4} \d{3,}", after) or caseless and token.isascii():
                    return -4.0, touched
            return 4.0, touched
        if "…" in mark or "..." in mark:
            if _UNSPACED.match(nxt):
                return -4.0 if after.startswith(GOES_ON) else 1.5, touched
            return 3.0 if nxt.isupper() or nxt in OPENERS or caseless else -1.0, touched
        if closed:
            if nxt in "([（" and token.casefold() in INSIDE | EITHER:
                return -3.0, touched
            return 3.5 if not nxt.isdigit() else 1.5, touched
        word = token.casefold().rstrip(".")
        core = re.split(r"[-–/]", word)[-1] if word not in INSIDE else word
        if (word in INSIDE or core in INSIDE) and not (word == "no" and not nxt.isdigit()):
            return -5.0, touched
        letters = [c for c in token if c.isalpha()]
        if len(token.rstrip(".")) == 1 and token[0].isalpha():
            # an initial or a part of "z. B."; a unit after a number may end a sentence
            p = self.last_before(at - len(token), begin)
            touched |= p < begin
            prev = block[p] if p >= begin else ""
            dotted = prev == "."
            if dotted:
                # the letters between this full stop and the blank or full stop before it
                q = p - 1
                while q >= begin and p - q <= 2 and not block[q].isspace() and block[q] != ".":
                    q -= 1
                touched |= q < begin
                single = p - 1 - q == 1
            if token.isupper() or dotted and not block[p - 1 : p].isdigit() and single:
                return 1.0 if dotted and word in ("д", "п") and block[p - 1 : p] == "т" and nxt.isupper() else -4.0 if not prev.isdigit() else 2.0, touched
            if not token.isascii() and caseless:
                return -4.0, touched
            return 2.5 if prev.isdigit() or prev and prev in "%)" or word in ("l", "m", "s", "g", "a", "o", "y", "и", "я") else -2.0, touched
        if token.isdigit() and nxt.isalpha():
            p = at - len(token) - 1
            while p >= begin and not (block[p].isalnum() or block[p] == "_"):
                p -= 1
            q = p
            while q >= begin and (block[q].isalnum() or block[q] == "_"):
                q -= 1
            touched |= q < begin
            if block[q + 1 : p + 1].casefold() in ORDINAL_BEFORE:
                return -4.0, touched
            if self.last_before(at - len(token), begin) < begin:
                return -6.0, True
            return 4.0, touched
        if word in EITHER or core in EITHER:
            following = re.match(r"\w+", after)
            if word == "co" and following and following[0] in COMPANY:
                return -5.0, touched
            if nxt.isdigit():
                return -4.0, touched
            return 2.5 if nxt.isupper() or nxt in OPENERS or caseless else -3.0, touched
        if "." in token.rstrip(".") and letters and all(len(p) <= 2 for p in token.split(".") if p):
            return -3.0, touched
        if nxt.isdigit():
            return 1.0 if len(letters) > 4 or closed else -1.0, touched
        return 4.0, touched


#: What parts tokens: white space and opening marks.
_TOKEN_BREAK = re.compile(r"[\s(\[{«„“\"（「¿¡]")
_FOREIGN_PART = re.compile("[^" + _SPACELESS + ".!?…。！？؟।]*")
#: Paths that lie this far behind the best one are given up.
SPREAD = 16.0


def _cuts(block: str, begin: int, lexicon: Lexicon | None = None) -> list[int]:
    """Ends of the sentences of ``block[begin:]``: the best path through the lattice of cuts. A place adds
    its score to the path where it is cut and takes it off where it is passed over."""
    ends: list[tuple[int, int, re.Match | None]] = [(m.end(), m.end(), m) for m in _END.finditer(block, begin)]
    ends += [(m.start(), m.end(), None) for gap in (_SPACELESS_GAP, _CJK_GAP) for m in gap.finditer(block, begin)]
    ends.sort(key=lambda x: x[0])
    if not ends:
        return []
    b = _Block(block, lexicon or _PLAIN_LEXICON)
    # nodes of the lattice: place and the node before; paths as they stand: node and value
    nodes: list[tuple[int, int]] = [(begin, -1)]
    paths: list[tuple[int, float]] = [(0, 0.0)]
    for a, z, m in ends:
        told = b.gap_cut(begin, a, z) if m is None else None
        reached: dict[int, tuple[float, int]] = {}
        going = []
        for k, value in reversed(paths):  # from the latest beginning back: an untouched score holds for all earlier ones
            start = nodes[k][0]
            if told is None and m.start() >= start:
                at, cut, moved = _trim(b, start, m)
                score, touched = b.terminator_score(start, cut)
                score -= 6.0 if b.inside[at] else 0.0
                if not (moved or touched):
                    told = at, score
            elif told is not None:
                at, score = told
            else:
                at, score = -1, 0.0
            if at <= start or not _ALNUM.search(block, start, at):
                going.append((k, value))
                continue
            going.append((k, value - score))
            if at not in reached or value + score > reached[at][0] + 1e-9:
                reached[at] = value + score, k
        best = max(v for _, v in going)
        paths = [p for p in reversed(going) if p[1] > best - SPREAD]
        for at, (value, k) in sorted(reached.items()):
            if value > best - SPREAD:
                nodes.append((at, k))
                paths.append((len(nodes) - 1, value))
        if len(paths) > 1:
            best = max(v for _, v in paths)
            paths = [p for p in paths if p[1] > best - SPREAD]
    out, k = [], max(paths, key=lambda p: (p[1], -p[0]))[0]
    while k > 0:
        out.append(nodes[k][0])
        k = nodes[k][1]
    return out[::-1]


_ALNUM = re.compile(r"[^\W_]")


def _trim(b: _Block, begin: int, m: re.Match) -> tuple[int, re.Match, bool]:
    """``(end, match, moved)``: a mark that opens a quote is no closer: “ closes only after „, » only after «,
    straight ones before no letter. ``moved`` where quotes since ``begin`` were counted."""
    block, end, counted = b.text, m.end(), False
    while end > m.start() + 1 and block[end - 1] in "“\"'’»›":
        c, after = block[end - 1], block[end : end + 1]
        if c == "“":
            counted, opens = True, b.count("„", begin, end - 1) > b.count("“", begin, end - 1)
        elif c in "\"'":
            counted, opens = True, not (after.isalnum()) and b.count(c, begin, end - 1) % 2 == 1
        elif c == "»":
            counted, opens = True, b.count("«", begin, end - 1) > b.count("»", begin, end - 1) or not b.count("«", 0, len(block))
        else:
            opens = not after.isalnum()
        if opens:
            break
        end -= 1
        while end > m.start() + 1 and block[end - 1] in "   ":
            end -= 1
    return (end, m, counted) if end == m.end() else (end, _END.match(block, m.start(), end), True)


def _open_spans(block: str) -> list[int]:
    """For each place, how many pairs of an opening mark and its closing one it lies in."""
    spans, stack, awaited = [], [], Counter()
    for m in _MARK.finditer(block):
        i, c = m.start(), m[0]
        if awaited[c]:
            # it closes the nearest of its kind; what opened after that is given up
            while True:
                x = stack.pop()
                awaited.subtract(_PAIRS[block[x]])
                if c in _PAIRS[block[x]]:
                    break
            spans.append((x, i))
        elif c in _PAIRS:
            stack.append(i)
            awaited.update(_PAIRS[c])
    depth = [0] * (len(block) + 2)
    for x, y in spans:
        depth[x + 1] += 1
        depth[y] -= 1
    return list(accumulate(depth))


def _blocks(text: str) -> Iterator[tuple[int, int, int]]:
    """``(from, to, mark)`` of each block; ``mark`` is the length of a list item's mark."""
    lines, at = [], 0
    for m in _LINE.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    begin, end, mark, number = None, 0, 0, 0
    for a, b in lines:
        line = text[a:b]
        if not line.strip(BLANK):
            if begin is not None:
                yield begin, end, mark
            begin, number = None, 0
            continue
        item = _ITEM.match(text, a, b)
        if item and item[1] and not (int(item[1]) == 1 or int(item[1]) == number + 1):
            item = None
        if begin is None or item:
            if begin is not None:
                yield begin, end, mark
            begin, mark = a, item.end() - a if item else 0
            number = int(item[1]) if item and item[1] else number if item else 0
        end = b
    if begin is not None:
        yield begin, end, mark


def unit_ends(text: str | None, lexicon: Lexicon | None = None) -> list[int]:
    """``end_pos`` of every sentence unit."""
    if not text or not text.strip():
        return []
    out = []
    for a, b, mark in _blocks(text):
        block = text[a:b]
        block = block.rstrip(BLANK).rstrip()
        if not block:
            continue
        ends = _cuts(block, mark, lexicon)
        if not ends or ends[-1] < len(block):
            ends.append(len(block))
        out += [a + e for e in ends]
    return out


#: Bounds of what is learned from a corpus: longest word, least occurrences, least different
#: letters on either side, most words kept; occurrences at ends of blocks that make a word final.
WORD_CHARS, LEAST_SEEN, LEAST_SIDES, MOST_WORDS, LEAST_ENDS = 10, 5, 3, 30_000, 2
#: Whole phrases of at most so many letters that come often are words of the lattice too.
SET_PHRASE = 48
_LEADING_VOWELS = frozenset("เแโใไເແໂໃໄ")


def _may_begin(c: str) -> bool:
    return unicodedata.category(c)[0] == "L" and c not in "ะาำๅຳາະ"


def _strings(phrase: str) -> Iterator[tuple[str, str, str]]:
    """``(string, letter before, letter after)`` of what could be a word of a phrase."""
    n = len(phrase)
    cut_here = [i == n or _may_begin(phrase[i]) and (i == 0 or phrase[i - 1] not in _LEADING_VOWELS) for i in range(n + 1)]
    for i in range(n):
        if cut_here[i]:
            for j in range(i + 2, min(n, i + WORD_CHARS) + 1):
                if cut_here[j]:
                    yield phrase[i:j], phrase[i - 1 : i] or "^", phrase[j : j + 1] or "$"
    if WORD_CHARS < n <= SET_PHRASE:
        yield phrase, "^", "$"


def _simple(counts: dict[str, int]) -> list[str]:
    """Words that are not two more frequent ones in a row; particles at either end are taken off."""
    seeds = frozenset(THAI_OPENING) | frozenset(THAI_FINAL) | frozenset(THAI_BINDING)
    out = set()
    for w, n in counts.items():
        if any(counts.get(w[:i], 0) >= 1.5 * n and counts.get(w[i:], 0) >= 1.5 * n for i in range(1, len(w))):
            continue
        head = max((s for s in seeds if w != s and w.startswith(s)), key=len, default="")
        rest = w[len(head) :]
        if not head or len(rest) < 2:
            out.add(w)
        elif _may_begin(rest[0]):
            out.add(rest)
    return sorted(out)


def learned(documents: DataFrame) -> Lexicon:
    """The lexicon of a corpus. All documents with spaceless scripts are counted, strings first within a
    task; at most ``MOST_WORDS`` words, and their counts at ends and starts, come to the driver."""
    from pyspark.sql import functions as F

    texts = documents.select("text").where(F.col("text").rlike(f"[{_SPACELESS}]"))

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(w, x[0], sorted(x[1]), sorted(x[2])) for w, x in held.items()], columns=["word", "n", "before", "after"])

        for pdf in batches:
            for phrase, n in Counter(p for t in pdf["text"] for p in _SPACELESS_RUN.findall(t)).items():
                for w, x, y in _strings(phrase):
                    entry = held.setdefault(w, [0, set(), set()])
                    entry[0] += n
                    entry[1].add(x), entry[2].add(y)
                if len(held) > 200_000:
                    yield rows()
                    held.clear()
        yield rows()

    edge = lambda c, e: F.max(F.array_contains(c, e))
    sides = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(c))))
    counted = spread(texts).mapInPandas(strings, "word string, n long, before array<string>, after array<string>").groupBy("word").agg(F.sum("n").alias("n"), sides("before").alias("b"), sides("after").alias("a"), edge("before", "^").alias("edge_b"), edge("after", "$").alias("edge_a"))
    # a phrase's edge is as good as many letters; a word at one edge needs two ways to go on at the other
    edge_b, edge_a = F.col("edge_b"), F.col("edge_a")
    free_b, free_a = edge_b | (F.col("b") >= LEAST_SIDES), edge_a | (F.col("a") >= LEAST_SIDES)
    counted = counted.where((F.col("n") >= LEAST_SEEN) & (free_b & free_a | edge_b & (F.col("a") >= 2) | edge_a & (F.col("b") >= 2)))
    words = _simple({r["word"]: r["n"] for r in counted.orderBy(F.desc("n"), "word").limit(MOST_WORDS).collect()})
    if not words:
        return Lexicon()

    def roles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(words)
        for pdf in batches:
            seen: Counter[tuple[str, str, bool]] = Counter()
            for text in pdf["text"]:
                for a, b, mark in _blocks(text):
                    block = text[a:b].rstrip()
                    for m in _SPACELESS_RUN.finditer(block, mark):
                        before, after = block[mark : m.start()].rstrip()[-1:] if m.start() - mark < 8 else block[m.start() - 8 : m.start()].rstrip()[-1:], block[m.end() : m.end() + 8].lstrip()[:1]
                        w = lexicon.segment(m[0])
                        gap_after, gap_before = block[m.end() : m.end() + 1].isspace(), block[m.start() - 1 : m.start()].isspace() and m.start() > 0
                        if not after or gap_after and _is_spaceless(after):
                            seen[w[-1], "end", not after] += 1
                        if not before or gap_before and _is_spaceless(before):
                            seen[w[0], "start", not before] += 1
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["word", "role", "hard", "n"])

    told = spread(texts).mapInPandas(roles, "word string, role string, hard boolean, n long").groupBy("word", "role").agg(F.sum(F.when(F.col("hard"), F.col("n")).otherwise(0)).alias("hard"), F.sum("n").alias("n")).where(F.length("word") > 1)
    share = {r["role"]: r["hard"] / r["n"] for r in told.groupBy("role").agg(F.sum("hard").alias("hard"), F.sum("n").alias("n")).collect()}
    kept = [r for r in told.where(F.col("hard") >= LEAST_ENDS).orderBy(F.desc("hard"), "word").limit(2 * MOST_WORDS).collect() if r["hard"] >= 0.25 * share[r["role"]] * r["n"]]
    return Lexicon(words, *[[r["word"] for r in kept if r["role"] == role] for role in ("end", "start")])


def sentence_units(documents: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """``(doc_id, end_pos)``: one row per sentence unit. The lexicon is that of the documents
    themselves where none is given."""
    lexicon = lexicon or learned(documents)
    parts = (sorted(lexicon.words), sorted(lexicon.finals), sorted(lexicon.openings))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = Lexicon(*parts)
        for pdf in batches:
            out = [(d, e) for d, t in zip(pdf["doc_id"], pdf["text"]) for e in unit_ends(t, lex)]
            yield pd.DataFrame(out, columns=["doc_id", "end_pos"])

    return spread(documents.select("doc_id", "text").where("doc_id is not null and text is not null")).mapInPandas(run, "doc_id long, end_pos long")
