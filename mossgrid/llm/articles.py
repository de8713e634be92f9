"""Listings of the same article, sold by different sellers in different words.

1. Every listing is read into marks: the model with its suffix, brand, colour, measures
   in common units, and what its sku adds to the model. Accessories and listings that hold
   residue in place of content take no part. A model is a run of letters and digits
   ("GSR 18V-60", "S21 Ultra", "PLD-5625 Mini"); of several in a title the one that other
   fields of the listing repeat is taken. A listing without one, but with a brand, is known
   by the brand and the words of its title that are no colour, measure or advertisement.
2. Listings of one model form a block. The distinct marks of a block (its profiles) are
   parted into components: profiles that do not contradict each other hang together. Only
   profiles meet here, not listings.
3. Seller-constrained assignment: listings of one seller with equal marks are one node. In
   each component, for each pair of sellers, the pairs of nodes are scored by weighted
   agreement and a maximum-weight matching is solved; conflicting marks forbid a pair. Where
   several brands use a model name, the brands must be known and equal.
4. A match is kept where matches through third sellers agree with it more often than not;
   kept matches are merged from the heaviest down as long as the whole class stays free of
   conflicts and holds no seller twice.

Defined results
* null and empty texts say nothing; a listing without a model pairs with none;
* repeated rows count once; ties are broken by product id, so results do not depend on
  the order of rows;
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossgrid.llm import residue
from mossgrid.session import cut, spread

#: Words for colours in the languages of the listings; a shade comes before or after.
COLOURS = {
    "black": "black schwarz schwarze schwarzer schwarzes noir noire negro negra zwart zwarte czarny czarna czarne svart svarta nero nera preto preta чёрный черный чёрная черная чёрное черное",
    "white": "white weiß weiss weiße weißer blanc blanche blanco blanca wit witte biały biała białe vit vita bianco bianca branco branca белый белая белое",
    "red": "red rot rote roter rotes rouge rojo roja rood rode czerwony czerwona czerwone röd röda rosso rossa vermelho красный красная красное",
    "green": "green grün grüne grüner vert verte verde groen groene zielony zielona zielone grön gröna зелёный зеленый зелёная зеленая",
    "blue": "blue blau blaue blauer bleu bleue azul blauw blauwe niebieski niebieska niebieskie blå blåa blu azzurro синий синяя голубой голубая",
    "yellow": "yellow gelb gelbe gelber jaune amarillo amarilla geel gele żółty żółta żółte gul gula giallo gialla amarelo жёлтый желтый жёлтая желтая",
    "grey": "grey gray grau graue grauer gris grise grijs grijze szary szara szare grå gråa grigio grigia cinza серый серая",
    "brown": "brown braun braune brauner marron brun brune marrón bruin bruine brązowy brązowa brązowe bruna marrone castanho коричневый коричневая",
    "orange": "orange orangefarben orangefarbene naranja oranje pomarańczowy pomarańczowa pomarańczowe orangea arancione laranja оранжевый оранжевая",
    "violet": "violet violett violette violeta fioletowy fioletowa fioletowe paars paarse lila viola roxo purple фиолетовый фиолетовая",
    "pink": "pink rosa rose roze różowy różowa rosado rosada розовый розовая",
    "beige": "beige beżowy beżowa бежевый бежевая",
    "silver": "silver silber silbern argenté plateado zilver zilveren srebrny srebrna argento серебристый серебристая",
    "gold": "gold golden doré dorado goud gouden złoty złota guld oro золотой золотистый",
    "turquoise": "turquoise türkis turquesa turkusowy turkoois turkos бирюзовый",
}
#: Words for a blue as dark as the navy's, and what makes a colour dark or light.
NAVY = ("navy blue", "navy", "marineblau", "bleu marine", "azul marino", "marineblauw", "granatowy", "granatowa", "granatowe", "marinblå", "тёмно-синий", "темно-синий")
DARK = ("dark ", "dunkel", "donker", "ciemno", "mörk", "тёмно-", "темно-", "foncé", "foncée", "oscuro", "oscura", "escuro", "ciemny")
LIGHT = ("light ", "hell", "licht", "jasno", "ljus", "светло-", "clair", "claire", "claro", "clara", "jasny")
#: Words after which a colour names a line of products.
SERIES = ("seria", "serie", "series", "série", "edition", "édition", "edición", "linie", "línea", "серия")
#: Words that make a listing an accessory or a spare part.
ACCESSORY = (
    "schutzhülle", "hülle für", "ersatz\\w*", "replacement", "spare handle", "spare part", "carry case", "case for", "cover for", "sleeve for", "charger for", "poignée de rechange", "de rechange", "housse", "étui pour", "część zamienna", "części zamienne",
    "pokrowiec", "etui na", "repuesto", "recambio", "funda", "hoes voor", "reserveonderdeel", "reservegreep", "vervangende", "los handvat", "handvat voor", "reservhandtag", "reservdel", "fodral", "skyddsfodral", "чехол", "запасная", "запчасть", "сменная", "ручка для",
)
#: Units, as the factor to millilitres, milliwatts, millimetres, grams, megabytes, milliampere hours or volts.
UNITS = {
    "ml": ("v", 1), "cl": ("v", 10), "dl": ("v", 100), "l": ("v", 1000), "liter": ("v", 1000), "litre": ("v", 1000), "litres": ("v", 1000), "liters": ("v", 1000), "litra": ("v", 1000), "litry": ("v", 1000), "litros": ("v", 1000), "litro": ("v", 1000), "л": ("v", 1000), "мл": ("v", 1),
    "mw": ("p", 1), "w": ("p", 1000), "watt": ("p", 1000), "watts": ("p", 1000), "kw": ("p", 1_000_000), "вт": ("p", 1000), "мвт": ("p", 1), "квт": ("p", 1_000_000),
    "mm": ("x", 1), "cm": ("x", 10), "m": ("x", 1000), "мм": ("x", 1), "см": ("x", 10), "м": ("x", 1000), "in": ("x", 25.4), "inch": ("x", 25.4), "inches": ("x", 25.4), "zoll": ("x", 25.4), '"': ("x", 25.4), "”": ("x", 25.4), "″": ("x", 25.4), "ft": ("x", 304.8),
    "g": ("g", 1), "kg": ("g", 1000), "г": ("g", 1), "кг": ("g", 1000), "oz": ("g", 28.3495), "lb": ("g", 453.592),
    "mb": ("b", 1), "gb": ("b", 1000), "tb": ("b", 1_000_000), "гб": ("b", 1000), "mah": ("c", 1), "ah": ("c", 1000), "v": ("u", 1), "volt": ("u", 1),
}
ROUGH = (25.4, 28.3495, 304.8, 453.592)
#: Words that belong to a model where they follow its number.
SUFFIXES = ("ii", "iii", "iv", "plus", "mini", "pro", "max", "ultra", "lite", "air", "neo", "compact", "s", "x", "xl", "se")
#: Words of advertisement that belong to no product's name.
ADVERTS = frozenset("new neu nouveau nuevo nieuw nowość ny новинка sale top deal bestseller hit sprzedaży offer angebot offre oferta aanbieding promotion free shipping versandkostenfrei".split())

_COLOUR = {w: c for c, words in COLOURS.items() for w in words.split()}
_any = lambda words: "|".join(map(re.escape, sorted(words, key=len, reverse=True)))
_COLOUR_RE = re.compile(rf"(?<!\w)(?:(?P<navy>{_any(NAVY)})|(?P<before>{_any(x for x in DARK + LIGHT if x)})?(?P<word>{_any(_COLOUR)})(?: (?P<after>{_any(x for x in DARK + LIGHT if x[-1] not in ' -')}))?)(?!\w)(?! (?:{_any(SERIES)}))")
_SUFFIX = rf"(?:[ -]?(?:{_any(SUFFIXES)})(?!-?\w))+"
_CODE = re.compile(rf"(?<![^\W_])(?P<a>[^\W\d_]{{1,12}}+)(?P<gap>[ -]?)(?P<d>\d{{1,8}})(?P<rest>(?:[^\W\d_]{{1,3}}\d*(?![^\W_]))?(?:-(?:\d+|[^\W\d_]{{1,3}})(?![^\W_]))*)(?P<suffix>{_SUFFIX})?(?![^\W_])|(?<![^\W_])(?P<n>\d{{1,4}})(?P<b>[^\W\d_]{{2,6}})(?P<e>\d{{2,8}})(?P<f>[^\W\d_]{{0,3}})(?![^\W_])")
_MEASURE = re.compile(rf"(?<![\w.,Ø])(\d+(?:[.,]\d+)?) ?({_any(UNITS)})(?![\w²³])(?!-\d)")
_SIZE = re.compile(r"(?<!\w)(?:eu|gr\.?|size|taille|talla|maat|stl\.?|rozm\.?|р\.?|размер|rozmiar|größe|storlek|str\.?) ?(\d{2}|xs|s|m|l|xl|xxl)(?!\w)|(?<!\w)(?:small|medium|large|x-large|xx-large) \((xs|s|m|l|xl|xxl)\)")
#: Labels before a colour and before a measure in a description.
COLOUR_LABELS = frozenset("colour color farbe couleur kleur kolor färg colore cor цвет".split())
MEASURE_LABELS = frozenset("specification ausführung format uitvoering wersja tamaño utförande исполнение size größe taille maat rozmiar storlek размер".split())
#: The word before a colon, read backwards from it.
_LABEL = re.compile(r"\n? ?([^\W\d_]+)")
_VALUE = re.compile(r" ?([^;\n]*)")
_ACCESSORY = re.compile(rf"(?<!\w)(?:{'|'.join(ACCESSORY)})")
_SUFFIX_OF_BRAND = re.compile(r" (?:official|gmbh|store|co\.?|ltd\.?|inc\.?|shop)$")
_LETTERS = re.compile(r"[^\W\d_]{2,}")
PART = "\x1f"


def _found(pattern: re.Pattern, text: str, within: int | None) -> Iterator[re.Match]:
    """The matches in ``text``, one after another; those that begin in the first ``within`` characters
    are looked for there alone."""
    if within is None:
        yield from pattern.finditer(text)
        return
    at = 0
    while at <= within:
        if m := pattern.match(text, at):
            yield m
        at = m.end() if m else at + 1


def measures_of(text: str, within: int | None = None) -> str | None:
    """The measures in ``text`` in common units, the first of each kind: "v750", "b128000|x150",
    "size:m". ``within``: the first must begin in so many characters, and stands alone."""
    if m := next(_found(_SIZE, text, within), None):
        return f"size:{m[1] or m[2]}"
    out: dict[str, str] = {}
    for m in _found(_MEASURE, text, within):
        if text[: m.start()].rstrip().endswith("ø"):
            continue
        kind, factor = UNITS[m[2]]
        value = float(m[1].replace(",", ".")) * factor
        # written inches and ounces have one decimal; the article's own measure is a round one
        out.setdefault(kind, f"{kind}{round(value / 10) * 10 if factor in ROUGH else round(value)}")
        if within is not None:
            break
    return "|".join(sorted(out.values())) or None


def colour_of(text: str) -> str | None:
    """The first colour in ``text``, as its plain name and shade: "green", "blue/dark"."""
    m = _COLOUR_RE.search(text)
    if not m:
        return None
    if m["navy"]:
        return "blue/dark"
    shade = m["before"] or m["after"]
    return _COLOUR[m["word"]] + ("" if not shade else "/dark" if shade in DARK else "/light")


def _plain(text: str) -> str:
    return text if text.isalnum() else "".join(filter(str.isalnum, text))


def labelled(text: str) -> tuple[str | None, str | None]:
    """What a description states after a label for the colour, and for the measure."""
    colour = measure = None
    at = text.find(":")
    while at >= 0:
        if m := _LABEL.match(text[max(0, at - 24) : at][::-1]):
            label = m[1][::-1]
            if colour is None and label in COLOUR_LABELS:
                colour = _VALUE.match(text, at + 1)[1].partition(".")[0]
            elif measure is None and label in MEASURE_LABELS:
                measure = _VALUE.match(text, at + 1)[1]
        at = text.find(":", at + 1)
    return colour, measure


def model_of(texts: list[str]) -> tuple[str, str, re.Match | None, int]:
    """``(model, suffix, match, field)`` of the first field that names one; empty where none does.

    Sizes and measures are no models. A candidate counts more the more fields repeat it, then
    if its letters and digits are not parted by a blank, then the longer its number is."""
    squeezed = None
    for at, text in enumerate(texts):
        found = [m for m in _CODE.finditer(text)] if text else []
        if any(m["gap"] == " " for m in found):
            taken = [m.span() for m in _SIZE.finditer(text)] + [m.span() for m in _MEASURE.finditer(text)]
            found = [m for m in found if m["gap"] != " " or not any(x < m.end("d") and m.start("d") < y for x, y in taken)]
        best = None
        for m in found:
            digits, letters = m["d"] or m["e"], m["a"] or m["b"]
            core, alone = letters + digits, len(found) == 1
            if not alone and squeezed is None:
                squeezed = [_plain(t) for t in texts]
            rank = (1 if alone else sum(core in s for s in squeezed), m["gap"] != " ", min(len(digits), 3), len(letters) <= 4, -m.start())
            if best is None or rank > best[0]:
                best = (rank, m, (m["n"] or "") + core)
        if best and (best[0][0] > 1 or best[0][1] or best[0][2] > 1):
            m = best[1]
            return best[2], _plain((m["rest"] or "") + (m["suffix"] or "") + (m["f"] or "")), m, at
    return "", "", None, -1


def marks(title: str | None, brand: str | None, sku: str | None, description: str | None, site: str | None = None, index: residue.Index | None = None) -> tuple[str, str | None, str | None, str | None, str | None] | None:
    """``(model, brand, colour, measures, variant)`` of a listing; None where it has no model,
    is an accessory or holds residue instead of content."""
    index = index or _UNWEIGHTED
    t, d = title or "", description or ""
    loud = [not index.quiet(x) for x in (t, d)]
    t, d = ((residue._clean(x) if y else x).casefold() for x, y in zip((t, d), loud))
    if any(y and index.judge(x, residue.words_of(site), True) for x, y in zip((t, d), loud)) or _ACCESSORY.search(t):
        return None
    s = (sku or "").casefold().strip()
    code, suffix, m, field = model_of([t, d, s])
    named = brand_name(brand or "")
    rest = t[: m.start()] + " | " + t[m.end() :] if field == 0 else t
    said_colour, said_measure = labelled(d)
    colour = (colour_of(said_colour) if said_colour else None) or colour_of(rest)
    measure = (measures_of(said_measure, 2) if said_measure else None) or measures_of(rest)
    if not code:
        bare = _SIZE.sub(" ", _MEASURE.sub(" ", _COLOUR_RE.sub(" ", t)))
        words = sorted(set(_LETTERS.findall(bare)) - ADVERTS - set(_LETTERS.findall(named or "")))
        return (f"{named} {' '.join(words)}", named, colour, measure, None) if named and len(words) >= 2 else None
    variant = None
    if s and field != 2:
        # what the sku adds after the model; a sku without the model is the seller's own number
        flat = _plain(s)
        at = flat.find(code + suffix)
        size = len(code + suffix)
        if at < 0:
            at, size = flat.find(code), len(code)
        variant = (flat[at + size :] or None) if at >= 0 else None
    elif field == 2:
        # the sku alone names the model: letters after the number are its suffix
        flat = _plain(s)
        tail = flat[flat.find(code) + len(code) :]
        suffix = re.match(r"[^\W\d_]*", tail)[0]
        variant = tail[len(suffix) :] or None
    return code + suffix, named, colour, measure, variant


@lru_cache(maxsize=1 << 14)
def brand_name(brand: str) -> str | None:
    """The brand without the words shops add to it."""
    return _SUFFIX_OF_BRAND.sub("", residue._clean(brand).casefold().strip()) or None


_UNWEIGHTED = residue.Index()

Profile = tuple[str | None, str | None, str | None, str | None]  # brand, colour, measures, variant
Node = tuple[int, str, Profile]  # least product id, seller, marks
#: What agreement on the model, and on each mark, is worth.
_MODEL, _WEIGHTS = 1.0, (0.5, 2.0, 2.0, 3.0)


@lru_cache(maxsize=1 << 16)
def same_measures(a: str, b: str) -> bool | None:
    """Whether the kinds of measure that both hold agree; None where they share no kind."""
    if a == b:
        return True
    if a.startswith("size:") or b.startswith("size:"):
        return False if a[:5] == b[:5] else None
    x, y = ({p[0]: p for p in s.split("|")} for s in (a, b))
    shared = x.keys() & y.keys()
    return all(x[k] == y[k] for k in shared) if shared else None


def agreement(a: Profile, b: Profile, several_brands: bool = False) -> float | None:
    """The weight of two profiles of one model; None where they contradict each other."""
    if several_brands and (a[0] is None or a[0] != b[0]):
        return None
    total = _MODEL
    for k, (x, y, w) in enumerate(zip(a, b, _WEIGHTS)):
        if x is not None and y is not None:
            same = same_measures(x, y) if k == 2 else x == y
            if same is False:
                return None
            total += w if same else 0
    return total


def components(profiles: list[Profile]) -> list[int]:
    """For each profile the least index of those it hangs together with."""
    several = len({p[0] for p in profiles if p[0] is not None}) > 1
    group: list[int] = [-1] * len(profiles)
    rest = list(range(len(profiles)))
    while rest:
        first = rest[0]
        group[first], reached = first, [first]
        rest = rest[1:]
        while reached:
            p = profiles[reached.pop()]
            near = [i for i in rest if agreement(p, profiles[i], several) is not None]
            for i in near:
                group[i] = first
            reached += near
            rest = [i for i in rest if group[i] < 0]
    return group


def best_matching(weights: list[list[float | None]]) -> list[tuple[int, int]]:
    """Maximum-weight matching of a small bipartite graph (Hungarian method); None is no edge."""
    n, m = len(weights), len(weights[0])
    if n == 1 or m == 1:
        cells = [(w, -i, -j) for i, row in enumerate(weights) for j, w in enumerate(row) if w is not None]
        return [(-max(cells)[1], -max(cells)[2])] if cells else []
    size = n + m  # every node may stay alone at no weight
    cost = np.zeros((size, size))
    for i, row in enumerate(weights):
        for j, w in enumerate(row):
            cost[i, j] = -w if w is not None else 1e6
    u, v, p, way = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1, int), np.zeros(size + 1, int)
    for i in range(1, size + 1):
        p[0], j0 = i, 0
        low, used = np.full(size + 1, np.inf), np.zeros(size + 1, bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            now = cost[p[j0] - 1, free - 1] - u[p[j0]] - v[free]
            less = now < low[free]
            low[free[less]], way[free[less]] = now[less], j0
            j1 = free[np.argmin(low[free])]
            delta = low[j1]
            u[p[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    return sorted((int(p[j]) - 1, j - 1) for j in range(1, m + 1) if 1 <= p[j] <= n and weights[p[j] - 1][j - 1] is not None)


def _cycles_agree(partner: list[dict[str, int]], i: int, j: int) -> bool:
    """Of the third sellers in which both ends of a match have a partner, no more than half name different ones."""
    shared = partner[i].keys() & partner[j].keys()
    return 2 * sum(partner[i][s] != partner[j][s] for s in shared) <= len(shared)


def classes(nodes: list[Node], several_brands: bool = False) -> list[tuple[int, int]]:
    """``(node, class)`` of the nodes of one component; a class is named by its least node."""
    if len(nodes) == 1:
        return [(nodes[0][0], nodes[0][0])]
    nodes = sorted(nodes)
    sellers: dict[str, list[int]] = defaultdict(list)
    for i, x in enumerate(nodes):
        sellers[x[1]].append(i)
    names = list(sellers)
    matches, partner = [], [{} for _ in nodes]
    for s, a in enumerate(names):
        for b in names[s + 1 :]:
            left, right = sellers[a], sellers[b]
            weights = [[agreement(nodes[i][2], nodes[j][2], several_brands) for j in right] for i in left]
            for x, y in best_matching(weights):
                i, j = left[x], right[y]
                partner[i][b], partner[j][a] = j, i
                matches.append((-weights[x][y], min(i, j), max(i, j)))
    # heaviest first; a class keeps one value of each mark and one node of a seller
    parent = list(range(len(nodes)))
    known = [x[2] for x in nodes]
    held = [{x[1]} for x in nodes]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, a, b in sorted(matches):
        i, j = sorted((root(a), root(b)))
        if i == j or held[i] & held[j] or agreement(known[i], known[j], several_brands) is None or not _cycles_agree(partner, a, b):
            continue
        parent[j] = i
        held[i] |= held[j]
        known[i] = tuple(y if x is None else x if k != 2 or y is None else "|".join(sorted(set(x.split("|")) | set(y.split("|")))) for k, (x, y) in enumerate(zip(known[i], known[j])))
    return [(x[0], nodes[root(i)][0]) for i, x in enumerate(nodes)]


def _written(p: Profile) -> str:
    return PART.join("" if x is None else x for x in p)


def _profile(text: str) -> Profile:
    return tuple(x or None for x in text.split(PART))


def _grouped(batches: Iterator[pd.DataFrame], keys: int) -> Iterator[list[tuple]]:
    """The rows of each group, of batches sorted by the first ``keys`` columns."""
    held: list[tuple] = []
    for pdf in batches:
        for row in pdf.itertuples(index=False, name=None):
            if held and row[:keys] != held[-1][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _chunks(rows: Iterator[tuple], columns: list[str], size: int = 20_000) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pd.DataFrame(held, columns=columns)
            held = []
    yield pd.DataFrame(held, columns=columns)


def listing_marks(products: DataFrame) -> DataFrame:
    """``(product_id, site, model, profile)`` of the listings that take part."""
    df, n = residue.frequencies(products)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = residue.Index(df, n)
        for pdf in batches:
            out = []
            for i, site, *texts in zip(pdf["product_id"], pdf["site"], pdf["title"], pdf["brand"], pdf["sku"], pdf["description"]):
                if m := marks(*texts, site, index):
                    out.append((i, site or "", m[0], _written(m[1:])))
            yield pd.DataFrame(out, columns=["product_id", "site", "model", "profile"])

    return spread(products.where("product_id is not null").select("product_id", "site", "title", "brand", "sku", "description")).mapInPandas(run, "product_id long, site string, model string, profile string")


def article_classes(products: DataFrame) -> DataFrame:
    """``(product_id, class_id)``: one row per listing that takes part; listings of one article share a class."""
    listings = cut(listing_marks(products).dropDuplicates(["product_id"]))
    nodes = listings.groupBy("model", "profile", "site").agg(F.min("product_id").alias("node"))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for held in _grouped(batches, 1):
                profiles = [_profile(p) for _, p in held]
                several = len({p[0] for p in profiles if p[0] is not None}) > 1
                for (model, p), g in zip(held, components(profiles)):
                    yield model, p, g, several

        yield from _chunks(rows(), ["model", "profile", "part", "several"])

    # the components of a block, from its distinct marks alone
    profiles = listings.select("model", "profile").distinct()
    parts = profiles.repartition("model").sortWithinPartitions("model", "profile").mapInPandas(part, "model string, profile string, part int, several boolean")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for held in _grouped(batches, 2):
                by_node = dict(classes([(x[3], x[4], _profile(x[5])) for x in held], bool(held[0][2])))
                for model, _, _, node, site, profile in held:
                    yield model, profile, site, by_node[node]

        yield from _chunks(rows(), ["model", "profile", "site", "class_id"])

    # a component meets in one task as its distinct marks by seller, however many listings it has
    placed = nodes.join(parts, ["model", "profile"]).select("model", "part", "several", "node", "site", "profile")
    solved = placed.repartition("model", "part").sortWithinPartitions("model", "part").mapInPandas(match, "model string, profile string, site string, class_id long")
    return listings.join(solved, ["model", "profile", "site"]).select("product_id", "class_id")


def article_pairs(products: DataFrame) -> DataFrame:
    """``(product_id_a, product_id_b)``: every pair of listings of one article. The rows asked for grow
    with the square of a class, so ``article_classes`` is the form for classes of any size; here a large
    class is dealt out: its second members by a salt, its first ones to every salt."""
    member = cut(article_classes(products))
    size = member.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").withColumn("salts", F.ceil(F.col("n") / SALTED).cast("int"))
    member = member.join(size, "class_id")
    a = member.select("class_id", F.col("product_id").alias("product_id_a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    b = member.select("class_id", F.col("product_id").alias("product_id_b"), F.expr("cast(pmod(xxhash64(product_id), salts) as int)").alias("salt"))
    return a.join(b, ["class_id", "salt"]).where("product_id_a < product_id_b").select("product_id_a", "product_id_b")


#: Members of a class that meet in one task when pairs are written out.
SALTED = 2000
