"""Template residue, filler, error-page and script notices in place of real text.

Labelled exemplars of residue stand in an inverted index (token to exemplars). A text
retrieves the exemplars most of whose weight it holds; a window of the exemplar's
length slides over the text and the TF-IDF containment of the exemplar in the window
is taken, with word frequencies counted over all texts. A text is excluded where
a long exemplar is contained, or where contained exemplars cover most of the text:
honest texts that speak of such things hold a few words of an exemplar among others.
Messages in words of their own are told by the containment the other way round: the
TF-IDF weight of a short text that lies in the pooled words of one kind of exemplars.
Placeholders are known by their shape: signs that only templates use, or names written
as identifiers (``product_name``, ``item.title``, ``PRODUCT_TITLE``) in any signs.

Defined results
* null, empty and blank values are no case;
* whole texts are read, after wrong encodings are undone and look-alike forms folded;
* repeated rows give one row per id and field; other columns are ignored;
* without any text all frequencies are 0 and the result is empty.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossgrid.llm import characters, encoding
from mossgrid.session import spread

#: The labelled exemplars, by kind. "#" is any number, "§" a placeholder's name.
EXEMPLARS = {
    "notice": [
        "Please enable JavaScript to view this shop", "You need to enable JavaScript to run this app.", "Your browser does not support JavaScript or it is turned off",
        "Cookies and scripts must be allowed before this page can load", "Scripts are blocked in your browser; this page works only with scripts switched on", "Scripting disabled – content cannot be shown",
        "Bitte aktivieren Sie JavaScript, um fortzufahren", "Ce site a besoin de JavaScript pour s’afficher", "Activa JavaScript en tu navegador para continuar", "Aktivera JavaScript för att se innehållet",
        "Zet JavaScript aan om deze pagina te bekijken", "Włącz obsługę skryptów, aby zobaczyć ofertę", "Для работы сайта включите JavaScript", "This site requires JavaScript to be enabled", "JavaScript is required to view this page",
        "Please turn on JavaScript and reload the page", "JavaScript seems to be disabled in your browser. You must have JavaScript enabled in your browser to use this website", "We're sorry but this app doesn't work properly without JavaScript enabled", "Abilita JavaScript per visualizzare questa pagina", "Please enable cookies to continue",
    ],
    "error": [
        "Fatal error: uncaught exception in /srv/shop/view_#.php on line #", "# Bad Gateway", "Service momentanément indisponible", "Database connection failed (#)", "Page introuvable", "The requested item does not exist any more or the link is broken",
        "Access denied – reference no. #", "Internal server error", "Nie znaleziono strony", "Sidan kunde inte hittas", "Wartungsmodus: Der Shop ist gleich wieder da", "# – page not found", "Unexpected token < at position #",
        "Error #: service unavailable", "Checking your browser, one moment", "Pagina niet gevonden", "Zugriff verweigert", "Too many requests, try again in # seconds", "Página no encontrada", "Please prove that you are human",
        "# Not Found", "Access denied", "Error #", "Service Unavailable", "Site is down for maintenance", "Gateway time-out", "Pagina non trovata", "The page you are looking for could not be found", "The page you requested does not exist", "Sorry, this page isn't available", "Die angeforderte Seite existiert nicht", "La page demandée n'existe pas", "La página solicitada no existe", "Sivua ei löytynyt", "Siden blev ikke funnet", "ページが見つかりません", "页面不存在", "Bad request", "Request timed out", "Connection refused", "An unexpected error occurred, please try again later", "Ein Fehler ist aufgetreten, bitte versuchen Sie es später erneut", "Une erreur est survenue, veuillez réessayer plus tard", "Se ha producido un error, inténtelo de nuevo más tarde", "We are currently performing scheduled maintenance", "You don't have permission to access this resource", "Accès refusé", "Acceso denegado", "Toegang geweigerd", "Odmowa dostępu", "Доступ запрещён", "Åtkomst nekad",
        "Страница не найдена", "Oops! Something went wrong on our side", "Seite nicht gefunden (Fehler #)", "This session has expired, please sign in again", "# Gateway Timeout", "# Forbidden", "Verify you are human to continue", "Site under maintenance, please come back later",
    ],
    "filler": [
        "Lorem ipsum", "Coming soon", "TODO", "Beispieltext hier einfügen", "Sed ut perspiciatis unde omnis", "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque", "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip", "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum", "Placeholder text", "Dummy text", "This is a placeholder", "Description coming soon", "Beschreibung folgt", "Description à venir", "Descripción próximamente", "Platzhaltertext", "Texte de remplissage", "Tekst zastępczy", "Platshållartext", "Add your product description here", "Enter product name",
        "Lorem ipsum dolor", "Lorem ipsum dolor sit amet, consectetur elit, sed tempor #.", "Dolor amet ipsum sed consectetur lorem tempor elit # ut labore.", "xxxx xxxxx xx xxxxxxx # xxx xxxx.", "xxxxx xxx", "asdf asdf jklö qwertz # asdf.", "asdf qwertz",
        "Hier steht später die Beschreibung. Blindtext Nummer #, bitte ersetzen.", "Type your description in this box (max. # characters).", "Text kommt noch. Text kommt noch. Text kommt noch.", "Aquí va el texto del producto, ejemplo #.",
        "Voorbeeldtekst #: vul hier de omschrijving in.", "Здесь будет описание, рыба-текст #.", "This is sample text number #. Replace it with your own words before you publish.", "Texte d’exemple n° #, à remplacer par le vôtre.",
        "Titel hier eingeben", "TODO: Titel", "Blindtext #", "Wpisz nazwę produktu", "Sample product #", "Titre à compléter", "Rubrik saknas – exempeltext", "Insert title here", "Название товара (пример #)", "Product name goes here", "test test #", "Título de ejemplo",
    ],
    "template": [
        "[object Object]", "undefined", "null", "NaN", "(no title set) undefined undefined",
        "{§}", "@@§@@", "$§", "{{§}}", "{{{§}}}", "{%§%}", "<%=§%>", "${§}", "#{§}", "{§:s}", "[[§]]", "[§]", "*|§|*", "%%§%%", "%§%", "$§$", "__§__", "&lt;§&gt;", "<§ here>", "«§»_TBD", "@Model.§", "t('§')", "##§##", "[%§%]",
    ],
    # what stands around residue; it counts as covered but is none itself
    "frame": ["Home > Shop >", "Back to the start page.", "Buy online"],
}
#: Names that placeholders in ordinary brackets or signs hold.
SLOT_WORDS = frozenset("title name product heading variant label attr size spec shop city colour color first last item price brand sku image description text model here user date category".split())

CONTAINED = 0.8
#: A message in words of its own: at most so many words, so much of their weight in one
#: kind's pool; telling words stand in at most this share of all texts.
MESSAGE, POOLED, TELLING = 16, 0.85, 0.02
LONG = 4
#: The bound of the labelled sample.
MOST_EXEMPLARS = 5000
COVERED = 0.6
#: Words a task remembers as saying nothing: how many, and of at most how many characters.
KNOWN, KNOWN_LENGTH = 1 << 16, 64
_NAME = r"\s*[A-Za-z][\w.]*(?:[ ][A-Za-z][\w.]*){0,3}\s*"
_SHAPES = [("{{{", "}}}"), ("{{", "}}"), ("{%", "%}"), ("<%=", "%>"), ("[%", "%]"), ("${", "}"), ("#{", "}"), ("[[", "]]"), ("*|", "|*"), ("%%", "%%"), ("##", "##"), ("@@", "@@"), ("__", "__"), ("&lt;", "&gt;"), ("«", "»_tbd"), ("t('", "')"), ("{", ":s}"), ("<", " here>"), ("{", "}"), ("[", "]"), ("%", "%"), ("$", "$"), ("@model.", ""), ("$", "")]
#: Signs that honest text uses too: what stands in them must be an identifier or name a field.
_WEAK = {("{", "}"), ("[", "]"), ("%", "%"), ("$", "$"), ("&lt;", "&gt;"), ("<", " here>"), ("$", "")}
#: An identifier: words joined by "_" or ".", or by capitals inside a word.
_IDENTIFIER = re.compile(r"\s*(?:[A-Za-z]\w*[_.][A-Za-z][\w.]*|[a-z]+(?:[A-Z][a-z]+)+)\s*")
_LEX = re.compile("|".join(f"(?P<s{i}>{re.escape(a)}{_NAME if b else r'[A-Za-z][\w.]*'}{re.escape(b)})" for i, (a, b) in enumerate(_SHAPES)) + r"|(?P<w>[^\W\d_]+)|(?P<n>\d+(?:[.,]\d+)*)", re.IGNORECASE)
_SIGNS = re.compile(r"[{}\[\]%$«@&*#]|__|<|t\('", re.IGNORECASE)
_WORDS = re.compile(r"[^\W\d_]+")
_PLAIN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*")


def tokens(text: str) -> list[str]:
    """Lower-case words, "#" for numbers, and three tokens for a placeholder."""
    if not _SIGNS.search(text):
        return ["#" if t[0].isdigit() else t for t in _PLAIN.findall(text.casefold())]
    out = []
    for m in _LEX.finditer(text):
        kind = m.lastgroup
        if kind == "w":
            out.append(m[0].casefold())
        elif kind == "n":
            out.append("#")
        else:
            a, b = _SHAPES[int(kind[1:])]
            name = m[0][len(a) : len(m[0]) - len(b)] if b else m[0][len(a) :]
            words = [w.casefold() for w in re.findall(r"[^\W\d_]+", name)]
            if (a, b) in _WEAK and not _IDENTIFIER.fullmatch(name) and not (b and words and all(w in SLOT_WORDS for w in words)):
                out += [w for w in words]
            else:
                out += [f"⟦{a}", "§", f"{b}⟧"]
    return out


def _exemplar_tokens(text: str) -> list[str]:
    text = text.replace("#", "0") if "§" not in text else text.replace("§", "product_title")
    return tokens(text)


class Index:
    """The inverted index of the exemplars, weighted by ``df`` of ``n`` texts."""

    def __init__(self, df: dict[str, int] | None = None, n: int = 0, exemplars: dict[str, Sequence[str]] | None = None) -> None:
        self.kinds, self.bags, self.sizes, self.mass = [], [], [], []
        self.postings: dict[str, list[int]] = defaultdict(list)
        df = df or {}
        for kind, texts in (exemplars or EXEMPLARS).items():
            for t in texts:
                toks = [x for x in _exemplar_tokens(t) if x != "#"]
                bag = Counter(toks)
                for x in bag:
                    self.postings[x].append(len(self.bags))
                self.kinds.append(kind), self.bags.append(bag), self.sizes.append(len(_exemplar_tokens(t)))
        self.weight = {x: 1.0 + math.log((n + 1) / (df.get(x, 0) + 1)) for x in self.postings}
        self.mass = [sum(self.weight[x] * c for x, c in bag.items()) for bag in self.bags]
        self.rare = frozenset(x for x in self.postings if x != "§")
        # a text that holds CONTAINED of an exemplar's weight holds one of its heaviest
        # tokens that together exceed the rest: only those retrieve it
        self.heads: dict[str, list[int]] = defaultdict(list)
        for e, bag in enumerate(self.bags):
            left = self.mass[e]
            for x in sorted(bag, key=lambda x: (-self.weight[x], -len(x), x)):
                self.heads[x].append(e)
                left -= self.weight[x] * bag[x]
                if left < CONTAINED * self.mass[e] - 1e-9:
                    break
        self.first = frozenset(self.heads)
        self.known: set[str] = set()
        # the pooled words of the messages, and those of them that few texts and one kind hold
        self.rarest = 1.0 + math.log(n + 1)
        self.pools = {k: frozenset(t for kind, bag in zip(self.kinds, self.bags) if kind == k for t in bag) for k in ("notice", "error", "filler")}
        self.telling = {k: frozenset(t for t in pool if len(t) > 3 and df.get(t, 0) <= TELLING * n) for k, pool in self.pools.items()}

    def matches(self, toks: list[str]) -> list[tuple[int, int, int]]:
        """``(exemplar, from, to)`` of the windows that hold a contained exemplar: the best ones whose words do not overlap."""
        have = Counter(t for t in toks if t in self.postings)
        out = []
        for e in dict.fromkeys(e for t in have if t in self.heads for e in self.heads[t]):
            bag = self.bags[e]
            if sum(self.weight[t] * min(c, have[t]) for t, c in bag.items() if t in have) < CONTAINED * self.mass[e] - 1e-9:
                continue
            size = self.sizes[e] + (self.sizes[e] > 3) * 2
            window: Counter[str] = Counter()
            inside, least, full = 0.0, CONTAINED * self.mass[e] - 1e-9, []
            for i, t in enumerate(toks):
                if t in bag:
                    window[t] += 1
                    if window[t] <= bag[t]:
                        inside += self.weight[t]
                if i >= size and (old := toks[i - size]) in bag:
                    if window[old] <= bag[old]:
                        inside -= self.weight[old]
                    window[old] -= 1
                if inside >= least:
                    full.append((-round(inside, 9), i))
            taken: set[int] = set()
            for held, i in sorted(full):
                # the words at the window's end that make up its weight
                spare, at = bag.copy(), i + 1
                while held < -1e-6:
                    at -= 1
                    if spare[t := toks[at]] > 0:
                        spare[t] -= 1
                        held += self.weight[t]
                if taken.isdisjoint(range(at, i + 1)):
                    taken.update(range(at, i + 1))
                    out.append((e, max(0, i - size + 1), i + 1))
        return out

    def quiet(self, text: str) -> bool:
        """Whether :func:`_clean` would leave the text as it is and :meth:`judge` would find nothing in
        its lower-case form, so that neither needs to read it. Neither looks across a blank for a trace, so
        the text's words tell, and most words have been seen before. False says nothing."""
        words = text.split(" ")
        if not self.known.issuperset(words):
            if len(self.known) >= KNOWN:
                self.known.clear()
            for w in words:
                if w not in self.known:
                    if not self._quiet_word(w):
                        return False
                    if len(w) <= KNOWN_LENGTH:
                        self.known.add(w)
        return text.isascii() or encoding._other_cyrillic(text) is None

    def _quiet_word(self, word: str) -> bool:
        if not word.isascii() and (any(map(encoding.suspicious, encoding._PIECE.findall(word))) or characters.suspect_chars().search(word)):
            return False
        low = word.casefold()
        return not _SIGNS.search(low) and self.first.isdisjoint(_WORDS.findall(low))

    def judge(self, text: str, own: frozenset[str] = frozenset(), folded: bool = False) -> str | None:
        """The kind of residue a text is or contains. ``own``: words of the seller's
        address, which error pages append. ``folded``: the text is in lower case already."""
        if not _SIGNS.search(text) and self.first.isdisjoint(_WORDS.findall(text if folded else text.casefold())):
            return None
        toks = tokens(text)
        if not toks or self.first.isdisjoint(toks):
            return None
        return self._contained(toks, own) or self.pooled(toks, own)

    def _contained(self, toks: list[str], own: frozenset[str]) -> str | None:
        kinds, covered, long = [], set(), None
        for e, a, b in self.matches(toks):
            kind, bag = self.kinds[e], self.bags[e]
            # every repetition of a contained exemplar's words is covered by it
            covered.update(i for i, t in enumerate(toks) if t in bag) if len(bag) <= 2 or kind == "filler" else covered.update(i for i in range(a, b) if toks[i] in bag)
            if kind != "frame":
                kinds.append((self.mass[e], kind))
                if sum(bag.values()) >= LONG or "§" in bag:
                    long = max(long or (0, ""), (self.mass[e], kind))
        if not kinds:
            return None
        if long:
            return long[1]
        words = [i for i, t in enumerate(toks) if t != "#" and t not in own]
        return max(kinds)[1] if words and sum(i in covered for i in words) >= COVERED * len(words) else None

    def pooled(self, toks: list[str], own: frozenset[str]) -> str | None:
        """The kind of exemplars in whose pooled words most of a short text's weight lies. One word
        of a message alone says nothing, nor do its everyday words: two telling ones must be there."""
        words = [t for t in toks if t != "#" and t not in own]
        if not 2 <= len(words) <= MESSAGE:
            return None
        weights = [self.weight.get(t, self.rarest) for t in words]
        for kind, pool in self.pools.items():
            if len({t for t in words if t in self.telling[kind]}) >= 2 and sum(w for t, w in zip(words, weights) if t in pool) >= POOLED * sum(weights):
                return kind
        return None


@lru_cache(maxsize=4096)
def words_of(seller: str | None) -> frozenset[str]:
    """The words of a seller's address."""
    return frozenset(_WORDS.findall((seller or "").casefold()))


def _clean(text: str) -> str:
    """The text as it was meant to read: encoding undone, look-alike forms folded."""
    if encoding.harmless(text):
        return text
    text = encoding.repair(text)[0]
    if characters.suspect_chars().search(text):
        text = characters._WORD.sub(lambda m: next(iter(characters.twin_spellings(m[0])), m[0]), characters.fold(text))
    return text


def labelled(table: DataFrame, most: int = MOST_EXEMPLARS) -> dict[str, list[str]]:
    """Exemplars from a table ``(kind, text)`` of labelled rows; at most ``most`` of them are fitted."""
    out: dict[str, list[str]] = defaultdict(list)
    for r in table.where("kind is not null and text <> ''").select("kind", "text").distinct().orderBy("kind", "text").limit(most).collect():
        out[r["kind"]].append(r["text"])
    return dict(out)


def frequencies(products: DataFrame, fields: Sequence[str] = ("title", "description"), exemplars: dict[str, Sequence[str]] | None = None) -> tuple[dict[str, int], int]:
    """Over all texts: how often each word of the exemplars occurs, and the number of texts (at most
    as many rows come to the driver as the exemplars have words). Built-in expressions only."""
    vocabulary = sorted(Index(exemplars=exemplars).rare)
    texts = spread(products.select(*fields)).select(F.explode(F.array(*fields)).alias("text")).where("text <> ''")
    counted = texts.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("token")).where(F.col("token").isin(vocabulary)).groupBy("token").agg(F.count("*").alias("n"))
    counts = {r["token"]: r["n"] for r in counted.collect()}
    return counts, texts.count()


def residue_fields(products: DataFrame, fields: Sequence[str] = ("title", "description"), key: str = "product_id", seller: str = "site", exemplars: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """``(key, field_name, kind)`` of every field value that is or contains residue, once.
    ``exemplars`` replaces the labelled exemplars of this module (see :func:`labelled`)."""
    df, n = frequencies(products, fields, exemplars)
    kind_of_key = dict(products.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(df, n, exemplars)
        for pdf in batches:
            out = []
            for f in fields:
                for i, s, t in zip(pdf[key], pdf[seller], pdf[f]):
                    if t:
                        if hit := index.judge(_clean(t), words_of(s)):
                            out.append((i, f, hit))
            yield pd.DataFrame(out, columns=[key, "field_name", "kind"])

    return spread(products.where(F.col(key).isNotNull()).select(key, seller, *fields)).mapInPandas(run, f"{key} {kind_of_key}, field_name string, kind string").dropDuplicates([key, "field_name"])


def without_residue(products: DataFrame, fields: Sequence[str] = ("title", "description"), key: str = "product_id") -> DataFrame:
    """``products`` with residue values set to null, so that later use leaves them out."""
    bad = residue_fields(products, fields, key).groupBy(key).agg(F.collect_set("field_name").alias("_residue"))
    rest = products.join(bad, key, "left")
    for f in fields:
        rest = rest.withColumn(f, F.when(~F.coalesce(F.array_contains("_residue", f), F.lit(False)), F.col(f)))
    return rest.drop("_residue").select(*products.columns)
