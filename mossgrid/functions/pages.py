"""What kind of page a text of markup is, by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mossgrid.functions.money import stripped

SHELL_TEXT = 600
CHALLENGE_CHARS = 60_000
#: Mount points of client-side pages, phrases of challenge pages, words of sold items.
MOUNT = r"""(?i)id=["'](root|app|__next|__nuxt|q-app)["']|__NUXT__|__NEXT_DATA__"""
CHALLENGES = (
    "cf-browser-verification", "cf_chl_opt", "challenge-platform", "just a moment...", "checking your browser", "enable javascript and cookies to continue",
    "please wait while your request is being verified", "one moment, please", "attention required! | cloudflare", "verifying you are human", "ddos protection by",
)
SOLD = ("verkocht", "verkauft", "vendu", "vendue", "vendido", "venduto", "no longer available", "niet meer beschikbaar", "nicht mehr verfügbar", "plus disponible")
BLOCKED = (401, 403, 429)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def visible_text(html: Column | str) -> Column:
    """The text a reader sees, roughly: no scripts, styles or tags, white space squeezed."""
    bare = F.regexp_replace(_c(html), r"(?is)<(script|style|noscript|template)[^>]*>.*?</\1>", " ")
    return stripped(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"(?U)\s+", " "))


def visible_text_length(html: Column | str) -> Column:
    return F.length(visible_text(html))


def looks_js_shelled(html: Column | str) -> Column:
    """Empty, or little text beside a mount point: the page is drawn in the browser."""
    h = _c(html)
    return F.coalesce(h, F.lit("")).eqNullSafe("") | ((visible_text_length(h) < SHELL_TEXT) & h.rlike(MOUNT))


def challenge_marker(html: Column | str) -> Column:
    """The first challenge phrase of a small page."""
    low = F.lower(_c(html))
    return F.when(F.length(_c(html)) <= CHALLENGE_CHARS, F.coalesce(*[F.when(low.contains(m), F.lit(m)) for m in CHALLENGES]))


def sold_marker(html: Column | str) -> Column:
    """The first word for "sold" among the visible words."""
    bare = F.regexp_replace(_c(html), r"(?is)<(script|style|noscript|template)[^>]*>.*?</\1>", " ")
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.regexp_replace(bare, "<[^>]+>", " ")), r"[^\p{L}\p{N}]", " "), F.lit(" "))
    return F.coalesce(*[F.when(words.contains(f" {m} "), F.lit(m)) for m in SOLD])


def strip_html(html: Column | str) -> Column:
    """Without tags; null where nothing is left. Entities stay."""
    return F.nullif(stripped(F.regexp_replace(_c(html), "<[^>]+>", "")), F.lit(""))


def decoded(body: Column | str, declared: Column | None = None) -> Column:
    """Bytes as text: UTF-8 where no charset is declared and the bytes are valid UTF-8, else ISO-8859-1."""
    b = _c(body)
    utf8 = F.is_valid_utf8(b.cast("string"))
    if declared is not None:
        utf8 = utf8 & declared.isNull() | (F.lower(declared) == "utf-8")
    return F.when(utf8, F.decode(b, "UTF-8")).otherwise(F.decode(b, "ISO-8859-1"))


def is_blocked(status: Column | str) -> Column:
    return F.coalesce(_c(status).isin(*BLOCKED), F.lit(False))


def scroll_rounds(heights: Column | str, most: int) -> Column:
    """Rounds of scrolling until the height stops growing, at most ``most``."""
    h = _c(heights)
    stop = F.filter(F.transform(h, lambda x, i: F.when((i > 0) & (x <= F.get(h, i - 1)), i)), lambda x: x.isNotNull())
    return F.least(F.coalesce(F.get(stop, F.lit(0)), F.greatest(F.size(h) - 1, F.lit(0))), F.lit(most))
