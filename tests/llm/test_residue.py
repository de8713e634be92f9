import pytest

from mossgrid.llm import residue

SCHEMA = "product_id long, site string, title string, description string, kind string, token string, n long"
BAD = [
    "{{ product.title }}", "Buy %%attr.size%% online", "<COLOUR here> – [HEADING]", "$title$ | grywick", "*|first_name|*", "__SHOP CITY__", "@Model.item_title", "t('TITLE')", "&lt;name&gt;", "{title:s}", "«TITLE»_TBD", "#{spec_1}", "[VARIANT LABEL]",
    "undefined", "NaN", "null undefined", "[object Object]", "Lorem ipsum dolor", "Page introuvable :(", "ZUGRIFF VERWEIGERT", "Error 503: service unavailable", "404 – page not found", "Please enable JavaScript to view this shop | pasdal",
    "Home > Shop > Страница не найдена", "Text kommt noch. Text kommt noch. Text kommt noch. Back to the start page.", "Farbe: {{COLOUR}}. Ausführung: 20 W.", "Good kettle. You need to enable JavaScript to run this app. Colour: red.", "Page introuvable", "Service momentanÃ©ment indisponible",
]
GOOD = [
    "Error 404 Hoodie – the tee for lost pages Xandor ABC-1234", "Access Denied door mat Xandor ABC-1234", "JavaScript for Gardeners, paperback", "Page Not Found art print, framed Xandor ABC 1234", "Null Island travel mug Xandor ABC-1234",
    "Undefined by design: a puzzle without edge pieces, 500 parts, made from board.", "Shaped like {curly} brackets; screws [3 x 5 mm] are part of the set.", "use %-marks on the ruler", "[refurbished] desk fan, 100% tested",
    "This book shows how to enable JavaScript in a garden planner, step by step, with 9 drawings.", "Sign with the words “access denied”, enamelled, for cellar doors.", "Placeholder frames in oak: put your own picture in, the inlay shows a sample.",
    "Lorem & Ipsum tea towels Xandor ABC-1234", "Sorry we missed you cards: 20 pieces, for parcels that could not be delivered.", "", "   ",
]


@pytest.mark.parametrize("text", BAD)
def test_residue(text):
    own = frozenset(("pasdal", "grywick", "example"))
    assert residue.Index().judge(residue._clean(text), own)


@pytest.mark.parametrize("text", GOOD)
def test_honest_text(text):
    assert residue.Index().judge(text) is None


PROBES = [
    "Lorem ipsum", "404 Not Found", "Service Unavailable", "Placeholder text", "{product_name}", "$PRODUCT_TITLE", "@@PRODUCT_NAME@@", "Please turn JavaScript on and reload the page.", "Pagina non trovata", "The page you are looking for could not be found",
    "Sed ut perspiciatis unde omnis iste natus error", "HTTP 500 Internal Server Error", "Access Denied", "[PRODUCT_TITLE]", "{item.title}", "${name}", "Sorry, the page you requested was not found", "JavaScript must be enabled to view this page", "Your browser must support scripts",
    "Site is down for maintenance", "Internal error, try again later", "Sorry, this page could not be loaded. Please try again", "Gateway Time-out",
]
HONEST = [
    "Error 404 Hoodie – the tee for lost pages", "Page Not Found art print, framed", "[NEW] kettle in red", "a set of {curly} brackets", "price $5 or $PRO for members", "Browser game for two, with a page to view", "Please try it again: error-free service", "A service page for your car, available now", "Not found in nature: glass fruit",
]


@pytest.mark.parametrize("text", PROBES)
def test_residue_in_other_words(text):
    assert residue.Index().judge(text)


@pytest.mark.parametrize("text", HONEST)
def test_honest_text_in_other_words(text):
    df = {"page": 900, "not": 400, "found": 200, "the": 50_000, "for": 40_000, "please": 500, "try": 300, "a": 60_000, "in": 40_000, "error": 300, "service": 900}
    assert residue.Index().judge(text) is None and residue.Index(df, 120_000).judge(text) is None


def test_labelled_exemplars_and_frequencies(spark):
    table = spark.createDataFrame([("error", "Aisle closed for cleaning"), ("error", "Aisle closed for cleaning"), (None, "x"), ("filler", "")], "kind string, text string")
    own = residue.labelled(table)
    assert own == {"error": ["Aisle closed for cleaning"]}
    df = spark.createDataFrame([(1, "s", "Aisle closed for cleaning", "a fine, fine kettle for tea"), (2, "s", "null", None)], "product_id long, site string, title string, description string")
    assert [tuple(r) for r in residue.residue_fields(df, exemplars=own).collect()] == [(1, "title", "error")]
    assert residue.frequencies(df, exemplars=own) == ({"aisle": 1, "closed": 1, "cleaning": 1, "for": 2}, 3)


def test_containment_against_brute_force():
    """Prefix-filtered retrieval finds what comparing every exemplar with every window finds."""
    ix = residue.Index({"page": 900, "not": 500, "found": 300, "the": 5000}, 6000)
    for text in BAD + GOOD:
        toks = residue.tokens(text)
        want = set()
        for e, bag in enumerate(ix.bags):
            size = ix.sizes[e] + (ix.sizes[e] > 3) * 2
            for i in range(max(1, len(toks) - size + 1)):
                window = toks[i : i + size]
                if sum(ix.weight[t] * min(c, window.count(t)) for t, c in bag.items()) >= residue.CONTAINED * ix.mass[e] - 1e-9:
                    want.add(e)
        assert {e for e, _, _ in ix.matches(toks)} == want


def test_over_a_table(spark):
    rows = [(i, "shop.example", t, None, "x", "y", 1) for i, t in enumerate(BAD)] + [(100 + i, "shop.example", None, t, "x", "y", 1) for i, t in enumerate(GOOD)]
    rows += [rows[0], (None, "s", "null", None, None, None, None), (999, None, "word " * 20_000 + "{{title}}", None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["product_id"], r["field_name"]) for r in residue.residue_fields(df).collect()}
    skip = {i for i, t in enumerate(BAD) if "|" in t and "*" not in t}  # the seller's name is another one here
    assert {g for g in got if g[0] not in skip} == {(i, "title") for i in range(len(BAD)) if i not in skip} | {(999, "title")}
    assert residue.residue_fields(df.limit(0)).count() == 0
    kept = {r["product_id"]: r["title"] for r in residue.without_residue(df.where("product_id in (0, 999) or product_id >= 100")).collect()}
    assert kept[0] is None and kept[999] is None


@pytest.mark.parametrize("text", ["Page not found.", "Pagina niet gevonden.", "Nie znaleziono strony."])
def test_repeated_short_messages(text):
    for n in (1, 2, 5):
        assert residue.Index().judge(" ".join([text] * n))
    assert residue.Index().judge(f"{text} {text} Kettle in red enamel with a long spout, a lid and two handles of oak.") is None
