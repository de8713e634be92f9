import itertools
import random

import pytest

from mossgrid.llm import articles as a

SCHEMA = "product_id long, site string, title string, brand string, sku string, description string, model string, node long, class_id long"


def rows(*listings):
    return [(*x, "m", 0, 0) for x in listings]


L = rows(
    (1, "s1", "Vintorp PLD 5625 Mini Ladekabel gelb 200 cm", "Vintorp", None, None),
    (2, "s2", "PLD-5625 Mini | charging cable | 78.7 in", "VINTORP Official", "PLD-5625MINI/05/3", "Colour: yellow. Specification: 2 m."),
    (3, "s3", "kabel PLD5625 Mini żółta seria", None, "PLD5625MINI-053", None),
    (4, "s4", "Vintorp PLD-5625 Mini Ladekabel rot 200 cm", "Vintorp", None, None),
    (5, "s5", "Ersatzgriff für Vintorp PLD-5625 Mini, gelb", "Vintorp", "PLD5625MINI-053-AC", None),
    (6, "s6", "Page introuvable", "Vintorp", "PLD5625MINI-053", "Colour: yellow. Specification: 2 m. PLD 5625 Mini"),
    (7, "s7", "PLD 5625 II Ladekabel gelb 200 cm", "Vintorp", None, None),
    (8, "s8", None, None, None, None),
    (9, "s1", "plain text without a model", None, "12345", ""),
    (10, "s9", "ＰＬＤ－５６２５ Mini câble jaune doré 2000 mm", "Vintorp", None, None),
)


def pairs(df):
    return {tuple(r) for r in a.article_pairs(df).collect()}


def test_pairs(spark):
    df = spark.createDataFrame([*L, L[0], (None, *L[0][1:])], SCHEMA)
    assert pairs(df) == set(itertools.combinations((1, 2, 3, 10), 2))
    assert pairs(df.limit(0)) == set()
    assert pairs(df.orderBy("title").repartition(7)) == set(itertools.combinations((1, 2, 3, 10), 2))


def test_copies_of_one_seller_are_one_node(spark):
    copies = rows(*[(100 + i, "s1", "Vintorp PLD 5625 Mini Ladekabel gelb 200 cm", "Vintorp", None, "x" * 5000) for i in range(5)], (200, "s2", "PLD 5625 Mini charging cable yellow 2 m", None, None, None))
    assert pairs(spark.createDataFrame(copies, SCHEMA)) == set(itertools.combinations((100, 101, 102, 103, 104, 200), 2))


@pytest.mark.parametrize("text, want", [("128 gb, 6 in", "b128000|x150"), ("118.1 in", "x3000"), ("0,35 l", "v350"), ("35 cl", "v350"), ("9 watt", "p9000"), ("9000 mw", "p9000"), ("0,75 kg", "g750"), ("26.5 oz", "g750"), ("eu 39", "size:39"), ("gr. m", "size:m"), ("large (l)", "size:l"), ("für ø 8 mm rails", None), ("7 m²", None), ("none", None)])
def test_measures(text, want):
    assert a.measures_of(text) == want


def test_matching_is_maximal():
    random.seed(5)
    for _ in range(60):
        n, m = random.randint(1, 4), random.randint(1, 4)
        w = [[random.choice([None, 1.0, 2.0, 3.5, 5.0]) for _ in range(m)] for _ in range(n)]
        got = a.best_matching(w)
        assert len({i for i, _ in got}) == len(got) == len({j for _, j in got})
        best = 0.0
        wide, tall = max(n, m), min(n, m)
        for perm in itertools.permutations(range(wide), tall):
            cells = zip(range(tall), perm) if n <= m else ((j, i) for i, j in zip(range(tall), perm))
            best = max(best, sum(w[i][j] or 0 for i, j in cells))
        assert sum(w[i][j] for i, j in got) == pytest.approx(best)


def test_cycles_that_contradict_are_cut():
    # a and c differ in colour; b could go to either, and goes to the heavier
    nodes = [(1, "s1", (None, "red", "x1", None)), (2, "s2", (None, None, "x1", None)), (3, "s3", (None, "blue", None, None))]
    assert dict(a.classes(nodes)) == {1: 1, 2: 1, 3: 3}
    # one seller never holds two listings of one article
    nodes = [(1, "s1", (None, "red", None, None)), (2, "s1", (None, None, "x1", None)), (3, "s2", (None, "red", "x1", None))]
    assert len({c for _, c in a.classes(nodes)}) == 2
    # both ends of a match have a partner at a third seller, and not the same one
    assert not a._cycles_agree([{"s3": 2}, {"s3": 3}], 0, 1) and a._cycles_agree([{"s3": 2}, {"s3": 2}], 0, 1) and a._cycles_agree([{}, {}], 0, 1)


def test_components():
    profiles = [(None, "red", "x1", None), (None, "red", None, None), (None, "blue", "x1", None), (None, "blue", None, None), (None, "green", None, "7")]
    assert a.components(profiles) == [0, 0, 2, 2, 4]
    assert a.components([*profiles, (None, None, None, None)]) == [0] * 6
    # a model name that several brands use holds only with its brand
    assert a.components([("x", None, None, None), ("y", None, None, None), (None, None, None, None)]) == [0, 1, 2]


@pytest.mark.parametrize("text, want", [("dark green", "green/dark"), ("dunkelgrün", "green/dark"), ("vert foncé", "green/dark"), ("grün", "green"), ("navy blue", "blue/dark"), ("тёмно-синий", "blue/dark"), ("hellblau", "blue/light"), ("gris argenté", "grey"), ("czarna seria", None), ("brot", None)])
def test_colours(text, want):
    assert a.colour_of(text) == want


ORDINARY = [
    (1, "s1", "Bosch Professional GSR 18V-60 cordless drill, blue", "Bosch", None, None),
    (2, "s2", "BOSCH GSR18V-60 Akkuschrauber blau", "Bosch GmbH", None, None),
    (3, "s3", "perceuse sans fil GSR 18V-60 bleu", "bosch", "06019G1100", None),
    (4, "s1", "Samsung Galaxy S21 128 GB black", "Samsung", None, None),
    (5, "s2", "Samsung Galaxy S21 schwarz 128GB", "Samsung", None, None),
    (6, "s3", "Samsung Galaxy S21 Ultra 128 GB black", "Samsung", None, None),
    (7, "s4", "Samsung Galaxy S21 256 GB black", "Samsung", None, None),
    (8, "s1", "Miele Classic C1 vacuum cleaner red", "Miele", None, None),
    (9, "s2", "Miele Staubsauger C1 rot", "Miele", None, None),
    (10, "s3", "Canon C1 red", "Canon", None, None),
    (11, "s1", "Sony WH-1000XM4 headphones black", "Sony", None, None),
    (12, "s2", "Kopfhörer Sony WH1000XM4 schwarz", "Sony", None, None),
    (13, "s3", "Carry case for Sony WH-1000XM4 black", "Sony", None, None),
    (14, "s1", "KitchenAid Artisan stand mixer red", "KitchenAid", None, None),
    (15, "s2", "NEW Artisan Stand Mixer, red", "KitchenAid", None, None),
    (16, "s3", "KitchenAid Artisan stand mixer blue", "KitchenAid", None, None),
]


def test_ordinary_titles(spark):
    df = spark.createDataFrame(rows(*ORDINARY), SCHEMA)
    assert pairs(df) == {(1, 2), (1, 3), (2, 3), (4, 5), (8, 9), (11, 12), (14, 15)}


def test_large_classes_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(a, "SALTED", 3)
    df = spark.createDataFrame(rows(*[(i, f"s{i}", "Miele Classic C1 vacuum cleaner red", "Miele", None, None) for i in range(11)]), SCHEMA)
    assert pairs(df) == set(itertools.combinations(range(11), 2)) and a.article_pairs(df).count() == 55
