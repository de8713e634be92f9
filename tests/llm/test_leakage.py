import random
import time

import pytest

from mossgrid.llm import leakage as k

DOCS = "doc_id long, text string, item_id long, coverage string"
ITEMS = "item_id long, text string, doc_id long"
A = "By noon the knotted harness swallowed 779 crooked rivets except those from Dunmerrow. Past Castle Ulmo the slanted nozzle lost 421 zinc plated stamps as the clerk noted. At the third bell the damp spindle dragged along 50 striped brackets."
B = "中午之前，沉重的磨坊压住了844个带刺的弹簧，没有人拍卖过。大门后面，镀金的滑轮带回了97个暗淡的代币，全部重新拍卖。"


def brute(doc, item, size):
    """Greedy string tiling by trying everything."""
    free_d, free_i, total = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (size - 1, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and free_d[i + n] and free_i[j + n] and doc[i + n] and doc[i + n] == item[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, j, i)
        n, j, i = best
        if n < size:
            return total
        for x in range(n):
            free_d[i + x] = free_i[j + x] = False
        total += n


def test_tiling_against_brute_force():
    random.seed(2)
    for _ in range(150):
        doc = [random.randint(0, 4) for _ in range(random.randint(0, 40))]
        item = [random.randint(1, 4) for _ in range(random.randint(1, 25))]
        assert k.tile_coverage(doc, item, 3) == brute(doc, item, 3)
        runs = {(n, j, i) for j in range(len(item)) for i in range(len(doc)) for n in range(3, 41) if item[j : j + n] == doc[i : i + n] and len(item[j : j + n]) == n == len(doc[i : i + n]) and (j == 0 or i == 0 or item[j - 1] != doc[i - 1]) and item[j + n : j + n + 1] != (doc[i + n : i + n + 1] or [-1])}
        assert set(k.common_runs(doc, item, 3)) == {r for r in runs if r[1] + r[0] == len(item) or r[2] + r[0] == len(doc) or item[r[1] + r[0]] != doc[r[2] + r[0]]}


def edited(text, every):
    """The text with every so many words replaced."""
    words = text.split(" ")
    return " ".join("changed" if i % every == every - 1 else w for i, w in enumerate(words))


@pytest.mark.parametrize("every", [4, 5, 6, 10])
def test_edited_words(every):
    long = A + " " + A.replace("rivets", "bolts").replace("noon", "dusk")
    assert [x for x, _ in k.Items([(1, long)]).found("Intro. " + edited(long, every) + " Outro.")] == [1]
    assert k.Items([(1, long)]).found("Intro. " + edited(long, 2) + " Outro.") == []


def test_common_phrases_are_no_leak():
    rng = random.Random(3)
    words = A.lower().replace(".", "").split()
    # runs of three words in random order share many seeds, but no passage
    parts = [" ".join(words[i : i + 3]) for i in range(0, len(words) - 3, 3)]
    rng.shuffle(parts)
    assert k.Items([(1, A)]).found(" and also others say ".join(parts)) == []


def test_short_items():
    items = k.Items([(1, "two words"), (2, "one"), (3, "a b c d")])
    assert {x for x, _ in items.found("here two words stand")} == {1} and {x for x, _ in items.found("two other words a b c")} == set()
    assert {x for x, _ in items.found("One a b c d")} == {2, 3}


def test_repetitive_texts_are_quick():
    began = time.time()
    k.Items([(1, "ab " * 60)]).found("ab " * 40_000)
    assert time.time() - began < 20


@pytest.mark.parametrize("limit", [k.BROADCAST_CHARS, 0])
def test_both_joins_find_the_same(spark, limit):
    part = A.split(". ")
    rows = [
        (1, "Intro. " + A + " Outro.", 0, ""), (2, f"{part[2]} Something else here entirely. {part[0]}.", 0, ""), (3, part[0][:40], 0, ""), (4, None, 0, ""), (5, "", 0, ""), (6, "前言。" + B[:40], 0, ""),
        (7, A.upper().replace("RIVETS", "RVETS"), 0, ""), (8, "the clerk noted as the clerk noted " * 50, 0, ""), (1, "Intro. " + A + " Outro.", 0, ""), (9, "filler text " * 20_000 + A, 0, ""), (None, A, 0, ""),
    ]
    items = spark.createDataFrame([(10, A, 1), (11, B, 1), (12, A, 1), (13, None, 1), (14, "too short", 1), (16, "noted as", 1), (15, " ", 1)], ITEMS)
    got = {(r["doc_id"], r["item_id"]) for r in k.leaked_items(spark.createDataFrame(rows, DOCS), items, limit).collect()}
    assert got == {(d, i) for d in (1, 2, 7, 9) for i in (10, 12)} | {(6, 11)} | {(8, 16)}
    assert k.leaked_items(spark.createDataFrame([], DOCS), items, limit).count() == 0
    assert k.leaked_items(spark.createDataFrame(rows, DOCS), items.limit(0), limit).count() == 0
