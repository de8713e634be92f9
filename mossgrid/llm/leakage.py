"""Held-out evaluation passages that leaked into training documents.

Shared-token seeds (runs of three tokens) join documents with items; what shares enough
seeds is tiled greedily: Karp-Rabin fingerprints of the least tile length find all
maximal common runs, the longest run that touches no marked token is marked, and so on.
The share of an item's tokens under tiles tells the leak, in whatever order the
sentences come and with other text between them. A single tile of a few words is common
style and counts for nothing; short tiles count where an edited word or two stand between
them and they make a passage together.

A token is a word of letters or digits in lower case; in scripts written without spaces
every character is one.

Defined results
* null, empty and blank documents and items are in no pair;
* an item is reported for a document when tiles cover at least ``COVERED`` of its tokens;
* of an item shorter than the least passage all tokens must stand in the document in a row;
  an item without a token is never found; equal items are all reported;
* an empty table on either side gives an empty result; repeated rows give one pair.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossgrid.session import cut, spread

SEED = 3
COVERED = 0.4
#: The least tile, in words and in characters of a spaceless script, and the least that tiles in a
#: chain must hold together; between two tiles of a chain stand at most so many edited tokens.
TILE_WORDS, WHOLE_WORDS = 3, 6
TILE_CHARS, WHOLE_CHARS = 5, 8
GAP = 2
#: Items go to every task only up to this many characters of text; beyond, seeds are joined by a shuffle.
BROADCAST_CHARS = 8_000_000
_SPACELESS = "⺀-〆〡-鿿ꀀ-꒏가-힣豈-﫿ｦ-ﾟ฀-๿ຠ-໿က-႟ក-៿"
_TOKEN = re.compile(rf"[{_SPACELESS}]|[^\W_{_SPACELESS}]+")
_BASE, _MOD = 1_000_003, (1 << 61) - 1


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def least_tile(item: list[str]) -> tuple[int, int]:
    """``(least tile, least passage)`` of an item."""
    single = sum(len(t) == 1 and not t.isascii() for t in item)
    size, whole = (TILE_CHARS, WHOLE_CHARS) if 2 * single > len(item) else (TILE_WORDS, WHOLE_WORDS)
    return min(size, len(item)), min(whole, len(item))


def _fingerprints(ids: list[int], size: int) -> Iterator[int]:
    """Rolling Karp-Rabin fingerprints of all windows."""
    top = pow(_BASE, size - 1, _MOD)
    h = 0
    for i, x in enumerate(ids):
        if i >= size:
            h = (h - ids[i - size] * top) % _MOD
        h = (h * _BASE + x) % _MOD
        if i >= size - 1:
            yield h


def common_runs(doc: list[int], item: list[int], size: int) -> list[tuple[int, int, int]]:
    """``(length, place in item, place in doc)`` of all maximal common runs of at least ``size`` tokens."""
    at: dict[int, list[int]] = defaultdict(list)
    for j, h in enumerate(_fingerprints(item, size)):
        at[h].append(j)
    runs, going = [], {}
    for i, h in enumerate(_fingerprints(doc, size)):
        # runs that stand at item place j here came from j - 1 one token before
        now = {}
        for j in at.get(h, ()):
            before = going.pop(j - 1, None)
            if before is not None:
                now[j] = before + 1
            elif doc[i : i + size] == item[j : j + size]:
                now[j] = size
        runs += [(n, j - n + size, i - 1 - n + size) for j, n in going.items()]
        going = now
    last = len(doc) - size
    return runs + [(n, j - n + size, last - n + size) for j, n in going.items()]


def tiles(doc: list[int], item: list[int], size: int) -> list[tuple[int, int, int]]:
    """``(place in item, place in doc, length)`` of the tiles of greedy string tiling; a doc token of 0 equals none."""
    runs = [(-n, j, i) for n, j, i in common_runs(doc, item, size)]
    heapq.heapify(runs)
    in_doc, in_item, out = set(), set(), []
    while runs and len(in_item) < len(item):
        n, j, i = heapq.heappop(runs)
        free = [k for k in range(-n) if i + k not in in_doc and j + k not in in_item]
        if len(free) == -n:
            in_doc.update(range(i, i - n))
            in_item.update(range(j, j - n))
            out.append((j, i, -n))
            continue
        # what earlier tiles left of the run stands in line again
        begin = 0
        while begin < len(free):
            end = begin
            while end + 1 < len(free) and free[end + 1] == free[end] + 1:
                end += 1
            if end - begin + 1 >= size:
                heapq.heappush(runs, (-(end - begin + 1), j + free[begin], i + free[begin]))
            begin = end + 1
    return out


def tile_coverage(doc: list[int], item: list[int], size: int, whole: int | None = None) -> int:
    """Tokens of ``item`` under tiles. Tiles of less than ``whole`` tokens count where they stand in a
    chain: one behind the other in document and item, with at most ``GAP`` edited tokens between,
    ``whole`` tokens or more together."""
    whole = whole or size
    total, chain, end_item, end_doc = 0, 0, -1, -1
    for j, i, n in sorted(tiles(doc, item, size)):
        if chain and 0 <= j - end_item <= GAP and 0 <= i - end_doc <= GAP:
            chain += n
        else:
            total += chain if chain >= whole else 0
            chain = n
        end_item, end_doc = j + n, i + n
    return total + (chain if chain >= whole else 0)


class Items:
    """Items with the index of their seeds."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.ids: dict[int, list[int]] = {}
        self.size: dict[int, tuple[int, int]] = {}
        self.seeds: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for key, text in rows:
            toks = tokens(text or "")
            ids = [self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in toks]
            if ids:
                self.size[key], self.ids[key] = least_tile(toks), ids
                # an item shorter than a seed is its own seed
                for j in range(max(1, len(ids) - SEED + 1)):
                    self.seeds[tuple(ids[j : j + SEED])].append((key, j))
        self.lengths = sorted({len(s) for s in self.seeds})

    def coverage(self, doc: list[int], key: int) -> float:
        return tile_coverage(doc, self.ids[key], *self.size[key]) / len(self.ids[key])

    def enough(self, key: int) -> float:
        """Item positions at which a seed must be shared: a tile of n tokens holds n - 2 seeds."""
        size = self.size[key][0]
        return COVERED * len(self.ids[key]) * max(1, size - SEED + 1) / max(size, SEED) if len(self.ids[key]) > SEED else 1

    def found(self, text: str) -> list[tuple[int, float]]:
        get = self.vocabulary.get
        doc = [get(t, 0) for t in tokens(text)]
        shared: dict[int, set[int]] = defaultdict(set)
        run, seen = 0, set()
        for i, x in enumerate(doc):
            run = run + 1 if x else 0
            for n in self.lengths:
                if run >= n:
                    seed = tuple(doc[i - n + 1 : i + 1])
                    if seed not in seen:
                        seen.add(seed)
                        for key, j in self.seeds.get(seed, ()):
                            shared[key].add(j)
        out = []
        for key, places in shared.items():
            if len(places) >= self.enough(key) - 1e-9 and (c := self.coverage(doc, key)) >= COVERED - 1e-9:
                out.append((key, c))
        return out


_RESULT = "doc_id long, item_id long, coverage double"


def _by_broadcast(documents: DataFrame, rows: list[tuple[int, str]]) -> DataFrame:
    """All items in every task: no document is moved."""
    shared = documents.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = Items(shared.value)
        for pdf in batches:
            out = [(d, k, c) for d, t in zip(pdf["doc_id"], pdf["text"]) if t for k, c in items.found(t)]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "coverage"])

    return spread(documents.select("doc_id", "text").where("doc_id is not null and text is not null")).mapInPandas(run, _RESULT)


def _seeds(df: DataFrame, key: str, own: bool) -> DataFrame:
    """``(key, seed, place)`` of every run of three tokens; of an item (``own``) that is shorter the whole,
    of a document the shorter runs too."""
    kind, sizes = dict(df.dtypes)[key], (SEED,) if own else range(1, SEED + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key], pdf["text"]):
                toks = tokens(t) if t else []
                out += [(k, " ".join(toks[i : i + n]), i) for n in sizes for i in range(len(toks) - n + 1)]
                if own and 0 < len(toks) < SEED:
                    out.append((k, " ".join(toks), 0))
            yield pd.DataFrame(out, columns=[key, "seed", "place"])

    return df.select(key, "text").mapInPandas(run, f"{key} {kind}, seed string, place int").select(key, F.xxhash64("seed").alias("seed"), "place")


def _needs(items: DataFrame) -> DataFrame:
    """``(item_id, need)``: places of each item at which a leak shares a seed at least."""
    kind = dict(items.dtypes)["item_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            every = [Items([(i, t)]) for i, t in zip(pdf["item_id"], pdf["text"])]
            yield pd.DataFrame([(i, x.enough(i)) for i, x in zip(pdf["item_id"], every) if i in x.ids], columns=["item_id", "need"])

    return items.select("item_id", "text").mapInPandas(run, f"item_id {kind}, need double").groupBy("item_id").agg(F.min("need").alias("need"))


def _by_shuffle(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Seeds joined by a shuffle, for item sets of any size."""
    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    doc_seeds = _seeds(docs, "doc_id", False).select("doc_id", "seed").distinct()
    shared = doc_seeds.join(_seeds(items, "item_id", True), "seed").groupBy("doc_id", "item_id").agg(F.count_distinct("place").alias("places"))
    # pairs that share too few of an item's seeds for a leak go; the exact test follows
    shared = cut(shared.join(_needs(items), "item_id").where(F.col("places") >= F.col("need") - 1e-9).select("doc_id", "item_id"))
    joined = shared.join(docs, "doc_id").join(items.select("item_id", F.col("text").alias("item")), "item_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, t, k, item in zip(pdf["doc_id"], pdf["text"], pdf["item_id"], pdf["item"]):
                out += [(d, k, c) for k, c in Items([(k, item)]).found(t)]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "coverage"])

    return joined.select("doc_id", "text", "item_id", "item").mapInPandas(run, _RESULT)


def leaked_items(documents: DataFrame, items: DataFrame, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """``(doc_id, item_id, coverage)`` of every item a document carries."""
    held = items.select("item_id", "text").where("item_id is not null and text is not null and trim(text) <> ''").dropDuplicates()
    size = held.agg(F.sum(F.length("text"))).first()[0] or 0
    if size <= broadcast_chars:
        found = _by_broadcast(documents, [(r["item_id"], r["text"]) for r in held.collect()])
    else:
        found = _by_shuffle(documents, held)
    return found.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"))
