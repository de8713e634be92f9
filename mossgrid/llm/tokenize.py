"""Encoding of a corpus with a public byte-level BPE tokenizer.

The distinct words of a batch are laid out as one flat array of symbols. Each round
looks up all neighbouring pairs at once, by binary search over the sorted pair keys,
finds every word's lowest rank and merges that pair wherever it stands in the word;
words without a known pair leave the array. Finished words are kept for later batches.

Defined results
* an empty and a null text give an empty list;
* the special tokens' strings in a text are ordinary text;
* lone surrogates cannot reach Python from Spark; any text is encoded whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mossgrid.session import spread

#: Where the public vocabularies lie; a parameter of every function here.
VOCABULARIES = os.environ.get("MOSSGRID_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: how a text is split before merging (the published pattern of the vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts split into words at once; a worker's memory grows with it.
AT_ONCE = 512
#: Encoded words a worker remembers, and the longest of them.
KEEP_WORDS = 200_000
KEEP_CHARS = 64


class Encoder:
    """Encodes batches of texts with the ranks of a ``.tiktoken`` file."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(PATTERN).findall
        self.size = max(ranks.values()) + 1
        self.of_byte = np.array([ranks[bytes((i,))] for i in range(256)], np.int64)
        keys, results = [], []
        # a token's parts are those its own bytes merge to with lower ranks only
        for token, rank in ranks.items():
            if len(token) > 1:
                a, b = self._parts(token, rank, ranks)
                keys.append(a * self.size + b)
                results.append(rank)
        order = np.argsort(keys)
        self.keys = np.array(keys, np.int64)[order]
        self.results = np.array(results, np.int64)[order]
        self.known: dict[str, np.ndarray] = {}

    @staticmethod
    def _parts(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[int, int]:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            low, at = rank, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], rank)
                if r < low:
                    low, at = r, i
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        top = len(self.keys)
        while len(symbols):
            pair = symbols[:-1] * self.size + symbols[1:]
            at = np.searchsorted(self.keys, pair)
            at[at == top] = 0
            rank = np.where((self.keys[at] == pair) & (word[:-1] == word[1:]), self.results[at], self.size) if top else np.full(len(pair), self.size)
            rank = np.append(rank, self.size)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            counts = np.diff(np.append(starts, len(word)))
            low = np.minimum.reduceat(rank, starts)
            ended = low == self.size
            if ended.any():
                for s, n in zip(starts[ended], counts[ended]):
                    done[word[s]] = symbols[s : s + n]
                keep = ~np.repeat(ended, counts)
                symbols, word, rank, counts, low = symbols[keep], word[keep], rank[keep], counts[~ended], low[~ended]
                if not len(symbols):
                    break
            hit = rank == np.repeat(low, counts)
            # in a run of overlapping hits every second one merges, from the left
            i = np.flatnonzero(hit)
            first = np.append(True, np.diff(i) > 1)
            begin = i[first][np.cumsum(first) - 1]
            i = i[(i - begin) % 2 == 0]
            symbols[i] = rank[i]
            stay = np.ones(len(symbols), bool)
            stay[i + 1] = False
            symbols, word = symbols[stay], word[stay]
        return done

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.split(t) if t else () for t in texts]
        fresh = list({w for ws in split for w in ws} - self.known.keys())
        if len(self.known) + len(fresh) > KEEP_WORDS:
            self.known = {}
            fresh = list({w for ws in split for w in ws})
        if fresh:
            self.known.update(zip(fresh, self.merge(fresh)))
        empty, known = np.empty(0, np.int64), self.known
        out = [np.concatenate([known[w] for w in ws]) if ws else empty for ws in split]
        for w in fresh:
            if len(w) > KEEP_CHARS:
                del known[w]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)


def token_ids(text: Column | str, tokenizer: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> Column:
    """``array<int>``: the ids of a text column, without special tokens."""
    path = f"{folder}/{tokenizer}.tiktoken"
    if not os.path.exists(path):
        try:
            import public_tokenizers

            path = public_tokenizers.path(f"{tokenizer}.tiktoken")
        except ImportError:
            pass

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for texts in batches:
            out: list[np.ndarray] = []
            for at in range(0, len(texts), AT_ONCE):
                out += [x.astype(np.int32) for x in own.encode([t or None for t in texts.iloc[at : at + AT_ONCE]])]
            yield pd.Series(out)

    return run(text)


def corpus_ids(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``(doc_id, ids)``: one row per row of ``documents``."""
    return spread(documents.select("doc_id", "text")).select("doc_id", token_ids(F.col("text"), tokenizer, folder).alias("ids"))
