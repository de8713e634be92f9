import base64
import os
import random

import pytest

from mossgrid.llm import tokenize

PATH = f"{tokenize.VOCABULARIES}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="the public vocabularies are not here")


@pytest.fixture(scope="module")
def public():
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokenize.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    random.seed(7)
    made = ["".join(random.choice("ab ct\n\t aé漢😀<|endoftext|>　\x85 '’sre1२") for _ in range(random.randint(0, 60))) for _ in range(400)]
    return [*made, "a" * 5000, "<|endoftext|>", "漢字" * 2000, " " * 3000, "", "it's we'll I'd", "\r\n\r\n x", "aaaa" * 50 + "b"]


def test_equals_the_public_library(public):
    own = tokenize.Encoder(PATH)
    for t, ids in zip(texts(), own.encode(texts())):
        assert list(map(int, ids)) == public.encode_ordinary(t)
        assert public.decode(list(map(int, ids))) == t


def test_over_a_table(spark, public):
    rows = [(1, "Hello  world", 5), (2, "", 5), (3, None, 5), (3, None, 5)]
    got = tokenize.corpus_ids(spark.createDataFrame(rows, "doc_id long, text string, ids long")).collect()
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in got) == [(1, tuple(public.encode_ordinary("Hello  world"))), (2, ()), (3, ()), (3, ())]
    assert tokenize.corpus_ids(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_remembered_words_are_bounded(monkeypatch, public):
    monkeypatch.setattr(tokenize, "KEEP_WORDS", 50)
    own = tokenize.Encoder(PATH)
    for i in range(0, 400, 40):
        for t, ids in zip(texts()[i : i + 40], own.encode(texts()[i : i + 40])):
            assert list(map(int, ids)) == public.encode_ordinary(t)
