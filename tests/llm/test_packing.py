"""Best-fit packing: places, round trip of ids, number of sequences."""

import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from statspine.llm import packing

RANKS, PATTERN = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
TEXTS = [
    None, "", " ", "a", "\n\n  x\t y  ", "It's  we'll don't\r\n 12 345", "Größe élève ñandú 日本語 🙂🙃 é", "<|endoftext|> in <|endoftext|>text",
    "word " * 5000, "   x　 ", "x" * 3000, " !!! ?? ... --",
]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_those_of_the_json_form(text):
    coder = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert packing.token_ids(text, RANKS, PATTERN).tolist() == coder.encode(text or "", add_special_tokens=False).ids


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((capacity if fit is None else fit) - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(4))
def test_as_few_sequences_as_one_by_one(spark, seed, monkeypatch):
    monkeypatch.setattr(packing, "PART", 10)  # a common length numbered in parts
    rng = random.Random(seed)
    high = (64, 40, 33, 20)[seed]
    lengths = [rng.randint(1, high) for _ in range(300)] + [17] * 200
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    rows = packing.best_fit(items, 64).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    assert check_places(rows, 64) == best_fit_decreasing(lengths, 64)


def test_documents_round_trip(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(2, TEXTS[8], 1)] * 2 + [(None, "no id", 2)], "doc_id long, text string, length int")
    rows = packing.pack(docs, RANKS, PATTERN, 64).collect()
    check_places(rows, 64)
    coder = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i, text in enumerate(TEXTS):
        if i == 2:
            continue
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        ids = b"".join(bytes(r.ids) for r in own)
        assert ids == b"".join(x.to_bytes(4, "little") for x in [*coder.encode(text or "", add_special_tokens=False).ids, 0])
        assert [r.start for r in own] == [sum(p.length for p in own[:k]) for k in range(len(own))]
        assert all(r.length == 64 for r in own[1:])
    assert sum(r.doc_id is None for r in rows) == 1
    assert sum(r.doc_id == 2 for r in rows) == 1 + 2 * sum(r.doc_id == 8 for r in rows)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), RANKS, PATTERN).count() == 0
