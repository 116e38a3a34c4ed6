"""Winnowing against its definition."""

import random

import numpy as np
import pytest

from statspine.llm import winnowing as W


def brute(text, k, window):
    points = np.array([ord(c) for c in text], dtype="<u4")
    if not len(points):
        return [], []
    k = min(k, len(points))
    hashes = [int(W.gram_hashes(points[i : i + k], k)[0]) for i in range(len(points) - k + 1)]
    window = min(window, len(hashes))
    kept = []
    for i in range(len(hashes) - window + 1):
        own = hashes[i : i + window]
        at = i + max(j for j, h in enumerate(own) if h == min(own))
        if not kept or kept[-1] != at:
            kept.append(at)
    return [hashes[i] for i in kept], kept


@pytest.mark.parametrize("k,window", [(1, 1), (5, 4), (12, 8), (7, 5), (3, 20)])
def test_kept_hashes(monkeypatch, k, window):
    rng = random.Random(k)
    for text in ["", "a", "abc", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "".join(rng.choices("ab", k=200)), "".join(rng.choices("abcdé🙂", k=300))]:
        for span in (1 << 22, 16):
            monkeypatch.setattr(W, "SPAN", span)
            hashes, positions = W.winnow(text, k, window)
            assert (hashes.tolist(), positions.tolist()) == brute(text, k, window)


def test_shared_passage_is_found():
    rng = random.Random(1)
    passage = "".join(rng.choices("abcdefgh ", k=W.K + W.WINDOW - 1))
    for _ in range(50):
        a, b = ("".join(rng.choices("ijklmnop ", k=rng.randint(0, 60))) + passage + "".join(rng.choices("qrst ", k=40)) for _ in range(2))
        assert set(W.winnow(a)[0].tolist()) & set(W.winnow(b)[0].tolist())


def test_compared_rows(spark):
    rng = random.Random(2)
    rows = [(i * 31 % 211, "".join(rng.choices("abc é🙂\n", k=rng.randint(0, 80))), "x", 0) for i in range(120)]
    rows += [(500, None, "x", 1), (501, "", "x", 1), (None, "null id", "y", 2), (502, "x" * 100_000, "y", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string, carry int")
    got = {r.doc_id: r for r in W.compared(docs).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    for (doc, text, *_), (_, after, *_) in zip(order, order[1:] + order[:1]):
        text, after, r = text or "", after or "", got[doc]
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        sets = [set(brute(t, W.K, W.WINDOW)[0]) for t in (text, new, after)]
        alike = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        import hashlib

        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert [r.near_edited, r.near_next] == pytest.approx(alike)
        assert (r.fingerprint == r.edited_fingerprint) == (text == new)
    assert len(got) == len(rows)


def test_repeated_rows_and_one_row(spark):
    docs = spark.createDataFrame([(1, "one text that is repeated")] * 3 + [(1, "another text"), (2, "last")], "doc_id long, text string")
    assert sorted(r.doc_id for r in W.compared(docs).collect()) == [1, 1, 1, 1, 2]
    one = W.compared(spark.createDataFrame([(9, "abcd")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.n_chars == 4


def test_empty(spark):
    assert W.compared(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprints(spark):
    r = W.fingerprints(spark.createDataFrame([(1, "some text to be kept in part")], "doc_id long, text string")).first()
    h, p = W.winnow("some text to be kept in part")
    assert r.hashes == h.view(np.int64).tolist() and r.positions == p.tolist()
