"""License scans against every block and template."""

import math
import random
import re

import pytest

from statspine.llm import licenses as L

TEXT = "Licensed under the Apache License, Version 2.0."


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_blocks(text, templates, containment):
    found, start = [], 0
    for line in (text or "").split("\n"):
        w = words(line)
        for at in range(0, max(1, len(w) - L.BLOCK // 2), L.BLOCK // 2):
            for label, t in templates.items():
                ts, own = set(words(t)), set(w[at : at + L.BLOCK])
                if len(ts & own) >= math.ceil(round(containment * 1000) * len(ts) / 1000):
                    found.append((label, start + at))
        start += len(w)
    return sorted(found)


def scanned(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, places string")
    return {r.doc_id: r for r in L.scan(docs, **kw).collect()}


@pytest.mark.parametrize("containment", [0.5, 0.8, 1.0])
def test_matches_every_block(spark, containment):
    rng = random.Random(2)
    pool = sorted({w for t in L.TEMPLATES.values() for w in words(t)}) + [f"x{i}" for i in range(30)]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(rng.randint(1, 4)):
            w = words(rng.choice(list(L.TEMPLATES.values()))) if rng.random() < 0.6 else []
            w = [x for x in w if rng.random() < 0.9] + rng.choices(pool, k=rng.choice([0, 3, 90]))
            rng.shuffle(w)
            lines.append(rng.choice([" ", ", "]).join(w))
        rows.append((i, "\n".join(lines)))
    got = scanned(spark, rows, containment=containment)
    for i, t in rows:
        assert sorted((b.label, b.start) for b in got[i].blocks) == brute_blocks(t, L.TEMPLATES, containment)


def test_places_of_phrases(spark):
    text = "CC BY cc-by, the MIT license mit License\nApache\nlicense GNU General Public License ccby accby cc byé"
    rows = [(1, text), (2, None), (3, ""), (4, TEXT), (5, "mit license " * 20_000), (6, "...")]
    got = scanned(spark, rows)
    for i, t in rows:
        w = words(t)
        expected = sorted((p, k) for p in L.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert sorted((p.phrase, p.start) for p in got[i].places) == expected and got[i].n_words == len(w)
    assert {b.label for b in got[4].blocks} == {"apache-2.0"} and not got[2].blocks


def test_long_line_is_cut_into_overlapping_blocks(spark):
    for lead in (0, 20, 40, 57, 64, 100):
        text = "word " * lead + TEXT + " word" * 200
        assert "apache-2.0" in {b.label for b in scanned(spark, [(1, text)])[1].blocks}


def test_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, TEXT), (1, TEXT), (None, TEXT)], "doc_id long, text string")
    assert [len(r.blocks) for r in L.scan(docs).collect()] == [1, 1, 1]
    assert L.scan(docs.limit(0)).count() == 0


WRAPPED = {
    "gpl-text": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or",
    "bsd-text": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at",
}


@pytest.mark.parametrize("lead", [0, 17, 40, 64, 100])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\n * "])
def test_wrapped_notices(spark, lead, end):
    rows = [(i, "word " * lead + "\n" + t.replace("\n", end) + "\n" + "word\n" * 70) for i, t in enumerate(WRAPPED.values())]
    got = scanned(spark, rows)
    for i, label in enumerate(WRAPPED):
        assert label in {b.label for b in got[i].passages} and not got[i].blocks


def test_passages_are_every_window_of_the_text(spark):
    rng = random.Random(3)
    templates = L.TEMPLATES | {"long": " ".join(f"t{i}" for i in range(50))}
    pool = [w for t in templates.values() for w in words(t)] + [f"x{i}" for i in range(20)]
    rows = []
    for i in range(60):
        w = [x for _ in range(3) for x in words(rng.choice(list(templates.values()))) + rng.choices(pool, k=rng.choice([0, 5, 90]))]
        rows.append((i, "".join(x + rng.choice(["\n", " ", " ", " "]) for x in w)))
    got = scanned(spark, rows, templates=templates)
    size = 100
    for i, t in rows:
        w, found = words(t), []
        for at in range(0, max(1, len(w) - size // 2), size // 2):
            for label, template in templates.items():
                ts = set(words(template))
                if len(ts & set(w[at : at + size])) >= math.ceil(800 * len(ts) / 1000):
                    found.append((label, at))
        assert sorted((b.label, b.start) for b in got[i].passages) == sorted(found)


def test_query_takes_wrapped_notices(spark, tmp_path):
    from statspine.llm import queries

    spark.createDataFrame([(i, t) for i, t in enumerate(WRAPPED.values())], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op10_license_scan"](spark, str(tmp_path)).collect()}
    assert [got[i].labels for i in range(3)] == ["gpl,gpl-3.0,gpl-text", "bsd-text", "mpl-2.0"]
    assert all(r.score >= 0.8 for r in got.values())
