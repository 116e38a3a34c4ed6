"""License scans: an exact set-similarity join of text blocks with license templates.

A template's tokens are put in the order of how often they occur in the whole corpus, rarest first. A block that holds at
least the share ``CONTAINMENT`` of a template's n tokens, that is ``need`` of them, holds one of its first
n - need + 1 tokens; those are looked up in an index. Further filters ask for enough tokens in the block, and for enough
left in both orders from the first shared token on. Blocks that pass are verified on the sets.

A block is a line; a longer one than ``BLOCK`` words is cut into windows of ``BLOCK`` words that overlap by half, so
that every passage of up to half a window lies in one block. Notices that are wrapped over lines are found in passages:
windows of the same kind over the words of the whole text, line ends being white space, twice as long as the longest
template if that is more than ``BLOCK``. Beside the join, phrases are counted where their words stand consecutively in the
whole text.

Templates are configuration, a few hundred tokens that every task holds. Defined results: null texts are empty; a text
without words has no labels and score 0; repeated rows give repeated results; an empty table gives an empty table (all
tokens are then equally frequent, ties fall by token); other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTAINMENT = 0.8
BLOCK = 64
#: phrases to be counted and the labels they stand for
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: opening or notice lines of well-known licenses
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "mit-notice": "Released under the MIT License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
#: digits, letters in lower case and all bytes outside ASCII are kept, line ends stay line ends
KEPT = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b == 10 else 32 for b in range(256)
)


def plain(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(KEPT)


def token_counts(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> dict[bytes, int]:
    """How often each template token occurs in all texts; as many numbers as templates have tokens."""
    tokens = frozenset(w for t in templates.values() for w in plain(t).split())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.update(filter(tokens.__contains__, plain(text).split()))
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["w", "n"])

    rows = docs.select("text").mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["w"]): r["n"] for r in rows}


class Index:
    """Prefix index of templates under a frequency order."""

    def __init__(self, templates: dict[str, str], counts: dict[bytes, int], containment: float = CONTAINMENT):
        self.order = lambda w: (counts.get(w, 0), w)
        self.templates = [(label, sorted(set(plain(t).split()), key=self.order)) for label, t in templates.items()]
        self.need = [math.ceil(round(containment * 1000) * len(ts) / 1000) for _, ts in self.templates]
        self.tokens = frozenset(w for _, ts in self.templates for w in ts)
        self.window = max(BLOCK, 2 * max((len(plain(t).split()) for t in templates.values()), default=0))
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for i, (_, ts) in enumerate(self.templates):
            for at, w in enumerate(ts[: len(ts) - self.need[i] + 1]):
                self.prefix.setdefault(w, []).append((i, at))

    def matches(self, block: list[bytes]) -> Iterator[tuple[str, float]]:
        """Labels and containments of the templates that a block meets."""
        held = sorted(self.tokens.intersection(block), key=self.order)
        tried = set()
        for i, w in enumerate(held):
            for template, at in self.prefix.get(w, ()):
                label, ts = self.templates[template]
                # w is the first shared token of a pair that is new; what is left from it on must do
                if template in tried or min(len(ts) - at, len(held) - i) < self.need[template]:
                    tried.add(template)
                    continue
                tried.add(template)
                shared = len(set(ts).intersection(held))
                if shared >= self.need[template]:
                    yield label, shared / len(ts)


def blocks(text: bytes, size: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """Blocks of a text's words with the place of their first word in the text."""
    start = 0
    for line in text.split(b"\n"):
        words = line.split()
        yield from windows(words, size, start)
        start += len(words)


def windows(words: list[bytes], size: int, start: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """Windows of ``size`` words that overlap by half, with their places from ``start`` on."""
    for at in range(0, max(1, len(words) - size // 2), size // 2):
        yield start + at, words[at : at + size]


def places(words: list[bytes], phrases: dict[str, str]) -> dict[str, list[int]]:
    """Starts, in words, of each phrase."""
    joined = b" " + b" ".join(words) + b" "
    found = {}
    for phrase in phrases:
        sought, at, place, counted = b" " + phrase.encode() + b" ", -1, 0, 0
        while (at := joined.find(sought, at + 1)) >= 0:
            place += joined.count(b" ", counted, at)
            counted = at
            found.setdefault(phrase, []).append(place)
    return found


def matched(index: Index, cut: Iterator[tuple[int, list[bytes]]]) -> list[dict]:
    """What the blocks of ``cut`` meet."""
    found = []
    for start, own in cut:
        if not index.prefix.keys().isdisjoint(own):
            found += [{"label": k, "start": start, "length": len(own), "containment": c} for k, c in index.matches(own)]
    return found


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, phrase places (phrase, start), blocks and passages (label, start, length, containment) of every row."""
    counts = token_counts(docs, templates)
    kind = dict(docs.dtypes)["doc_id"]
    place = pa.list_(pa.struct([("phrase", pa.string()), ("start", pa.int64())]))
    block = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("containment", pa.float64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, counts, containment)
        for batch in batches:
            n, at, met, across = [], [], [], []
            for text in batch.column("text").to_pylist():
                text = plain(text)
                words = text.split()
                n.append(len(words))
                at.append([{"phrase": p, "start": s} for p, starts in places(words, phrases).items() for s in starts])
                # a text without a prefix token has no block that meets a template
                any_ = not index.prefix.keys().isdisjoint(words)
                met.append(matched(index, blocks(text)) if any_ else [])
                across.append(matched(index, windows(words, index.window)) if any_ else [])
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(at, place), pa.array(met, block), pa.array(across, block)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "places", "blocks", "passages"])

    schema = (
        f"doc_id {kind}, n_words long, places array<struct<phrase: string, start: long>>, "
        "blocks array<struct<label: string, start: long, length: long, containment: double>>, "
        "passages array<struct<label: string, start: long, length: long, containment: double>>"
    )
    return docs.select("doc_id", "text").mapInArrow(each, schema)
