"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers read the words of a clause: insults and threats (what is said), targets (at whom), negation and
reported speech (how far it is meant). Each turns a word into a class and moves between its own few states; their
composition is one automaton whose state is the tuple of theirs, built once as a table. A clause is scored at its end:
the weights of the insults and threats matched in it, more if a target was seen, less inside the scope of a negation or
of reported speech. A word outside a matched clause scores nothing.

The insult lexicon has a few fixed words; further entries, whole words or beginnings of words, are those which labelled
training rows show to stand in toxic texts only. A document's score is a logistic function of its clauses' scores.

Defined results: null texts are empty; an empty text has the score of a text without matched clauses; repeated rows give
repeated results; an empty table gives an empty table; without labelled rows only the fixed words and weights count;
labels that are null are left out; other columns are carried along or not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import product

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statspine.llm.common import logistic, training_rows, written

#: labelled rows that the lexicon and the weights are learnt from, at most
SAMPLE = 20_000
#: a learnt entry stands in so many different toxic training texts at least and in such a share of them, and in
#: so few others for each of them; a word that only the copies of one text hold is no entry
LEAST, SUPPORT, SHARE = 5, 0.02, 0.02
#: letters of a word's beginning that may form an entry
STEMS = (4, 5, 6)
#: entries that are learnt, at most, those in most toxic texts first
ENTRIES = 2000
THRESHOLD = 0.3

INSULTS = "idiot moron stupid loser trash pathetic disgusting scum worthless clown fool dumb vermin"
THREATS = "kill hurt destroy beat punish"
TARGETS = "you your yours yourself they them he she him her these those"
NEGATIONS = "not no never neither nor without cannot isnt arent wasnt werent dont doesnt didnt cant couldnt wont wouldnt shouldnt aint"
REPORTS = "said says called calls wrote quoted claimed reported according"

WORD = re.compile(r"[^\W\d_]+")
#: words with what is contracted to them
CONTRACTED = re.compile(r"[^\W\d_]+(?:['\u2019][^\W\d_]+)*")
APOSTROPHES = {ord("'"): None, 0x2019: None}
CLAUSE_ENDS = ".!?;:\n"
CLAUSE = re.compile(r"[.!?;:\n]+")

NONE, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)


@dataclass(frozen=True)
class Transducer:
    """States 0..n-1 from state 0; ``moves`` maps (state, class) to a state, class -1 meaning any other; all else stays."""

    states: int
    moves: dict[tuple[int, int], int]

    def next(self, state: int, kind: int) -> int:
        return self.moves.get((state, kind), self.moves.get((state, -1), state))


#: a negation or a report reaches over the three words after it; a target stays seen to the end of the clause
SCOPE = 3
TARGET_SEEN = Transducer(2, {(0, TARGET): 1})
SCOPED = lambda kind: Transducer(SCOPE + 1, {(s, kind): SCOPE for s in range(SCOPE + 1)} | {(s, -1): s - 1 for s in range(1, SCOPE + 1)})
INSULTED = Transducer(3, {(s, INSULT): min(2, s + 1) for s in range(3)})
THREATENED = Transducer(2, {(0, THREAT): 1})
PARTS = (INSULTED, THREATENED, TARGET_SEEN, SCOPED(NEGATION), SCOPED(REPORT))


def compose(parts: tuple[Transducer, ...] = PARTS) -> tuple[list[tuple[int, ...]], list[list[int]]]:
    """States of the composed automaton and its table [state][class] -> state; state 0 is the start."""
    states = list(product(*(range(p.states) for p in parts)))
    number = {s: i for i, s in enumerate(states)}
    table = [[number[tuple(p.next(x, kind) for p, x in zip(parts, s))] for kind in range(6)] for s in states]
    return states, table


STATES, TABLE = compose()
#: factor of a matched word by the state in which it is read: halved in the scope of a negation or a report
DAMPED = [0.5 ** ((s[3] > 0) + (s[4] > 0)) for s in STATES]
#: factor of a clause by the state at its end
AIMED = [1.0 + 0.5 * (s[2] > 0) + 0.25 * (s[0] > 1) for s in STATES]


@dataclass
class Grammar:
    """Lexicon of classes and weights: of whole words, and of beginnings of words."""

    words: dict[str, tuple[int, float]]
    stems: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    slope: float = 3.0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("lengths", "automaton")}

    @cached_property
    def lengths(self) -> list[int]:
        return sorted({len(x) for x in self.stems}, reverse=True)

    @cached_property
    def automaton(self):
        """Finds the places at which anything can be matched at all."""
        found = ahocorasick.Automaton()
        for entry in [w for w, (kind, _) in self.words.items() if kind in (INSULT, THREAT)] + list(self.stems):
            found.add_word(entry, len(entry))
        found.make_automaton()
        return found

    def classify(self, word: str) -> tuple[int, float]:
        found = self.words.get(word)
        if found:
            return found
        for n in self.lengths:
            if len(word) >= n and (weight := self.stems.get(word[:n])) is not None:
                return INSULT, weight
        return NONE, 0.0

    def clause_words(self, text: str, start: int, end: int) -> list[str]:
        """Words of a clause; a contraction with a negation is one word, any other is its parts."""
        out = []
        for word in CONTRACTED.findall(text, start, end):
            whole = word.translate(APOSTROPHES)
            if whole == word or self.words.get(whole, (NONE, 0.0))[0] == NEGATION:
                out.append(whole)
            else:
                out += WORD.findall(word)
        return out

    def clause(self, words: list[str]) -> float:
        """Weight of a clause; 0 unless an insult or a threat is matched in it."""
        state, weight = 0, 0.0
        for word in words:
            kind, w = self.classify(word)
            if kind == INSULT or kind == THREAT:
                weight += w * DAMPED[state]
            state = TABLE[state][kind]
        return weight * AIMED[state] if weight else 0.0

    def clauses(self, text: str | None) -> Iterator[tuple[int, int, float]]:
        """Matched clauses (start, end, weight) of a whole text."""
        text = (text or "").lower()
        end = -1
        for last, size in self.automaton.iter(text) if text else ():
            at = last + 1 - size
            if at < end or at and text[at - 1].isalpha():
                continue
            # the clause around the hit, between the ends before and after it; no further back than the clause before
            start = max(max(text.rfind(c, max(end, 0), at) for c in CLAUSE_ENDS) + 1, 0)
            after = CLAUSE.search(text, last + 1)
            clause_end = after.start() if after else len(text)
            weight = self.clause(self.clause_words(text, start, clause_end))
            end = clause_end
            if weight:
                yield start, end, weight

    def feature(self, text: str | None) -> float:
        """Sum of clause weights, on a logarithmic scale."""
        return math.log1p(math.fsum(w for _, _, w in self.clauses(text)))

    def score(self, text: str | None) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * self.feature(text)))))


def base_words() -> dict[str, tuple[int, float]]:
    lists = ((INSULTS, INSULT), (THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT))
    return {w: (kind, 1.0 if kind in (INSULT, THREAT) else 0.0) for words, kind in lists for w in words.split()}


def forms(text: str) -> set[str]:
    """Words of a text and, marked by a star, the beginnings of longer ones."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _form_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            (toxic if label else clean).update(forms(text))
    both = list(toxic.keys() | clean.keys())
    arrays = [pa.array(both, pa.string()), pa.array([toxic[f] for f in both], pa.int64()), pa.array([clean[f] for f in both], pa.int64())]
    yield pa.RecordBatch.from_arrays(arrays, names=["form", "t", "c"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    """Lexicon and weights from at most ``sample`` labelled training rows."""
    rows = written(training_rows(docs, labels, "toxic", sample).dropDuplicates(["text", "label"]), "toxic-training")
    words = base_words()
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    clean = n - toxic
    if not toxic or not clean:
        return Grammar(words)
    # in how many texts of either kind a word or a beginning of words stands
    counts = rows.mapInArrow(_form_counts, "form string, t long, c long").groupBy("form").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    kept = counts.where((F.col("t") >= max(LEAST, SUPPORT * toxic)) & (F.col("c") * toxic <= F.col("t") * SHARE * clean))
    stems: dict[str, float] = {}
    learnt: dict[str, tuple[int, float]] = {}
    for r in kept.orderBy(F.desc("t"), "form").limit(ENTRIES).collect():
        weight = min(2.0, 0.25 * math.log(((r["t"] + 0.5) / toxic) / ((r["c"] + 0.5) / clean)))
        if r["form"].endswith("*"):
            # the beginning of a word that is an entry itself says nothing new
            if not any(w.startswith(r["form"][:-1]) for w in words):
                stems[r["form"][:-1]] = weight
        elif words.get(r["form"], (INSULT,))[0] in (INSULT, THREAT):
            learnt[r["form"]] = (INSULT, weight)
    # an entry that a shorter beginning already covers says nothing new
    short = {s: w for s, w in stems.items() if not any(s[:k] in stems for k in STEMS if k < len(s))}
    grammar = Grammar(words | {w: x for w, x in learnt.items() if not any(w[:k] in short for k in STEMS)}, short)
    featured = rows.mapInArrow(_features(grammar), "x double, label int").collect()
    x, y = np.array([r["x"] for r in featured]), np.array([r["label"] for r in featured], dtype=float)
    grammar.bias, grammar.slope = logistic(x, y)
    return grammar


def _features(grammar: Grammar):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([grammar.feature(t) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([x, batch.column("label")], names=["x", "label"])

    return each


def scored(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, score, clauses)."""
    kind = dict(docs.dtypes)["doc_id"]
    item = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(grammar.clauses(t)) for t in batch.column("text").to_pylist()]
            total = [math.log1p(math.fsum(w for _, _, w in f)) for f in found]
            scores = [1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, grammar.bias + grammar.slope * x)))) for x in total]
            clauses = pa.array([[{"start": a, "end": b, "weight": w} for a, b, w in f] for f in found], item)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), clauses], names=["doc_id", "score", "clauses"])

    schema = f"doc_id {kind}, score double, clauses array<struct<start: long, end: long, weight: double>>"
    return docs.select("doc_id", "text").mapInArrow(each, schema)


def scores(text, grammar: Grammar):
    """Column of scores of a text column."""
    @F.pandas_udf("double")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([grammar.score(t) for t in texts], dtype="float64")

    return each(text)
