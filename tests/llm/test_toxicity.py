"""Toxicity grammar: transducers, scope, learning, held-out accuracy."""

import random

import pytest

from statspine.llm import toxicity as T
from statspine.llm.common import held_out


def weight(text, **more):
    return sum(w for _, _, w in T.Grammar(T.base_words(), **more).clauses(text))


def test_clauses_not_words():
    assert weight("nothing here") == 0 and weight("") == 0 and weight(None) == 0
    plain, aimed = weight("an idiot"), weight("you are an idiot")
    assert aimed > plain > 0
    assert weight("you are not an idiot") < aimed and weight("he said idiot") < weight("he idiot")
    assert weight("never. an idiot") == plain  # a negation ends with its clause
    assert weight("not one two three four idiot") == plain  # and reaches over three words
    assert weight("idiotic") == 0 and weight("xidiot") == 0
    assert weight("IDIOT, you moron!") > aimed


def test_learnt_beginnings():
    assert weight("das ist loweischaft", stems={"lowei": 1.0}) == 1.0
    assert weight("glowei", stems={"lowei": 1.0}) == 0


def test_composition_is_the_product():
    states, table = T.compose()
    assert len(states) == 3 * 2 * 2 * 4 * 4 and all(0 <= s < len(states) for row in table for s in row)
    start = table[0][T.NEGATION]
    assert states[start][3] == T.SCOPE and states[table[start][T.NONE]][3] == T.SCOPE - 1


def test_clauses_by_the_machines_side_by_side():
    """Scores of random clauses from the five transducers run one beside the other, without their product."""
    rng = random.Random(8)
    grammar = T.Grammar(T.base_words(), {"vexor": 0.7})
    pool = "idiot moron kill beat you they not never said quoted vexorus plain word and so".split()
    for _ in range(2000):
        words = [rng.choice(pool) for _ in range(rng.randrange(1, 14))]
        states, total = [0] * len(T.PARTS), 0.0
        for word in words:
            kind, weight = grammar.classify(word)
            if kind in (T.INSULT, T.THREAT):
                total += weight * (0.5 if states[3] else 1) * (0.5 if states[4] else 1)
            states = [p.next(s, kind) for p, s in zip(T.PARTS, states)]
        total *= 1 + (0.5 if states[2] else 0) + (0.25 if states[0] == 2 else 0)
        assert grammar.clause(words) == pytest.approx(total, abs=0)


def test_contractions_negate():
    whole, not_ = weight("you are an idiot"), weight("you are not an idiot")
    assert not_ < whole
    for text in ("you arent an idiot", "you aren't an idiot", "you aren\u2019t an idiot"):
        assert weight(text) == not_
    assert weight("l'idiot") == weight("l idiot") > 0 and weight("you're an idiot") == weight("you re an idiot")


def test_time_follows_the_clauses():
    import time

    grammar = T.Grammar(T.base_words())

    def seconds(n):
        text = "you idiot, " * 3 + "you moron. " * n
        start = time.perf_counter()
        assert len(list(grammar.clauses(text))) >= n
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(80_000) < 24 * max(seconds(10_000), 0.02)


def corpus(spark, n=400):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["vexor" + rng.choice(["a", "us", "en"]), "moron"])
        docs.append((i, " ".join(words) + ".", "x", 0.5))
        labels.append((i, None, int(toxic)))
    docs += [(n, None, "x", 0.5), (n + 1, "", "x", 0.5), (n + 2, "word " * 50_000, "x", 0.5), (0, docs[0][1], "x", 0.5), (None, "moron", "x", 0.5)]
    labels += [(n, 1, None), (n + 1, 1, 0), (n + 50, 1, 1), (None, 1, 1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, label string, score double"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    grammar = T.learn(docs, labels)
    assert any("vexor".startswith(s) for s in grammar.stems)
    out = T.scored(docs, grammar).withColumn("held", held_out()).collect()
    assert len(out) == docs.count()
    scores = {r.doc_id: r.score for r in out}
    tested = [r for r in out if r.held and r.doc_id is not None and r.doc_id < 400]
    assert len(tested) > 50
    assert all((r.score >= T.THRESHOLD) == (r.doc_id % 4 == 0) for r in tested)
    assert scores[400] == scores[401] == scores[402] < T.THRESHOLD


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = corpus(spark)
    flipped = labels.withColumn("toxic", held_out().cast("int") * (1 - labels.toxic) + (1 - held_out().cast("int")) * labels.toxic)
    one, other = T.learn(docs, labels), T.learn(docs, flipped)
    assert (one.stems, one.bias, one.slope) == (other.stems, other.bias, other.slope)


def test_column_agrees(spark):
    docs, labels = corpus(spark, 40)
    grammar = T.Grammar(T.base_words())
    by_row = sorted(r.score for r in T.scored(docs, grammar).collect())
    assert by_row == pytest.approx(sorted(r.s for r in docs.select(T.scores(docs.text, grammar).alias("s")).collect()))


def test_no_labels_and_empty(spark):
    docs, labels = corpus(spark, 20)
    grammar = T.learn(docs, labels.limit(0))
    assert grammar.stems == {}
    assert T.scored(docs.limit(0), grammar).count() == 0
