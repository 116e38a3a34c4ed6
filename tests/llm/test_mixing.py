"""Temperature mixing: exponent, budgets, blocks."""

import math

import pytest

from statspine.llm import mixing


def test_exponent_meets_repetition_limit():
    sizes = {"a": 1000, "b": 100, "c": 10}
    mix = mixing.solve(sizes, repeats=2.0)
    assert max(mix.passes.values()) == pytest.approx(2.0) and min(mix.passes.values()) == 1.0
    assert sum(mix.weights.values()) == pytest.approx(1.0)
    drawn = {k: mix.passes[k] * n for k, n in sizes.items()}
    assert all(drawn[k] / sum(drawn.values()) == pytest.approx(mix.weights[k]) for k in sizes)


def test_exponent_meets_entropy():
    sizes = {"a": 900, "b": 90, None: 10}
    low = -sum(n / 1000 * math.log(n / 1000) for n in sizes.values())
    for target in (low + 0.1, 0.8, 1.0):
        mix = mixing.solve(sizes, entropy=target)
        assert -sum(w * math.log(w) for w in mix.weights.values()) == pytest.approx(target, abs=1e-6)
    assert mixing.solve(sizes, entropy=5.0).exponent == 0.0


def test_without_limits_sources_are_even():
    mix = mixing.solve({"a": 8, "b": 2}, repeats=None)
    assert mix.weights == pytest.approx({"a": 0.5, "b": 0.5}) and mix.passes == pytest.approx({"a": 1, "b": 4})


def test_no_tokens():
    assert mixing.solve({}).weights == {}
    assert mixing.solve({"a": 0}).passes == {"a": 1.0}
    assert mixing.solve({"a": 0, "b": 5}).passes == {"a": 1.0, "b": 1.0}


def corpus(spark):
    rows = [(i, "w " * (1 + i % 7), "big", i) for i in range(600)] + [(1000 + i, "w " * 5, "small", i) for i in range(90)]
    rows += [(2000 + i, "x y z", None, i) for i in range(40)] + [(3000, None, "void", 0), (3001, "", "small", 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, weight int")


def test_rows_follow_the_mix(spark):
    rows, docs = corpus(spark)
    out = mixing.mixed(docs, repeats=1.6, block=100)
    assert out.columns == [*docs.columns, "_mix"]
    got = out.collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    mix = mixing.solve(sizes, repeats=1.6)
    for source, size in sizes.items():
        drawn = sum(r._mix.tokens for r in got if r.source == source)
        assert abs(drawn - mix.passes[source] * size) <= 8  # within a document of its budget
        assert all(r._mix["pass"] in (0, 1) for r in got)
    again = mixing.mixed(docs, repeats=1.6, block=100).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_blocks_are_whole_but_one(spark):
    _, docs = corpus(spark)
    got = mixing.mixed(docs, repeats=1.5, block=20).where("source = 'small'").collect()
    by = {}
    for r in got:
        by.setdefault(r._mix.block, []).append(r._mix["pass"])
    part = [b for b, passes in by.items() if 0 < sum(passes) < len(passes) - sum(passes)]
    assert len(part) <= 1


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "s")] * 3 + [(2, "c d", "t")], "doc_id long, text string, source string")
    assert sum(r.doc_id == 1 for r in mixing.mixed(docs).collect()) >= 3


def test_empty(spark):
    assert mixing.mixed(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_every_pass_is_a_permutation_of_its_own(spark):
    rows, docs = corpus(spark)
    got = mixing.mixed(docs, repeats=2.6, block=100).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs, repeats=2.6, block=100).collect()))
    by = {}
    for r in got:
        by.setdefault((r.source, r._mix["pass"]), []).append((r._mix.place, r._mix.block, r.doc_id))
    for rows_ in by.values():
        assert sorted(p for p, _, _ in rows_) == list(range(len(rows_)))
        blocks = [b for _, b, _ in sorted(rows_)]
        assert sum(x != y for x, y in zip(blocks, blocks[1:])) == len(set(blocks)) - 1  # a block comes in one piece
    first, second = ([d for _, _, d in sorted(by["small", k])] for k in (0, 1))
    again = set(second)
    assert len(again) > 10 and [d for d in first if d in again] != second and first != sorted(first)
    other = mixing.mixed(docs, repeats=2.6, block=100, seed=1).where("source = 'small' AND _mix.pass = 0").collect()
    assert [r.doc_id for r in sorted(other, key=lambda r: r._mix.place)] != first


def test_entropy_below_the_corpus_needs_an_exponent_above_one():
    sizes = {"a": 900, "b": 90, None: 10}
    own = -sum(n / 1000 * math.log(n / 1000) for n in sizes.values())
    mix = mixing.solve(sizes, entropy=own / 2)
    assert mix.exponent > 1 and min(mix.passes.values()) == pytest.approx(1.0)
    assert -sum(w * math.log(w) for w in mix.weights.values()) == pytest.approx(own / 2, abs=1e-6)
    with pytest.raises(ValueError):
        mixing.solve({"a": 5, "b": 5, "c": 1}, entropy=0.5)
    assert mixing.solve({"a": 5}, entropy=0.0).passes == {"a": 1.0}
