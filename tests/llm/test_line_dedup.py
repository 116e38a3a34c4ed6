"""Line dedup against all pairs of lines."""

import random

import pytest

from statspine.llm import line_dedup


def grams(line):
    w = line.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else None


def brute(rows):
    """Cleaned texts by every pair, for rows (id, text) with distinct ids."""
    lines = [(d, k, grams(v)) for d, t in rows if t is not None for k, v in enumerate(t.split("\n"))]
    lines = sorted((x for x in lines if x[2]), key=lambda x: (x[0] is None, x[0], x[1]))
    gone = set()
    for i, (d, k, own) in enumerate(lines):
        for _, _, other in lines[:i]:
            if len(own & other) * 1800 >= (len(own) + len(other)) * 800:
                gone.add((d, k))
                break
    return {d: None if t is None else "\n".join(v for k, v in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in rows}


def varied(rng, base):
    w = base.split(" ")
    for _ in range(rng.randrange(0, 4)):
        at = rng.randrange(len(w))
        if rng.random() < 0.5:
            w[at] = rng.choice("red green blue white".split())
        else:
            w[at : at + 1] = []
    return " ".join(w)


@pytest.mark.parametrize("seed", range(3))
def test_matches_all_pairs(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(60 if seed else 9)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(3, 60))) for _ in range(12)]
    rows = [(i * 13 % 97, "\n".join(varied(rng, rng.choice(base)) for _ in range(rng.randint(1, 5)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.clean(docs).collect()}
    assert got == brute(rows)


def test_edges(spark):
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    one = "the same five words here"
    rows = [
        (3, one, "a"), (1, one + "\nshort\n" + one, "b"), (2, None, None), (4, "", "c"), (5, "short\nshort", "d"),
        (None, "THE SAME  five words here\nand a line that is its own", "e"), (6, long, "f"), (7, long + "\nlast", "g"), (8, "a b c d\ne f", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    out = line_dedup.clean(docs)
    assert out.columns == ["doc_id", "text", "key", "n_lines", "n_removed"]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in out.collect()}
    assert got[None] == ("and a line that is its own", 2, 1)
    assert got[1] == (one + "\nshort", 3, 1) and got[3] == ("", 1, 1)
    assert got[2] == (None, 0, 0) and got[4] == ("", 1, 0) and got[5] == ("", 2, 2)
    assert got[6] == (long, 1, 0) and got[7] == ("last", 2, 1) and got[8] == ("a b c d\ne f", 2, 0)


def test_repeated_rows_are_one_document(spark):
    text = "a line with more than five words\nanother line with more than five words in it"
    docs = spark.createDataFrame([(1, text)] * 3 + [(2, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in line_dedup.clean(docs).collect())
    assert got == [(1, text)] * 3 + [(2, "")]


def test_large_group_of_near_copies_stays_linear(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:30] + [f"x{i}"] + words[30:])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert line_dedup.clean(docs).where("text <> ''").count() == 1


def test_lines_alike_but_below_the_similarity_leave_few_pairs(spark, monkeypatch):
    made = []
    verified = line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda sets, pairs, *more: made.append(pairs.count()) or verified(sets, pairs, *more))
    rng = random.Random(3)
    rows = []
    for i in range(120):
        words = [f"w{k}" for k in range(80)]
        for at in rng.sample(range(80), 3):
            # words as frequent as the others, so that rarity does not part the lines
            words[at] = f"w{rng.randrange(80)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, rows[i][1] + " more") for i in range(40, 50)]
    got = {r.doc_id: r.text for r in line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    # 120 lines have 7140 pairs
    tried, rest = made
    assert rest < 700, made


def test_lines_that_share_a_rare_part_leave_few_pairs(spark, monkeypatch):
    made = []
    verified = line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda sets, pairs, *more: made.append(pairs.count()) or verified(sets, pairs, *more))
    rng = random.Random(11)
    part = " ".join(f"rare{k}" for k in range(25))
    rows = [(i, part + " " + " ".join(rng.choices([f"w{k}" for k in range(15)], k=35))) for i in range(150)]
    rows += [(200 + i, rows[i][1] + " more") for i in range(20)]
    got = {r.doc_id: r.text for r in line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and list(got.values()).count("") == 20
    # every line meets the nine before it and the first, but few of these are near
    assert made[0] < 60, made


def test_signatures_never_exclude_a_match(spark):
    rng = random.Random(5)
    words = [f"v{i}" for i in range(300)]
    rows = []
    for i in range(60):
        own = rng.sample(words, rng.randint(1, 120))
        like = [w for w in own if rng.random() > 0.08] + rng.sample(words, rng.randint(0, 4))
        rows.append((i, sorted({hash(w) % (1 << 62) for w in own}), sorted({hash(w) % (1 << 62) for w in like})))
    pairs = spark.createDataFrame(rows, "i int, a array<long>, b array<long>")
    F = line_dedup.F
    signed = pairs.select("a", "b", line_dedup.signature(F.col("a")).alias("p"), line_dedup.signature(F.col("b")).alias("q"))
    signed = signed.select(
        "a", "b", *(F.col(f"p.{c}").alias(f"x_{c}") for c in line_dedup.SIGNS), *(F.col(f"q.{c}").alias(f"y_{c}") for c in line_dedup.SIGNS),
        line_dedup.packed(F.size("a"), F.lit(0)).alias("x_at"), line_dedup.packed(F.size("b"), F.lit(0)).alias("y_at"),
    )
    found = signed.select("a", "b", line_dedup.near_signs("x", "y", 0.8).alias("near")).collect()
    alike = [r.near for r in found if len({*r.a} & {*r.b}) * 1800 >= (len(r.a) + len(r.b)) * 800]
    assert len(alike) > 10 and all(alike)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "small_enough", lambda *_: False)
    rng = random.Random(9)
    base = [" ".join(rng.choices("abcdefgh", k=rng.randint(3, 20))) for _ in range(8)]
    rows = [(i, "\n".join(varied(rng, rng.choice(base)) for _ in range(4))) for i in range(40)]
    got = {r.doc_id: r.text for r in line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_a_document_of_many_equal_lines(spark):
    import time

    def seconds(n):
        docs = spark.createDataFrame([(1, "the same line again and again\n" * n)], "doc_id long, text string")
        start = time.perf_counter()
        assert line_dedup.clean(docs).first().n_removed == n - 1
        return time.perf_counter() - start

    seconds(100)
    assert seconds(100_000) < 60


def test_empty(spark):
    assert line_dedup.clean(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_lines_and_white_space(spark):
    rng = random.Random(4)
    base = ["All rights reserved.", "a", "a b", "b a", "", "  ", "one two\tthree four five six", "one two three four", "a b c d e", "x\u00a0y\r"]
    base += [" ".join(rng.choices("pqrs", k=n)) for n in (3, 4, 5, 12)] + ["\t".join(f"w{i}" for i in range(30))]
    rows = [(i * 7 % 61, "\n".join(rng.choice(base).replace(" ", rng.choice([" ", "\t", "  "])) for _ in range(rng.randint(1, 5)))) for i in range(60)]
    seen, expected = [], {}
    for d, t in sorted(rows):
        kept = []
        for line in t.split("\n"):
            own = grams(line)
            if own is None or not any(len(own & x) * 1800 >= (len(own) + len(x)) * 800 for x in seen):
                kept.append(line)
            if own is not None:
                seen.append(own)
        expected[d] = "\n".join(kept)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.clean(docs).collect()} == expected


def test_pipeline_removes_short_repeats(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"own {i}\nAll rights\treserved.\n\nown {i}") for i in range(3)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert got == {0: "own 0\nAll rights\treserved.\n", 1: "own 1\n", 2: "own 2\n"}
