"""Source divergence against counts made one by one, and the tree against all pairs of its rows."""

import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from statspine.llm import divergence as D
from statspine.llm import queries
from tests.conftest import SF_DIR
from tests.test_queries import canonical

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
DOCS = "text string, lang string, source string"


def brute(rows, least):
    docs = [((t or "").translate(UPPER), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {d[1] for d in docs}:
        own = [(TERM.findall(t), s) for t, x, s in docs if x == lang]
        met = Counter(w for ws, _ in own for w in set(ws))
        kept = [w for w in met if met[w] >= least]
        counts = {s: Counter() for _, s in own}
        for ws, s in own:
            counts[s].update(w for w in ws if met[w] >= least)
        whole = sum(counts.values(), Counter())
        p = lambda c, w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept))
        for s, c in counts.items():
            pairs = [(o, sum(abs(p(c, w) - p(x, w)) for w in kept)) for o, x in counts.items() if o != s]
            terms = [(w, p(c, w) - p(whole, w)) for w in kept if c[w] and p(c, w) > p(whole, w)]
            for part, found, most in (("pair", pairs, None), ("term", terms, 50)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def check(spark, monkeypatch, rows, least, schema=DOCS):
    monkeypatch.setattr(D, "DOCUMENTS", least)
    got = D.audit(spark.createDataFrame(rows, schema))
    assert [f"{n} {k}" for n, k in got.dtypes] == ["lang string", "source string", "part string", "item string", "value bigint", "rank int"]
    assert sorted(map(tuple, got.collect())) == brute([r[:3] for r in rows], least)


@pytest.mark.parametrize("seed", range(3))
def test_against_counts(spark, monkeypatch, seed):
    rng = random.Random(seed)
    words = [f"w{c}" for c in "abcdefghij"] + ["Été", "été", "Straße", "x1y", "don't", "ÀB", "日本", "a b"]
    rows = []
    for _ in range(150):
        source = rng.choice(["s", "s", "s", "t", "u", "v", "é"])
        pool = words[: rng.randrange(3, len(words) + 1)] if source != "t" else words[-6:]
        rows.append((" ".join(rng.choices(pool, k=rng.randrange(40))), rng.choice(["en", "fr"]), source))
    check(spark, monkeypatch, rows, 30 if seed else 3)


def test_nulls_ties_and_groups_without_terms(spark, monkeypatch):
    rows = [(None, None, None), ("", "en", "empty"), ("rare", "en", None), ("a a b", "en", "x"), ("b b a", "en", "y"), ("b b a", "en", "y")]
    rows += [("c", "fr", "one"), ("c c", "de", "z"), ("c", "de", "w"), ("1 2 3", "de", "v")]
    check(spark, monkeypatch, [(*r, 7, "t", 1) for r in rows], 2, DOCS + ", n int, term string, s int")


def test_a_language_that_keeps_nothing(spark, monkeypatch):
    check(spark, monkeypatch, [(f"word{chr(97 + i)}", "en", f"s{i}") for i in range(5)], 2)


def test_long_texts_are_taken_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 50)
    text = "alpha Beta été " * 40 + "x" * 300 + " alpha"
    assert [t for ts in D.pieces(text.encode()) for t in ts] == [t.encode() for t in TERM.findall(text.translate(UPPER))]
    batch = pa.RecordBatch.from_pylist([{"lang": "en", "source": "s", "text": text}] * 2)
    out = {r["term"]: (r["n"], r["docs"]) for b in D.count_terms(iter([batch])) for r in b.to_pylist()}
    assert out["alpha"] == (82, 2) and out["été"] == (80, 2) and out["x" * 300] == (2, 2)


def test_counts_that_are_passed_on_early(monkeypatch):
    monkeypatch.setattr(D, "HELD", 8)
    rows = [{"lang": "en", "source": "st"[k % 2], "text": f"a b {chr(97 + k % 26)}x"} for k in range(60)]
    out = Counter()
    for b in D.count_terms(iter([pa.RecordBatch.from_pylist(rows)])):
        for r in b.to_pylist():
            out[r["source"], r["term"]] += r["n"]
    assert out["s", "a"] == 30 and out["t", "b"] == 30 and sum(out.values()) == 180


@pytest.mark.parametrize("held", [1, 1 << 18])
def test_tree_against_all_pairs(monkeypatch, held):
    monkeypatch.setattr(D, "HELD", held)
    rng = random.Random(1)
    rows = Counter()
    for _ in range(400):
        row = tuple((s, n, 10 * n + s, s) for s in range(1, 7) if (n := rng.randrange(3)))
        if row:
            rows["xy"[rng.randrange(2)], row] += rng.randrange(1, 4)
    want = Counter()
    for (lang, row), m in rows.items():
        for j, (b, _, pb, zb) in enumerate(row):
            for a, _, p, z in row[:j]:
                want[lang, a, b] += m * (abs(p - pb) - abs(p - zb) - abs(pb - z) + abs(z - zb))
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("s", "n", "p", "zero")]))
    lists = [[dict(zip(("s", "n", "p", "zero"), i)) for i in row] for (_, row) in sorted(rows)]
    table = pa.table({"lang": [k[0] for k in sorted(rows)], "path": pa.array(lists, kind), "m": [rows[k] for k in sorted(rows)]})
    got = Counter()
    for b in D.corrections(iter(table.to_batches(max_chunksize=37))):
        for r in b.to_pylist():
            got[r["lang"], r["a"], r["b"]] += r["x"]
    assert +got == +want and got.keys() <= want.keys()


def test_shared_paths_are_corrected_once():
    walk = D.Walk()
    seen = []
    leave = walk.leave
    walk.leave = lambda depth: (seen.extend([len(walk.path) - depth] if len(walk.path) > depth else []), leave(depth))
    for row in ([(1, 1, 9, 2), (2, 1, 7, 3)], [(1, 1, 9, 2), (2, 2, 8, 3)], [(1, 1, 9, 2), (2, 2, 8, 3), (3, 1, 5, 1)]):
        walk.insert(row, 10)
    walk.leave(0)
    # nodes left: the first row's leaf, then the whole last path
    assert sum(seen) == 4


def test_large_groups_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(D, "small_enough", lambda *_: False)
    rows = [(f"a b{chr(97 + i % 4)} c{chr(97 + i % 3)} a", "en", f"s{i % 5}") for i in range(60)]
    check(spark, monkeypatch, rows, 4)


def test_empty(spark):
    assert D.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    got = queries.QUERIES["op11_source_divergence"](spark, SF_DIR)
    found = con.execute(queries.SQL["op11_source_divergence"])
    rows = canonical(got.columns, got.collect())
    assert rows == canonical([c[0] for c in found.description], found.fetchall()) and len(rows) > 50
