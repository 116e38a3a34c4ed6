"""NN-descent against brute force."""


import numpy as np
import pytest

from statspine.llm import nn_descent as N

SCHEMA = "vec_id long, embedding array<float>, label int, id string"


def brute(rows, threshold=N.THRESHOLD):
    """(vec_id, links, component) of each row by all pairs."""
    unit = []
    for _, e, label, _ in rows:
        bad = label is None or not e or any(x is None or not np.isfinite(np.float32(x)) for x in e) or not any(e)
        v = None if bad else np.array(e, dtype=np.float32).astype(np.float64)
        unit.append(None if bad else v / np.linalg.norm(v))
    n = len(rows)
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    seen, comp = {}, [None] * n
    for i in range(n):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen[x] = i
                todo += near[x]
    for root in set(seen.values()):
        own = [i for i in range(n) if seen[i] == root]
        least = min((rows[i][0] for i in own if rows[i][0] is not None), default=None)
        for i in own:
            comp[i] = least
    return sorted(((rows[i][0], len(near[i]), comp[i]) for i in range(n)), key=str)


def cloud(seed, dense):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(250):
        rows.append(rng.normal(size=16))
    for centre in rng.normal(size=(25, 16)):
        rows += [centre + rng.normal(size=16) * 0.02 for _ in range(rng.integers(2, 6))]
    centre = rng.normal(size=16)
    rows += [centre + rng.normal(size=16) * 0.03 for _ in range(dense)]
    rng.shuffle(rows)
    return [(i * 3 % 1009, v.astype(np.float32).tolist(), i % 2, "x") for i, v in enumerate(rows)]


@pytest.mark.parametrize("seed,dense", [(0, 0), (1, 90)])
def test_links_and_components(spark, monkeypatch, seed, dense):
    monkeypatch.setattr(N, "TILE", 16)
    rows = cloud(seed, dense)
    out, recall = N.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in out.collect()), key=str)
    assert recall >= 0.98
    expected = brute(rows)
    assert sum(g == e for g, e in zip(got, expected)) >= 0.99 * len(rows)
    found, true = sum(g[1] for g in got), sum(e[1] for e in expected)
    assert found >= 0.98 * true and all(g[1] <= e[1] for g, e in zip(got, expected))


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    e = [1.0, 2.0, 3.0]
    rows = [
        (1, e, 0, "a"), (2, e, 0, "a"), (3, [2.0, 4.0, 6.0], 0, "a"), (4, e, 1, "a"), (5, e, None, "a"), (6, None, 0, "a"), (7, [], 0, "a"),
        (8, [0.0, 0.0, 0.0], 0, "a"), (9, [1.0, None, 3.0], 0, "a"), (10, [1.0, nan, 3.0], 0, "a"), (11, [1.0, inf, 3.0], 0, "a"),
        (2, e, 0, "a"), (None, [9.0, -1.0, 0.0], 0, "a"), (12, [1.0, 2.0], 0, "a"), (13, [1e30, 2e30, 3e30], 0, "a"),
    ]
    out, _ = N.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out.collect()), key=str) == brute(rows)


def test_many_equal_vectors_are_one_point(spark):
    rows = [(i, [1.0, 0.5], 0, "x") for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert N.points(df).count() == 1
    assert {(r.n_links, r.component_id) for r in N.near_duplicates(df)[0].collect()} == {(499, 0)}


def test_empty(spark):
    out, recall = N.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and recall == 1.0




def by_id(rows):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in rows), key=str)


def test_groups_that_fail_their_audit_are_compared_as_a_whole(spark, monkeypatch):
    """A search that sees next to nothing: links are rare, so that an audit by hash alone meets none."""
    for name, value in (("LIST", 2), ("ORDERS", 1), ("REACH", 1), ("JOINED", 1), ("ROUNDS", 1), ("AUDITS", 2), ("BLOCK", 64), ("AUDITED", 10)):
        monkeypatch.setattr(N, name, value, raising=False)
    rng = np.random.default_rng(5)
    vectors = list(rng.normal(size=(500, 24)))
    for centre in rng.normal(size=(12, 24)):
        vectors += [centre + rng.normal(size=24) * 0.09 for _ in range(3)]
    rows = [(i, v.astype(np.float32).tolist(), i % 2, "x") for i, v in enumerate(vectors)]
    expected = brute(rows)
    assert any(e[1] for e in expected)
    assert by_id(N.near_duplicates(spark.createDataFrame(rows, SCHEMA))[0].collect()) == expected


def test_audit_asks_every_label_near_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(N, "AUDITED", 8)
    own = spark.createDataFrame([(g, g * 1000 + i, 1000) for g in range(3) for i in range(1000)], "gid long, id long, many long")
    lists = spark.createDataFrame([(g * 1000 + i, -1, 0.97 if i < 10 else 0.3) for g in range(3) for i in range(1000)], "u long, v long, cos double")
    got = [r.id for r in N.asked(own, lists, 0.98).collect()]
    for g in range(3):
        assert {g * 1000 + i for i in range(10)} <= set(got) and 30 < sum(x // 1000 == g for x in got) < 130
    sizes = []
    for n in (10_000, 40_000):
        many = spark.range(n).selectExpr("0L AS gid", "id", f"{n}L AS many")
        sizes.append(N.asked(many, lists.limit(0), 0.98).count())
    assert 1.5 < sizes[1] / sizes[0] < 2.5


def test_few_links_met_do_not_settle_a_group(spark):
    """One link between 3000 vectors: no sample can tell, so every vector is compared."""
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(3000, 32)).astype(np.float32)
    vectors[2999] = vectors[0] + rng.normal(size=32).astype(np.float32) * 0.1
    own = N.points(spark.createDataFrame([(i, v.tolist(), 0, "x") for i, v in enumerate(vectors)], SCHEMA))
    lists, recall, failed = N.search(own)
    assert failed.count() == 3000 and lists.count() == 0


def test_every_turn_draws_other_members_and_longer_lists_draw_more(spark):
    lists = spark.createDataFrame([(0, i, 0.5, True) for i in range(1, 201)], "u long, v long, cos double, new boolean")
    at = lambda length, turn: {r.id for r in N.drawn(lists, length, turn).where("at = 0").collect()}
    first = at(N.LIST, 0)
    assert len(first) == 2 * N.JOINED and at(N.LIST, 1) != first
    assert len(at(4 * N.LIST, 0)) == 8 * N.JOINED
    kept = N.after_join(lists, N.drawn(lists, N.LIST, 0)).collect()
    assert {r.v for r in kept if not r.new} == first and len(kept) == 200
