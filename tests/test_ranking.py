"""Distributed ranks, numbers and medians against plain Python."""

import statistics

import pytest
from pyspark.sql import functions as F

from statspine.operators import ranking as R


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key; some keys are missing."""
    return spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 101 == 0, None).otherwise(F.col("id") * 37 % 500).alias("v"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 5).cast("string"))).alias("g"),
    )


@pytest.mark.parametrize("by", ["v", "-v"])
def test_global_rank(spark, skewed, by):
    got = {r.id: r["rank"] for r in R.global_rank(skewed, by).collect()}
    rows = skewed.collect()
    sign = -1 if by.startswith("-") else 1
    key = lambda r: (r.v is None, 0 if r.v is None else sign * r.v)
    ordered = sorted(rows, key=key)
    expected, seen = {}, {}
    for i, r in enumerate(ordered, 1):
        expected[r.id] = seen.setdefault(key(r), i)
    assert got == expected


def test_row_number_spreads_copies(spark, skewed, monkeypatch):
    monkeypatch.setattr(R, "COPY_CHUNK", 100)
    df = skewed.select("v", "g")
    got = [(r.n, r.v, r.g) for r in R.global_row_number(df, ["-g", "v"], "n").orderBy("n").collect()]
    assert [n for n, *_ in got] == list(range(1, 3001))
    expected = sorted(((r.v, r.g) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    expected.sort(key=lambda r: r[1], reverse=True)
    assert [(v, g) for _, v, g in got] == expected


def test_row_number_of_nothing(spark, skewed):
    assert R.global_row_number(skewed.where("false"), ["id"]).count() == 0


def test_median_is_exact(spark, skewed):
    got = {r.g: r.m for r in R.grouped_median(skewed, ["g"], "v", "m").collect()}
    groups = {}
    for r in skewed.collect():
        if r.v is not None:
            groups.setdefault(r.g, []).append(r.v)
    assert got == {g: float(statistics.median(v)) for g, v in groups.items()}


def test_median_groups_with_missing_key(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 4.0), ("a", 2.0), ("b", None)], "g string, v double")
    assert {r.g: r.m for r in R.grouped_median(df, ["g"], "v", "m").collect()} == {None: 2.5, "a": 2.0}


@pytest.mark.parametrize("intervals, counted, groups", [(1024, 50_000, 50_000), (4, 3, 50_000), (2, 0, 50_000), (16, 10, 0)])
def test_median_by_selection(spark, monkeypatch, intervals, counted, groups):
    import random

    monkeypatch.setattr(R, "INTERVALS", intervals)
    monkeypatch.setattr(R, "COUNTED", counted)
    monkeypatch.setattr(R, "GROUPS", groups)
    rng = random.Random(intervals)
    values = {
        "even": [1.0, 2.0, 3.0, 4.0], "odd": [5.0, 1.0, 9.0], "one": [7.5], "two": [1.0, 2.0], "same": [3.0] * 50,
        "hot": [rng.choice([1.0, 1.0, 1.0, 2.0]) for _ in range(400)], "far": [1e300, -1e300, 0.0, 1e-300, 5e-324, 1.0],
        "tail": [10.0**k for k in range(40)], "many": [rng.gauss(0, 1) for _ in range(999)], None: [rng.random() for _ in range(64)],
    }
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("even", None), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    assert {r.g: r.m for r in R.grouped_median(df, ["g"], "v", "m").collect()} == {g: statistics.median(v) for g, v in values.items()}


def test_median_of_values_without_a_span(spark):
    rows = [("nan", float("nan")), ("nan", 1.0), ("nan", 2.0), ("inf", float("inf")), ("inf", 1.0), ("inf", -float("inf")), ("wide", 1.7e308), ("wide", -1.7e308), ("wide", 2.0)]
    got = {r.g: r.m for r in R.grouped_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", "m").collect()}
    assert got == {"nan": 2.0, "inf": 1.0, "wide": 2.0}
    assert R.grouped_median(spark.createDataFrame([], "g string, v double"), ["g"], "v", "m").count() == 0


def test_selection_moves_no_values(spark, skewed):
    """Every exchange above the written values is one of counts by interval or value."""
    plan = R.grouped_median(skewed, ["g"], "v", "m")._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    below = [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert below and all("HashAggregate" in line for line in below)


def test_top_k_per_group(spark, skewed):
    got = R.top_k_per_group(skewed, ["g"], [F.col("id").desc()], 2)
    assert got.count() == 12 and got.where("row_number = 1").agg(F.max("id")).first()[0] == 2999


def test_slices_of_rows_that_differ_in_a_map(spark, monkeypatch):
    from statspine.operators import aggregates as A

    rows = [("k", {"a": str(i * 7 % 20)}, "t") for i in range(20)] + [("j", None, "t"), ("k", None, "t")]
    df = spark.createDataFrame(rows, "k string, m map<string,string>, t string").repartition(4)
    near = [A.limit_offset(df, ["k"], 3, at).collect() for at in range(0, 22, 3)]
    monkeypatch.setattr(A, "NEAR_ROWS", 0)
    assert [A.limit_offset(df, ["k"], 3, at).collect() for at in range(0, 22, 3)] == near
    assert sum(map(len, near)) == 22
