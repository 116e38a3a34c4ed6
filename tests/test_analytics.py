"""Literal stars with known answers."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from statspine import model
from statspine.operators import aggregates as A
from statspine.operators import analytics as D
from statspine.operators import predicates as P
from tests.stars import star

META = [("D1", "One", "popolazione", 10), ("D2", "Two", "popolazione", 5), ("D3", "Empty", None, 1)]


def test_territory_comparison_ranks_germany_first(spark):
    values = [("IT", 100), ("IT", 95), ("FR", 85), ("FR", 90), ("DE", 110), ("DE", 105)]
    s = star(spark, [("D1", 2023, t, f"m{i % 2}", v) for i, (t, v) in enumerate(values)], META)
    got = [tuple(r) for r in D.territory_comparison_dataset(s, "D1", 2023).select("territory_code", "avg_value", "rank").collect()]
    assert got == [("DE", 107.5, 1), ("IT", 97.5, 2), ("FR", 87.5, 3)]


def test_gdp_series_in_order(spark):
    values = [1659516.7, 1785373.9, 1909154.2, 2010245.8]
    s = star(spark, [("D1", 2020 + i, "IT", "GDP", v) for i, v in enumerate(values)], META)
    got = [(r.year, float(r.obs_value)) for r in D.time_series(s, ["D1"], 2020, 2023).collect()]
    assert got == [(2020 + i, v) for i, v in enumerate(values)]
    assert D.time_series(s, ["D1"], 2021, 2022, ["FR"]).count() == 0


def test_category_trends_two_datasets_three_years(spark):
    observations = [(d, y, "IT", "M", y * 10 + n) for n, d in ((1, "D1"), (2, "D2")) for y in (2020, 2021, 2022)]
    got = D.category_trends(star(spark, observations, META), ["popolazione"], 2020, 2022).collect()
    assert [(r.year, r.dataset_count, r.total_observations, r.avg_value, r.median_value) for r in got] == [
        (2020, 2, 2, 20201.5, 20201.5), (2021, 2, 2, 20211.5, 20211.5), (2022, 2, 2, 20221.5, 20221.5),
    ]
    assert [r.prev_avg_value for r in got] == [None, 20201.5, 20211.5]
    assert [r.next_avg_value for r in got] == [20211.5, 20221.5, None]
    assert got[0].year_over_year_change is None and got[1].year_over_year_change == pytest.approx(10 / 20201.5 * 100)
    assert [r.moving_avg_3yr for r in got] == [None, None, 20211.5]
    simple = D.category_trends_simple(star(spark, observations, META), "popolazione", end_year=2021).collect()
    assert [r.year for r in simple] == [2020, 2021]


def test_summary_keeps_datasets_without_data(spark):
    observations = [("D1", 2020 + i % 5, f"T{i % 10}", f"M{i % 3}", i) for i in range(1000)]
    got = {r.dataset_id: r for r in D.dataset_summary(star(spark, observations, META)).collect()}
    assert (got["D1"].total_observations, got["D1"].territory_count) == (1000, 10)
    assert (got["D1"].min_year, got["D1"].max_year, got["D1"].min_value, got["D1"].max_value) == (2020, 2024, 0.0, 999.0)
    assert (got["D3"].total_observations, got["D3"].territory_count, got["D3"].avg_value) == (0, 0, None)
    first = D.dataset_summary(star(spark, observations, META)).first()
    assert first.dataset_id == "D1"


def test_missing_values_and_one_row_groups(spark):
    observations = [("D1", 2020, "IT", "M", 5), ("D1", 2020, "FR", "M", None), ("D1", 2020, None, "M", 7)]
    s = star(spark, observations, META)
    comparison = {r.territory_code: r for r in D.territory_comparison(s, ["M"], 2020).collect()}
    assert set(comparison) == {"IT", None} and comparison["IT"].std_dev is None
    totals = {r.territory_code: r for r in D.territory_aggregates(s).collect()}
    assert (totals["FR"].avg_value, totals["FR"].completeness_pct, totals["FR"].indicator_count) == (None, 0.0, 1)


def test_growth_ignores_previous_zero_and_one_sided_years(spark, rows):
    observations = [
        ("D1", 2022, "IT", "M", 100), ("D1", 2023, "IT", "M", 110), ("D1", 2022, "FR", "M", 0), ("D1", 2023, "FR", "M", 5),
        ("D1", 2023, "DE", "M", 5), ("D2", 2022, "IT", "M", 50), ("D2", 2022, "IT", "N", 150), ("D2", 2023, "IT", "M", 50),
    ]
    s = star(spark, observations, META)
    expected = [("D1", "IT", 110.0, 100.0, 10.0), ("D2", "IT", 50.0, 100.0, -50.0)]
    columns = ["dataset_id", "territory_code", "current_value", "previous_value", "growth_rate"]
    assert rows(D.growth_vs_previous_year(s, 2023), *columns) == expected
    assert rows(D.join_previous_year(D.yearly_values(s)), *columns) == expected


def test_quarterly_differences(spark):
    observations = [(y, q, 100 + (y - 2022) * 10 + q * 2.5) for y in (2022, 2023) for q in (1, 2, 3, 4)]
    df = spark.createDataFrame([("D1", y, q, v) for y, q, v in observations], "dataset_id string, year int, quarter int, v double")
    got = D.period_differences(df.withColumn("v", F.col("v").cast("decimal(20,6)")), ["dataset_id"], ["year", "quarter"], "v")
    changes = [r.change for r in got.orderBy("year", "quarter").collect()]
    assert changes == [None, 2.5, 2.5, 2.5, 2.5, 2.5, 2.5, 2.5]


def test_raw_series_value_or_flag(spark):
    attributes = {"territory_code": "IT", "measure_code": "M"}
    raw = spark.createDataFrame(
        [
            ("D", 1, None, "5.5", "2024", attributes),
            ("D", 2, None, "c", "2024-Q1", attributes),
            ("D", 3, None, "", "2023", {**attributes, "obs_status": "x"}),
            ("D", 4, None, "d", "2022", {**attributes, "obs_status": "x", "territory_code": "FR"}),
            ("E", 5, None, "1", "2024", None),
        ],
        "dataset_id string, record_id long, ingestion_timestamp timestamp, obs_value string, time_period string, "
        "additional_attributes map<string,string>",
    )
    got = [(r.record_id, r.year, r.obs_value, r.obs_status) for r in D.dataset_time_series(raw, "D").collect()]
    assert got == [(4, 2022, None, "x"), (3, 2023, None, "x"), (1, 2024, 5.5, None), (2, None, None, "c")]
    assert [r.record_id for r in D.dataset_time_series(raw, "D", territory_code="FR").collect()] == [4]
    # a period that is no year fails every year bound
    assert [r.record_id for r in D.dataset_time_series(raw, "D", start_year=2024).collect()] == [1]


def test_freshness(spark):
    as_of = datetime(2024, 1, 1, 12)
    df = spark.createDataFrame(
        [(1, datetime(2024, 1, 1, 11, 55, 1)), (2, datetime(2024, 1, 1, 11, 55)), (3, datetime(2024, 1, 1, 11, 30)), (4, None)],
        "id int, updated timestamp",
    )
    got = {r.id: (r.minutes_ago, r.status) for r in D.freshness_status(df, "updated", as_of).collect()}
    assert got == {1: (4, "fresh"), 2: (5, "recent"), 3: (30, "stale"), 4: (None, "unknown")}


def test_kpi_uses_the_last_two_periods(spark):
    observations = [("D1", y, "IT", "M", v) for y, v in ((2021, 100), (2022, None), (2023, 80), (2024, 120))]
    got = D.kpi_metrics(star(spark, observations, META), ["popolazione"], 2020, 2024).first()
    assert (got.latest, got.growth, got.avg, got.quality, got.points) == (120.0, 50.0, 100.0, 75.0, 4)


def test_territory_levels(spark, rows):
    s = star(spark, [("D1", 2020, t, "M", 1) for t in ("IT", "ITC", "ITC1", "ITC11")], META)
    got = rows(D.territory_dimension(s), "TerritoryCode", "Level", "ParentCode")
    assert got == [("IT", "Country", None), ("ITC", "Area", "IT"), ("ITC1", "Region", "ITC"), ("ITC11", "Province", "ITC1")]
    assert D.measure_dimension(s).first().DataType == "Integer"


def test_aggregate_names(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 6), ("b", 3)], "k string, v int").withColumn("v", F.col("v").cast("decimal(20,6)"))
    out = A.aggregate(df, ["k"], sd=("STDDEV", "v"), var=("VARIANCE", "v"), med=("MEDIAN", "v"), n=("COUNT_DISTINCT", "v"))
    got = {r.k: r for r in out.collect()}
    assert got["a"].sd == pytest.approx(7**0.5) and got["a"].var == pytest.approx(14 / 3)
    assert (got["a"].med, got["b"].med, got["b"].sd, got["b"]["var"]) == (2.0, 3.0, None, 0.0)


def test_conditions(spark, rows):
    people = spark.createDataFrame([(1, "Alice", 25, "Rome"), (2, "Bob", 30, None), (3, "Charlie", 35, "Milan")], "id int, name string, age int, city string")
    assert [r.name for r in P.where(people, [("age", ">", 25)]).orderBy("age").collect()] == ["Bob", "Charlie"]
    assert P.where(people, [("age", "<=", 30)]).count() == 2
    # three-valued: a missing city is neither in nor not in the list
    assert rows(P.where(people, [("city", "NOT IN", ["Rome"])]), "id") == [(3,)]
    assert rows(P.where(people, [("city", "IS NULL")]), "id") == [(2,)]
    assert rows(P.where(people, [("name", "ILIKE", "%LI%")]), "id") == [(1,), (3,)]
    for bad in (("age", "IN", 5), ("age", "BETWEEN", [1]), ("age", "~", 1)):
        with pytest.raises(ValueError):
            P.condition(*bad)


def test_pages(spark, monkeypatch):
    df = spark.range(95).select((95 - F.col("id")).alias("v"))
    near = A.page(df, ["v"], 4, 30).collect()
    assert [r.v for r in near] == [91, 92, 93, 94, 95] and not near[0].has_next and near[0].total_count == 95
    # a page beyond the limit is cut out of the numbering and gives the same rows
    monkeypatch.setattr(A, "NEAR_ROWS", 10)
    deep = A.page(df, ["-v"], 2, 30).collect()
    assert sorted(r.v for r in deep) == list(range(36, 66)) and deep[0].has_next
    for number, size in ((0, 10), (1, 0), (1, 1001)):
        with pytest.raises(ValueError):
            A.page(df, ["v"], number, size)
    with pytest.raises(ValueError):
        A.limit_offset(df, ["v"], -1)


def test_tied_rows_are_on_one_page(spark, monkeypatch):
    df = spark.range(90).select((F.col("id") % 3).alias("v"), F.col("id").alias("k"))
    near = [r.k for n in range(1, 10) for r in A.page(df, ["-v"], n, 10).collect()]
    monkeypatch.setattr(A, "NEAR_ROWS", 35)  # ties on both sides of the change of plan
    deep = [r.k for n in range(1, 10) for r in A.page(df, ["-v"], n, 10).collect()]
    assert near == deep and sorted(near) == list(range(90))


def test_slice_without_an_end_keeps_maps_and_order(spark):
    df = spark.range(50).select((50 - F.col("id")).alias("v"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    rest = A.limit_offset(df, ["v"], None, 45).collect()
    assert [(r.v, r.m) for r in rest] == [(v, {"a": 50 - v}) for v in range(46, 51)]


def test_joined_values_are_a_code_list(spark, monkeypatch):
    df = spark.range(20).select(F.lit(1).alias("k"), F.col("id").cast("string").alias("v"))
    monkeypatch.setattr(A, "MAX_CODES", 20)
    assert A.joined_values(df, ["k"], "v", "t").first().t.count(",") == 19
    monkeypatch.setattr(A, "MAX_CODES", 19)
    with pytest.raises(ValueError):
        A.joined_values(df, ["k"], "v", "t")


def test_canonical_tables(spark):
    """The full schemas, in which observations repeat columns of their series."""

    def table(schema, *rows):
        return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)

    base = {"dataset_id": "D1", "year": 2020, "territory_code": "IT"}
    s = model.Star(
        table(model.METADATA, {"dataset_id": "D1", "dataset_name": "One", "category": "c", "priority": 1}),
        table(model.SERIES, {"id": 1, "territory_name": "Italia", "measure_code": "M", "time_period": "2020", **base}),
        table(model.OBSERVATIONS, *({"dataset_row_id": 1, "obs_value": Decimal(v), "value_type": "NUMERIC", **base} for v in (2, 4))),
    )
    assert D.dataset_summary(s).first().avg_value == 3.0
    assert D.time_series(s, ["D1"], 2020, 2020).count() == 2
    assert D.territory_comparison(s, ["M"], 2020).first().avg_value == 3.0
    assert D.category_trends(s, ["c"], 2020, 2020).first().median_value == 3.0
    assert D.top_performers(s, "c", "M", 2020).first()["rank"] == 1
    assert D.dataset_stats(s).first().measure_count == 1
    assert D.kpi_metrics(s, ["c"], 2020, 2020).first().points == 2
    assert D.territory_aggregates(s).first().indicator_count == 2


def test_empty_tables(spark):
    s = star(spark, [("D1", 2020, "IT", "M", 1)], META)
    none = type(s)(s.metadata.where("false"), s.series.where("false"), s.observations.where("false"))
    assert D.dataset_summary(none).count() == 0
    assert D.category_trends(none, ["popolazione"], 2000, 2020).count() == 0
    assert D.territory_comparison_dataset(none, "D1", 2020).count() == 0
    assert D.kpi_metrics(none, ["popolazione"], 2000, 2020).count() == 0
    assert A.exists(none.series).first().row_exists is False
    assert A.result_count(none.series).first().row_count == 0
