"""Registry, logs, quality and table-client options on literal rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from statspine.operators import logs as G
from statspine.operators import quality as Q
from statspine.operators import registry as M
from statspine.operators import table_query as O

REGISTRY = [
    ("DCIS_POPRES1", "Popolazione residente", "popolazione", None, 10, True, datetime(2024, 1, 1)),
    ("DCCN_PIL", "PIL e inflazione", "economia", "Conti nazionali", 9, True, datetime(2024, 1, 1)),
    ("OLD", "Vecchio", None, "Dataset chiuso", 5, False, datetime(2023, 1, 1)),
]


@pytest.fixture
def registry(spark):
    return spark.createDataFrame(
        REGISTRY, "dataset_id string, name string, category string, description string, priority int, is_active boolean, updated_at timestamp"
    )


def test_listing_and_search(registry, rows):
    assert [r.dataset_id for r in M.list_datasets(registry).collect()] == ["DCIS_POPRES1", "DCCN_PIL"]
    assert [r.dataset_id for r in M.list_datasets(registry, active_only=False, limit=1, offset=2).collect()] == ["OLD"]
    assert rows(M.categories(registry)) == [("economia",), ("popolazione",)]
    # a missing description is no match and no error
    assert rows(M.search(registry, " RESIDENTE "), "dataset_id") == [("DCIS_POPRES1",)]
    assert rows(M.search(registry, "dc", "economia"), "dataset_id") == [("DCCN_PIL",)]
    assert rows(M.high_priority(registry), "dataset_id") == [("DCCN_PIL",), ("DCIS_POPRES1",)]


def test_upsert_latest_replaces_and_reactivates(spark, registry):
    incoming = registry.where("dataset_id = 'OLD'").withColumn("name", F.lit("Nuovo"))
    newer = incoming.withColumns({"name": F.lit("Nuovissimo"), "updated_at": F.lit(datetime(2024, 5, 1)).cast("timestamp")})
    got = {r.dataset_id: r for r in M.upsert_latest(registry, incoming.unionByName(newer)).collect()}
    assert len(got) == 3 and got["OLD"].name == "Nuovissimo" and got["OLD"].is_active
    # an incoming row wins over the stored one even with an older stamp
    older = incoming.withColumn("updated_at", F.lit(datetime(2000, 1, 1)).cast("timestamp"))
    assert {r.name for r in M.upsert_latest(registry, older).where("dataset_id = 'OLD'").collect()} == {"Nuovo"}


def test_upsert_partial_keeps_other_columns(spark):
    stored = spark.createDataFrame([("A", "a", "x", "kg"), ("B", "b", "y", "m")], "dataset_id string, dataset_name string, category string, unit_of_measure string")
    incoming = spark.createDataFrame([("A", "a2", None, "cm"), ("C", "c", "z", "l")], stored.schema)
    got = sorted(tuple(r) for r in M.upsert_partial(stored, incoming).collect())
    assert got == [("A", "a2", None, "kg"), ("B", "b", "y", "m"), ("C", "c", "z", "l")]


def test_repeated_keys_of_a_change_set(spark, registry):
    schema = "dataset_id string, dataset_name string, category string, unit_of_measure string, updated_at timestamp"
    at = lambda day: datetime(2024, 1, day)
    stored = spark.createDataFrame([("A", "a", "x", "kg", at(1))], schema)
    incoming = [("A", "a3", "y", "cm", at(3)), ("A", "a2", None, "l", at(2)), ("N", "n2", "q", "m", at(5)), ("N", "n1", "p", "t", at(4)), ("N", "n1", "p", "t", at(4))]
    got = sorted(tuple(r)[:4] for r in M.upsert_partial(stored, spark.createDataFrame(incoming, schema)).collect())
    assert got == [("A", "a3", "y", "kg"), ("N", "n2", "q", "t")]
    changes = spark.createDataFrame([("OLD", 5, at(2)), ("OLD", None, at(3)), ("OLD", 4, at(1))], "dataset_id string, record_count long, last_updated timestamp")
    table = registry.withColumns({"last_updated": F.col("updated_at"), "record_count": F.lit(1).cast("long")})
    stats = M.update_stats(table, changes, datetime(2024, 6, 1))
    assert stats.count() == registry.count()
    assert [(r.record_count, r.last_updated) for r in stats.where("dataset_id = 'OLD'").collect()] == [(5, at(3))]


def test_rolling_count_of_one_busy_identifier(spark):
    rows = [("hot", datetime(2024, 1, 1) + timedelta(seconds=i // 3)) for i in range(6000)] + [("cold", datetime(2024, 1, 1))] * 2
    df = spark.createDataFrame(rows, "identifier string, timestamp timestamp")
    out = G.rolling_request_count(df, 600)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame" not in plan
    got = {(r.identifier, r.timestamp): (r.request_count, r.rolling_count) for r in out.collect()}
    for s in (0, 1, 599, 600, 601, 1999):
        assert got["hot", datetime(2024, 1, 1) + timedelta(seconds=s)] == (3, 3 * min(s + 1, 600))
    assert got["cold", datetime(2024, 1, 1)] == (2, 2) and len(got) == 2001


def test_many_rules(spark):
    rules = spark.range(10_050).select(
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("rule_id"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("category"),
        F.array(F.concat(F.lit("key"), F.col("id").cast("string"), F.lit("."))).alias("keywords"), F.lit(1).alias("priority"),
        F.lit(True).alias("is_active"), F.lit(datetime(2024, 1, 1)).alias("created_at"),
    )
    df = spark.createDataFrame([("x key10049. y",), ("nothing",)], "name string")
    got = {r.name: r.category for r in M.categorise(df, rules, ["name"]).collect()}
    assert got == {"x key10049. y": "c10049", "nothing": M.DEFAULT_CATEGORY}


def test_update_delete_retain(spark, registry):
    as_of = datetime(2024, 6, 1)
    changes = spark.createDataFrame([("OLD", 5), ("DCCN_PIL", None)], "dataset_id string, record_count long")
    got = {r.dataset_id: r for r in M.update_stats(registry.withColumn("record_count", F.lit(1).cast("long")), changes, as_of).collect()}
    assert (got["OLD"].record_count, got["OLD"].updated_at) == (5, as_of)
    assert (got["DCCN_PIL"].record_count, got["DCCN_PIL"].updated_at) == (1, datetime(2024, 1, 1))
    ids = spark.createDataFrame([("DCCN_PIL",), ("DCCN_PIL",)], "dataset_id string")
    assert [r.is_active for r in M.soft_delete(registry, ids, as_of).orderBy("dataset_id").collect()] == [False, True, False]
    assert M.retain_since(registry, "updated_at", datetime(2024, 1, 31), 30).count() == 2


def test_rules(spark):
    schema = "rule_id string, category string, keywords array<string>, priority int, is_active boolean, created_at timestamp"
    day = datetime(2024, 1, 1)
    rules = spark.createDataFrame(
        [
            ("a", "economia", [" PIL ", "", "Prezzi"], 9, True, day),
            ("b", "lavoro", ["occupazione"], 9, True, day - timedelta(days=1)),
            ("c", "salute", ["pil"], 10, False, day),
            ("d", "vuota", ["  "], 10, True, day),
        ],
        schema,
    )
    clean = M.normalise_rules(rules)
    assert {r.rule_id: r.keywords for r in clean.collect()} == {"a": ["pil", "prezzi"], "b": ["occupazione"], "c": ["pil"]}
    assert [r.rule_id for r in M.active_rules(clean).collect()] == ["b", "a"]
    texts = spark.createDataFrame(
        [(1, "Il PIL e i prezzi", None), (2, "Occupazione", "e PIL"), (3, "Nulla", ""), (4, None, None)], "id int, name string, description string"
    )
    got = {r.id: (r.category, r.priority, r.score) for r in M.categorise(texts, clean, ["name", "description"]).collect()}
    assert got == {1: ("economia", 9, 2), 2: ("lavoro", 9, 1), 3: ("altro", 1, 0), 4: ("altro", 1, 0)}
    defaults = M.default_rules(spark)
    assert [r.priority for r in M.active_rules(defaults).collect()] == [10, 9, 8, 7, 6, 5]
    assert {r.id for r in M.categorise(texts, defaults, ["name"]).where("category = 'economia'").collect()} == {1}


def test_dataset_ids(spark):
    ids = ["", "  ", None, "DCIS_POPRES1", "AB", "A B#C", "_ABC", "ABC-", "A__B", "X" * 51, " CENSUS-2019 "]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], "i int, dataset_id string")
    got = {r.i: (r.problem, r.suggestion) for r in M.validate_dataset_ids(df).collect()}
    assert [got[i][0] for i in range(len(ids))] == [
        "empty", "empty", "empty", "valid", "too_short", "invalid_characters", "leading_separator", "trailing_separator",
        "consecutive_separators", "too_long", "valid",
    ]
    assert [got[i][1] for i in (3, 4, 5, 8, 10)] == ["DCIS_POPRES1", None, "A_B_C", "A_B", "CENSUS_2019"]


def test_typed_settings(spark):
    values = [("json", '{"a": 1}'), ("json", "{bad"), ("boolean", "YES"), ("boolean", "nope"), ("number", "1.5"), ("number", "x"), ("integer", "7"), ("string", "s"), ("string", None)]
    df = spark.createDataFrame([(f"k{i}", v, t) for i, (t, v) in enumerate(values)], "k string, v string, t string")
    got = {r.k: r for r in M.typed_settings(df, "k", "v", "t").collect()}
    assert (got["k0"].json_value, got["k0"].text_value, got["k1"].json_value, got["k1"].text_value) == ('{"a": 1}', None, None, "{bad")
    assert (got["k2"].boolean_value, got["k3"].boolean_value, got["k4"].number_value, got["k5"].text_value) == (True, False, 1.5, "x")
    assert (got["k6"].integer_value, got["k6"].text_value, got["k7"].text_value, got["k8"].text_value) == (7, None, "s", None)
    assert M.typed_settings(df, "k", "v", "t", "k1%").count() == 1


def test_key_usage_without_active_keys(spark):
    df = spark.createDataFrame([("a", ["read"], False, 5, None)], "name string, scopes array<string>, is_active boolean, usage_count long, last_used timestamp")
    got = M.key_usage_stats(df, datetime(2024, 1, 1)).first()
    assert (got.total_keys, got.active_keys, got.revoked_keys, got.total_usage, got.avg_usage, got.most_used) == (1, 0, 1, None, None, None)
    assert M.keys_per_scope(df).count() == 0


T = datetime(2024, 1, 1, 10)
LOG = [
    (1, "u1", "LOGIN", "user", "7", '{"k": "v"}', True, None, 10.0, T),
    (2, "u1", "read", "dataset", "8", None, False, "boom", 30.0, T + timedelta(minutes=1)),
    (3, "u2", "read", "dataset", "8", "{bad", True, None, None, T + timedelta(minutes=2)),
    (4, "u2", "LOGIN", "user", None, "", True, None, 20.0, T - timedelta(days=9)),
]


@pytest.fixture
def log(spark):
    return spark.createDataFrame(
        LOG, "id long, user_id string, action string, resource_type string, resource_id string, details_json string, success boolean, "
        "error_message string, execution_time_ms double, timestamp timestamp",
    )


def test_audit_log(log):
    got = G.audit_logs(log).collect()
    assert [r.id for r in got] == [3, 2, 1, 4]
    assert [r.details for r in got] == [{}, {}, {"k": "v"}, {}]
    assert [r.id for r in G.audit_logs(log, user_id="u1", success=False).collect()] == [2]
    assert [r.id for r in G.audit_logs(log, start=T, limit=1, offset=1).collect()] == [2]
    stats = G.audit_statistics(log).first()
    assert (stats.total_events, stats.failed_events, stats.unique_users, stats.avg_execution_time) == (4, 1, 2, 20.0)
    assert G.audit_statistics(log.where("false")).first().avg_execution_time is None
    assert [r.action for r in G.user_activity(log, "u1").collect()] == ["read", "LOGIN"]
    # the time bound holds for named actions as well as for failures
    assert [r.id for r in G.security_events(log, start=T).collect()] == [2, 1]
    assert {r.action: r.event_count for r in G.action_summary(log).collect()} == {"LOGIN": 2, "read": 2}


def test_usage(log):
    requests = log.withColumn("endpoint", F.col("resource_type"))
    got = {(r.date, r.endpoint): (r.request_count, r.avg_response_time_ms, r.error_count) for r in G.usage_analytics(requests).collect()}
    assert got == {("2023-12-23", "user"): (1, 20.0, 0), ("2024-01-01", "user"): (1, 10.0, 0), ("2024-01-01", "dataset"): (2, 30.0, 1)}
    summary = G.usage_summary(requests).first()
    assert (summary.total_requests, summary.error_rate, summary.most_used_endpoint) == (4, 0.25, "dataset")
    with pytest.raises(ValueError):
        G.usage_analytics(requests, "year")


def test_rolling_count_is_exact_at_the_edge(spark):
    at = [0, 0, 3599.999999, 3600, 3600.000001, 7200, 9000]
    df = spark.createDataFrame([("u", T + timedelta(seconds=s)) for s in at], "identifier string, timestamp timestamp")
    got = [r.rolling_count for r in G.rolling_request_count(df, 3600).orderBy("timestamp").collect()]
    times = sorted(set(at))
    assert got == [sum(1 for s in at if t - 3600 < s <= t) for t in times]


def test_request_windows_and_limits(spark):
    df = spark.createDataFrame([("u", "/x", T + timedelta(seconds=s)) for s in range(0, 130)], "identifier string, endpoint string, timestamp timestamp")
    counts = G.request_counts(df)
    got = sorted((r.window_type, r.request_count) for r in counts.collect())
    assert got == [("day", 130), ("hour", 130), ("minute", 10), ("minute", 60), ("minute", 60)]
    over = G.limit_violations(counts.withColumn("scope", F.lit("write")), G.scope_limit("scope", "window_type")).collect()
    assert sorted((r.window_type, r.limit_value, r.exceeded_by) for r in over) == [("minute", 30, 30), ("minute", 30, 30)]
    assert G.expired_windows_removed(counts, T + timedelta(minutes=2)).count() == 3


def test_quality(spark, rows):
    data = [("IT", 2022, 10), ("", 2023, 11), ("IT", 2024, None), ("IT", 2022, 10)]
    df = spark.createDataFrame(data, "territorio string, anno int, valore int")
    report = Q.quality_report(df).first()
    assert tuple(report) == (4, 1, 1, 1, 1, 25.0)
    assert rows(Q.clean(df)) == [("IT", 2022, 10)]
    assert tuple(Q.quality_report(df.where("false")).first()) == (0, 0, 0, 0, 0, None)
    check = {r.column_name: (r.null_share, r.null_share_ok, r.completeness_ok) for r in Q.threshold_check(df).collect()}
    assert check == {"territorio": (0.0, True, True), "anno": (0.0, True, True), "valore": (0.25, True, True)}


def test_duplicates(spark, rows):
    schema = "dataset_id string, time_period string, obs_value string, record_id int, ingestion_timestamp timestamp, m map<string,string>"
    raw = spark.createDataFrame(
        [("D", "2020", "1", 2, T, {"a": "b"}), ("D", "2020", "1", 1, T, None), ("D", "2020", None, 1, T, None), ("E", "2020", "1", 1, T, None), ("D", "2020", None, 1, T, None)],
        schema,
    )
    assert Q.exact_duplicates(raw, ["dataset_id", "obs_value", "time_period", "record_id"]).first()[0] == 1
    assert rows(Q.business_duplicates(raw), "dataset_id", "occurrences", "different_value") == [("D", 4, "1")]
    assert rows(Q.duplicate_record_ids(raw)) == [("D", 2, 4, 2)]
    kept = Q.dedupe_keep_first(raw, ["dataset_id", "obs_value", "time_period"], ["ingestion_timestamp", "record_id"])
    assert rows(kept, "dataset_id", "obs_value", "record_id") == [("D", None, 1), ("D", "1", 1), ("E", "1", 1)]


def test_quality_score(spark):
    df = spark.createDataFrame([("a", 0, 10), ("b", 5, 999), ("c", 5, 5000)], "dataset_id string, observations_count long, payload_size long")
    got = {r.dataset_id: (r.quality_score, r.completeness, len(r.validation_errors)) for r in Q.dataset_quality_score(df).collect()}
    assert got == {"a": (40.0, 50.0, 2), "b": (90.0, 100.0, 1), "c": (100.0, 100.0, 0)}


def test_table_query(spark, rows):
    df = spark.createDataFrame([(1, "Alpha", "10"), (2, "beta", None), (3, "Gamma", "x")], "Id int, Name string, Value string")
    assert rows(O.filter_rows(df, [("Id", "eq", "2")]), "Id") == [(2,)]
    # a missing value is different from any given one
    assert rows(O.filter_rows(df, [("Value", "ne", "10")]), "Id") == [(2,), (3,)]
    assert rows(O.filter_rows(df, [("Value", "gt", "5")]), "Id") == [(1,)]
    assert rows(O.filter_rows(df, [("Name", "contains", "A"), ("Id", "gt", "1")]), "Id") == [(2,), (3,)]
    assert [r.Id for r in O.query(df, order="Name desc", top=2).collect()] == [2, 3]
    got = O.query(df, skip=1, top=0, select=["Name", "Nothing"])
    assert got.columns == ["Name"] and got.count() == 2
    assert O.query_count(df, [("Id", "gt", "1")]).first()["count"] == 2
    for bad in ([("Nope", "eq", "1")], [("Id", "lt", "1")]):
        with pytest.raises(ValueError):
            O.filter_rows(df, bad)
    with pytest.raises(ValueError):
        O.order_rows(df, "Nope")


def test_observations_need_a_dataset(spark):
    raw = spark.createDataFrame(
        [("D", 1, None, "1", "2021", None), ("D", 0, None, "2", "2020", None)],
        "dataset_id string, record_id long, ingestion_timestamp timestamp, obs_value string, time_period string, additional_attributes map<string,string>",
    )
    for missing in (None, ""):
        with pytest.raises(ValueError):
            O.observation_entities(raw, missing)
    # ids are given before the filter
    got = O.observation_entities(raw, "D", [("Year", "eq", "2021")]).collect()
    assert [(r.Id, r.ObsValue) for r in got] == [(2, 1.0)]
