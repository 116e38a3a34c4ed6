"""Registry, partition, log, quality and table-client queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from statspine.operators import analytics as D
from statspine.operators import keywords as KW
from statspine.operators import logs as G
from statspine.operators import partitioning as N
from statspine.operators import quality as Q
from statspine.operators import registry as M
from statspine.operators import table_query as O
from statspine.plans import standin as S
from statspine.plans.analytic import STATS
from statspine.plans.catalog import SQL, query
from statspine.session import scratch_dir
from statspine.sources.bucketed import BucketedTable

AS_OF = datetime(2024, 1, 20, 12)
AS_OF_SQL = "TIMESTAMP '2024-01-20 12:00:00'"

# registry


@query("M1_list_datasets", f"""SELECT dataset_id, name, priority FROM {S.REGISTRY} r WHERE is_active AND category = 'BUILDING'
  ORDER BY priority DESC, name, dataset_id LIMIT 40 OFFSET 20""")  # fmt: skip
def _(spark, d):
    return M.list_datasets(S.registry(spark, d), "BUILDING", limit=40, offset=20).select("dataset_id", "name", "priority")


@query("M2_search", f"""SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'the') AND lang = 'en'""")  # noqa: F541
def _(spark, d):
    docs = S.table(spark, d, "documents").withColumn("category", F.col("lang"))
    return M.search(docs, " THE ", "en", columns=("text",)).select("doc_id", "lang", "source")


@query("M2_search_indexed", SQL["M2_search"])
def _(spark, d):
    docs, path = S.table(spark, d, "documents"), scratch_dir(spark, "search-index")
    KW.write_search_index(docs, "doc_id", ["text"], path)
    found = KW.search_indexed(spark, docs, "doc_id", ["text"], path, " THE ")
    return found.where("lang = 'en'").select("doc_id", "lang", "source")


@query("M2_search_registry", f"""SELECT dataset_id, name FROM {S.REGISTRY} r WHERE contains(lower(name), '10') OR contains(lower(description), '10')
  OR contains(CAST(dataset_id AS VARCHAR), '10')""")  # fmt: skip
def _(spark, d):
    return M.search(S.registry(spark, d), "10").select("dataset_id", "name")


@query("M3_registry_summary", f"""SELECT COUNT(*) AS total_datasets, COUNT(CASE WHEN is_active THEN 1 END) AS active_datasets, COUNT(DISTINCT category) AS categories,
  SUM(record_count)::BIGINT AS total_records, CAST(SUM(CAST(quality_score AS DECIMAL(20,6))) AS DOUBLE) / COUNT(quality_score) AS avg_quality_score,
  MAX(last_updated) AS last_processing FROM {S.REGISTRY} r""")  # fmt: skip
def _(spark, d):
    return M.registry_summary(S.registry(spark, d))


@query("M4_categories_summary", f"SELECT category, COUNT(*) AS dataset_count FROM {S.REGISTRY} r GROUP BY category")
def _(spark, d):
    return M.categories_summary(S.registry(spark, d))


@query("M4_datasets_by_category", f"SELECT dataset_id, name FROM {S.REGISTRY} r WHERE category = 'MACHINERY'")
def _(spark, d):
    return M.datasets_by_category(S.registry(spark, d), "MACHINERY").select("dataset_id", "name")


@query("M4_high_priority", f"SELECT dataset_id, priority FROM {S.REGISTRY} r WHERE priority >= 7")
def _(spark, d):
    return M.high_priority(S.registry(spark, d)).select("dataset_id", "priority")


UPSERT_COLS = "dataset_id, name, category, priority, is_active, updated_at"
INCOMING = f"""(SELECT dataset_id + 8 AS dataset_id, name || ' v' || CAST(v AS VARCHAR) AS name, category, CAST(priority + v AS INTEGER) AS priority,
  true AS is_active, updated_at + to_minutes(v * 10000) AS updated_at FROM {S.REGISTRY} r, (VALUES (1), (2)) t(v) WHERE dataset_id % 5 = 0)"""


def _incoming(spark, d):
    return (
        S.registry(spark, d)
        .where("dataset_id % 5 = 0")
        .withColumn("v", F.explode(F.array(F.lit(1), F.lit(2))))
        .select(
            (F.col("dataset_id") + 8).alias("dataset_id"),
            F.concat("name", F.lit(" v"), F.col("v").cast("string")).alias("name"),
            "category",
            (F.col("priority") + F.col("v")).alias("priority"),
            "is_active",
            (F.col("updated_at") + F.make_interval(mins=F.col("v") * 10000)).alias("updated_at"),
        )
    )


@query("M5_upsert_latest", f"""SELECT {UPSERT_COLS} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset_id ORDER BY fresh DESC, updated_at DESC) AS rn FROM
  (SELECT {UPSERT_COLS}, 0 AS fresh FROM {S.REGISTRY} r UNION ALL SELECT {UPSERT_COLS}, 1 FROM {INCOMING} i)) WHERE rn = 1""")  # fmt: skip
def _(spark, d):
    stored = S.registry(spark, d).select(*UPSERT_COLS.split(", "))
    return M.upsert_latest(stored, _incoming(spark, d))


def _stored_registry(spark, d, columns: list[str]) -> BucketedTable:
    rows = S.registry(spark, d).select(*columns)
    table = BucketedTable(scratch_dir(spark, "registry"), rows.schema)
    table.create(rows)
    return table


@query("M5_upsert_stored", SQL["M5_upsert_latest"])
def _(spark, d):
    table = _stored_registry(spark, d, UPSERT_COLS.split(", "))
    table.merge(_incoming(spark, d), M.upsert_latest)
    return table.read(spark)


# two rows for every key: the later name, by text, wins; the unit of a new key is that of its first row
M6_INCOMING = f"""(SELECT dataset_id + 7 AS dataset_id, dataset_name || suffix AS dataset_name, 'altro' AS category, 1 AS priority, unit AS unit_of_measure
  FROM {S.METADATA} m, (VALUES (' new', 'kg'), (' newer', 'g')) v(suffix, unit) WHERE dataset_id % 3 = 0)"""


@query("M6_upsert_partial", f"""SELECT COALESCE(s.dataset_id, i.dataset_id) AS dataset_id, CASE WHEN i.dataset_id IS NULL THEN s.dataset_name ELSE i.dataset_name END AS dataset_name,
  CASE WHEN i.dataset_id IS NULL THEN s.category ELSE i.category END AS category, CASE WHEN i.dataset_id IS NULL THEN s.priority ELSE i.priority END AS priority,
  CASE WHEN s.dataset_id IS NULL THEN i.unit_of_measure ELSE s.unit_of_measure END AS unit_of_measure FROM {S.METADATA} s FULL JOIN
  (SELECT dataset_id, MAX(dataset_name) AS dataset_name, MIN(category) AS category, MIN(priority) AS priority, arg_min(unit_of_measure, dataset_name) AS unit_of_measure
   FROM {M6_INCOMING} GROUP BY dataset_id) i ON s.dataset_id = i.dataset_id""")  # fmt: skip
def _(spark, d):
    meta = S.metadata(spark, d).select("dataset_id", "dataset_name", "category", "priority", "unit_of_measure")
    twice = F.explode(F.array(*[F.struct(F.lit(s).alias("suffix"), F.lit(u).alias("unit")) for s, u in ((" new", "kg"), (" newer", "g"))]))
    incoming = meta.where("dataset_id % 3 = 0").select((F.col("dataset_id") + 7).alias("dataset_id"), "dataset_name", twice.alias("v"))
    incoming = incoming.select("dataset_id", F.concat("dataset_name", "v.suffix").alias("dataset_name"), F.col("v.unit").alias("unit_of_measure"))
    return M.upsert_partial(meta, M.with_insert_defaults(incoming))


# a change for every order, in order of its date: each field ends with its last value that is not NULL
M7_CHANGES = """SELECT o_custkey, o_orderdate, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS n, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 100 AS DOUBLE) END AS q FROM orders"""


@query("M7_update_stats", f"""SELECT r.dataset_id, COALESCE(c.n, r.record_count) AS record_count, COALESCE(c.q, r.quality_score) AS quality_score, COALESCE(c.u, r.last_updated) AS last_updated,
  CASE WHEN c.u IS NOT NULL THEN {AS_OF_SQL} ELSE r.updated_at END AS updated_at FROM {S.REGISTRY} r LEFT JOIN
  (SELECT o_custkey, MAX(o_orderdate) AS u, arg_max(n, struct_pack(a := o_orderdate, b := COALESCE(n, -1), c := COALESCE(q, -1))) FILTER (n IS NOT NULL) AS n,
   arg_max(q, struct_pack(a := o_orderdate, b := COALESCE(n, -1), c := COALESCE(q, -1))) FILTER (q IS NOT NULL) AS q FROM ({M7_CHANGES}) GROUP BY o_custkey) c
  ON r.dataset_id = c.o_custkey""")  # fmt: skip
def _(spark, d):
    registry = S.registry(spark, d).select("dataset_id", "record_count", "quality_score", "last_updated", "updated_at")
    key = F.col("o_orderkey")
    changes = S.table(spark, d, "orders").select(
        F.col("o_custkey").alias("dataset_id"),
        F.when(key % 2 == 0, key).alias("record_count"),
        F.when(key % 3 == 0, (key % 100).cast("double")).alias("quality_score"),
        F.col("o_orderdate").alias("last_updated"),
    )
    return M.update_stats(registry, changes, AS_OF)


@query("M7_soft_delete", f"""SELECT dataset_id, CASE WHEN dataset_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN false ELSE is_active END AS is_active,
  CASE WHEN dataset_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN {AS_OF_SQL} ELSE updated_at END AS updated_at FROM {S.REGISTRY} r""")  # fmt: skip
def _(spark, d):
    gone = S.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("dataset_id"))
    return M.soft_delete(S.registry(spark, d).select("dataset_id", "is_active", "updated_at"), gone, AS_OF)


@query("M7_soft_delete_stored", SQL["M7_soft_delete"])
def _(spark, d):
    table = _stored_registry(spark, d, ["dataset_id", "is_active", "updated_at"])
    gone = S.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("dataset_id"))
    table.merge(gone, lambda rows, ids: M.soft_delete(rows, ids, AS_OF))
    return table.read(spark)


@query("M7_retention", f"""SELECT id, "timestamp" FROM {S.AUDIT} a WHERE "timestamp" >= {AS_OF_SQL} - INTERVAL 10 DAY""")
def _(spark, d):
    return M.retain_since(S.audit_log(spark, d), "timestamp", AS_OF, 10).select("id", "timestamp")


@query("M8_with_analytics", f"""SELECT r.dataset_id, r.category, s.record_count, min_year, max_year, territory_count, measure_count, true AS has_analytics_data
  FROM {S.REGISTRY} r JOIN {STATS} s ON r.dataset_id = s.dataset_id""")  # fmt: skip
def _(spark, d):
    registry = S.registry(spark, d).select("dataset_id", "category", "record_count")
    return M.with_analytics(registry, D.dataset_stats(S.star(spark, d)), present=True)


RULES_SQL = """(SELECT p_partkey AS rule_id, p_type AS category, CAST(p_size % 10 AS INTEGER) AS priority, p_partkey % 3 <> 0 AS is_active,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(p_partkey % 97) AS created_at, string_split(' ' || upper(p_name) || '  ', ' ') AS keywords FROM part)"""


def _rules(spark, d):
    return S.table(spark, d, "part").select(
        F.col("p_partkey").alias("rule_id"),
        F.col("p_type").alias("category"),
        F.expr("CAST(p_size % 10 AS INT)").alias("priority"),
        F.expr("p_partkey % 3 <> 0").alias("is_active"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(p_partkey % 97 AS INT), 0)").alias("created_at"),
        F.split(F.concat(F.lit(" "), F.upper("p_name"), F.lit("  ")), " ").alias("keywords"),
    )


@query("M9_normalise_rules", f"""SELECT rule_id, keywords FROM (SELECT rule_id, list_filter(list_transform(keywords, lambda k: trim(lower(k))), lambda k: k <> '') AS keywords
  FROM {RULES_SQL} r) WHERE len(keywords) > 0""")  # fmt: skip
def _(spark, d):
    return M.normalise_rules(_rules(spark, d)).select("rule_id", "keywords")


@query("M10_active_rules", f"SELECT rule_id, category, priority, created_at FROM {RULES_SQL} r WHERE is_active AND category = 'PROMO'")
def _(spark, d):
    return M.active_rules(_rules(spark, d), "PROMO").select("rule_id", "category", "priority", "created_at")


def _rule_sql() -> str:
    """The default rules as SQL: score per rule, best first."""
    hits, category, priority, score = [], [], [], []
    for i, (_, name, prio, words) in enumerate(M.DEFAULT_RULES):
        found = " + ".join(f"CAST(contains(t, '{w}') AS INTEGER)" for w in words)
        hits.append(f"{found} AS s{i}")
        category.append(f"WHEN s{i} > 0 THEN '{name}'")
        priority.append(f"WHEN s{i} > 0 THEN {prio}")
        score.append(f"WHEN s{i} > 0 THEN s{i}")
    case = lambda parts, default: f"CASE {' '.join(parts)} ELSE {default} END"
    return (
        f"SELECT doc_id, {case(category, repr('altro'))} AS category, {case(priority, 1)} AS priority, {case(score, 0)} AS score "
        f"FROM (SELECT doc_id, {', '.join(hits)} FROM (SELECT doc_id, lower(source || ' ' || text) AS t FROM documents))"
    )


@query("M11_categorise", _rule_sql())
def _(spark, d):
    docs = S.table(spark, d, "documents")
    return M.categorise(docs, M.default_rules(spark), ["source", "text"]).select("doc_id", "category", "priority", "score")


IDS_SQL = """(SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN source || '__' || lang WHEN 2 THEN '_' || source WHEN 3 THEN lang
  WHEN 4 THEN source || ' data#' || lang WHEN 5 THEN source || '-' WHEN 6 THEN repeat(source, 15) ELSE upper(source) || '_' || CAST(doc_id AS VARCHAR) END AS dataset_id FROM documents)"""


@query("M12_validate_dataset_ids", f"""SELECT doc_id, dataset_id, CASE WHEN trim(dataset_id) = '' THEN 'empty' WHEN NOT regexp_full_match(trim(dataset_id), '[A-Za-z0-9_-]+') THEN 'invalid_characters'
  WHEN length(trim(dataset_id)) < 3 THEN 'too_short' WHEN length(trim(dataset_id)) > 50 THEN 'too_long' WHEN regexp_matches(trim(dataset_id), '^[_-]') THEN 'leading_separator'
  WHEN regexp_matches(trim(dataset_id), '[_-]$') THEN 'trailing_separator' WHEN regexp_matches(trim(dataset_id), '[_-][_-]') THEN 'consecutive_separators' ELSE 'valid' END AS problem,
  CASE WHEN length(s) >= 3 THEN upper(s) END AS suggestion FROM (SELECT *, array_to_string(regexp_extract_all(dataset_id, '[A-Za-z0-9]+'), '_') AS s FROM {IDS_SQL} i)""")  # fmt: skip
def _(spark, d):
    ids = S.table(spark, d, "documents").select(
        "doc_id",
        F.expr(
            "CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN concat(source, '__', lang) WHEN 2 THEN concat('_', source) WHEN 3 THEN lang "
            "WHEN 4 THEN concat(source, ' data#', lang) WHEN 5 THEN concat(source, '-') WHEN 6 THEN repeat(source, 15) "
            "ELSE concat(upper(source), '_', CAST(doc_id AS STRING)) END"
        ).alias("dataset_id"),
    )
    return M.validate_dataset_ids(ids)


@query("M13_preference_stats", f"""SELECT COUNT(DISTINCT user_id) AS total_users, COUNT(*) AS total_preferences, COUNT(DISTINCT preference_key) AS unique_keys,
  COUNT(CASE WHEN preference_type = 'json' THEN 1 END) / COUNT(*)::DOUBLE AS json_ratio, COUNT(CASE WHEN is_encrypted THEN 1 END) AS encrypted_count FROM {S.SETTINGS} s""")  # fmt: skip
def _(spark, d):
    return M.preference_stats(S.settings(spark, d))


@query("M13_users_with_preferences", f"SELECT DISTINCT user_id FROM {S.SETTINGS} s")
def _(spark, d):
    return M.users_with_preferences(S.settings(spark, d))


@query("M14_typed_settings", f"""SELECT id, CASE WHEN preference_type IN ('number', 'integer') AND NOT contains(preference_value, '.') THEN TRY_CAST(preference_value AS BIGINT) END AS integer_value,
  CASE WHEN preference_type IN ('number', 'integer') AND contains(preference_value, '.') THEN TRY_CAST(preference_value AS DOUBLE) END AS number_value,
  CASE WHEN preference_type = 'boolean' THEN lower(preference_value) IN ('true', '1', 'yes', 'on') END AS boolean_value,
  CASE WHEN preference_type = 'json' AND json_valid(preference_value) THEN preference_value END AS json_value,
  CASE WHEN preference_type = 'string' OR (preference_type = 'number' AND TRY_CAST(preference_value AS DOUBLE) IS NULL) THEN preference_value END AS text_value
  FROM {S.SETTINGS} s WHERE preference_key LIKE 'c%'""")  # fmt: skip
def _(spark, d):
    typed = M.typed_settings(S.settings(spark, d), "preference_key", "preference_value", "preference_type", "c%")
    return typed.select("id", "integer_value", "number_value", "boolean_value", "json_value", "text_value")


@query("M15_key_usage_stats", f"""SELECT COUNT(*) AS total_keys, COUNT(CASE WHEN is_active THEN 1 END) AS active_keys, COUNT(CASE WHEN NOT is_active THEN 1 END) AS revoked_keys,
  COUNT(CASE WHEN is_active AND last_used > {AS_OF_SQL} - INTERVAL 7 DAY THEN 1 END) AS recently_used, SUM(CASE WHEN is_active THEN usage_count END)::BIGINT AS total_usage,
  CAST(SUM(CASE WHEN is_active THEN usage_count END) AS DOUBLE) / COUNT(CASE WHEN is_active THEN 1 END) AS avg_usage, MAX(CASE WHEN is_active THEN usage_count END) AS max_usage,
  (SELECT name FROM {S.API_KEYS} j WHERE is_active ORDER BY usage_count DESC, name DESC LIMIT 1) AS most_used FROM {S.API_KEYS} k""")  # fmt: skip
def _(spark, d):
    return M.key_usage_stats(S.api_keys(spark, d), AS_OF)


@query("M15_keys_per_scope", f"SELECT scope, COUNT(*) AS key_count FROM (SELECT unnest(scopes) AS scope FROM {S.API_KEYS} k WHERE is_active) GROUP BY scope")
def _(spark, d):
    return M.keys_per_scope(S.api_keys(spark, d))


# partitions

KEY_SQL = {
    "year": "'year_' || CAST(year AS VARCHAR)",
    "territory": "CASE WHEN territory_code LIKE 'IT%' THEN 'territory_italy_' || substr(territory_code, 1, 4) ELSE 'territory_' || substr(territory_code, 1, 2) END",
    "hybrid": "'hybrid_' || CAST(year // 10 * 10 AS VARCHAR) || 's_' || substr(territory_code, 1, 2)",
    "columns": "'year_' || CAST(year AS VARCHAR) || '_territory_code_' || territory_code",
}


@query("N1_partition_keys", f"SELECT id, {KEY_SQL['year']} AS year_key, {KEY_SQL['territory']} AS territory_key, {KEY_SQL['hybrid']} AS hybrid_key, {KEY_SQL['columns']} AS columns_key FROM {S.SERIES} d")
def _(spark, d):
    return S.series(spark, d).select(
        "id",
        *[N.partition_key(s).alias(f"{s}_key") for s in ("year", "territory", "hybrid")],
        N.partition_key("columns", ["year", "territory_code"]).alias("columns_key"),
    )


@query("N3_partition_predicate", f"SELECT id, year, territory_code FROM {S.SERIES} d WHERE year BETWEEN 1998 AND 2000 AND territory_code IN ('ITA0', 'ED8', 'EE24')")
def _(spark, d):
    rows = N.with_partition_columns(S.series(spark, d))
    return N.prune(rows, 1998, 2000, ["ITA0", "ED8", "EE24"]).select("id", "year", "territory_code")


KEYED_SQL = f"(SELECT *, {KEY_SQL['hybrid']} AS partition_key FROM {S.SERIES} d)"


def _keyed(spark, d):
    return S.series(spark, d).withColumn("partition_key", N.partition_key("hybrid"))


@query("N4_partition_stats", f"""SELECT partition_key, COUNT(*) AS row_count, MIN(year) AS min_year, MAX(year) AS max_year, COUNT(DISTINCT territory_code) AS territory_count
  FROM {KEYED_SQL} k GROUP BY partition_key""")  # fmt: skip
def _(spark, d):
    return N.partition_stats(_keyed(spark, d))


@query("N4_partition_totals", f"""SELECT COUNT(*) AS total_partitions, MAX(n) AS largest_partition, MIN(n) AS smallest_partition FROM
  (SELECT partition_key, COUNT(*) AS n FROM {KEYED_SQL} k GROUP BY partition_key)""")  # fmt: skip
def _(spark, d):
    return N.partition_totals(N.partition_stats(_keyed(spark, d)))


@query("N5_partition_view", f"""SELECT k.id, k.dataset_id, k.year, k.partition_key, obs_value, obs_status, value_type FROM {KEYED_SQL} k
  LEFT JOIN {S.OBSERVATIONS} o ON k.id = o.dataset_row_id WHERE partition_key = 'hybrid_1990s_IT'""")  # fmt: skip
def _(spark, d):
    view = N.partition_view(_keyed(spark, d), S.observations(spark, d), "hybrid_1990s_IT")
    return view.select("id", "dataset_id", "year", "partition_key", "obs_value", "obs_status", "value_type")


@query("N5_partition_key_list", f"SELECT DISTINCT partition_key FROM {KEYED_SQL} k")
def _(spark, d):
    return N.partition_keys(_keyed(spark, d))


# logs

T0, T1 = datetime(2024, 1, 5), datetime(2024, 1, 15)
BETWEEN = "\"timestamp\" >= TIMESTAMP '2024-01-05' AND \"timestamp\" <= TIMESTAMP '2024-01-15'"


@query("G1_audit_logs", f"""SELECT id, user_id, action, resource_type, "timestamp", details_json->>'k' AS k FROM {S.AUDIT} a
  WHERE action = 'purchase' AND success AND {BETWEEN} ORDER BY "timestamp" DESC, id DESC LIMIT 100 OFFSET 30""")  # fmt: skip
def _(spark, d):
    logs = G.audit_logs(S.audit_log(spark, d), start=T0, end=T1, offset=30, action="purchase", success=True)
    return logs.select("id", "user_id", "action", "resource_type", "timestamp", F.col("details")["k"].alias("k"))


MEAN_MS = "CAST(SUM(CAST(execution_time_ms AS DECIMAL(20,6))) AS DOUBLE) / COUNT(execution_time_ms)"
EVENTS = f"""COUNT(CASE WHEN success THEN 1 END) AS success_count, COUNT(CASE WHEN NOT success THEN 1 END) AS failure_count,
  {MEAN_MS} AS avg_execution_time, MAX("timestamp") AS last_occurrence"""


@query("G2_audit_statistics", f"""SELECT COUNT(*) AS total_events, COUNT(CASE WHEN success THEN 1 END) AS successful_events, COUNT(CASE WHEN NOT success THEN 1 END) AS failed_events,
  COUNT(DISTINCT user_id) AS unique_users, COUNT(DISTINCT action) AS unique_actions, COUNT(DISTINCT resource_type) AS unique_resource_types, {MEAN_MS} AS avg_execution_time,
  MAX("timestamp") AS last_event_time, MIN("timestamp") AS first_event_time FROM {S.AUDIT} a WHERE {BETWEEN}""")  # fmt: skip
def _(spark, d):
    return G.audit_statistics(S.audit_log(spark, d), T0, T1)


@query("G3_action_summary", f"SELECT action, resource_type, COUNT(*) AS event_count, {EVENTS} FROM {S.AUDIT} a GROUP BY action, resource_type")
def _(spark, d):
    return G.action_summary(S.audit_log(spark, d))


@query("G4_user_activity", f"""SELECT action, resource_type, resource_id, success, "timestamp", error_message FROM {S.AUDIT} a WHERE user_id = '5'
  ORDER BY "timestamp" DESC, id DESC LIMIT 50""")  # fmt: skip
def _(spark, d):
    return G.user_activity(S.audit_log(spark, d), "5")


@query("G5_security_events", f"""SELECT id, action, success, "timestamp", details_json->>'k' AS k FROM {S.AUDIT} a WHERE (action IN ('signup') OR NOT success) AND {BETWEEN}
  ORDER BY "timestamp" DESC, id DESC LIMIT 100""")  # fmt: skip
def _(spark, d):
    events = G.security_events(S.audit_log(spark, d), T0, T1, actions=["signup"])
    return events.select("id", "action", "success", "timestamp", F.col("details")["k"].alias("k"))


@query("G6_usage_analytics", f"""SELECT strftime(date_trunc('week', "timestamp"), '%Y-%m-%d') AS date, endpoint, COUNT(*) AS request_count, {MEAN_MS} AS avg_response_time_ms,
  COUNT(CASE WHEN NOT success THEN 1 END) AS error_count FROM {S.REQUESTS} r GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    return G.usage_analytics(S.requests(spark, d), "week")


@query("G6_usage_summary", f"""SELECT COUNT(*) AS total_requests, {MEAN_MS} AS avg_response_time_ms, COUNT(CASE WHEN NOT success THEN 1 END) / COUNT(*)::DOUBLE AS error_rate,
  (SELECT endpoint FROM {S.REQUESTS} q GROUP BY endpoint ORDER BY COUNT(*) DESC, endpoint LIMIT 1) AS most_used_endpoint FROM {S.REQUESTS} r""")  # fmt: skip
def _(spark, d):
    return G.usage_summary(S.requests(spark, d))


@query("G7_query_log_stats", """SELECT event_type AS query_type, COUNT(*) AS count, CAST(SUM(CAST(value * 20 AS DECIMAL(20,6))) AS DOUBLE) AS total_time,
  CAST(SUM(CAST(value * 20 AS DECIMAL(20,6))) AS DOUBLE) / COUNT(value) AS avg_time, COUNT(CASE WHEN event_id % 3 = 0 THEN 1 END) / COUNT(*)::DOUBLE AS cache_hit_rate,
  COUNT(CASE WHEN value * 20 > 1000 THEN 1 END) / COUNT(*)::DOUBLE AS slow_share, COUNT(CASE WHEN event_id % 10 = 0 THEN 1 END) / COUNT(*)::DOUBLE AS error_share
  FROM events GROUP BY event_type""")  # fmt: skip
def _(spark, d):
    log = S.table(spark, d, "events").select(
        F.col("event_type").alias("query_type"),
        (F.col("value") * 20).alias("execution_time_ms"),
        F.expr("event_id % 3 = 0").alias("cache_hit"),
        F.expr("event_id % 10 <> 0").alias("success"),
    )
    return G.query_log_stats(log)


def _window_sql(w: str) -> str:
    return f"""SELECT identifier, endpoint, '{w}' AS window_type, date_trunc('{w}', "timestamp") AS window_start, COUNT(*) AS request_count FROM {S.REQUESTS} r GROUP BY ALL"""


COUNTS_SQL = " UNION ALL ".join(_window_sql(w) for w in G.WINDOWS)


@query("T1_request_counts", COUNTS_SQL)
def _(spark, d):
    return G.request_counts(S.requests(spark, d))


LIMITS_SQL = ", ".join(f"('{s}', '{w}', {n})" for s, limits in G.SCOPE_LIMITS.items() for w, n in zip(G.WINDOWS, limits, strict=True))


@query("T2_limit_violations", f"""SELECT c.*, CAST(n AS INTEGER) AS limit_value, request_count - n AS exceeded_by FROM (SELECT identifier, endpoint, window_type, window_start,
  request_count * 40 AS request_count, CASE WHEN endpoint = '/error' THEN 'write' ELSE 'read' END AS scope FROM ({COUNTS_SQL})) c
  JOIN (VALUES {LIMITS_SQL}) l(s, w, n) ON scope = s AND window_type = w WHERE request_count > n""")  # fmt: skip
def _(spark, d):
    # the events are sparse: each stands for 40 requests
    counts = G.request_counts(S.requests(spark, d)).withColumns(
        {
            "request_count": F.col("request_count") * 40,
            "scope": F.when(F.col("endpoint") == "/error", "write").otherwise("read"),
        }
    )
    return G.limit_violations(counts, G.scope_limit("scope", "window_type"))


@query("T3_rolling_request_count", f"""SELECT DISTINCT identifier, "timestamp", COUNT(*) OVER (PARTITION BY identifier, "timestamp") AS request_count,
  COUNT(*) OVER (PARTITION BY identifier ORDER BY "timestamp" RANGE BETWEEN INTERVAL '21599999999 microseconds' PRECEDING AND CURRENT ROW) AS rolling_count,
  COUNT(*) OVER (PARTITION BY identifier ORDER BY "timestamp" RANGE BETWEEN INTERVAL '21599999999 microseconds' PRECEDING AND CURRENT ROW) <= 2 AS allowed FROM {S.REQUESTS} r""")  # fmt: skip
def _(spark, d):
    return G.rolling_request_count(S.requests(spark, d), 21600, max_requests=2)


@query("M7_expired_windows", f"""SELECT identifier, endpoint, window_type, window_start FROM ({COUNTS_SQL}) WHERE window_start +
  CASE window_type WHEN 'minute' THEN INTERVAL 1 MINUTE WHEN 'hour' THEN INTERVAL 1 HOUR ELSE INTERVAL 1 DAY END > {AS_OF_SQL}""")  # fmt: skip
def _(spark, d):
    counts = G.request_counts(S.requests(spark, d))
    return G.expired_windows_removed(counts, AS_OF).select("identifier", "endpoint", "window_type", "window_start")


# quality


@query("Q1_quality_counts", f"""SELECT COUNT(*) AS total, COUNT(CASE WHEN obs_value = '' THEN 1 END) AS empty_values, COUNT(CASE WHEN obs_value IS NULL THEN 1 END) AS null_values FROM {S.RAW} r""")
def _(spark, d):
    return Q.quality_counts(S.raw_observations(spark, d))


@query("Q2_exact_duplicates", f"SELECT COUNT(*) - COUNT(DISTINCT (dataset_id, obs_value, time_period, record_id)) AS exact_duplicates FROM {S.RAW} r")
def _(spark, d):
    return Q.exact_duplicates(S.raw_observations(spark, d), ["dataset_id", "obs_value", "time_period", "record_id"])


@query("Q3_business_duplicates", f"""WITH r AS (SELECT * FROM {S.RAW} x), t AS (SELECT dataset_id, time_period, COUNT(*) AS occurrences FROM r GROUP BY ALL HAVING COUNT(*) > 1
  ORDER BY occurrences DESC, dataset_id, time_period LIMIT 20) SELECT DISTINCT t.dataset_id, t.time_period, occurrences, obs_value AS different_value FROM t
  LEFT JOIN r ON t.dataset_id = r.dataset_id AND t.time_period = r.time_period AND obs_value IS NOT NULL""")  # fmt: skip
def _(spark, d):
    return Q.business_duplicates(S.raw_observations(spark, d))


@query("Q4_duplicate_record_ids", f"""SELECT dataset_id, COUNT(DISTINCT record_id) AS unique_records, COUNT(*) AS total_records, COUNT(*) - COUNT(DISTINCT record_id) AS potential_duplicates
  FROM {S.RAW} r GROUP BY dataset_id HAVING COUNT(*) > COUNT(DISTINCT record_id)""")  # fmt: skip
def _(spark, d):
    return Q.duplicate_record_ids(S.raw_observations(spark, d))


@query("Q5_dedupe_keep_first", f"""SELECT dataset_id, obs_value, time_period, record_id, ingestion_timestamp FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset_id, obs_value, time_period
  ORDER BY ingestion_timestamp, record_id) AS rn FROM {S.RAW} r) WHERE rn = 1""")  # fmt: skip
def _(spark, d):
    kept = Q.dedupe_keep_first(S.raw_observations(spark, d), ["dataset_id", "obs_value", "time_period"], ["ingestion_timestamp", "record_id"])
    return kept.select("dataset_id", "obs_value", "time_period", "record_id", "ingestion_timestamp")


QUALITY_SQL = f"(SELECT dataset_id, obs_value, time_period, territory_code FROM {S.RAW} r)"


def _quality_rows(spark, d):
    raw = S.raw_observations(spark, d)
    return raw.select("dataset_id", "obs_value", "time_period", F.col("additional_attributes")["territory_code"].alias("territory_code"))


@query("Q6_quality_report", f"""WITH q AS (SELECT * FROM {QUALITY_SQL} x), c AS (SELECT DISTINCT * FROM q WHERE obs_value IS NOT NULL AND time_period IS NOT NULL AND territory_code IS NOT NULL
  AND obs_value <> '' AND time_period <> '') SELECT (SELECT COUNT(*) FROM q) AS total_rows, (SELECT COUNT(CASE WHEN obs_value IS NULL THEN 1 END) FROM q) AS missing_values,
  (SELECT COUNT(CASE WHEN obs_value = '' THEN 1 END) FROM q) AS empty_strings, (SELECT COUNT(*) FROM q) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM q)) AS duplicates,
  (SELECT COUNT(*) FROM c) AS cleaned_rows, (SELECT COUNT(*) FROM c) * 100.0::DOUBLE / (SELECT COUNT(*) FROM q) AS completeness_score""")  # fmt: skip
def _(spark, d):
    return Q.quality_report(_quality_rows(spark, d))


@query("Q6_clean_rows", f"SELECT DISTINCT * FROM {QUALITY_SQL} x WHERE obs_value <> '' AND time_period <> '' AND territory_code <> ''")
def _(spark, d):
    return Q.clean(_quality_rows(spark, d))


@query("Q7_dataset_quality_score", """SELECT dataset_id, CASE WHEN n = 0 THEN 50.0 ELSE 100.0 END::DOUBLE - CASE WHEN size < 1000 THEN 10.0 ELSE 0.0 END::DOUBLE AS quality_score,
  CASE WHEN n = 0 THEN 50.0 ELSE 100.0 END::DOUBLE AS completeness, 100.0::DOUBLE AS consistency,
  list_filter([CASE WHEN n = 0 THEN 'no_observations' END, CASE WHEN size < 1000 THEN 'small_payload' END], lambda m: m IS NOT NULL) AS validation_errors
  FROM (SELECT c_custkey AS dataset_id, COUNT(o_orderkey) AS n, COUNT(o_orderkey) * 120 AS size FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND year(o_orderdate) = 1996 GROUP BY c_custkey)""")  # fmt: skip
def _(spark, d):
    counts = S.table(spark, d, "orders").where(F.year("o_orderdate") == 1996).groupBy("o_custkey").agg(F.count("*").alias("n"))
    ids = S.table(spark, d, "customer").select(F.col("c_custkey").alias("dataset_id"))
    n = F.coalesce("n", F.lit(0))
    datasets = ids.join(counts, F.col("dataset_id") == F.col("o_custkey"), "left").select(
        "dataset_id", n.alias("observations_count"), (n * 120).alias("payload_size")
    )
    return Q.dataset_quality_score(datasets).drop("observations_count", "payload_size")


def _share(c: str) -> str:
    return f"COUNT(CASE WHEN {c} IS NULL THEN 1 END) / COUNT(*)::DOUBLE AS {c}"


COLS = ["dataset_id", "obs_value", "time_period", "territory_code"]


@query("Q8_threshold_check", f"""WITH s AS (SELECT {', '.join(_share(c) for c in COLS)} FROM {QUALITY_SQL} x)
  SELECT column_name, null_share, completeness, null_share <= 0.3 AS null_share_ok, completeness >= 0.8 AS completeness_ok FROM (
  {' UNION ALL '.join(f"SELECT '{c}' AS column_name, {c} AS null_share, 1 - (0.0::DOUBLE + {' + '.join(COLS)}) / 4 AS completeness FROM s" for c in COLS)})""")  # fmt: skip
def _(spark, d):
    return Q.threshold_check(_quality_rows(spark, d))


# table-client options


@query("O1_filter_eq_ne", "SELECT o_orderkey, o_orderstatus FROM orders WHERE CAST(o_custkey AS VARCHAR) = '42' AND o_orderstatus <> 'F'")
def _(spark, d):
    rows = O.filter_rows(S.table(spark, d, "orders"), [("o_custkey", "eq", "42"), ("o_orderstatus", "ne", "F")])
    return rows.select("o_orderkey", "o_orderstatus")


@query("O2_filter_gt", f"SELECT record_id, obs_value FROM {S.RAW} r WHERE TRY_CAST(obs_value AS DOUBLE) > 50000")
def _(spark, d):
    return O.filter_rows(S.raw_observations(spark, d).select("record_id", "obs_value"), [("obs_value", "gt", "50000")])


@query("O3_filter_contains", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def _(spark, d):
    return O.filter_rows(S.table(spark, d, "part").select("p_partkey", "p_name"), [("p_name", "contains", "RING")])


@query("O4_order_by", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def _(spark, d):
    return O.query(S.table(spark, d, "customer"), order="c_acctbal desc", top=100, select=["c_custkey", "c_name"])


@query("O5_skip_top_select", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 40""")
def _(spark, d):
    return O.query(
        S.table(spark, d, "orders"), [("o_orderstatus", "eq", "O")], "o_totalprice asc", skip=40, top=20, select=["o_orderkey", "o_totalprice", "missing"]
    )


@query("O5_count", "SELECT COUNT(*) AS count FROM orders WHERE o_orderstatus = 'O'")
def _(spark, d):
    return O.query_count(S.table(spark, d, "orders"), [("o_orderstatus", "eq", "O")])


ENTITY_SQL = f"""SELECT CAST(ROW_NUMBER() OVER (ORDER BY time_period NULLS LAST, record_id NULLS LAST, dataset_id, TRY_CAST(time_period AS INTEGER) NULLS LAST, territory_code, territory_name,
  measure_code, measure_name, TRY_CAST(obs_value AS DOUBLE) NULLS LAST, status NULLS LAST) AS BIGINT) AS "Id", dataset_id AS "DatasetId",
  CASE WHEN regexp_full_match(time_period, '[0-9]+') THEN CAST(time_period AS INTEGER) END AS "Year", time_period AS "TimePeriod", territory_code AS "TerritoryCode",
  territory_name AS "TerritoryName", measure_code AS "MeasureCode", measure_name AS "MeasureName", TRY_CAST(obs_value AS DOUBLE) AS "ObsValue", status AS "ObsStatus"
  FROM (SELECT *, CASE WHEN obs_value = 'c' THEN 'c' ELSE obs_status END AS status FROM {S.RAW} r WHERE dataset_id = '7')"""


@query("O6_observations_of_dataset", f"""SELECT * FROM ({ENTITY_SQL}) WHERE "ObsValue" > 20000""")
def _(spark, d):
    return O.observation_entities(S.raw_observations(spark, d), "7", [("ObsValue", "gt", "20000")])


@query("O7_row_ids", ENTITY_SQL)
def _(spark, d):
    return O.observation_entities(S.raw_observations(spark, d), "7")


@query("O7_row_ids_whole_table", "SELECT ROW_NUMBER() OVER (ORDER BY l_shipdate, l_orderkey, l_partkey, l_linenumber, l_quantity) AS id, l_shipdate, l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem")
def _(spark, d):
    from statspine.operators.ranking import global_row_number

    rows = S.table(spark, d, "lineitem").select("l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return global_row_number(rows, ["l_shipdate"], "id")


@query("O8_dataset_entities", f"""SELECT r.dataset_id AS "DatasetId", name AS "Name", category AS "Category", description AS "Description", priority AS "Priority",
  COALESCE(s.record_count, 0) AS "RecordCount", min_year AS "MinYear", max_year AS "MaxYear", COALESCE(territory_count, 0) AS "TerritoryCount",
  COALESCE(measure_count, 0) AS "MeasureCount" FROM {S.REGISTRY} r LEFT JOIN {STATS} s ON r.dataset_id = s.dataset_id""")  # fmt: skip
def _(spark, d):
    return O.dataset_entities(S.registry(spark, d), D.dataset_stats(S.star(spark, d)))
