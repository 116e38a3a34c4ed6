"""The statistical tables, derived from the given tables, as DataFrames and as SQL.

Datasets are customers, series are orders, observations are line items; the audit log
and the requests are the events; the registry is the customers again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statspine.model import Star


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("dataset_id"),
        F.col("c_name").alias("dataset_name"),
        F.col("c_mktsegment").alias("category"),
        F.expr("CAST(c_custkey % 10 AS INT)").alias("priority"),
        F.expr("CAST(c_custkey % 101 AS DOUBLE)").alias("completeness_score"),
        F.col("c_acctbal").alias("data_quality_score"),
        F.expr("concat('unit_', CAST(c_custkey % 3 AS STRING))").alias("unit_of_measure"),
    )


METADATA = """(SELECT c_custkey AS dataset_id, c_name AS dataset_name, c_mktsegment AS category,
  CAST(c_custkey % 10 AS INTEGER) AS priority, CAST(c_custkey % 101 AS DOUBLE) AS completeness_score,
  c_acctbal AS data_quality_score, 'unit_' || CAST(c_custkey % 3 AS VARCHAR) AS unit_of_measure FROM customer)"""


def territories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        "n_nationkey",
        F.expr(
            "concat(CASE WHEN n_regionkey IN (0, 1) THEN 'IT' ELSE 'E' END, chr(65 + n_regionkey), CAST(n_nationkey AS STRING))"
        ).alias("territory_code"),
        F.col("n_name").alias("territory_name"),
    )


TERRITORIES = """(SELECT n_nationkey, (CASE WHEN n_regionkey IN (0, 1) THEN 'IT' ELSE 'E' END) || chr(65 + n_regionkey)
  || CAST(n_nationkey AS VARCHAR) AS territory_code, n_name AS territory_name FROM nation)"""


def series(spark: SparkSession, sf_dir: str, territory: bool = True) -> DataFrame:
    """``territory=False`` leaves the two territory columns, and the joins for them, out."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("dataset_id"),
        F.year("o_orderdate").alias("year"),
        F.expr(
            "CASE o_orderkey % 3 WHEN 0 THEN date_format(o_orderdate, 'yyyy') "
            "WHEN 1 THEN concat(date_format(o_orderdate, 'yyyy'), '-Q', CAST(quarter(o_orderdate) AS STRING)) "
            "ELSE date_format(o_orderdate, 'yyyy-MM') END"
        ).alias("time_period"),
        F.quarter("o_orderdate").alias("quarter"),
        F.col("o_orderpriority").alias("measure_code"),
        F.concat(F.lit("Measure "), "o_orderpriority").alias("measure_name"),
    )
    if not territory:
        return rows
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("dataset_id"), "c_nationkey")
    places = customers.join(territories(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.join(places.drop("c_nationkey", "n_nationkey"), "dataset_id")


SERIES = f"""(SELECT o_orderkey AS id, o_custkey AS dataset_id, CAST(year(o_orderdate) AS INTEGER) AS year,
  CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y')
    WHEN 1 THEN strftime(o_orderdate, '%Y') || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR)
    ELSE strftime(o_orderdate, '%Y-%m') END AS time_period,
  CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
  o_orderpriority AS measure_code, 'Measure ' || o_orderpriority AS measure_name, territory_code, territory_name
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN {TERRITORIES} t ON c_nationkey = n_nationkey)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("dataset_row_id"),
        F.expr("CASE WHEN l_quantity > 1 THEN CAST(l_extendedprice AS DECIMAL(20,6)) END").alias("obs_value"),
        F.col("l_linestatus").alias("obs_status"),
        F.col("l_returnflag").alias("value_type"),
    )


OBSERVATIONS = """(SELECT l_orderkey AS dataset_row_id,
  CASE WHEN l_quantity > 1 THEN CAST(l_extendedprice AS DECIMAL(20,6)) END AS obs_value,
  l_linestatus AS obs_status, l_returnflag AS value_type FROM lineitem)"""


def star(spark: SparkSession, sf_dir: str, territory: bool = True) -> Star:
    return Star(metadata(spark, sf_dir), series(spark, sf_dir, territory), observations(spark, sf_dir))


JOINED = f"{SERIES} d JOIN {OBSERVATIONS} o ON d.id = o.dataset_row_id JOIN {METADATA} m ON d.dataset_id = m.dataset_id"
SERIES_OBS = f"{SERIES} d JOIN {OBSERVATIONS} o ON d.id = o.dataset_row_id"
# the mean as its exact sum over its count
AVG = "CAST(SUM(o.obs_value) AS DOUBLE) / NULLIF(COUNT(o.obs_value), 0)"


def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text observations with attributes, in 40 datasets; with empty, missing, flag and stray values."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.expr("l_orderkey * 10 + l_linenumber").alias("record_id"),
        F.col("l_shipdate").alias("ingestion_timestamp"),
        F.expr(
            "CASE WHEN l_linenumber = 7 THEN '' WHEN l_linenumber = 6 THEN NULL "
            "WHEN l_linenumber = 5 AND l_returnflag = 'R' THEN 'c' "
            "ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) END"
        ).alias("obs_value"),
        F.expr("l_linenumber = 4 AND l_returnflag = 'N'").alias("_stray"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("_stamp"),
        "l_linestatus",
    )
    rows = lines.join(series(spark, sf_dir), F.col("l_orderkey") == F.col("id"))
    pairs = [
        p
        for c in ("territory_code", "territory_name", "measure_code", "measure_name")
        for p in (F.lit(c), F.col(c))
    ]
    return rows.select(
        (F.col("dataset_id") % 40).cast("string").alias("dataset_id"),
        "record_id",
        "ingestion_timestamp",
        "obs_value",
        F.when(F.col("_stray"), F.col("_stamp")).otherwise(F.col("time_period")).alias("time_period"),
        F.create_map(*pairs, F.lit("obs_status"), F.when(F.col("obs_value") != "c", F.col("l_linestatus"))).alias(
            "additional_attributes"
        ),
    )


RAW = f"""(SELECT CAST(dataset_id % 40 AS VARCHAR) AS dataset_id, l_orderkey * 10 + l_linenumber AS record_id,
  l_shipdate AS ingestion_timestamp,
  CASE WHEN l_linenumber = 7 THEN '' WHEN l_linenumber = 6 THEN NULL
    WHEN l_linenumber = 5 AND l_returnflag = 'R' THEN 'c'
    ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS obs_value,
  CASE WHEN l_linenumber = 4 AND l_returnflag = 'N' THEN strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') ELSE time_period END AS time_period,
  territory_code, territory_name, measure_code, measure_name, l_linestatus,
  CASE WHEN l_linenumber = 5 AND l_returnflag = 'R' OR l_linenumber = 6 THEN NULL ELSE l_linestatus END AS obs_status
  FROM lineitem JOIN {SERIES} s ON l_orderkey = s.id)"""


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type").alias("action"),
        F.expr("concat('type_', CAST(event_id % 3 AS STRING))").alias("resource_type"),
        F.expr("CAST(event_id % 50 AS STRING)").alias("resource_id"),
        F.expr("event_type <> 'error'").alias("success"),
        F.expr("CASE WHEN event_type = 'error' THEN 'failed' END").alias("error_message"),
        F.col("value").alias("execution_time_ms"),
        F.col("ts").alias("timestamp"),
        F.col("props").alias("details_json"),
    )


AUDIT = """(SELECT event_id AS id, CAST(user_id AS VARCHAR) AS user_id, event_type AS action,
  'type_' || CAST(event_id % 3 AS VARCHAR) AS resource_type, CAST(event_id % 50 AS VARCHAR) AS resource_id,
  event_type <> 'error' AS success, CASE WHEN event_type = 'error' THEN 'failed' END AS error_message,
  value AS execution_time_ms, ts AS "timestamp", props AS details_json FROM events)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("identifier"),
        F.concat(F.lit("/"), "event_type").alias("endpoint"),
        F.col("ts").alias("timestamp"),
        F.col("value").alias("execution_time_ms"),
        F.expr("event_type <> 'error'").alias("success"),
    )


REQUESTS = """(SELECT CAST(user_id AS VARCHAR) AS identifier, '/' || event_type AS endpoint, ts AS "timestamp",
  value AS execution_time_ms, event_type <> 'error' AS success FROM events)"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("dataset_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("category"),
        F.expr("CASE WHEN c_custkey % 7 <> 0 THEN concat('Accounts of ', c_mktsegment, ' nr ', CAST(c_custkey AS STRING)) END").alias("description"),
        F.expr("CAST(c_custkey % 10 AS INT)").alias("priority"),
        F.expr("c_custkey % 4 <> 0").alias("is_active"),
        F.col("c_acctbal").alias("quality_score"),
        F.expr("c_custkey % 1000").alias("record_count"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(c_custkey % 5000 AS INT), 0)").alias("updated_at"),
    ).withColumn("last_updated", F.col("updated_at"))


REGISTRY = """(SELECT c_custkey AS dataset_id, c_name AS name, c_mktsegment AS category,
  CASE WHEN c_custkey % 7 <> 0 THEN 'Accounts of ' || c_mktsegment || ' nr ' || CAST(c_custkey AS VARCHAR) END AS description,
  CAST(c_custkey % 10 AS INTEGER) AS priority, c_custkey % 4 <> 0 AS is_active, c_acctbal AS quality_score,
  c_custkey % 1000 AS record_count, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c_custkey % 5000) AS updated_at,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c_custkey % 5000) AS last_updated FROM customer)"""


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = "CASE s_suppkey % 3 WHEN 0 THEN array('read') WHEN 1 THEN array('read', 'write') ELSE array('admin', 'export', 'read') END"
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.expr(scopes).alias("scopes"),
        F.expr("s_suppkey % 5 <> 0").alias("is_active"),
        F.expr("s_suppkey * 37 % 1000").alias("usage_count"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(s_suppkey % 30 AS INT), 0, 0, 0)").alias("last_used"),
    )


API_KEYS = """(SELECT s_suppkey AS id, s_name AS name,
  CASE s_suppkey % 3 WHEN 0 THEN ['read'] WHEN 1 THEN ['read', 'write'] ELSE ['admin', 'export', 'read'] END AS scopes,
  s_suppkey % 5 <> 0 AS is_active, s_suppkey * 37 % 1000 AS usage_count,
  TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(s_suppkey % 30 AS INTEGER)) AS last_used FROM supplier)"""


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User settings: one text column and its declared type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.expr("concat(event_type, '.', CAST(event_id % 11 AS STRING))").alias("preference_key"),
        F.expr(
            "CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN CASE WHEN event_id % 4 = 1 THEN 'Yes' ELSE 'off' END "
            "WHEN 2 THEN CAST(CAST(value AS DECIMAL(18,2)) AS STRING) WHEN 3 THEN CAST(event_id AS STRING) "
            "WHEN 4 THEN event_type ELSE concat('n', CAST(event_id AS STRING)) END"
        ).alias("preference_value"),
        F.expr(
            "CASE event_id % 6 WHEN 0 THEN 'json' WHEN 1 THEN 'boolean' WHEN 2 THEN 'number' WHEN 3 THEN 'integer' "
            "WHEN 4 THEN 'string' ELSE 'number' END"
        ).alias("preference_type"),
        F.expr("event_id % 9 = 0").alias("is_encrypted"),
    )


SETTINGS = """(SELECT event_id AS id, CAST(user_id AS VARCHAR) AS user_id,
  event_type || '.' || CAST(event_id % 11 AS VARCHAR) AS preference_key,
  CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN CASE WHEN event_id % 4 = 1 THEN 'Yes' ELSE 'off' END
    WHEN 2 THEN CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) WHEN 3 THEN CAST(event_id AS VARCHAR)
    WHEN 4 THEN event_type ELSE 'n' || CAST(event_id AS VARCHAR) END AS preference_value,
  CASE event_id % 6 WHEN 0 THEN 'json' WHEN 1 THEN 'boolean' WHEN 2 THEN 'number' WHEN 3 THEN 'integer'
    WHEN 4 THEN 'string' ELSE 'number' END AS preference_type,
  event_id % 9 = 0 AS is_encrypted FROM events)"""
