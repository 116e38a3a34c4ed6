"""Ingestion, storage and export queries. Files are written by Spark from the given
tables into the shared scratch folder and read back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statspine.operators import partitioning as N
from statspine.plans import standin as S
from statspine.plans.catalog import SQL, query
from statspine.session import scratch_dir
from statspine.sinks import export as K
from statspine.sources import sdmx as X
from statspine.sources import store as I

NOW = datetime(2024, 1, 20)
ORDERS_PER_FILE = 250_000
ROOT = "message:GenericData"
HEADER = f'<?xml version="1.0" encoding="UTF-8"?>\n<!-- <not a="tag"> -->\n<{ROOT}>\n<message:DataSet>'
FOOTER = f"</message:DataSet>\n</{ROOT}>"

# dataset of a line item: orders spread over as many files as their number asks for
FILES_SQL = f"(SELECT CAST(greatest(4, ceil(COUNT(*) / {ORDERS_PER_FILE}.0)) AS BIGINT) FROM orders)"
DATASET_SQL = f"'DS_' || CAST(l_orderkey % {FILES_SQL} AS VARCHAR)"
# datasets whose number leaves 3 (mod 4) are cut off in the middle
WHOLE_SQL = f"(l_orderkey % {FILES_SQL}) % 4 <> 3"


def write_sdmx(spark: SparkSession, sf_dir: str) -> str:
    """Line items as SDMX files, one per dataset; returns the folder.

    Line 7 has an empty value, line 6 none, line 5 carries plain attributes and, of even orders, closes itself; line 4
    of flag N has a timestamp as its period; dataset 1 gives its periods without an id, dataset 2 has observations
    without a prefix, dataset 0 with another one. One more file has no observation.
    """
    path = scratch_dir(spark, "sdmx")
    orders = S.table(spark, sf_dir, "orders").count()
    files = max(4, -(-orders // ORDERS_PER_FILE))
    number = lambda key: (F.col(key) % files).alias("_d")
    lines = S.table(spark, sf_dir, "lineitem").select(
        number("l_orderkey"), F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), "l_returnflag", "l_linestatus", "l_shipdate",
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("v"),
    )
    stray = (F.col("b") == 4) & (F.col("l_returnflag") == "N")
    period = F.when(stray, F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("l_shipdate", "yyyy-MM"))
    dimension = F.concat(
        F.when(F.col("_d") == 1, "<generic:ObsDimension").otherwise('<generic:ObsDimension id="TIME_PERIOD"'),
        F.lit(' value="'), period, F.lit('"/>'),
    )
    value = (
        F.when(F.col("b") == 7, '<generic:ObsValue value=""/>')
        .when(F.col("b") == 6, "")
        .otherwise(F.concat(F.lit('<generic:ObsValue value="'), F.col("v"), F.lit('"/>')))
    )
    status = F.concat(
        F.lit('<generic:Attributes><generic:Value id="OBS_STATUS" value="'), F.col("l_linestatus"), F.lit('"/></generic:Attributes>')
    )
    nested = F.concat(F.lit("<generic:Obs>"), dimension, value, status, F.lit("</generic:Obs>"))
    plain = F.concat(
        F.lit("<generic:Obs TIME_PERIOD='"), period, F.lit("' OBS_VALUE=\""), F.col("v"), F.lit('" note="'),
        F.col("l_returnflag"), F.when(F.col("a") % 2 == 0, ' &amp; more"/>').otherwise(' &amp; more"></generic:Obs>'),
    )
    text = F.when(F.col("b") == 5, plain).otherwise(nested)
    for number_, prefix in ((2, ""), (0, "gen:")):
        renamed = F.regexp_replace(text, r"(</?)generic:Obs(?=[\s>])", f"$1{prefix}Obs")
        text = F.when(F.col("_d") == number_, renamed).otherwise(text)
    obs = lines.select("_d", "a", "b", text.alias("t"))
    series = lines.select("_d", "a").distinct()
    opened = series.select("_d", "a", F.lit(-1).alias("b"), F.concat(F.lit('<generic:Series>\n<generic:SeriesKey><generic:Value id="ORDER" value="'), F.col("a").cast("string"), F.lit('"/></generic:SeriesKey>')).alias("t"))
    closed = series.select("_d", "a", F.lit(1_000_000).alias("b"), F.lit("</generic:Series>").alias("t"))
    datasets = series.select("_d").distinct()
    head = datasets.select("_d", F.lit(-1).cast("long").alias("a"), F.lit(0).alias("b"), F.lit(HEADER).alias("t"))
    foot = datasets.where("_d % 4 <> 3").select("_d", F.lit(2**62).alias("a"), F.lit(0).alias("b"), F.lit(FOOTER).alias("t"))
    rows = obs.unionByName(opened).unionByName(closed).unionByName(head).unionByName(foot)
    (
        rows.withColumn("dataset_id", F.concat(F.lit("DS_"), F.col("_d").cast("string")))
        .repartition("dataset_id")
        .sortWithinPartitions("dataset_id", "a", "b", "t")
        .select("dataset_id", F.col("t").alias("value"))
        .write.partitionBy("dataset_id")
        .text(path)
    )
    none = spark.range(1).select(F.lit("DS_NONE").alias("dataset_id"), F.lit(HEADER + FOOTER).alias("value"))
    none.write.mode("append").partitionBy("dataset_id").text(path)
    return path


STRAY = "(l_linenumber = 4 AND l_returnflag = 'N')"
PERIOD = "strftime(l_shipdate, '%Y-%m')"
VALUE = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)"
PARSED_SQL = f"""SELECT {DATASET_SQL} AS dataset_id, CASE WHEN l_linenumber IN (6, 7) THEN NULL ELSE {VALUE} END AS obs_value,
  CASE WHEN {STRAY} OR (l_orderkey % {FILES_SQL} = 1 AND l_linenumber <> 5) THEN '' ELSE {PERIOD} END AS time_period,
  CASE WHEN l_linenumber = 5 THEN l_returnflag || ' & more' END AS note FROM lineitem WHERE {WHOLE_SQL}"""


@query("I1_ingest_sdmx", PARSED_SQL)
def _(spark, d):
    rows = X.ingest_sdmx(spark, write_sdmx(spark, d), NOW)
    return rows.select("dataset_id", "obs_value", "time_period", F.col("additional_attributes")["obs_note"].alias("note"))


@query("I1_record_ids", f"""SELECT {DATASET_SQL} AS dataset_id, COUNT(*) AS records, CAST(0 AS BIGINT) AS first_id, COUNT(*) - 1 AS last_id, COUNT(*) AS ids
  FROM lineitem WHERE {WHOLE_SQL} GROUP BY 1""")  # fmt: skip
def _(spark, d):
    rows = X.ingest_sdmx(spark, write_sdmx(spark, d), NOW)
    return rows.groupBy("dataset_id").agg(
        F.count("*").alias("records"),
        F.min("record_id").alias("first_id"),
        F.max("record_id").alias("last_id"),
        F.count_distinct("record_id").alias("ids"),
    )


@query("I1_files_without_observations", "SELECT 'DS_NONE' AS dataset_id, (SELECT COUNT(*) FROM orders) > 0 AS looked")
def _(spark, d):
    index = X.file_index(X.read_fragments(spark, write_sdmx(spark, d)))
    return X.files_without_observations(index).select("dataset_id", F.lit(True).alias("looked"))


def write_compact(spark: SparkSession, sf_dir: str) -> str:
    """Orders as elements of other names, one file for each remainder of their key by 6; returns the folder.

    0: rows with a period and a value among their attributes, every third closed by an end tag; 1: cells with an obsValue
    and, of even customers, a period in a child; 2: numbers as text between texts; 3: as 0, each after an observation that is
    commented out, every fifth inside a comment over two of them; 4: as 0, nested across each other; 5: as 0, in a comment
    that is never closed.
    """
    path = scratch_dir(spark, "compact")
    key, value = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    period = F.date_format("o_orderdate", "yyyy-MM")
    row = F.concat(F.lit('<Row TIME_PERIOD="'), period, F.lit('" STATUS="a &gt; b" obsValue="'), value, F.when(key % 18 < 6, '"></Row>').otherwise('"/>'))
    child = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit('<x:ObsDimension id="TIME_PERIOD" value="'), period, F.lit('"/>'))).otherwise("")
    gone = F.lit('<Obs><ObsValue value="1"/></Obs>')
    text = (
        F.when(key % 6 == 1, F.concat(F.lit('<cell obsValue="'), value, F.lit('">'), child, F.lit("</cell>")))
        .when(key % 6 == 2, F.concat(F.lit("<name>order "), key.cast("string"), F.lit("</name><total>"), value, F.lit("</total>")))
        .when((key % 6 == 3) & (key % 5 == 0), F.concat(F.lit("<!-- "), gone, row, gone, F.lit(" -->")))
        .when(key % 6 == 3, F.concat(F.lit("<!-- "), gone, F.lit(" -->"), row))
        .when(key % 6 == 4, F.concat(F.lit("<a><b>"), row, F.lit("</a></b>")))
        .otherwise(row)
    )
    lines = S.table(spark, sf_dir, "orders").select((key % 6).alias("_d"), key.alias("a"), text.alias("value"))
    every = lines.select("_d").distinct()
    head = every.select("_d", F.lit(-1).cast("long").alias("a"), F.when(F.col("_d") == 5, "<D><!-- ").otherwise("<D>").alias("value"))
    foot = every.select("_d", F.lit(2**62).alias("a"), F.lit("</D>").alias("value"))
    rows = lines.unionByName(head).unionByName(foot).withColumn("dataset_id", F.concat(F.lit("CO_"), F.col("_d").cast("string")))
    rows.repartition("dataset_id").sortWithinPartitions("dataset_id", "a").select("dataset_id", "value").write.partitionBy("dataset_id").text(path)
    return path


TOTAL, MONTH = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)", "strftime(o_orderdate, '%Y-%m')"


@query("I1_elements_of_any_name", f"""SELECT 'CO_' || CAST(o_orderkey % 6 AS VARCHAR) AS dataset_id, CAST(ROW_NUMBER() OVER (PARTITION BY o_orderkey % 6 ORDER BY o_orderkey) - 1 AS BIGINT) AS record_id,
  CASE WHEN o_orderkey % 6 <> 2 THEN {TOTAL} END AS obs_value, CASE WHEN o_orderkey % 6 IN (0, 3) OR (o_orderkey % 6 = 1 AND o_custkey % 2 = 0) THEN {MONTH} ELSE '' END AS time_period,
  CASE WHEN o_orderkey % 6 = 2 THEN {TOTAL} END AS number FROM orders WHERE o_orderkey % 6 < 4 AND NOT (o_orderkey % 6 = 3 AND o_orderkey % 5 = 0)""")  # fmt: skip
def _(spark, d):
    rows = X.ingest_sdmx(spark, write_compact(spark, d), NOW)
    return rows.select("dataset_id", "record_id", "obs_value", "time_period", F.col("additional_attributes")["raw_text"].alias("number"))


@query("I4_crossed_and_unclosed", """SELECT DISTINCT 'CO_' || CAST(o_orderkey % 6 AS VARCHAR) AS dataset_id,
  CASE WHEN o_orderkey % 6 = 4 THEN 'not well-formed: unbalanced tags' ELSE 'not well-formed: invalid token' END AS parse_error FROM orders WHERE o_orderkey % 6 IN (4, 5)""")  # fmt: skip
def _(spark, d):
    fragments = X.read_fragments(spark, write_compact(spark, d))
    return X.quarantine(fragments, X.file_index(fragments), NOW).select("dataset_id", "parse_error")


@query("I2_clean_observations", f"""SELECT record_id, CASE WHEN obs_value = '' OR (length(obs_value) > 15 AND (contains(obs_value, 'T') OR regexp_matches(obs_value, '-.*-'))) THEN NULL ELSE obs_value END AS obs_value,
  CASE WHEN time_period IS NULL OR (length(time_period) > 15 AND (contains(time_period, 'T') OR regexp_matches(time_period, '-.*-'))) THEN '' ELSE time_period END AS time_period
  FROM (SELECT record_id, CASE WHEN record_id % 50 = 1 THEN '2024-01-01 00:00:00' ELSE obs_value END AS obs_value, time_period FROM {S.RAW} r)""")  # fmt: skip
def _(spark, d):
    raw = S.raw_observations(spark, d).select("record_id", "obs_value", "time_period")
    raw = raw.withColumn("obs_value", F.when(F.col("record_id") % 50 == 1, "2024-01-01 00:00:00").otherwise(F.col("obs_value")))
    return X.clean_observations(raw)


@query("I3_attributes_map", f"""WITH l AS (SELECT *, l_orderkey % {FILES_SQL} AS ds, CASE WHEN {STRAY} THEN strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') ELSE {PERIOD} END AS p FROM lineitem),
  kv AS (SELECT 'obsdimension_id' AS key, 'TIME_PERIOD' AS value FROM l WHERE l_linenumber <> 5 AND ds <> 1 UNION ALL SELECT 'obsdimension_value', p FROM l WHERE l_linenumber <> 5
  UNION ALL SELECT 'obsvalue_value', CASE WHEN l_linenumber = 7 THEN '' ELSE {VALUE} END FROM l WHERE l_linenumber NOT IN (5, 6) UNION ALL SELECT 'obs_time_period', p FROM l WHERE l_linenumber = 5
  UNION ALL SELECT 'obs_obs_value', {VALUE} FROM l WHERE l_linenumber = 5 UNION ALL SELECT 'obs_note', l_returnflag || ' & more' FROM l WHERE l_linenumber = 5)
  SELECT key, COUNT(*) AS n, COUNT(DISTINCT value) AS distinct_values FROM kv GROUP BY key""")  # fmt: skip
def _(spark, d):
    parsed = X.parse_observations(X.elements(X.read_fragments(spark, write_sdmx(spark, d))))
    # explode() would push a test of the map below the parse and run it twice
    pairs = parsed.select(F.explode_outer("additional_attributes"))
    return pairs.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("value").alias("distinct_values"))


@query("I4_quarantine_malformed", f"""SELECT DISTINCT {DATASET_SQL} AS dataset_id, 'not well-formed: unbalanced tags' AS parse_error, TIMESTAMP '2024-01-20' AS ingestion_timestamp,
  true AS has_sample FROM lineitem WHERE NOT ({WHOLE_SQL})""")  # fmt: skip
def _(spark, d):
    fragments = X.read_fragments(spark, write_sdmx(spark, d))
    rows = X.quarantine(fragments, X.file_index(fragments), NOW)
    sample = F.col("raw_data_sample").startswith(HEADER) & (F.length("raw_data_sample") == 500)
    stamp = F.col("ingestion_timestamp").cast("timestamp_ntz").alias("ingestion_timestamp")
    return rows.select("dataset_id", "parse_error", stamp, sample.alias("has_sample"))


@query("I5_dataset_overrides", f"""SELECT {DATASET_SQL} AS dataset_id, CASE WHEN l_linenumber = 5 THEN {VALUE} WHEN l_linenumber IN (6, 7) THEN NULL ELSE {VALUE} END AS obs_value,
  CASE WHEN {STRAY} OR (l_orderkey % {FILES_SQL} = 1 AND l_linenumber IN (6, 7)) THEN '' ELSE {PERIOD} END AS time_period FROM lineitem""")  # fmt: skip
def _(spark, d):
    parsed = X.parse_observations(X.elements(X.read_fragments(spark, write_sdmx(spark, d))), overrides=("DS_1",))
    return X.clean_observations(parsed).select("dataset_id", "obs_value", "time_period")


LOADED = "CAST(dataset_id AS INTEGER) % 4 = 0"


@query("I6_skip_loaded_datasets", f"SELECT dataset_id, record_id FROM {S.RAW} r WHERE NOT ({LOADED})")
def _(spark, d):
    raw = S.raw_observations(spark, d)
    return I.skip_loaded_datasets(raw, raw.where("CAST(dataset_id AS INT) % 4 = 0")).select("dataset_id", "record_id")


@query("I6_skipped_report", f"SELECT dataset_id, COUNT(*) AS existing_records FROM {S.RAW} r WHERE {LOADED} GROUP BY dataset_id")
def _(spark, d):
    raw = S.raw_observations(spark, d)
    return I.skipped_datasets(raw, raw.where("CAST(dataset_id AS INT) % 4 = 0"))


NEW_SQL = f"""(SELECT * FROM {S.RAW} r WHERE NOT EXISTS (SELECT 1 FROM {S.RAW} k WHERE k.record_id % 3 = 0 AND k.dataset_id = r.dataset_id
  AND k.obs_value IS NOT DISTINCT FROM r.obs_value AND k.time_period IS NOT DISTINCT FROM r.time_period))"""


@query("I7_new_records_only", f"SELECT dataset_id, record_id, obs_value, time_period FROM {NEW_SQL} n")
def _(spark, d):
    raw = S.raw_observations(spark, d).drop("additional_attributes")
    return I.new_records_only(raw, raw.where("record_id % 3 = 0")).select("dataset_id", "record_id", "obs_value", "time_period")


STORED_SQL = f"(SELECT * FROM {S.RAW} s WHERE {LOADED})"
REPORT_SQL = f"""(SELECT dataset_id, SUM(CASE WHEN {LOADED} THEN 0 ELSE 1 END)::BIGINT AS records_processed, SUM(CASE WHEN {LOADED} THEN 1 ELSE 0 END)::BIGINT AS records_skipped,
  SUM(CASE WHEN obs_value = 'c' THEN 1 ELSE 0 END)::BIGINT AS records_failed, CASE WHEN {LOADED} THEN 'empty' ELSE 'active' END AS status FROM {S.RAW} r GROUP BY dataset_id)"""


def _report(spark, d) -> DataFrame:
    raw = S.raw_observations(spark, d)
    return I.ingest_report(raw, raw.where("CAST(dataset_id AS INT) % 4 = 0"), raw.where("obs_value = 'c'"))


@query("I8_ingest_report", f"SELECT * FROM {REPORT_SQL} r")
def _(spark, d):
    return _report(spark, d)


@query("I8_batch_totals", f"""SELECT COUNT(*) AS total_datasets, COUNT(CASE WHEN records_failed = 0 THEN 1 END) AS successful, COUNT(CASE WHEN records_failed > 0 THEN 1 END) AS failed,
  SUM(records_processed)::BIGINT AS total_records FROM {REPORT_SQL} r""")  # fmt: skip
def _(spark, d):
    return I.batch_totals(_report(spark, d))


@query("I9_dataflow_catalogue", "SELECT 'DF_' || CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 = 0 THEN 'DF_' || CAST(c_custkey AS VARCHAR) ELSE 'Flusso ' || c_name END AS name, 'IT1' AS agency, CASE WHEN c_custkey % 2 = 0 THEN '1.1' ELSE '1.0' END AS version FROM customer")
def _(spark, d):
    path = scratch_dir(spark, "catalogue")
    key = F.col("c_custkey").cast("string")
    flow = F.concat(
        F.lit('<str:Dataflow id="DF_'), key, F.lit('"'),
        F.when(F.col("c_custkey") % 2 == 0, ' agencyID="IT1" version="1.1"').otherwise(""),
        F.lit('><common:Name xml:lang="it">Flusso '), F.col("c_name"), F.lit('</common:Name><common:Name xml:lang="en">Flow '),
        F.col("c_name"), F.lit("</common:Name></str:Dataflow>"),
    )
    # every third entry closes itself, every fifth has another prefix
    alone = F.concat(F.regexp_replace(flow, "><common.*$", ""), F.lit("/>"))
    text = F.when(F.col("c_custkey") % 3 == 0, alone).otherwise(flow)
    text = F.when(F.col("c_custkey") % 5 == 0, F.regexp_replace(text, "str:Dataflow", "s:Dataflow")).otherwise(text)
    S.table(spark, d, "customer").select(text.alias("value")).write.text(path)
    return X.parse_dataflow_catalogue(spark, path)


@query("I10_align_and_append", f"""SELECT CAST(1 AS BIGINT) AS dataset_row_id, 'D1' AS dataset_id, TRY_CAST(time_period AS INTEGER) AS year, territory_code, TRY_CAST(obs_value AS DECIMAL(20,6)) AS obs_value,
  obs_status, 'NUMERIC' AS value_type, 1 AS unit_multiplier, 2 AS decimals, false AS is_estimated, TIMESTAMP '2024-01-20' AS created_at FROM {S.RAW} r""")  # fmt: skip
def _(spark, d):
    raw = S.raw_observations(spark, d)
    source = raw.select(
        F.col("obs_value").alias("OBS_VALUE"),
        F.col("time_period").alias("TIME_PERIOD"),
        F.col("additional_attributes")["territory_code"].alias("TERRITORY"),
        F.col("additional_attributes")["obs_status"].alias("OBS_STATUS"),
        F.lit("x").alias("unknown_column"),
    )
    path = scratch_dir(spark, "append")
    I.append(I.align(source, "D1", NOW), path)
    return I.read_store(spark, path).select(
        "dataset_row_id", "dataset_id", "year", "territory_code", "obs_value", "obs_status", "value_type", "unit_multiplier", "decimals",
        "is_estimated", F.col("created_at").cast("timestamp_ntz").alias("created_at"),
    )


@query("I11_scan_dataset", f"SELECT time_period, obs_value FROM {S.RAW} r WHERE dataset_id = '7' AND time_period >= '1996-01-01' AND time_period <= '1998'")
def _(spark, d):
    return I.scan_dataset(S.raw_observations(spark, d), "7", "1996-01-01", "1998", ["time_period", "obs_value", "no_such_column"])


@query("I11_scan_clustered", SQL["I11_scan_dataset"])
def _(spark, d):
    path = scratch_dir(spark, "clustered")
    I.write_clustered(S.raw_observations(spark, d), path, ["dataset_id", "time_period"], ["dataset_id"])
    return I.scan_dataset(I.read_store(spark, path), "7", "1996-01-01", "1998", ["time_period", "obs_value"])


# export


def _exported(spark, d, fmt: str, name: str = "orders", **options) -> DataFrame:
    rows = S.table(spark, d, name)
    path = scratch_dir(spark, f"export-{fmt}")
    K.export(rows, path, fmt, **options)
    return K.read_export(spark, path, fmt, rows.schema)


@query("K1_export_csv", "SELECT * FROM orders")
def _(spark, d):
    return _exported(spark, d, "csv")


@query("K1_export_csv_nested", f"SELECT dataset_id, record_id, obs_value, time_period, territory_code, measure_name FROM {S.RAW} r")
def _(spark, d):
    raw = S.raw_observations(spark, d)
    path = scratch_dir(spark, "export-csv")
    # an empty value and none are the same in CSV unless they are told apart by a text
    K.export(raw.withColumn("obs_value", F.coalesce("obs_value", F.lit("none"))), path, "csv")
    back = K.read_export(spark, path, "csv", raw.schema)
    attributes = [F.col("additional_attributes")[c].alias(c) for c in ("territory_code", "measure_name")]
    value = F.when(F.col("obs_value").isNull(), "").when(F.col("obs_value") != "none", F.col("obs_value")).alias("obs_value")
    return back.select("dataset_id", "record_id", value, "time_period", *attributes)


@query("K2_export_json", "SELECT * FROM events")
def _(spark, d):
    return _exported(spark, d, "json", "events")


@query("K2_export_json_metadata", "SELECT 'orders' AS dataset_id, COUNT(*) AS total_records, ['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority'] AS columns FROM orders")
def _(spark, d):
    path = scratch_dir(spark, "export-json")
    K.export(S.table(spark, d, "orders"), path, "json", "orders", NOW)
    return spark.read.schema("dataset_id string, total_records long, columns array<string>").json(f"{path}/metadata")


@query("K3_export_parquet", "SELECT * FROM lineitem")
def _(spark, d):
    return _exported(spark, d, "parquet", "lineitem")


@query("K4_export_chunked", "SELECT * FROM lineitem")
def _(spark, d):
    rows = S.table(spark, d, "lineitem")
    path = scratch_dir(spark, "export-chunked")
    K.export_chunked(rows, path, "csv")
    return K.read_export(spark, path, "csv", rows.schema)


@query("K5_export_empty", "SELECT f.format, (SELECT COUNT(*) FROM orders WHERE o_totalprice < 0) AS n FROM (VALUES ('csv'), ('json'), ('parquet')) f(format)")
def _(spark, d):
    rows = S.table(spark, d, "orders").where("o_totalprice < 0")
    parts = []
    for fmt in K.FORMATS:
        path = scratch_dir(spark, f"export-empty-{fmt}")
        K.export(rows, path, fmt)
        parts.append(K.read_export(spark, path, fmt, rows.schema).agg(F.count("*").alias("n")).select(F.lit(fmt).alias("format"), "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("K6_export_filters", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-06-30'")
def _(spark, d):
    return K.export_filters(
        S.table(spark, d, "orders"), ["o_orderkey", "o_orderdate", "o_totalprice", "nothing"], datetime(1996, 1, 1), datetime(1996, 6, 30)
    )


@query("K6_export_filters_text_dates", f"""SELECT dataset_id, CASE WHEN length(time_period) = 4 THEN TRY_CAST(time_period || '-01-01' AS TIMESTAMP) WHEN length(time_period) = 7 AND NOT contains(time_period, 'Q')
  THEN TRY_CAST(time_period || '-01' AS TIMESTAMP) ELSE TRY_CAST(time_period AS TIMESTAMP) END AS time_period, obs_value FROM {S.RAW} r
  WHERE CASE WHEN length(time_period) = 4 THEN TRY_CAST(time_period || '-01-01' AS TIMESTAMP) WHEN length(time_period) = 7 AND NOT contains(time_period, 'Q')
  THEN TRY_CAST(time_period || '-01' AS TIMESTAMP) ELSE TRY_CAST(time_period AS TIMESTAMP) END >= TIMESTAMP '1999-01-01'""")  # fmt: skip
def _(spark, d):
    return K.export_filters(S.raw_observations(spark, d), ["dataset_id", "time_period", "obs_value"], start=datetime(1999, 1, 1))


@query("K6_export_limit", f"SELECT dataset_id, record_id, obs_value FROM {S.RAW} r ORDER BY dataset_id, record_id, ingestion_timestamp, obs_value, time_period LIMIT 100")
def _(spark, d):
    # the rows have a map among their columns
    return K.export_filters(S.raw_observations(spark, d), limit=100).select("dataset_id", "record_id", "obs_value")


@query("K7_export_estimate", f"""SELECT dataset_id, n AS row_count, round(n * 100 / (1024.0 * 1024.0), 2)::DOUBLE AS csv_mb, round(n * 150 / (1024.0 * 1024.0), 2)::DOUBLE AS json_mb,
  round(n * 50 / (1024.0 * 1024.0), 2)::DOUBLE AS parquet_mb, n > 50000 AS recommended_streaming, CASE WHEN n > 10000 THEN 'parquet' ELSE 'csv' END AS optimal_format,
  least(n / 10000.0::DOUBLE, 300.0::DOUBLE) AS estimated_seconds FROM (SELECT dataset_id, COUNT(*) AS n FROM {S.RAW} r GROUP BY dataset_id)""")  # fmt: skip
def _(spark, d):
    return K.export_estimate(S.raw_observations(spark, d))


def _checked(spark, d, fmt: str) -> DataFrame:
    """A folder of good files, one without a required column and one without rows, checked file by file."""
    rows = S.raw_observations(spark, d).select(F.col("time_period").alias("TIME_PERIOD"), F.col("obs_value").alias("OBS_VALUE"))
    path = scratch_dir(spark, "export-checked")
    K.export(rows, f"{path}/good", fmt)
    K.export(S.table(spark, d, "region").select(F.col("r_name").alias("other")).coalesce(1), f"{path}/other", fmt)
    K.export(rows.where("false").coalesce(1), f"{path}/empty", fmt)
    return K.validate_export(spark, path, fmt)


def _check_counts(files: DataFrame) -> DataFrame:
    return files.agg(
        F.sum(F.when(F.col("is_valid"), F.col("row_count"))).alias("valid_rows"),
        F.sum(F.when(~F.col("is_valid"), F.col("row_count"))).alias("other_rows"),
        F.count_if(~F.col("is_valid")).alias("bad_files"),
    )


CHECKED = "SELECT (SELECT COUNT(*) FROM lineitem) AS valid_rows, (SELECT COUNT(*) FROM region) AS other_rows"


@query("K8_validate_export", f"{CHECKED}, 2 AS bad_files")
def _(spark, d):
    return _check_counts(_checked(spark, d, "parquet"))


@query("K8_validate_export_csv", f"{CHECKED}, 2 AS bad_files")
def _(spark, d):
    return _check_counts(_checked(spark, d, "csv"))


@query("K8_validate_export_json", "SELECT COUNT(*) AS valid_rows, true AS passed FROM orders")
def _(spark, d):
    # the metadata beside the records is no data file
    path = scratch_dir(spark, "export-checked")
    K.export(S.table(spark, d, "orders").select(F.col("o_totalprice").alias("OBS_VALUE")), path, "json", "orders", NOW)
    files = K.validate_export(spark, path, "json")
    return files.agg(F.sum(F.when(F.col("is_valid"), F.col("row_count"))).alias("valid_rows"), F.min(F.col("is_valid")).alias("passed"))


@query("N2_write_partitioned", f"SELECT id, dataset_id, year, territory_code, CAST(year // 10 * 10 AS INTEGER) AS decade, substr(territory_code, 1, 2) AS territory_group FROM {S.SERIES} d WHERE year BETWEEN 1996 AND 1999 AND territory_code IN ('ITA0', 'EC2')")
def _(spark, d):
    path = scratch_dir(spark, "partitioned")
    rows = S.series(spark, d).select("id", "dataset_id", "year", "territory_code")
    N.write_partitioned(rows, path)
    return N.prune(N.read_partitioned(spark, path, rows.schema), 1996, 1999, ["ITA0", "EC2"])


@query("N4_stored_partition_stats", f"""SELECT CAST(year // 10 * 10 AS INTEGER) AS decade, substr(territory_code, 1, 2) AS territory_group, COUNT(*) AS row_count,
  MIN(year) AS min_year, MAX(year) AS max_year FROM {S.SERIES} d GROUP BY 1, 2""")  # fmt: skip
def _(spark, d):
    path = scratch_dir(spark, "partitioned")
    rows = S.series(spark, d).select("id", "dataset_id", "year", "territory_code")
    N.write_partitioned(rows, path)
    return N.stored_partition_stats(spark, path, rows.schema)


@query("N2_write_partitioned_text_groups", "SELECT c_custkey AS id, printf('%02d', c_nationkey) AS territory_code, printf('%02d', c_nationkey) AS territory_group, 2020 AS decade FROM customer")
def _(spark, d):
    path = scratch_dir(spark, "partitioned")
    code = F.format_string("%02d", "c_nationkey").alias("territory_code")
    rows = S.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), code, F.lit(2021).alias("year"))
    N.write_partitioned(rows, path)
    return N.read_partitioned(spark, path, rows.schema).drop("year")
