"""Domain analytics over the star."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from statspine.model import Star
from statspine.operators import analytics as D
from statspine.operators.registry import with_analytics
from statspine.plans import standin as S
from statspine.plans.catalog import query

URGENT, LOW = "1-URGENT", "5-LOW"
CATEGORIES = ["BUILDING", "MACHINERY", "HOUSEHOLD"]
IN_CATEGORIES = "('BUILDING', 'MACHINERY', 'HOUSEHOLD')"


def rounded(df, **digits):
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("D1_dataset_summary", f"""SELECT m.dataset_id, m.dataset_name, m.category, m.priority, COUNT(o.dataset_row_id) AS total_observations,
  MIN(d.year) AS min_year, MAX(d.year) AS max_year, COUNT(DISTINCT d.territory_code) AS territory_count, {S.AVG} AS avg_value,
  CAST(MIN(o.obs_value) AS DOUBLE) AS min_value, CAST(MAX(o.obs_value) AS DOUBLE) AS max_value, m.completeness_score, m.data_quality_score
  FROM {S.METADATA} m LEFT JOIN {S.SERIES} d ON m.dataset_id = d.dataset_id LEFT JOIN {S.OBSERVATIONS} o ON d.id = o.dataset_row_id
  GROUP BY m.dataset_id, m.dataset_name, m.category, m.priority, m.completeness_score, m.data_quality_score""")  # fmt: skip
def _(spark, d):
    return D.dataset_summary(S.star(spark, d))


@query("D2_time_series", f"""SELECT d.dataset_id, d.year, time_period, territory_code, territory_name, measure_code, measure_name, obs_value,
  obs_status, category, unit_of_measure FROM {S.JOINED} WHERE obs_value IS NOT NULL AND d.dataset_id IN (1, 5, 17, 42, 99)
  AND d.year BETWEEN 1996 AND 1999""")  # fmt: skip
def _(spark, d):
    return D.time_series(S.star(spark, d), [1, 5, 17, 42, 99], 1996, 1999)


@query("D2_time_series_territories", f"""SELECT d.dataset_id, d.year, time_period, territory_code, territory_name, measure_code, measure_name,
  obs_value, obs_status, category, unit_of_measure FROM {S.JOINED} WHERE obs_value IS NOT NULL AND d.dataset_id BETWEEN 1 AND 80
  AND d.year BETWEEN 1995 AND 2001 AND territory_code IN ('ITA0', 'ITB6', 'EC2', 'ED8')""")  # fmt: skip
def _(spark, d):
    return D.time_series(S.star(spark, d), list(range(1, 81)), 1995, 2001, ["ITA0", "ITB6", "EC2", "ED8"])


@query("D3_territory_aggregates", f"""SELECT territory_code, territory_name, d.year, category, COUNT(*) AS indicator_count, {S.AVG} AS avg_value,
  COUNT(obs_value) AS non_null_count, COUNT(*) AS total_count, COUNT(obs_value) * 100.0::DOUBLE / COUNT(*) AS completeness_pct
  FROM {S.JOINED} GROUP BY territory_code, territory_name, d.year, category""")  # fmt: skip
def _(spark, d):
    return D.territory_aggregates(S.star(spark, d))


@query("D4_territory_comparison", f"""WITH t AS (SELECT territory_code, territory_name, measure_code, measure_name, {S.AVG} AS avg_value,
  CAST(MIN(obs_value) AS DOUBLE) AS min_value, CAST(MAX(obs_value) AS DOUBLE) AS max_value, COUNT(obs_value) AS obs_count,
  round(stddev_samp(CAST(obs_value AS DOUBLE)), 4) AS std_dev FROM {S.SERIES_OBS} WHERE d.year = 1997 AND measure_code IN ('{URGENT}', '{LOW}')
  AND obs_value IS NOT NULL GROUP BY ALL)
  SELECT *, RANK() OVER (PARTITION BY measure_code ORDER BY avg_value DESC) AS value_rank,
  NTILE(4) OVER (PARTITION BY measure_code ORDER BY avg_value, territory_code) AS quartile FROM t""")  # fmt: skip
def _(spark, d):
    return rounded(D.territory_comparison(S.star(spark, d), [URGENT, LOW], 1997), std_dev=4)


@query("D5_territory_comparison_dataset", f"""SELECT *, RANK() OVER (ORDER BY avg_value DESC) AS rank FROM (SELECT territory_code, territory_name,
  COUNT(*) AS indicators, {S.AVG} AS avg_value, CAST(MIN(obs_value) AS DOUBLE) AS min_value, CAST(MAX(obs_value) AS DOUBLE) AS max_value
  FROM {S.SERIES_OBS} WHERE d.measure_code = '{URGENT}' AND d.year = 1997 AND obs_value IS NOT NULL GROUP BY territory_code, territory_name)""")  # fmt: skip
def _(spark, d):
    # a customer has one territory: take the measures as the datasets here
    star = S.star(spark, d)
    series = star.series.withColumn("dataset_id", F.col("measure_code"))
    return D.territory_comparison_dataset(Star(star.metadata, series, star.observations), URGENT, 1997)


@query("D6_territory_comparison_simple", f"""SELECT territory_code, territory_name, {S.AVG} AS avg_value, COUNT(*) AS observation_count
  FROM {S.SERIES_OBS} WHERE measure_code = '{URGENT}' AND d.year = 1997 AND obs_value IS NOT NULL GROUP BY territory_code, territory_name""")  # fmt: skip
def _(spark, d):
    return D.territory_comparison_simple(S.star(spark, d), URGENT, 1997)


@query("D7_category_trends", f"""WITH y AS (SELECT category, d.year, COUNT(DISTINCT d.dataset_id) AS dataset_count, COUNT(obs_value) AS total_observations,
  {S.AVG} AS avg_value, median(CAST(obs_value AS DOUBLE)) AS median_value, stddev_samp(CAST(obs_value AS DOUBLE)) AS std_dev FROM {S.JOINED}
  WHERE category IN {IN_CATEGORIES} AND d.year BETWEEN 1995 AND 2000 AND obs_value IS NOT NULL GROUP BY category, d.year)
  SELECT category, year, dataset_count, total_observations, avg_value, round(median_value, 6) AS median_value, round(std_dev, 4) AS std_dev,
  LAG(avg_value) OVER w AS prev_avg_value, LEAD(avg_value) OVER w AS next_avg_value,
  (avg_value - LAG(avg_value) OVER w) / NULLIF(LAG(avg_value) OVER w, 0) * 100.0 AS year_over_year_change,
  round(CASE WHEN ROW_NUMBER() OVER w >= 3 THEN AVG(avg_value) OVER (PARTITION BY category ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END, 6)
  AS moving_avg_3yr FROM y WINDOW w AS (PARTITION BY category ORDER BY year)""")  # fmt: skip
def _(spark, d):
    trends = D.category_trends(S.star(spark, d, territory=False), CATEGORIES, 1995, 2000)
    return rounded(trends, median_value=6, std_dev=4, moving_avg_3yr=6)


@query("D8_category_trends_simple", f"""SELECT d.year, COUNT(DISTINCT d.dataset_id) AS datasets, COUNT(obs_value) AS total_observations, {S.AVG} AS avg_value,
  round(median(CAST(obs_value AS DOUBLE)), 6) AS median_value FROM {S.JOINED} WHERE category = 'FURNITURE' AND d.year >= 1996 AND obs_value IS NOT NULL GROUP BY d.year""")  # fmt: skip
def _(spark, d):
    return rounded(D.category_trends_simple(S.star(spark, d, territory=False), "FURNITURE", 1996), median_value=6)


@query("D9_category_totals", f"""SELECT d.year, COUNT(DISTINCT d.dataset_id) AS dataset_count, {S.AVG} AS avg_value,
  CAST(SUM(obs_value) AS DOUBLE) AS total_value FROM {S.JOINED} WHERE category = 'FURNITURE' AND obs_value IS NOT NULL GROUP BY d.year""")  # fmt: skip
def _(spark, d):
    return D.category_totals(S.star(spark, d, territory=False), "FURNITURE")


@query("D10_top_performers", f"""SELECT * FROM (SELECT territory_code, territory_name, measure_code, measure_name, unit_of_measure, {S.AVG} AS avg_value,
  COUNT(obs_value) AS obs_count, RANK() OVER (ORDER BY {S.AVG} DESC) AS rank FROM {S.JOINED} WHERE category = 'BUILDING' AND measure_code = '{URGENT}'
  AND d.year = 1998 AND obs_value IS NOT NULL GROUP BY territory_code, territory_name, measure_code, measure_name, unit_of_measure)
  ORDER BY avg_value DESC, territory_code, unit_of_measure LIMIT 10""")  # fmt: skip
def _(spark, d):
    return D.top_performers(S.star(spark, d), "BUILDING", URGENT, 1998, 10)


YEARLY = f"""(SELECT d.dataset_id, territory_code, territory_name, d.year, {S.AVG} AS value FROM {S.SERIES_OBS} WHERE obs_value IS NOT NULL GROUP BY ALL)"""


@query("D11_growth_vs_previous_year", f"""SELECT c.dataset_id, c.territory_code, c.territory_name, c.year, c.value AS current_value, p.value AS previous_value,
  (c.value - p.value) / p.value * 100.0 AS growth_rate FROM {YEARLY} c JOIN {YEARLY} p ON c.dataset_id = p.dataset_id
  AND c.territory_code = p.territory_code WHERE c.year = 1999 AND p.year = 1998 AND p.value > 0
  ORDER BY growth_rate DESC, c.dataset_id, c.territory_code LIMIT 50""")  # fmt: skip
def _(spark, d):
    return D.growth_vs_previous_year(S.star(spark, d), 1999)


def _only(code: str) -> str:
    value = f"CASE WHEN measure_code = '{code}' THEN obs_value END"
    return f"CAST(SUM({value}) AS DOUBLE) / NULLIF(COUNT({value}), 0)"


@query("D12_demographic_split", f"""SELECT d.year, territory_code, territory_name, {_only(URGENT)} AS male_pop, {_only(LOW)} AS female_pop,
  COUNT(DISTINCT d.dataset_id) AS dataset_count FROM {S.JOINED} WHERE category = 'MACHINERY' AND measure_code IN ('{URGENT}', '{LOW}')
  AND d.year BETWEEN 1996 AND 1999 AND obs_value IS NOT NULL GROUP BY d.year, territory_code, territory_name HAVING COUNT(DISTINCT d.dataset_id) > 1
  ORDER BY d.year DESC, male_pop DESC NULLS LAST, territory_code LIMIT 100""")  # fmt: skip
def _(spark, d):
    return D.demographic_split(S.star(spark, d), "MACHINERY", URGENT, LOW, 1996, 1999)


@query("D13_dataset_time_series", f"""SELECT dataset_id, time_period, CASE WHEN regexp_full_match(time_period, '[0-9]+') THEN CAST(time_period AS INTEGER) END AS year,
  TRY_CAST(obs_value AS DOUBLE) AS obs_value, record_id, ingestion_timestamp, territory_code, territory_name, measure_code, measure_name,
  CASE WHEN obs_value = 'c' THEN 'c' ELSE obs_status END AS obs_status FROM {S.RAW} r WHERE dataset_id = '7'""")  # fmt: skip
def _(spark, d):
    return D.dataset_time_series(S.raw_observations(spark, d), "7")


@query("D13_dataset_time_series_years", f"""SELECT dataset_id, time_period, CAST(time_period AS INTEGER) AS year, TRY_CAST(obs_value AS DOUBLE) AS obs_value,
  record_id, ingestion_timestamp, territory_code, territory_name, measure_code, measure_name, CASE WHEN obs_value = 'c' THEN 'c' ELSE obs_status END AS obs_status
  FROM {S.RAW} r WHERE dataset_id = '7' AND TRY_CAST(time_period AS INTEGER) BETWEEN 1996 AND 1999""")  # fmt: skip
def _(spark, d):
    return D.dataset_time_series(S.raw_observations(spark, d), "7", start_year=1996, end_year=1999)


STATS = f"""(SELECT d.dataset_id, COUNT(*) AS record_count, MIN(d.year) AS min_year, MAX(d.year) AS max_year,
  COUNT(DISTINCT territory_code) AS territory_count, COUNT(DISTINCT value_type) AS measure_count FROM {S.SERIES_OBS} GROUP BY d.dataset_id)"""


@query("D14_dataset_stats", f"SELECT * FROM {STATS} s")
def _(spark, d):
    return D.dataset_stats(S.star(spark, d))


@query("D15_kpi_metrics", f"""WITH r AS (SELECT category, d.year, time_period, obs_value, ROW_NUMBER() OVER (PARTITION BY category
    ORDER BY d.year DESC, time_period DESC, o.dataset_row_id DESC, obs_value DESC NULLS LAST) AS rn FROM {S.JOINED}
    WHERE category IN {IN_CATEGORIES} AND d.year BETWEEN 1995 AND 2000),
  k AS (SELECT category, MAX(CASE WHEN rn = 1 THEN CAST(obs_value AS DOUBLE) END) AS latest, MAX(CASE WHEN rn = 2 THEN CAST(obs_value AS DOUBLE) END) AS previous,
    CAST(SUM(obs_value) AS DOUBLE) / NULLIF(COUNT(obs_value), 0) AS avg, COUNT(obs_value) * 100.0::DOUBLE / COUNT(*) AS quality,
    CAST(MIN(obs_value) AS DOUBLE) AS min_value, CAST(MAX(obs_value) AS DOUBLE) AS max_value, MIN(year) AS first_period, MAX(year) AS last_period,
    COUNT(*) AS points FROM r GROUP BY category)
  SELECT category, latest, (latest - previous) / NULLIF(previous, 0) * 100.0 AS growth, avg, quality, min_value, max_value, first_period, last_period, points FROM k""")  # fmt: skip
def _(spark, d):
    return D.kpi_metrics(S.star(spark, d, territory=False), CATEGORIES, 1995, 2000)


@query("D16_freshness_status", f"""SELECT dataset_id, CAST(floor(date_diff('second', updated_at, TIMESTAMP '2024-01-02 12:00:00') / 60) AS BIGINT) AS minutes_ago,
  CASE WHEN updated_at IS NULL THEN 'unknown' WHEN floor(date_diff('second', updated_at, TIMESTAMP '2024-01-02 12:00:00') / 60) < 5 THEN 'fresh'
  WHEN floor(date_diff('second', updated_at, TIMESTAMP '2024-01-02 12:00:00') / 60) < 30 THEN 'recent' ELSE 'stale' END AS status FROM {S.REGISTRY} r""")  # fmt: skip
def _(spark, d):
    # rows newer than the asked time have negative minutes and are fresh
    return D.freshness_status(S.registry(spark, d), "updated_at", datetime(2024, 1, 2, 12)).select("dataset_id", "minutes_ago", "status")


@query("D17_year_territory_averages", f"""SELECT d.year, territory_code, COUNT(*) AS obs_count, {S.AVG} AS avg_value FROM {S.SERIES_OBS}
  WHERE d.year >= 1997 GROUP BY d.year, territory_code""")  # fmt: skip
def _(spark, d):
    return D.year_territory_averages(S.star(spark, d), 1997)


@query("D18_table_stats", f"""SELECT 'dataset_metadata' AS table_name, COUNT(*) AS row_count, COUNT(DISTINCT category) AS categories,
  AVG(completeness_score) AS avg_completeness FROM {S.METADATA} m UNION ALL
  SELECT 'datasets', COUNT(*), COUNT(DISTINCT dataset_id), CAST(COUNT(DISTINCT year) AS DOUBLE) FROM {S.SERIES} d UNION ALL
  SELECT 'observations', COUNT(*), COUNT(DISTINCT d.dataset_id), {S.AVG} FROM {S.SERIES_OBS}""")  # fmt: skip
def _(spark, d):
    return D.table_stats(S.star(spark, d, territory=False))


@query("D19_system_counts", f"""SELECT 'dataset_registry' AS name, COUNT(*) AS n FROM {S.REGISTRY} r UNION ALL SELECT 'user_preferences', COUNT(*) FROM {S.SETTINGS} s
  UNION ALL SELECT 'audit_log', COUNT(*) FROM {S.AUDIT} a UNION ALL SELECT 'api_keys', COUNT(*) FROM {S.API_KEYS} k
  UNION ALL SELECT 'total_observations', COUNT(*) FROM {S.OBSERVATIONS} o UNION ALL SELECT 'datasets_with_data', COUNT(DISTINCT dataset_id) FROM {S.SERIES} d""")  # fmt: skip
def _(spark, d):
    tables = {
        "dataset_registry": S.registry(spark, d),
        "user_preferences": S.settings(spark, d),
        "audit_log": S.audit_log(spark, d),
        "api_keys": S.api_keys(spark, d),
    }
    return D.system_counts(tables, S.star(spark, d, territory=False))


@query("D20_records_per_dataset", f"SELECT dataset_id, COUNT(*) AS records FROM {S.RAW} r GROUP BY dataset_id")
def _(spark, d):
    return D.records_per_dataset(S.raw_observations(spark, d))


@query("D20_dataset_periods", f"""SELECT dataset_id, COUNT(*) AS records, MIN(time_period) AS first_period, MAX(time_period) AS last_period,
  COUNT(DISTINCT time_period) AS unique_periods FROM {S.RAW} r GROUP BY dataset_id""")  # fmt: skip
def _(spark, d):
    return D.dataset_periods(S.raw_observations(spark, d))


@query("D20_recent_ingestions", f"SELECT dataset_id, MAX(ingestion_timestamp) AS latest_ingestion, COUNT(*) AS records FROM {S.RAW} r GROUP BY dataset_id")
def _(spark, d):
    return D.recent_ingestions(S.raw_observations(spark, d))


@query("D21_territory_dimension", f"""SELECT DISTINCT territory_code AS "TerritoryCode", territory_name AS "TerritoryName",
  CASE length(territory_code) WHEN 2 THEN 'Country' WHEN 3 THEN 'Area' WHEN 4 THEN 'Region' ELSE 'Province' END AS "Level",
  CASE WHEN length(territory_code) > 2 THEN substr(territory_code, 1, length(territory_code) - 1) END AS "ParentCode" FROM {S.SERIES} d""")  # fmt: skip
def _(spark, d):
    return D.territory_dimension(S.star(spark, d))


@query("D21_measure_dimension", f"""SELECT measure_code AS "MeasureCode", measure_name AS "MeasureName", MIN(unit_of_measure) AS "Unit",
  CASE WHEN MAX(CASE WHEN obs_value % 1 <> 0 THEN 1 ELSE 0 END) = 0 THEN 'Integer' ELSE 'Decimal' END AS "DataType" FROM {S.JOINED} GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    return D.measure_dimension(S.star(spark, d, territory=False))


@query("J7_registry_with_statistics", f"""SELECT r.dataset_id, r.name, COALESCE(s.record_count, 0) AS record_count, min_year, max_year, COALESCE(territory_count, 0) AS territory_count,
  COALESCE(measure_count, 0) AS measure_count, COALESCE(s.record_count, 0) > 0 AS has_analytics_data FROM {S.REGISTRY} r LEFT JOIN {STATS} s ON r.dataset_id = s.dataset_id""")  # fmt: skip
def _(spark, d):
    registry = S.registry(spark, d).select("dataset_id", "name", "record_count")
    return with_analytics(registry, D.dataset_stats(S.star(spark, d)))
