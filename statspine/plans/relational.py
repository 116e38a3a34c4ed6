"""Projections, filters, joins, aggregates, windows, slices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from statspine.functions.columns import exact_avg, growth_pct, nulls_last
from statspine.operators import aggregates as A
from statspine.operators import analytics as D
from statspine.operators import predicates as P
from statspine.operators import ranking as R
from statspine.operators import sketches as K
from statspine.plans import standin as S
from statspine.plans.catalog import query
from statspine.session import scratch_dir

HIGH = "1-URGENT"


@query(
    "P1_select",
    f"SELECT dataset_id, measure_code AS measure, year * 100 + quarter AS year_quarter, "
    f"CASE WHEN year >= 1998 THEN 'late' ELSE 'early' END AS era FROM {S.SERIES} d",
)
def _(spark, d):
    return S.series(spark, d).select(
        "dataset_id",
        F.col("measure_code").alias("measure"),
        (F.col("year") * 100 + F.col("quarter")).alias("year_quarter"),
        F.when(F.col("year") >= 1998, "late").otherwise("early").alias("era"),
    )


@query(
    "P2_comparisons",
    "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 40 "
    "AND l_returnflag <> 'R' AND l_linestatus = 'F' AND l_extendedprice > 1000 AND l_discount <= 0.05",
)
def _(spark, d):
    conditions = [
        ("l_quantity", ">=", 10), ("l_quantity", "<", 40), ("l_returnflag", "!=", "R"),
        ("l_linestatus", "=", "F"), ("l_extendedprice", ">", 1000), ("l_discount", "<=", 0.05),
    ]
    return P.where(S.table(spark, d, "lineitem"), conditions).select("l_orderkey", "l_partkey", "l_quantity")


@query(
    "P3_in_not_in",
    "SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders "
    "WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus NOT IN ('F')",
)
def _(spark, d):
    conditions = [("o_orderpriority", "IN", ["1-URGENT", "5-LOW"]), ("o_orderstatus", "NOT IN", ["F"])]
    return P.where(S.table(spark, d, "orders"), conditions).select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query("P4_like_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%' OR p_name ILIKE 'RED%'")
def _(spark, d):
    conditions = [("p_name", "LIKE", "%ring%"), ("p_name", "ILIKE", "RED%")]
    return P.where(S.table(spark, d, "part"), conditions, any_of=True).select("p_partkey", "p_name")


@query("P5_between", "SELECT event_id, value FROM events WHERE value BETWEEN 10 AND 20")
def _(spark, d):
    return P.where(S.table(spark, d, "events"), [("value", "BETWEEN", [10, 20])]).select("event_id", "value")


@query(
    "P6_null_tests",
    f"SELECT 'null' AS kind, COUNT(*) AS n FROM {S.OBSERVATIONS} o WHERE obs_value IS NULL "
    f"UNION ALL SELECT 'not_null', COUNT(*) FROM {S.OBSERVATIONS} o WHERE obs_value IS NOT NULL",
)
def _(spark, d):
    obs = S.observations(spark, d)
    count = lambda op, kind: P.where(obs, [("obs_value", op)]).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count("IS NULL", "null").unionByName(count("IS NOT NULL", "not_null"))


@query(
    "P7_conjunction",
    "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 300000) AND o_custkey > 100",
)
def _(spark, d):
    either = P.where(S.table(spark, d, "orders"), [("o_orderstatus", "=", "F"), ("o_totalprice", ">", 300000)], any_of=True)
    return P.where(either, [("o_custkey", ">", 100)]).select("o_orderkey")


@query(
    "P8_year_range_territories",
    f"SELECT id, year, territory_code FROM {S.SERIES} d WHERE year BETWEEN 1996 AND 1998 AND territory_code IN ('ITA0', 'EC2')",
)
def _(spark, d):
    return P.territories(P.year_range(S.series(spark, d), 1996, 1998), ["ITA0", "EC2"]).select("id", "year", "territory_code")


@query(
    "P9_case_when",
    f"SELECT d.year, CAST(SUM(CASE WHEN measure_code = '{HIGH}' THEN obs_value END) AS DOUBLE) "
    f"/ NULLIF(COUNT(CASE WHEN measure_code = '{HIGH}' THEN obs_value END), 0) AS urgent_avg, "
    f"CAST(SUM(CASE WHEN measure_code = '5-LOW' THEN obs_value END) AS DOUBLE) "
    f"/ NULLIF(COUNT(CASE WHEN measure_code = '5-LOW' THEN obs_value END), 0) AS low_avg FROM {S.SERIES_OBS} GROUP BY d.year",
)
def _(spark, d):
    only = lambda code: exact_avg(F.when(F.col("measure_code") == code, F.col("obs_value")))
    rows = S.star(spark, d, territory=False).series_observations()
    return rows.groupBy("year").agg(only(HIGH).alias("urgent_avg"), only("5-LOW").alias("low_avg"))


@query(
    "P10_attribute_predicate",
    f"SELECT dataset_id, record_id, obs_value FROM {S.RAW} r WHERE territory_code = 'ITB6' AND measure_code = '{HIGH}'",
)
def _(spark, d):
    raw = S.raw_observations(spark, d)
    return raw.where(
        (P.attribute("additional_attributes", "territory_code") == "ITB6")
        & (P.attribute("additional_attributes", "measure_code") == HIGH)
    ).select("dataset_id", "record_id", "obs_value")


@query(
    "P11_json_extraction",
    "SELECT event_id, props->>'k' AS k FROM events WHERE CAST(props->>'k' AS INTEGER) > 50",
)
def _(spark, d):
    k = P.json_attribute("props", "k")
    return S.table(spark, d, "events").select("event_id", k.alias("k")).where(F.col("k").try_cast("int") > 50)


@query(
    "P12_clean_period_range",
    f"SELECT MIN(time_period) AS earliest, MAX(time_period) AS latest FROM {S.RAW} r WHERE time_period NOT LIKE '%T%'",
)
def _(spark, d):
    return P.clean_period_range(S.raw_observations(spark, d))


@query("P13_period_parts", f"""SELECT time_period, CASE WHEN regexp_matches(time_period, '^[0-9]{{4}}(-|$)') THEN CAST(substr(time_period, 1, 4) AS INTEGER) END AS year,
  CASE WHEN regexp_matches(time_period, '^[0-9]{{4}}$') THEN 'YEAR' WHEN regexp_matches(time_period, '^[0-9]{{4}}-Q[1-4]$') THEN 'QUARTER'
  WHEN regexp_matches(time_period, '^[0-9]{{4}}-[0-9]{{2}}$') THEN 'MONTH' END AS period_type, COUNT(*) AS n
  FROM {S.RAW} r GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    from statspine.functions.columns import period_type, period_year

    raw = S.raw_observations(spark, d)
    counted = raw.groupBy("time_period").agg(F.count("*").alias("n"))
    return counted.select("time_period", period_year("time_period").alias("year"), period_type("time_period").alias("period_type"), "n")


# joins


@query(
    "J1_inner_join",
    f"SELECT d.dataset_id, category, d.year, obs_value, obs_status FROM {S.JOINED}",
)
def _(spark, d):
    return S.star(spark, d, territory=False).joined().select("dataset_id", "category", "year", "obs_value", "obs_status")


@query(
    "J2_left_join",
    f"SELECT m.dataset_id, COUNT(d.id) AS series_count FROM {S.METADATA} m LEFT JOIN {S.SERIES} d "
    "ON m.dataset_id = d.dataset_id AND d.year = 1995 GROUP BY m.dataset_id",
)
def _(spark, d):
    counts = S.series(spark, d, territory=False).where("year = 1995").groupBy("dataset_id").agg(F.count("*").alias("series_count"))
    meta = S.metadata(spark, d).select("dataset_id")
    return meta.join(counts, "dataset_id", "left").select("dataset_id", F.coalesce("series_count", F.lit(0)).alias("series_count"))


@query(
    "J3_right_full_join",
    # parts shipped, by number, against customers: both sides have keys that the other lacks
    "SELECT 'right' AS kind, p.p_partkey AS left_key, c.o_custkey AS right_key FROM part p "
    "RIGHT JOIN (SELECT DISTINCT o_custkey FROM orders) c ON p.p_partkey = c.o_custkey UNION ALL "
    "SELECT 'full', p.p_partkey, c.o_custkey FROM part p "
    "FULL JOIN (SELECT DISTINCT o_custkey FROM orders) c ON p.p_partkey = c.o_custkey",
)
def _(spark, d):
    left = S.table(spark, d, "part").select(F.col("p_partkey").alias("left_key"))
    right = S.table(spark, d, "orders").select(F.col("o_custkey").alias("right_key")).distinct()
    on = F.col("left_key") == F.col("right_key")
    kind = lambda how: left.join(right, on, how).select(F.lit(how).alias("kind"), "left_key", "right_key")
    return kind("right").unionByName(kind("full"))


@query(
    "J4_cross_join_fixed_list",
    f"SELECT territory_code, w.window_type FROM {S.TERRITORIES} t CROSS JOIN (VALUES ('minute'), ('hour'), ('day')) w(window_type)",
)
def _(spark, d):
    # the other side is a fixed list, written as an array: each row is repeated per entry, nothing is joined
    windows = F.array(*[F.lit(w) for w in ("minute", "hour", "day")])
    return S.territories(spark, d).select("territory_code", F.explode(windows).alias("window_type"))


YEARLY_SQL = f"""(SELECT d.dataset_id, territory_code, territory_name, d.year, {S.AVG} AS value
  FROM {S.SERIES_OBS} WHERE obs_value IS NOT NULL GROUP BY ALL)"""


@query(
    "J5_self_join_previous_year",
    f"SELECT c.dataset_id, c.territory_code, c.territory_name, c.year, c.value AS current_value, p.value AS previous_value, "
    f"(c.value - p.value) / p.value * 100.0 AS growth_rate FROM {YEARLY_SQL} c JOIN {YEARLY_SQL} p "
    "ON c.dataset_id = p.dataset_id AND c.territory_code = p.territory_code AND c.year = p.year + 1 WHERE p.value > 0",
)
def _(spark, d):
    return D.join_previous_year(D.yearly_values(S.star(spark, d)))


@query(
    "J6_anti_semi_join",
    "SELECT 'without' AS kind, c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996) "
    "UNION ALL SELECT 'with', c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996)",
)
def _(spark, d):
    ids = S.table(spark, d, "customer").select("c_custkey")
    used = S.table(spark, d, "orders").where(F.year("o_orderdate") == 1996).select("o_custkey").distinct()
    on = F.col("c_custkey") == F.col("o_custkey")
    part = lambda how, kind: ids.join(used, on, how).select(F.lit(kind).alias("kind"), "c_custkey")
    return part("left_anti", "without").unionByName(part("left_semi", "with"))


# aggregates


@query(
    "A1_group_by",
    f"SELECT d.year, measure_code, COUNT(*) AS n, CAST(SUM(obs_value) AS DOUBLE) AS total, {S.AVG} AS mean, "
    f"CAST(MIN(obs_value) AS DOUBLE) AS lowest, CAST(MAX(obs_value) AS DOUBLE) AS highest FROM {S.SERIES_OBS} GROUP BY d.year, measure_code",
)
def _(spark, d):
    rows = S.star(spark, d, territory=False).series_observations().select("year", "measure_code", "obs_value", "id")
    out = A.aggregate(
        rows, ["year", "measure_code"], n=("COUNT", "id"), total=("SUM", "obs_value"), mean=("AVG", "obs_value"),
        lowest=("MIN", "obs_value"), highest=("MAX", "obs_value"),
    )
    return out.withColumns({c: F.col(c).cast("double") for c in ("total", "lowest", "highest")})


@query(
    "A2_stddev",
    "SELECT l_returnflag, l_linestatus, round(stddev_samp(l_quantity), 4) AS sd FROM lineitem GROUP BY ALL",
)
def _(spark, d):
    out = A.aggregate(S.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], sd=("STDDEV", "l_quantity"))
    return out.withColumn("sd", F.round("sd", 4))


@query("A3_variance", "SELECT l_returnflag, round(var_pop(l_quantity), 4) AS variance FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    out = A.aggregate(S.table(spark, d, "lineitem"), ["l_returnflag"], variance=("VARIANCE", "l_quantity"))
    return out.withColumn("variance", F.round("variance", 4))


@query(
    "A4_median",
    "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, round(median(l_extendedprice), 6) AS median_price FROM lineitem GROUP BY ALL",
)
def _(spark, d):
    out = A.aggregate(
        S.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], n=("COUNT", "l_orderkey"), median_price=("MEDIAN", "l_extendedprice")
    )
    return out.withColumn("median_price", F.round("median_price", 6))


@query("A5_count_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    return A.aggregate(S.table(spark, d, "lineitem"), ["l_returnflag"], parts=("COUNT_DISTINCT", "l_partkey"))


def _month_sketches(spark, d) -> DataFrame:
    """Sketches of every month, as they are stored."""
    lines = S.table(spark, d, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    path = scratch_dir(spark, "sketches")
    K.sketched(lines, ["l_returnflag", "month"], ("l_extendedprice",), ("l_partkey",)).write.parquet(path)
    return spark.read.parquet(path)


SPAN_SQL = "FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') BETWEEN '1993-04' AND '1996-09' GROUP BY l_returnflag"


@query("A4_median_sketch", f"SELECT l_returnflag, COUNT(*) AS n, true AS within_error {SPAN_SQL}")
def _(spark, d):
    # months merged over a span; the estimate's rank among the values themselves says how far off it is
    span = K.estimated(K.merged(_month_sketches(spark, d).where("month BETWEEN '1993-04' AND '1996-09'"), ["l_returnflag"]))
    lines = S.table(spark, d, "lineitem").where("date_format(l_shipdate, 'yyyy-MM') BETWEEN '1993-04' AND '1996-09'")
    held = lines.join(span.select("l_returnflag", "l_extendedprice_quantile", F.col("rows").alias("n")), "l_returnflag")
    below = F.count_if(F.col("l_extendedprice") < F.col("l_extendedprice_quantile")) / F.count("*")
    upto = F.count_if(F.col("l_extendedprice") <= F.col("l_extendedprice_quantile")) / F.count("*")
    near = (below <= 0.5 + K.RANK_ERROR) & (upto >= 0.5 - K.RANK_ERROR)
    return held.groupBy("l_returnflag").agg(F.max("n").alias("n"), near.alias("within_error"))


@query("A5_distinct_sketch", f"SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, true AS within_error {SPAN_SQL}")
def _(spark, d):
    span = K.estimated(K.merged(_month_sketches(spark, d).where("month BETWEEN '1993-04' AND '1996-09'"), ["l_returnflag"]))
    lines = S.table(spark, d, "lineitem").where("date_format(l_shipdate, 'yyyy-MM') BETWEEN '1993-04' AND '1996-09'")
    exact = lines.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"))
    off = F.abs(F.col("l_partkey_distinct") - F.col("parts"))
    return exact.join(span, "l_returnflag").select("l_returnflag", "parts", (off <= F.col("parts") * K.COUNT_ERROR + 1).alias("within_error"))


@query(
    "A6_count_distinct_tuple",
    f"SELECT COUNT(DISTINCT (dataset_id, obs_value, time_period, record_id)) AS distinct_rows FROM {S.RAW} r",
)
def _(spark, d):
    return A.count_distinct_tuples(S.raw_observations(spark, d), ["dataset_id", "obs_value", "time_period", "record_id"], "distinct_rows")


@query(
    "A7_conditional_counts",
    f"SELECT action, COUNT(CASE WHEN success THEN 1 END) AS ok, SUM(CASE WHEN success THEN 0 ELSE 1 END)::BIGINT AS failed, "
    f"COUNT(CASE WHEN execution_time_ms > 50 THEN 1 END) AS slow FROM {S.AUDIT} a GROUP BY action",
)
def _(spark, d):
    return S.audit_log(spark, d).groupBy("action").agg(
        F.count_if("success").alias("ok"),
        F.sum(F.when(F.col("success"), 0).otherwise(1)).alias("failed"),
        F.count_if(F.col("execution_time_ms") > 50).alias("slow"),
    )


@query(
    "A8_having",
    "SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) > 600",
)
def _(spark, d):
    return A.having(A.aggregate(S.table(spark, d, "lineitem"), ["l_suppkey"], n=("COUNT", "l_orderkey")), "n > 600")


@query(
    "A9_joined_values",
    f"SELECT dataset_id, time_period, STRING_AGG(DISTINCT obs_status, ', ' ORDER BY obs_status) AS statuses FROM {S.RAW} r "
    "WHERE obs_status IS NOT NULL GROUP BY dataset_id, time_period",
)
def _(spark, d):
    raw = S.raw_observations(spark, d).withColumn("obs_status", P.attribute("additional_attributes", "obs_status"))
    return A.joined_values(raw, ["dataset_id", "time_period"], "obs_status", "statuses")


@query(
    "A10_count_exists_first",
    "SELECT (SELECT COUNT(*) FROM (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) > 10)) AS row_count, "
    "EXISTS (SELECT 1 FROM lineitem WHERE l_quantity > 49) AS row_exists, "
    "(SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS first_order",
)
def _(spark, d):
    lines = S.table(spark, d, "lineitem")
    groups = A.having(A.aggregate(lines, ["l_suppkey"], n=("COUNT", "l_orderkey")), "n > 10")
    first = A.first(S.table(spark, d, "orders"), *nulls_last("-o_totalprice", "o_orderkey")).select("o_orderkey")
    some = A.exists(lines.where("l_quantity > 49"))
    return A.result_count(groups).select("row_count", some.scalar().alias("row_exists"), first.scalar().alias("first_order"))


@query("A11_distinct", "SELECT DISTINCT c_mktsegment AS category FROM customer WHERE c_custkey % 4 <> 0")
def _(spark, d):
    from statspine.operators.registry import categories

    return categories(S.registry(spark, d))


# windows

TM_SQL = f"""(SELECT territory_code, measure_code, {S.AVG} AS avg_value FROM {S.SERIES_OBS} GROUP BY territory_code, measure_code)"""


def _territory_measures(spark, d):
    rows = S.star(spark, d).series_observations()
    return rows.groupBy("territory_code", "measure_code").agg(exact_avg("obs_value").alias("avg_value"))


@query(
    "W1_rank_in_measure",
    f"SELECT territory_code, measure_code, avg_value, RANK() OVER (PARTITION BY measure_code ORDER BY avg_value DESC NULLS LAST) AS value_rank FROM {TM_SQL} t",
)
def _(spark, d):
    w = Window.partitionBy("measure_code").orderBy(*nulls_last("-avg_value"))
    return _territory_measures(spark, d).withColumn("value_rank", F.rank().over(w).cast("long"))


@query(
    "W2_global_rank",
    "SELECT l_partkey, total_quantity, RANK() OVER (ORDER BY total_quantity DESC NULLS LAST) AS rank "
    "FROM (SELECT l_partkey, CAST(SUM(l_quantity) AS BIGINT) AS total_quantity FROM lineitem GROUP BY l_partkey)",
)
def _(spark, d):
    totals = S.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("total_quantity"))
    return R.global_rank(totals, "-total_quantity")


@query(
    "W2_global_rank_of_rows",
    "SELECT l_orderkey, l_partkey, l_quantity, RANK() OVER (ORDER BY l_quantity) AS rank FROM lineitem",
)
def _(spark, d):
    return R.global_rank(S.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), "l_quantity")


@query(
    "W3_ntile",
    f"SELECT territory_code, measure_code, NTILE(4) OVER (PARTITION BY measure_code ORDER BY avg_value NULLS LAST, territory_code) AS quartile FROM {TM_SQL} t",
)
def _(spark, d):
    w = Window.partitionBy("measure_code").orderBy(*nulls_last("avg_value", "territory_code"))
    return _territory_measures(spark, d).select("territory_code", "measure_code", F.ntile(4).over(w).cast("long").alias("quartile"))


CY_SQL = f"""(SELECT category, d.year, {S.AVG} AS avg_value FROM {S.JOINED} GROUP BY category, d.year)"""


def _category_years(spark, d):
    rows = S.star(spark, d, territory=False).joined()
    return rows.groupBy("category", "year").agg(exact_avg("obs_value").alias("avg_value"))


def _by_year():
    return Window.partitionBy("category").orderBy("year")


@query(
    "W4_lag_lead",
    f"SELECT category, year, LAG(avg_value) OVER (PARTITION BY category ORDER BY year) AS prev_avg_value, "
    f"LEAD(avg_value) OVER (PARTITION BY category ORDER BY year) AS next_avg_value FROM {CY_SQL} c",
)
def _(spark, d):
    w = _by_year()
    return _category_years(spark, d).select(
        "category", "year", F.lag("avg_value").over(w).alias("prev_avg_value"), F.lead("avg_value").over(w).alias("next_avg_value")
    )


@query(
    "W5_row_number",
    f"SELECT category, year, ROW_NUMBER() OVER (PARTITION BY category ORDER BY year) AS seen FROM {CY_SQL} c",
)
def _(spark, d):
    return _category_years(spark, d).select("category", "year", F.row_number().over(_by_year()).cast("long").alias("seen"))


@query(
    "W6_moving_average",
    f"SELECT category, year, round(CASE WHEN ROW_NUMBER() OVER (PARTITION BY category ORDER BY year) >= 3 THEN AVG(avg_value) OVER "
    f"(PARTITION BY category ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END, 6) AS moving_avg_3yr FROM {CY_SQL} c",
)
def _(spark, d):
    return _category_years(spark, d).select("category", "year", F.round(D.moving_average("avg_value", _by_year()), 6).alias("moving_avg_3yr"))


@query(
    "W7_year_over_year",
    f"SELECT category, year, (avg_value - prev) / NULLIF(prev, 0) * 100.0 AS change FROM (SELECT *, LAG(avg_value) OVER "
    f"(PARTITION BY category ORDER BY year) AS prev FROM {CY_SQL} c)",
)
def _(spark, d):
    return _category_years(spark, d).select("category", "year", growth_pct(F.col("avg_value"), F.lag("avg_value").over(_by_year())).alias("change"))


@query(
    "W8_period_difference",
    f"SELECT dataset_id, year, quarter, value, value - LAG(value) OVER (PARTITION BY dataset_id ORDER BY year, quarter) AS change FROM "
    f"(SELECT d.dataset_id, d.year, quarter, {S.AVG} AS value FROM {S.SERIES_OBS} GROUP BY ALL)",
)
def _(spark, d):
    rows = S.star(spark, d, territory=False).series_observations()
    return D.period_differences(rows, ["dataset_id"], ["year", "quarter"], "obs_value")


# order, limit, pages, union


@query(
    "L1_order_by",
    "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey",
)
def _(spark, d):
    return S.table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").orderBy(*nulls_last("c_mktsegment", "-c_acctbal", "c_custkey"))


@query(
    "L2_limit_offset",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50",
)
def _(spark, d):
    rows = S.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return A.limit_offset(rows, ["-o_totalprice", "o_orderkey"], 25, 50)


@query("L3_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, d):
    rows = S.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return A.limit_offset(rows, ["-o_totalprice", "o_orderkey"], 10)


@query(
    "L4_top_k_per_group",
    "SELECT c_mktsegment, c_custkey, row_number FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) "
    "AS row_number FROM customer) WHERE row_number <= 5",
)
def _(spark, d):
    rows = S.table(spark, d, "customer")
    top = R.top_k_per_group(rows, ["c_mktsegment"], nulls_last("-c_acctbal", "c_custkey"), 5)
    return top.select("c_mktsegment", "c_custkey", "row_number")


@query(
    "L5_page",
    f"SELECT dataset_id, name, priority, (SELECT COUNT(*) FROM customer) AS total_count, "
    f"(SELECT COUNT(*) FROM customer) > 100 AS has_next FROM {S.REGISTRY} r ORDER BY priority DESC, name, dataset_id LIMIT 50 OFFSET 50",
)
def _(spark, d):
    return A.page(S.registry(spark, d).select("dataset_id", "name", "priority"), ["-priority", "name", "dataset_id"], 2, 50)


@query(
    "L5_page_after_key",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 100",
)
def _(spark, d):
    return A.page_after(S.table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000, 100)


@query(
    "L6_union_all",
    "SELECT 'customer' AS source, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier",
)
def _(spark, d):
    side = lambda t, c: S.table(spark, d, t).select(F.lit(t).alias("source"), F.col(c).alias("nation"))
    return side("customer", "c_nationkey").unionByName(side("supplier", "s_nationkey"))
