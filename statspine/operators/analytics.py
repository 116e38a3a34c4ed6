"""The questions asked of the star: summaries, series, comparisons, trends, growth."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statspine.functions.columns import exact_avg, growth_pct, nulls_last, percent, ratio
from statspine.model import Star
from statspine.operators.aggregates import join_on
from statspine.operators.predicates import attribute, territories, year_range
from statspine.operators.ranking import global_rank, selected_median, top_k_per_group
from statspine.session import scratch_dir


def series_totals(observations: DataFrame) -> DataFrame:
    """Observations reduced to one row per series before anything is joined to them."""
    return observations.groupBy("dataset_row_id").agg(
        F.count("*").alias("_rows"),
        F.count("obs_value").alias("_values"),
        F.sum("obs_value").alias("_sum"),
        F.min("obs_value").alias("_min"),
        F.max("obs_value").alias("_max"),
    )


def _valued(star: Star) -> Star:
    """The star with its observations reduced to one row per series that has a value."""
    return Star(star.metadata, star.series, series_totals(star.observations).where("_values > 0"))


def dataset_summary(star: Star) -> DataFrame:
    """Per dataset: observations, years, territories, values. Datasets without data stay."""
    totals = series_totals(star.observations)
    series = star.series.select("id", "dataset_id", "year", "territory_code")
    joined = series.join(totals, F.col("id") == F.col("dataset_row_id"), "left")
    stats = joined.groupBy("dataset_id").agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("total_observations"),
        F.min("year").alias("min_year"),
        F.max("year").alias("max_year"),
        F.count_distinct("territory_code").alias("territory_count"),
        ratio(F.sum("_sum"), F.sum("_values")).alias("avg_value"),
        F.min("_min").cast("double").alias("min_value"),
        F.max("_max").cast("double").alias("max_value"),
    )
    meta = star.metadata.select(
        "dataset_id", "dataset_name", "category", "priority", "completeness_score", "data_quality_score"
    )
    return (
        meta.join(stats, "dataset_id", "left")
        .withColumns(
            {
                "total_observations": F.coalesce("total_observations", F.lit(0)),
                "territory_count": F.coalesce("territory_count", F.lit(0)),
            }
        )
        .orderBy(*nulls_last("-priority", "category", "dataset_name", "dataset_id"))
    )


def time_series(
    star: Star, dataset_ids: list, start_year: int, end_year: int, territory_codes: list[str] | None = None
) -> DataFrame:
    """Joined rows with a value, for chosen datasets, years and territories."""
    series = year_range(star.series.where(F.col("dataset_id").isin(list(dataset_ids))), start_year, end_year)
    series = territories(series, territory_codes)
    meta = star.metadata.select("dataset_id", "category", "unit_of_measure")
    rows = Star(meta, series, star.observations.where("obs_value IS NOT NULL")).joined()
    return rows.select(
        "dataset_id", "year", "time_period", "territory_code", "territory_name", "measure_code", "measure_name",
        "obs_value", "obs_status", "category", "unit_of_measure",
    ).orderBy(*nulls_last("dataset_id", "year", "territory_code", "time_period", "measure_code", "obs_value"))


def territory_aggregates(star: Star) -> DataFrame:
    """Per territory, year and category: rows, mean, non-null rows, completeness %."""
    totals = series_totals(star.observations)
    rows = Star(star.metadata.select("dataset_id", "category"), star.series, totals).joined()
    return rows.groupBy("territory_code", "territory_name", "year", "category").agg(
        F.sum("_rows").alias("indicator_count"),
        ratio(F.sum("_sum"), F.sum("_values")).alias("avg_value"),
        F.sum("_values").alias("non_null_count"),
        F.sum("_rows").alias("total_count"),
        percent(F.sum("_values"), F.sum("_rows")).alias("completeness_pct"),
    )


def territory_comparison(
    star: Star, measure_codes: list[str], year: int, territory_codes: list[str] | None = None
) -> DataFrame:
    """Territories per measure in one year, with rank and quartile.

    The windows run on one row per territory and measure, never on observations.
    """
    series = star.series.where((F.col("year") == year) & F.col("measure_code").isin(list(measure_codes)))
    rows = Star(
        star.metadata, territories(series, territory_codes), star.observations.where("obs_value IS NOT NULL")
    ).series_observations()
    stats = rows.groupBy("territory_code", "territory_name", "measure_code", "measure_name").agg(
        exact_avg("obs_value").alias("avg_value"),
        F.min("obs_value").cast("double").alias("min_value"),
        F.max("obs_value").cast("double").alias("max_value"),
        F.count("obs_value").alias("obs_count"),
        F.stddev_samp("obs_value").alias("std_dev"),
    )
    best = Window.partitionBy("measure_code").orderBy(F.col("avg_value").desc_nulls_last())
    lowest = Window.partitionBy("measure_code").orderBy(*nulls_last("avg_value", "territory_code"))
    return stats.withColumns(
        {
            "value_rank": F.rank().over(best).cast("long"),
            "quartile": F.ntile(4).over(lowest).cast("long"),
        }
    ).orderBy(*nulls_last("measure_code", "value_rank", "territory_code"))


def territory_comparison_dataset(star: Star, dataset_id, year: int) -> DataFrame:
    """Territories of one dataset in one year, with their overall rank."""
    series = star.series.where((F.col("dataset_id") == dataset_id) & (F.col("year") == year))
    rows = _valued(Star(star.metadata, series, star.observations)).series_observations()
    stats = rows.groupBy("territory_code", "territory_name").agg(
        F.sum("_values").alias("indicators"),
        ratio(F.sum("_sum"), F.sum("_values")).alias("avg_value"),
        F.min("_min").cast("double").alias("min_value"),
        F.max("_max").cast("double").alias("max_value"),
    )
    return global_rank(stats, "-avg_value").orderBy(*nulls_last("-avg_value", "territory_code"))


def territory_comparison_simple(star: Star, measure_code: str, year: int) -> DataFrame:
    """Mean and count per territory for one measure and year, highest first."""
    series = star.series.where((F.col("measure_code") == measure_code) & (F.col("year") == year))
    rows = _valued(Star(star.metadata, series, star.observations)).series_observations()
    return (
        rows.groupBy("territory_code", "territory_name")
        .agg(ratio(F.sum("_sum"), F.sum("_values")).alias("avg_value"), F.sum("_values").alias("observation_count"))
        .orderBy(*nulls_last("-avg_value", "territory_code"))
    )


def _category_rows(star: Star, categories: list[str], start: int | None, end: int | None) -> DataFrame:
    meta = star.metadata.where(F.col("category").isin(list(categories))).select("dataset_id", "category")
    series = year_range(star.series, start, end).select("id", "dataset_id", "year")
    values = star.observations.where("obs_value IS NOT NULL").select("dataset_row_id", "obs_value")
    return Star(meta, series, values).joined().select("category", "year", "dataset_id", "obs_value")


def _yearly(rows: DataFrame) -> DataFrame:
    """Counts, mean, spread and median of every category and year.

    The joined observations are written once, narrow and where they are; one aggregate and the rounds of the median read
    them, and none of these moves an observation.
    """
    keys, path = ["category", "year"], scratch_dir(rows.sparkSession, "trends")
    rows.write.parquet(path)
    rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
    stats = rows.groupBy(*keys).agg(
        F.count_distinct("dataset_id").alias("dataset_count"),
        F.count("obs_value").alias("total_observations"),
        exact_avg("obs_value").alias("avg_value"),
        F.stddev_samp(F.col("obs_value").cast("double")).alias("std_dev"),
    )
    return join_on(stats, selected_median(rows, keys, "obs_value", "median_value"), keys)


def category_trends(star: Star, categories: list[str], start_year: int, end_year: int) -> DataFrame:
    """Per category and year: datasets, values, neighbours, change and 3-year mean.

    The windows see one row per category and year.
    """
    yearly = _yearly(_category_rows(star, categories, start_year, end_year))
    w = Window.partitionBy("category").orderBy("year")
    return (
        yearly.withColumns(
            {
                "prev_avg_value": F.lag("avg_value").over(w),
                "next_avg_value": F.lead("avg_value").over(w),
                "moving_avg_3yr": moving_average("avg_value", w),
            }
        )
        .withColumn("year_over_year_change", growth_pct("avg_value", "prev_avg_value"))
        .orderBy("category", "year")
    )


def moving_average(value: str, w, rows: int = 3):
    """Mean of the last ``rows`` rows of the window; NULL until there are that many."""
    return F.when(
        F.row_number().over(w) >= rows, F.avg(F.col(value)).over(w.rowsBetween(-(rows - 1), 0))
    )


def category_trends_simple(
    star: Star, category: str, start_year: int | None = None, end_year: int | None = None
) -> DataFrame:
    """Per year of one category: datasets, observations, mean, median."""
    yearly = _yearly(_category_rows(star, [category], start_year, end_year))
    return yearly.select(
        "year", F.col("dataset_count").alias("datasets"), "total_observations", "avg_value", "median_value"
    ).orderBy("year")


def category_totals(star: Star, category: str) -> DataFrame:
    """Per year of one category: datasets, mean, sum."""
    meta = star.metadata.where(F.col("category") == category).select("dataset_id")
    series = star.series.select("id", "dataset_id", "year")
    rows = Star(meta, series, series_totals(star.observations).where("_values > 0")).joined()
    return (
        rows.groupBy("year")
        .agg(
            F.count_distinct("dataset_id").alias("dataset_count"),
            ratio(F.sum("_sum"), F.sum("_values")).alias("avg_value"),
            F.sum("_sum").cast("double").alias("total_value"),
        )
        .orderBy("year")
    )


def top_performers(star: Star, category: str, measure_code: str, year: int, k: int = 10) -> DataFrame:
    """The k best territories with their rank; the rank runs over those k rows only."""
    meta = star.metadata.where(F.col("category") == category).select("dataset_id", "unit_of_measure")
    series = star.series.where((F.col("measure_code") == measure_code) & (F.col("year") == year))
    rows = _valued(Star(meta, series, star.observations)).joined()
    keys = ["territory_code", "territory_name", "measure_code", "measure_name", "unit_of_measure"]
    best = (
        rows.groupBy(*keys)
        .agg(ratio(F.sum("_sum"), F.sum("_values")).alias("avg_value"), F.sum("_values").alias("obs_count"))
        .orderBy(*nulls_last("-avg_value", "territory_code", "unit_of_measure"))
        .limit(k)
    )
    return best.withColumn("rank", F.rank().over(Window.orderBy(F.col("avg_value").desc_nulls_last())).cast("long"))


YEAR_KEYS = ["dataset_id", "territory_code", "territory_name"]


def yearly_values(star: Star) -> DataFrame:
    """One value (the mean) per dataset, territory and year."""
    rows = Star(star.metadata, star.series, series_totals(star.observations).where("_values > 0")).series_observations()
    return rows.groupBy(*YEAR_KEYS, "year").agg(ratio(F.sum("_sum"), F.sum("_values")).alias("value"))


def join_previous_year(values: DataFrame) -> DataFrame:
    """Each yearly value next to the one of the year before.

    Both sides hold one row per key and year, so no group is multiplied out.
    """
    previous = values.select(
        "dataset_id", "territory_code", (F.col("year") + 1).alias("year"), F.col("value").alias("previous_value")
    ).where("previous_value > 0")
    joined = values.withColumnRenamed("value", "current_value").join(previous, ["dataset_id", "territory_code", "year"])
    return joined.withColumn("growth_rate", growth_pct("current_value", "previous_value"))


def growth_vs_previous_year(star: Star, year: int, k: int = 50) -> DataFrame:
    """The k largest growth rates against the year before, from one pass over both years."""
    series = star.series.where(F.col("year").isin(year, year - 1))
    values = yearly_values(Star(star.metadata, series, star.observations))
    side = lambda y: F.max(F.when(F.col("year") == y, F.col("value")))
    return (
        values.groupBy(*YEAR_KEYS)
        .agg(side(year).alias("current_value"), side(year - 1).alias("previous_value"))
        .where("current_value IS NOT NULL AND previous_value > 0")
        .withColumn("year", F.lit(year))
        .withColumn("growth_rate", growth_pct("current_value", "previous_value"))
        .orderBy(*nulls_last("-growth_rate", "dataset_id", "territory_code"))
        .limit(k)
    )


def demographic_split(
    star: Star, category: str, male: str, female: str, start_year: int, end_year: int, k: int = 100
) -> DataFrame:
    """Mean of two measures side by side per year and territory with more than one dataset."""
    meta = star.metadata.where(F.col("category") == category).select("dataset_id")
    series = year_range(star.series.where(F.col("measure_code").isin(male, female)), start_year, end_year)
    rows = _valued(Star(meta, series, star.observations)).joined()

    def only(code: str) -> Column:
        of = lambda c: F.sum(F.when(F.col("measure_code") == code, F.col(c)))
        return ratio(of("_sum"), of("_values"))

    return (
        rows.groupBy("year", "territory_code", "territory_name")
        .agg(
            only(male).alias("male_pop"),
            only(female).alias("female_pop"),
            F.count_distinct("dataset_id").alias("dataset_count"),
        )
        .where("dataset_count > 1")
        .orderBy(*nulls_last("-year", "-male_pop", "territory_code"))
        .limit(k)
    )


def dataset_time_series(
    raw: DataFrame,
    dataset_id,
    territory_code: str | None = None,
    measure_code: str | None = None,
    start_year: int | None = None,
    end_year: int | None = None,
) -> DataFrame:
    """Raw rows of one dataset: numeric value or status flag, attributes as columns."""
    rows = raw.where(F.col("dataset_id") == dataset_id)
    attr = lambda key: attribute("additional_attributes", key)
    if territory_code:
        rows = rows.where(attr("territory_code") == territory_code)
    if measure_code:
        rows = rows.where(attr("measure_code") == measure_code)
    rows = year_range(rows.withColumn("year", F.col("time_period").try_cast("int")), start_year, end_year)
    number = F.col("obs_value").try_cast("double")
    flag = F.when(number.isNull() & (F.col("obs_value") != ""), F.col("obs_value"))
    status = F.when(attr("obs_status") != "", attr("obs_status"))
    return rows.select(
        "dataset_id",
        "time_period",
        F.when(F.col("time_period").rlike("^[0-9]+$"), F.col("year")).alias("year"),
        number.alias("obs_value"),
        "record_id",
        "ingestion_timestamp",
        *[attr(k).alias(k) for k in ("territory_code", "territory_name", "measure_code", "measure_name")],
        F.coalesce(status, flag).alias("obs_status"),
    ).orderBy(*nulls_last("time_period", "record_id", "obs_value"))


def dataset_stats(star: Star) -> DataFrame:
    """Per dataset with data: rows, years, territories, kinds of value. One job for all datasets."""
    # counts by series and kind before the join, then by every distinct column: no group is larger than its combinations
    keyed = star.observations.groupBy("dataset_row_id", "value_type").agg(F.count("*").alias("_n"))
    rows = Star(star.metadata, star.series.select("id", "dataset_id", "year", "territory_code"), keyed)
    cells = (
        rows.series_observations()
        .groupBy("dataset_id", "year", "territory_code", "value_type")
        .agg(F.sum("_n").alias("_n"))
    )
    return cells.groupBy("dataset_id").agg(
        F.sum("_n").alias("record_count"),
        F.min("year").alias("min_year"),
        F.max("year").alias("max_year"),
        F.count_distinct("territory_code").alias("territory_count"),
        F.count_distinct("value_type").alias("measure_count"),
    )


def kpi_metrics(star: Star, categories: list[str], start_year: int, end_year: int) -> DataFrame:
    """Per category: latest value, growth on the value before it, mean, share of values, range.

    Observations shrink to one row per series, which is written and feeds both parts: the aggregate, and the choice of the
    two last series of a category, the only ones whose observations are looked at one by one.
    """
    spark, path = star.observations.sparkSession, scratch_dir(star.observations.sparkSession, "kpi")
    meta = star.metadata.where(F.col("category").isin(list(categories))).select("dataset_id", "category")
    series = year_range(star.series, start_year, end_year).select("id", "dataset_id", "year", "time_period")
    totals = Star(meta, series, series_totals(star.observations)).joined()
    totals.select("category", "year", "time_period", "dataset_row_id", "_rows", "_values", "_sum", "_min", "_max").write.parquet(path)
    totals = spark.read.parquet(path)
    newest = ["-year", "-time_period", "-dataset_row_id"]
    # two series at most of each of the asked categories
    last = top_k_per_group(totals.select("category", "year", "time_period", "dataset_row_id"), ["category"], nulls_last(*newest), 2, "_nth")
    values = star.observations.select("dataset_row_id", "obs_value").join(F.broadcast(last), "dataset_row_id")
    latest = top_k_per_group(values, ["category"], nulls_last(*newest, "-obs_value"), 2)
    at = lambda n: F.max(F.when(F.col("row_number") == n, F.col("obs_value"))).cast("double")
    last_two = latest.groupBy("category").agg(at(1).alias("latest"), at(2).alias("_previous"))
    stats = totals.groupBy("category").agg(
        ratio(F.sum("_sum"), F.sum("_values")).alias("avg"),
        percent(F.sum("_values"), F.sum("_rows")).alias("quality"),
        F.min("_min").cast("double").alias("min_value"),
        F.max("_max").cast("double").alias("max_value"),
        F.min("year").alias("first_period"),
        F.max("year").alias("last_period"),
        F.sum("_rows").alias("points"),
    )
    return (
        stats.join(last_two, "category")
        .withColumn("growth", growth_pct("latest", "_previous"))
        .drop("_previous")
        .orderBy("category")
    )


def freshness_status(df: DataFrame, updated: str, as_of: datetime) -> DataFrame:
    """Minutes since the last update at ``as_of`` and the status they stand for."""
    c = F.col(updated)
    seconds = F.timestamp_diff("SECOND", c, F.lit(as_of).cast(df.schema[updated].dataType))
    minutes = F.floor(seconds / 60).cast("long")
    status = (
        F.when(c.isNull(), "unknown").when(minutes < 5, "fresh").when(minutes < 30, "recent").otherwise("stale")
    )
    return df.withColumns({"minutes_ago": minutes, "status": status})


def year_territory_averages(star: Star, start_year: int) -> DataFrame:
    """Count and mean per year and territory from a first year on."""
    series = year_range(star.series, start_year)
    rows = Star(star.metadata, series, series_totals(star.observations)).series_observations()
    return (
        rows.groupBy("year", "territory_code")
        .agg(F.sum("_rows").alias("obs_count"), ratio(F.sum("_sum"), F.sum("_values")).alias("avg_value"))
        .orderBy(*nulls_last("year", "territory_code"))
    )


def table_stats(star: Star) -> DataFrame:
    """Row counts and coverage of the three tables in one result."""
    name = lambda t: F.lit(t).alias("table_name")
    meta = star.metadata.agg(
        F.count("*").alias("row_count"),
        F.count_distinct("category").alias("categories"),
        F.avg("completeness_score").cast("double").alias("avg_completeness"),
    ).select(name("dataset_metadata"), "*")
    series = star.series.agg(
        F.count("*").alias("row_count"),
        F.count_distinct("dataset_id").alias("categories"),
        F.count_distinct("year").cast("double").alias("avg_completeness"),
    ).select(name("datasets"), "*")
    per_series = Star(star.metadata, star.series, series_totals(star.observations)).series_observations()
    observations = per_series.agg(
        F.sum("_rows").alias("row_count"),
        F.count_distinct("dataset_id").alias("categories"),
        ratio(F.sum("_sum"), F.sum("_values")).alias("avg_completeness"),
    ).select(name("observations"), "*")
    return meta.unionByName(series).unionByName(observations)


def system_counts(tables: dict[str, DataFrame], star: Star) -> DataFrame:
    """Rows per metadata table, total observations and datasets with data."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    counts.append(star.observations.agg(F.count("*").alias("n")).select(F.lit("total_observations").alias("name"), "n"))
    counts.append(
        star.series.agg(F.count_distinct("dataset_id").alias("n")).select(F.lit("datasets_with_data").alias("name"), "n")
    )
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def records_per_dataset(raw: DataFrame) -> DataFrame:
    return raw.groupBy("dataset_id").agg(F.count("*").alias("records")).orderBy(*nulls_last("-records", "dataset_id"))


def dataset_periods(raw: DataFrame) -> DataFrame:
    return raw.groupBy("dataset_id").agg(
        F.count("*").alias("records"),
        F.min("time_period").alias("first_period"),
        F.max("time_period").alias("last_period"),
        F.count_distinct("time_period").alias("unique_periods"),
    )


def recent_ingestions(raw: DataFrame) -> DataFrame:
    return raw.groupBy("dataset_id").agg(
        F.max("ingestion_timestamp").alias("latest_ingestion"), F.count("*").alias("records")
    )


# fixed values: territory level by length of its code
LEVELS = {2: "Country", 3: "Area", 4: "Region"}


def territory_dimension(star: Star) -> DataFrame:
    """Distinct territories; level and parent follow from the code prefix (IT, ITC, ITC1)."""
    size = F.length("territory_code")
    level = F.lit("Province")
    for length, label in LEVELS.items():
        level = F.when(size == length, label).otherwise(level)
    parent = F.when(size > 2, F.expr("substring(territory_code, 1, length(territory_code) - 1)"))
    return (
        star.series.where("territory_code IS NOT NULL")
        .select("territory_code", "territory_name")
        .distinct()
        .select(
            F.col("territory_code").alias("TerritoryCode"),
            F.col("territory_name").alias("TerritoryName"),
            level.alias("Level"),
            parent.alias("ParentCode"),
        )
    )


def measure_dimension(star: Star) -> DataFrame:
    """Distinct measures with unit and data type (Integer when every value is whole)."""
    whole = F.max(F.when(F.col("obs_value") % 1 != 0, 1).otherwise(0))
    per_series = star.observations.groupBy("dataset_row_id").agg(whole.alias("_fraction"))
    rows = Star(star.metadata.select("dataset_id", "unit_of_measure"), star.series, per_series).joined()
    return rows.groupBy("measure_code", "measure_name").agg(
        F.min("unit_of_measure").alias("Unit"),
        F.when(F.max("_fraction") == 0, "Integer").otherwise("Decimal").alias("DataType"),
    ).withColumnsRenamed({"measure_code": "MeasureCode", "measure_name": "MeasureName"})


def period_differences(values: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Change against the period before, per key.

    Rows are first reduced to one value per key and period, so a group is never
    longer than the calendar, however many rows a dataset has.
    """
    per_period = values.groupBy(*keys, *order).agg(exact_avg(value).alias("value"))
    w = Window.partitionBy(*keys).orderBy(*nulls_last(*order))
    return per_period.withColumn("change", F.col("value") - F.lag("value").over(w))
