"""Counts of bad rows, duplicates, cleaning and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statspine.functions.columns import nulls_last, percent
from statspine.operators.aggregates import count_distinct_tuples, join_on

# fixed values: thresholds of the quality gate
COMPLETENESS_THRESHOLD = 0.8
MAX_NULL_SHARE = 0.3


def quality_counts(raw: DataFrame, value: str = "obs_value") -> DataFrame:
    return raw.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(value) == "").alias("empty_values"),
        F.count_if(F.col(value).isNull()).alias("null_values"),
    )


def exact_duplicates(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Rows beyond the first of every distinct tuple; tuples with NULL count as well."""
    distinct = count_distinct_tuples(raw, columns, "_d")
    return raw.agg(F.count("*").alias("_n")).select((F.col("_n") - distinct.scalar()).alias("exact_duplicates"))


def business_duplicates(raw: DataFrame, k: int = 20) -> DataFrame:
    """The k most repeated (dataset, period) keys with their distinct values, one row per value.

    The keys are found first, from counts; only their rows are looked at again. Values
    stay as rows: a repeated key may have any number of them.
    """
    keys = ["dataset_id", "time_period"]
    top = (
        raw.groupBy(*keys)
        .agg(F.count("*").alias("occurrences"))
        .where("occurrences > 1")
        .orderBy(*nulls_last("-occurrences", *keys))
        .limit(k)
    )
    values = raw.select(*keys, F.col("obs_value").alias("different_value")).where("different_value IS NOT NULL")
    return join_on(top, join_on(values, top.select(*keys), keys).distinct(), keys, "left")


def duplicate_record_ids(raw: DataFrame) -> DataFrame:
    return (
        raw.groupBy("dataset_id")
        .agg(F.count_distinct("record_id").alias("unique_records"), F.count("*").alias("total_records"))
        .withColumn("potential_duplicates", F.col("total_records") - F.col("unique_records"))
        .where("potential_duplicates > 0")
    )


def dedupe_keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key by ``order``; the remaining columns break ties.

    An aggregate keeps one candidate per key and task before the shuffle, so a key with
    many copies does not gather on one task. Maps cannot be compared and take part as
    arrays of their entries.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    maps = {c for c in rest if isinstance(df.schema[c].dataType, T.MapType)}
    columns = [F.map_entries(c).alias(c) if c in maps else F.col(c) for c in [*order, *rest]]
    first = df.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("r"))

    def column(c: str) -> Column:
        if c in keys:
            return F.col(c)
        return (F.map_from_entries(f"r.{c}") if c in maps else F.col(f"r.{c}")).alias(c)

    return first.select(*[column(c) for c in df.columns])


def _any_empty(df: DataFrame, test) -> Column:
    out = F.lit(0)
    for c in df.columns:
        out = out + F.when(test(df, c), 1).otherwise(0)
    return out


def _is_null(df: DataFrame, c: str) -> Column:
    return F.col(c).isNull()


def _is_blank(df: DataFrame, c: str) -> Column:
    if not isinstance(df.schema[c].dataType, T.StringType):
        return F.lit(False)
    return F.coalesce(F.col(c) == "", F.lit(False))


def quality_report(df: DataFrame) -> DataFrame:
    """Missing and empty cells, duplicate rows, rows left after cleaning, completeness %.

    One pass: equal rows collapse to a count, everything else follows from the counts.
    """
    distinct = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    nulls, blanks = _any_empty(df, _is_null), _any_empty(df, _is_blank)
    totals = distinct.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(nulls * F.col("_n")), F.lit(0)).alias("missing_values"),
        F.coalesce(F.sum(blanks * F.col("_n")), F.lit(0)).alias("empty_strings"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
        F.count_if((nulls + blanks) == 0).alias("cleaned_rows"),
    )
    return totals.withColumn("completeness_score", percent(F.col("cleaned_rows"), F.col("total_rows")))


def clean(df: DataFrame) -> DataFrame:
    """Rows without NULL, without empty text, without copies."""
    return df.where((_any_empty(df, _is_null) + _any_empty(df, _is_blank)) == 0).dropDuplicates()


def dataset_quality_score(datasets: DataFrame) -> DataFrame:
    """Score 0-100 from ``observations_count`` and ``payload_size`` of every dataset."""
    none, small = F.col("observations_count") == 0, F.col("payload_size") < 1000
    lost = F.when(none, 50.0).otherwise(0.0) + F.when(small, 10.0).otherwise(0.0)
    messages = F.array_compact(
        F.array(
            F.when(none, "no_observations"),
            F.when(small, "small_payload"),
        )
    )
    return datasets.withColumns(
        {
            "quality_score": F.greatest(F.lit(100.0) - lost, F.lit(0.0)),
            "completeness": F.when(none, 50.0).otherwise(100.0),
            "consistency": F.lit(100.0),
            "validation_errors": messages,
        }
    )


def threshold_check(
    df: DataFrame, completeness: float = COMPLETENESS_THRESHOLD, max_null_share: float = MAX_NULL_SHARE
) -> DataFrame:
    """NULL share of every column against the limit, and the share of filled cells overall.

    One aggregate over all columns; its single row is turned into one row per column.
    """
    shares = df.agg(
        *[F.try_divide(F.count_if(F.col(c).isNull()).cast("double"), F.count("*")).alias(c) for c in df.columns]
    )
    long = shares.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_share")) for c in df.columns])
        ).alias("s"),
        (1 - sum((F.col(c) for c in df.columns), F.lit(0.0)) / len(df.columns)).alias("completeness"),
    ).select("s.*", "completeness")
    return long.withColumns(
        {
            "null_share_ok": F.col("null_share") <= max_null_share,
            "completeness_ok": F.col("completeness") >= completeness,
        }
    )
