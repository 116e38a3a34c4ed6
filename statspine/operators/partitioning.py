"""Partition keys, predicates that prune them, and per-key statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statspine.operators.predicates import territories, year_range

PARTITION_COLUMNS = ["decade", "territory_group"]


def partition_key(strategy: str, columns: list[str] | None = None) -> Column:
    """``year``, ``territory``, ``hybrid``, or ``columns`` for the generic ``col_value`` form."""
    code = F.coalesce("territory_code", F.lit("UNKNOWN"))
    if strategy == "year":
        return F.concat(F.lit("year_"), F.col("year").cast("string"))
    if strategy == "territory":
        return F.when(code.startswith("IT"), F.concat(F.lit("territory_italy_"), F.substring(code, 1, 4))).otherwise(
            F.concat(F.lit("territory_"), F.substring(code, 1, 2))
        )
    if strategy == "hybrid":
        return F.concat(F.lit("hybrid_"), decade().cast("string"), F.lit("s_"), territory_group())
    if strategy == "columns":
        # NULL values are left out of the key
        parts = [F.concat(F.lit(f"{c}_"), F.col(c).cast("string")) for c in columns or []]
        return F.concat_ws("_", *parts)
    raise ValueError(f"unknown partition strategy: {strategy}")


def decade() -> Column:
    return (F.floor(F.col("year") / 10) * 10).cast("int")


def territory_group() -> Column:
    code = F.coalesce("territory_code", F.lit("UNKNOWN"))
    return F.when(code == "", "UNK").otherwise(F.substring(code, 1, 2))


def with_partition_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({"decade": decade(), "territory_group": territory_group()})


def write_partitioned(df: DataFrame, path: str, mode: str = "append") -> None:
    """Store by decade and territory group, rows sorted by year and territory inside a file.

    The rebalance hint lets adaptive execution split a group that is too large for one
    task and merge small ones.
    """
    keyed = with_partition_columns(df).hint("rebalance", *PARTITION_COLUMNS)
    sorted_rows = keyed.sortWithinPartitions(*PARTITION_COLUMNS, "year", "territory_code")
    sorted_rows.write.mode(mode).partitionBy(*PARTITION_COLUMNS).parquet(path)


def read_partitioned(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A partitioned table whose rows have ``schema``; groups stay text, ``01`` is not the number 1."""
    keys = [T.StructField("decade", T.IntegerType()), T.StructField("territory_group", T.StringType())]
    return spark.read.schema(T.StructType([*(f for f in schema if f.name not in PARTITION_COLUMNS), *keys])).parquet(path)


def prune(
    df: DataFrame, start_year: int | None = None, end_year: int | None = None, codes: list[str] | None = None
) -> DataFrame:
    """Year and territory filter; on a partitioned table also the directory predicates they imply."""
    rows = territories(year_range(df, start_year, end_year), codes)
    if not set(PARTITION_COLUMNS) <= set(df.columns):
        return rows
    if start_year is not None:
        rows = rows.where(F.col("decade") >= start_year // 10 * 10)
    if end_year is not None:
        rows = rows.where(F.col("decade") <= end_year // 10 * 10)
    if codes:
        rows = rows.where(F.col("territory_group").isin(sorted({c[:2] or "UNK" for c in codes})))
    return rows


def partition_stats(df: DataFrame, key: str = "partition_key") -> DataFrame:
    return df.groupBy(key).agg(
        F.count("*").alias("row_count"),
        F.min("year").alias("min_year"),
        F.max("year").alias("max_year"),
        F.count_distinct("territory_code").alias("territory_count"),
    )


def footer_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` whose Parquet scans answer counts, smallest and largest values from file footers."""
    beside = spark.newSession()
    beside.conf.set("spark.sql.sources.useV1SourceList", "csv,json,orc,text")
    beside.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return beside


def stored_partition_stats(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows, first and last year by decade and territory group of a table that ``write_partitioned`` wrote.

    All of it stands in the files' footers: no data column is read.
    """
    rows = read_partitioned(footer_session(spark), path, schema)
    return rows.groupBy(*PARTITION_COLUMNS).agg(F.count("*").alias("row_count"), F.min("year").alias("min_year"), F.max("year").alias("max_year"))


def partition_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.count("*").alias("total_partitions"),
        F.coalesce(F.max("row_count"), F.lit(0)).alias("largest_partition"),
        F.coalesce(F.min("row_count"), F.lit(0)).alias("smallest_partition"),
    )


def partition_keys(df: DataFrame, key: str = "partition_key") -> DataFrame:
    return df.select(key).distinct()


def partition_view(series: DataFrame, observations: DataFrame, key_value: str, key: str = "partition_key") -> DataFrame:
    """Series of one partition key with their values; series without values stay."""
    rows = series.where(F.col(key) == key_value)
    values = observations.select("dataset_row_id", "obs_value", "obs_status", "value_type")
    return rows.join(values, F.col("id") == F.col("dataset_row_id"), "left").drop("dataset_row_id")
