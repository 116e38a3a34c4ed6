"""Table-client options (filter, order, skip, top, select, count) on a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statspine.functions.columns import contains_ci
from statspine.operators.aggregates import limit_offset
from statspine.operators.analytics import dataset_time_series
from statspine.operators.ranking import global_row_number

OPERATORS = ("eq", "ne", "gt", "contains")


def filter_rows(df: DataFrame, conditions: list[tuple[str, str, str]]) -> DataFrame:
    """(field, op, value) triples joined by AND.

    eq and ne compare text, gt compares numbers (text that is no number never
    matches), contains ignores case. An unknown field or operator is an error.
    """
    for field, op, value in conditions:
        if field not in df.columns:
            raise ValueError(f"unknown field: {field}")
        c = F.col(field)
        if op == "eq":
            df = df.where(c.cast("string") == str(value))
        elif op == "ne":
            # a missing value differs from every given value
            df = df.where(~c.cast("string").eqNullSafe(str(value)))
        elif op == "gt":
            df = df.where(c.try_cast("double") > float(value))
        elif op == "contains":
            df = df.where(contains_ci(c, str(value)))
        else:
            raise ValueError(f"unknown operator: {op}; use one of {OPERATORS}")
    return df


def order_rows(df: DataFrame, order: str | None) -> DataFrame:
    """``"Field"``, ``"Field asc"`` or ``"Field desc"``; the other columns break ties."""
    return limit_offset(df, [_sort_name(df, order)]) if order else df


def _sort_name(df: DataFrame, order: str) -> str:
    field, *direction = order.split()
    if field not in df.columns:
        raise ValueError(f"unknown field: {field}")
    return f"-{field}" if direction and direction[0].lower() == "desc" else field


def query(
    df: DataFrame,
    conditions: list[tuple[str, str, str]] | None = None,
    order: str | None = None,
    skip: int = 0,
    top: int = 0,
    select: list[str] | None = None,
) -> DataFrame:
    """Filter, sort, skip, take, project, in that order. ``top=0`` is no limit; unknown
    names in ``select`` are ignored. A slice without an order is taken in column order."""
    rows = filter_rows(df, conditions or [])
    if not order and (skip or top):
        order = df.columns[0]
    if skip or top:
        rows = limit_offset(rows, [_sort_name(df, order)], top or None, skip)
    else:
        rows = order_rows(rows, order)
    if select:
        rows = rows.select(*[c for c in df.columns if c in {s.strip() for s in select}])
    return rows


def query_count(df: DataFrame, conditions: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Rows that match, before skip and top."""
    return filter_rows(df, conditions or []).agg(F.count("*").alias("count"))


def dataset_entities(registry: DataFrame, stats: DataFrame) -> DataFrame:
    """Registry rows under their entity names; missing statistics are 0 (years stay empty)."""
    joined = registry.drop("record_count").join(stats, "dataset_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        F.col("dataset_id").alias("DatasetId"),
        F.col("name").alias("Name"),
        F.col("category").alias("Category"),
        F.col("description").alias("Description"),
        F.coalesce("priority", F.lit(5)).alias("Priority"),
        zero("record_count").alias("RecordCount"),
        F.col("min_year").alias("MinYear"),
        F.col("max_year").alias("MaxYear"),
        zero("territory_count").alias("TerritoryCount"),
        zero("measure_count").alias("MeasureCount"),
    )


def observation_entities(
    raw: DataFrame, dataset_id, conditions: list[tuple[str, str, str]] | None = None
) -> DataFrame:
    """Observations of one dataset, numbered in time order before any further filter.

    The dataset is required: without it a client would number the whole table.
    """
    if dataset_id is None or dataset_id == "":
        raise ValueError("a dataset id is required for observations")
    series = dataset_time_series(raw, dataset_id).select(
        F.col("dataset_id").alias("DatasetId"),
        F.col("year").alias("Year"),
        F.col("time_period").alias("TimePeriod"),
        F.col("record_id").alias("_record"),
        F.col("territory_code").alias("TerritoryCode"),
        F.col("territory_name").alias("TerritoryName"),
        F.col("measure_code").alias("MeasureCode"),
        F.col("measure_name").alias("MeasureName"),
        F.col("obs_value").alias("ObsValue"),
        F.col("obs_status").alias("ObsStatus"),
    )
    numbered = global_row_number(series, ["TimePeriod", "_record"], "Id").drop("_record")
    return filter_rows(numbered, conditions or [])
