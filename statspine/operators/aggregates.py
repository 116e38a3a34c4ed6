"""Grouped aggregates, counts, slices and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statspine.functions.columns import col, exact_avg, nulls_last
from statspine.operators.ranking import global_row_number, grouped_median

_FUNCTIONS = {
    "COUNT": lambda c: F.count(c),
    "SUM": lambda c: F.sum(c),
    "AVG": lambda c: exact_avg(c),
    "MIN": lambda c: F.min(c),
    "MAX": lambda c: F.max(c),
    "STDDEV": lambda c: F.stddev_samp(c),
    "VARIANCE": lambda c: F.var_pop(c),
    "COUNT_DISTINCT": lambda c: F.count_distinct(c),
}

MAX_PAGE_SIZE = 1000
# rows from the top up to which a slice is taken as a top-k; the result is the same on either side
NEAR_ROWS = 100_000
# codes of a coded column that may be joined into one text
MAX_CODES = 1000


def aggregate(df: DataFrame, keys: list[str], **columns: tuple[str, str]) -> DataFrame:
    """``aggregate(df, ["year"], avg_value=("AVG", "obs_value"))``.

    STDDEV is the sample form and VARIANCE the population form, as the function
    names have always meant here. MEDIAN is exact and needs at least one key.
    """
    plain = [_FUNCTIONS[f](col(c)).alias(n) for n, (f, c) in columns.items() if f != "MEDIAN"]
    out = df.groupBy(*keys).agg(*plain) if plain else df.select(*keys).distinct()
    for n, (f, c) in columns.items():
        if f == "MEDIAN":
            out = join_on(out, grouped_median(df, keys, c, n), keys, "left")
    return out.select(*keys, *columns)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def count_distinct_tuples(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Distinct tuples, counting those that contain NULL."""
    return df.agg(F.count_distinct(F.struct(*columns)).alias(name))


def having(df: DataFrame, condition: Column | str) -> DataFrame:
    return df.where(condition)


def joined_values(df: DataFrame, keys: list[str], value: str, name: str, separator: str = ", ") -> DataFrame:
    """Distinct values of a coded column per key, sorted and joined into one text.

    For columns with a short code list (status flags, units). The list is read from the data and
    checked first: free values, more than ``MAX_CODES`` of them, are refused; ``distinct_values``
    gives those as rows.
    """
    pairs = distinct_values(df, keys, value).where(F.col(value).isNotNull())
    if pairs.select(value).distinct().limit(MAX_CODES + 1).count() > MAX_CODES:
        raise ValueError(f"{value} is no coded column: it has more than {MAX_CODES} values")
    return pairs.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(value)), separator).alias(name))


def distinct_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.select(*keys, value).distinct()


def result_count(df: DataFrame, name: str = "row_count") -> DataFrame:
    """Rows of a result; for a grouped query, the number of groups."""
    return df.agg(F.count("*").alias(name))


def exists(df: DataFrame) -> DataFrame:
    """One row telling whether the query has any row; reads no more than one."""
    return df.limit(1).agg((F.count("*") > 0).alias("row_exists"))


def first(df: DataFrame, *order: Column) -> DataFrame:
    return (df.orderBy(*order) if order else df).limit(1)


def _with_ties(df: DataFrame, order_by: list[str]) -> list[Column]:
    """Sort keys: ``order_by`` and then all other columns, maps by their sorted entries; no two different rows tie."""
    named = {c.lstrip("-") for c in order_by}
    rest = [f for f in df.schema if f.name not in named]
    return nulls_last(*order_by) + [
        (F.array_sort(F.map_entries(f.name)) if isinstance(f.dataType, T.MapType) else F.col(f.name)).asc_nulls_last() for f in rest
    ]


def limit_offset(df: DataFrame, order_by: list[str], limit: int | None = None, offset: int = 0) -> DataFrame:
    """A slice in the order of the named columns (``-name`` for descending), ties broken by the other columns.

    A slice near the top is a top-k. For one without an end or far down every task would send all
    rows before it to one place, so that is cut out of a distributed numbering, in the same order.
    """
    if (limit is not None and limit < 0) or offset < 0:
        raise ValueError("limit and offset must not be negative")
    order = _with_ties(df, order_by)
    if offset and (limit is None or offset + limit > NEAR_ROWS):
        numbered = global_row_number(df, order_by, "_row")
        last = F.lit(True) if limit is None else F.col("_row") <= offset + limit
        return numbered.where((F.col("_row") > offset) & last).orderBy("_row").drop("_row")
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def page(df: DataFrame, order_by: list[str], page_number: int, page_size: int) -> DataFrame:
    """One page of an ordered result with ``total_count`` and ``has_next`` on every row.

    ``order_by`` are column names, ``-name`` for descending; the other columns break ties, so
    every row is on one page.
    """
    if page_number < 1 or not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError("page starts at 1; page_size is 1 to 1000")
    start = (page_number - 1) * page_size
    rows = limit_offset(df, order_by, page_size, start)
    total = df.agg(F.count("*")).scalar()
    return rows.withColumn("total_count", total).withColumn("has_next", F.col("total_count") > start + page_size)


def page_after(df: DataFrame, key: str, last_key, page_size: int) -> DataFrame:
    """Keyset page: the rows after the last key seen; the bound reaches the scan."""
    rows = df if last_key is None else df.where(F.col(key) > last_key)
    return rows.orderBy(F.col(key)).limit(page_size)
