"""Filter conditions: the comparison operators a caller may name, as columns."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statspine.functions.columns import col

_COMPARE = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "LIKE": lambda c, v: c.like(v),
    "ILIKE": lambda c, v: c.ilike(v),
}


def condition(column: str | Column, op: str, value: Any = None) -> Column:
    """One condition. IN / NOT IN take a list, BETWEEN two values, IS [NOT] NULL none."""
    c, op = col(column), op.upper()
    if op in _COMPARE:
        return _COMPARE[op](c, value)
    if op in ("IN", "NOT IN"):
        if not isinstance(value, (list, tuple, set)):
            raise ValueError(f"{op} needs a list of values")
        member = c.isin(list(value))
        return member if op == "IN" else ~member
    if op == "BETWEEN":
        if not isinstance(value, (list, tuple)) or len(value) != 2:
            raise ValueError("BETWEEN needs exactly two values")
        return c.between(value[0], value[1])
    if op == "IS NULL":
        return c.isNull()
    if op == "IS NOT NULL":
        return c.isNotNull()
    raise ValueError(f"unknown operator: {op}")


def where(df: DataFrame, conditions: list[tuple], any_of: bool = False) -> DataFrame:
    """Rows that meet all conditions (or, with ``any_of``, at least one)."""
    columns = [condition(*c) for c in conditions]
    if not columns:
        return df
    return df.where(reduce(lambda a, b: (a | b) if any_of else (a & b), columns))


def year_range(df: DataFrame, start: int | None = None, end: int | None = None, column: str = "year") -> DataFrame:
    """Inclusive year bounds; either may be left open."""
    if start is not None:
        df = df.where(F.col(column) >= start)
    if end is not None:
        df = df.where(F.col(column) <= end)
    return df


def territories(df: DataFrame, codes: list[str] | None, column: str = "territory_code") -> DataFrame:
    return df.where(F.col(column).isin(list(codes))) if codes else df


def attribute(attributes: str | Column, key: str) -> Column:
    """Text value of one key of an attribute map."""
    return F.try_element_at(col(attributes), F.lit(key))


def json_attribute(text: str | Column, key: str) -> Column:
    """Text value of one top-level key of a JSON text column."""
    return F.get_json_object(col(text), f"$.{key}")


def clean_period_range(df: DataFrame, period: str = "time_period") -> DataFrame:
    """Earliest and latest period, leaving out timestamps in the period field."""
    return df.where(~F.col(period).like("%T%")).agg(F.min(period).alias("earliest"), F.max(period).alias("latest"))
