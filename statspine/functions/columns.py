"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it.

    The optimizer may copy the expression of a column into every place that uses it; a
    lambda variable it leaves alone.
    """
    return F.transform(F.array(value), body)[0]


def exact_avg(c: Column | str) -> Column:
    """Mean of a decimal column through its exact sum.

    The result does not depend on the order in which partitions are merged, so a
    recomputed task cannot change it. NULL for a group without values.
    """
    return F.try_divide(F.sum(col(c)).cast("double"), F.count(col(c)))


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def percent(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double") * F.lit(100.0), den.cast("double"))


def growth_pct(current: Column | str, previous: Column | str) -> Column:
    """(current - previous) / previous * 100; NULL without a previous value or when it is 0."""
    return F.try_divide(col(current) - col(previous), col(previous)) * F.lit(100.0)


def period_year(period: Column | str) -> Column:
    """Leading year of ``2024``, ``2024-Q1``, ``2024-01``; NULL for anything else."""
    c = col(period)
    return F.when(c.rlike(r"^[0-9]{4}(-|$)"), F.substring(c, 1, 4).cast("int"))


def period_type(period: Column | str) -> Column:
    c = col(period)
    return (
        F.when(c.rlike(r"^[0-9]{4}$"), "YEAR")
        .when(c.rlike(r"^[0-9]{4}-Q[1-4]$"), "QUARTER")
        .when(c.rlike(r"^[0-9]{4}-[0-9]{2}$"), "MONTH")
    )


def is_stray_timestamp(c: Column | str) -> Column:
    """Text that is a timestamp in the wrong field: longer than 15 with a T or two dashes."""
    c = col(c)
    return (F.length(c) > 15) & (c.contains("T") | c.rlike("-.*-"))


def contains_ci(c: Column | str, text: str) -> Column:
    """Case-insensitive substring test; NULL text never matches."""
    return F.coalesce(F.lower(col(c).cast("string")).contains(text.lower()), F.lit(False))


def nulls_last(*names: str) -> list[Column]:
    """Ascending sort keys; a leading ``-`` sorts that column descending."""
    return [
        F.col(n[1:]).desc_nulls_last() if n.startswith("-") else F.col(n).asc_nulls_last() for n in names
    ]
