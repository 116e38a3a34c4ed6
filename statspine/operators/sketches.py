"""Approximate medians and distinct counts from sketches that are stored once and merged over any span.

A sketch of a group is a few kilobytes whatever the group holds. Values go into KLL sketches, whose quantiles are off by a
share of the ranks; keys into HyperLogLog sketches, whose counts are off by a share of themselves. Sketches of finer groups
add up to those of wider ones, so a span of periods is answered from one row for each period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# accuracy: a KLL sketch with k = 400 is off by 0.7 % of the ranks, a HyperLogLog sketch of 2^12 cells by 1.6 %, in most cases
KLL_K = 400
HLL_LOG_CELLS = 12
#: what a result may be off in tests and queries: three times that and more
RANK_ERROR = 0.03
COUNT_ERROR = 0.06


def sketched(rows: DataFrame, keys: list[str], values: tuple[str, ...] = (), distinct: tuple[str, ...] = ()) -> DataFrame:
    """One row per group: rows, ``<value>_kll`` and ``<column>_hll``; one pass, partial sketches before the shuffle."""
    columns = [F.kll_sketch_agg_double(F.col(v).cast("double"), F.lit(KLL_K)).alias(f"{v}_kll") for v in values]
    columns += [F.hll_sketch_agg(F.col(c), F.lit(HLL_LOG_CELLS)).alias(f"{c}_hll") for c in distinct]
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), *columns)


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of wider groups; an empty list of keys merges all."""
    columns = [F.kll_merge_agg_double(c).alias(c) for c in sketches.columns if c.endswith("_kll")]
    columns += [F.hll_union_agg(c).alias(c) for c in sketches.columns if c.endswith("_hll")]
    return sketches.groupBy(*keys).agg(F.sum("rows").alias("rows"), *columns)


def estimated(sketches: DataFrame, quantile: float = 0.5) -> DataFrame:
    """Sketch columns as numbers: ``<value>_kll`` as ``<value>_quantile``, ``<column>_hll`` as ``<column>_distinct``."""
    out = []
    for c in sketches.columns:
        if c.endswith("_kll"):
            some = F.kll_sketch_get_n_double(c) > 0
            out.append(F.when(some, F.kll_sketch_get_quantile_double(c, F.lit(quantile))).alias(f"{c.removesuffix('_kll')}_quantile"))
        elif c.endswith("_hll"):
            out.append(F.hll_sketch_estimate(c).alias(f"{c.removesuffix('_hll')}_distinct"))
        else:
            out.append(F.col(c))
    return sketches.select(*out)
