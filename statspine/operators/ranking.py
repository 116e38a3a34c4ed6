"""Ranks, row numbers and exact medians without a single-task window.

A window without PARTITION BY moves every row to one task, and a window over a hot
key moves that key's rows to one task. Here the distinct sort keys are counted first
(copies collapse before the shuffle) and cut into ordered ranges; the ranges are
written to the shared scratch folder, so that the totals per range and the numbering
inside a range are taken from the same cut. Medians are selected by counts alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statspine.functions.columns import nulls_last
from statspine.session import scratch_dir

# copies of a row that one task writes out at a time
COPY_CHUNK = 100_000


def cut_into_ranges(keys: DataFrame, order_by: list[str]) -> DataFrame:
    """The same rows as a written table, with the number of their range in ``_bucket``.

    Every row of a range sorts before every row of the next. ``keys`` must be unique on
    ``order_by``: then no range can be much larger than the others.
    """
    path = scratch_dir(keys.sparkSession, "ranges")
    ranged = keys.repartitionByRange(*nulls_last(*order_by)).withColumn("_bucket", F.spark_partition_id())
    ranged.write.parquet(path)
    return keys.sparkSession.read.schema(ranged.schema).parquet(path)


def running_start(ranged: DataFrame, order_by: list[str], weight: str) -> DataFrame:
    """Add ``start``: the sum of ``weight`` over all rows that sort before this one."""
    # one row per range, that is at most one per shuffle partition
    totals = ranged.groupBy("_bucket").agg(F.sum(weight).alias("_total"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = (
        Window.partitionBy("_bucket").orderBy(*nulls_last(*order_by)).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn("start", F.col("_offset") + F.col("_inside"))
        .drop("_bucket", "_offset", "_inside")
    )


def global_rank(df: DataFrame, by: str, name: str = "rank") -> DataFrame:
    """RANK() OVER (ORDER BY by); write ``-column`` for descending. Ties share a rank.

    Equal keys collapse to one row before they are ranged, so a key that holds a third
    of the rows weighs no more than any other.
    """
    key = by.lstrip("-")
    ranged = cut_into_ranges(df.groupBy(key).agg(F.count("*").alias("_n")), [by])
    ranks = running_start(ranged, [by], "_n").select(
        F.col(key).alias("_key"), (F.col("start") + 1).cast("long").alias(name)
    )
    return df.join(ranks, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def global_row_number(df: DataFrame, order_by: list[str], name: str = "Id") -> DataFrame:
    """ROW_NUMBER() OVER (ORDER BY order_by, remaining columns), numbered from 1.

    All columns take part in the order, so the numbering is the same in every run; maps do
    as arrays of their entries. Identical rows are counted first; a group of copies is cut into
    chunks before the ranges are, so a large one spreads over ranges, and written out again after.
    """
    maps = [f.name for f in df.schema if isinstance(f.dataType, T.MapType)]
    rows = df.withColumns({c: F.array_sort(F.map_entries(c)) for c in maps}) if maps else df
    named = {c.lstrip("-") for c in order_by}
    order = [*order_by, *(c for c in df.columns if c not in named), "_chunk"]
    first, size = F.lit(0).cast("long"), F.lit(COPY_CHUNK).cast("long")
    chunks = F.explode(F.sequence(first, F.col("_n") - 1, size)).alias("_chunk")
    counted = rows.groupBy(*df.columns).agg(F.count("*").alias("_n")).select(*df.columns, "_n", chunks)
    ranged = cut_into_ranges(counted.withColumn("_n", F.least(F.col("_n") - F.col("_chunk"), size)), order)
    out = running_start(ranged, order, "_n").withColumn("_copy", F.explode(F.sequence(first, F.col("_n") - 1)))
    own = [F.map_from_entries(c).alias(c) if c in maps else F.col(c) for c in df.columns]
    return out.select((F.col("start") + F.col("_copy") + 1).cast("long").alias(name), *own)


def top_k_per_group(df: DataFrame, keys: list[str], order_by: list[Column], k: int, name: str = "row_number") -> DataFrame:
    """First k rows of every group; Catalyst keeps k rows per group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= k)


# intervals that a group's values are counted in at a time, and rows of a group that are counted by value in the end
INTERVALS = 1024
COUNTED = 50_000
# groups whose bounds are handed to every task, and rounds of narrowing; beyond either, values are cut into ranges
GROUPS = 50_000
ROUNDS = 12


def grouped_median(df: DataFrame, keys: list[str], value: str, name: str = "median_value") -> DataFrame:
    """Exact interpolated median per group, also for groups too large for one task.

    By selection: values are counted by group and interval where they lie, the interval that holds the middle is cut
    again, and when few values are left these are counted one by one. What is shuffled are counts. The rows are written
    once, since each round reads them.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    path = scratch_dir(df.sparkSession, "values")
    rows.write.parquet(path)
    return selected_median(df.sparkSession.read.schema(rows.schema).parquet(path), keys, "_v", name)


def selected_median(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``grouped_median`` of a written table whose values are not NULL."""
    spark, v = rows.sparkSession, F.col(value).cast("double")
    places = [F.floor((F.count("*") - 1) / 2), F.floor(F.count("*") / 2)]
    bounds = rows.groupBy(*keys).agg(
        F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count("*").alias("_n"), *[p.alias(f"_r{i}") for i, p in enumerate(places)]
    )
    schema = bounds.schema

    def stored(df: DataFrame) -> DataFrame:
        path = scratch_dir(spark, "bounds")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def inside(open_: DataFrame) -> DataFrame:
        """Rows within the bounds of their group, which stay on every machine: there is one row for each group."""
        named = open_.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], "_lo", "_hi", "_r0", "_r1")
        on = F.lit(True)
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_g{i}"))
        return rows.join(F.broadcast(named), on).where((v >= F.col("_lo")) & (v <= F.col("_hi")))

    bounds, found = stored(bounds), []
    for _ in range(ROUNDS):
        span = F.col("_hi") - F.col("_lo")
        groups, left, wide = bounds.agg(
            F.count("*"), F.coalesce(F.max(F.when(F.col("_lo") < F.col("_hi"), F.col("_n"))), F.lit(0)), F.coalesce(F.max(F.isnan(span) | (span == float("inf"))), F.lit(False))
        ).first()
        if groups > GROUPS or wide:
            break
        found.append(bounds.where("_lo = _hi").select(*keys, F.col("_lo").alias("_m0"), F.col("_lo").alias("_m1")))
        open_ = bounds.where("_lo < _hi")
        if left <= COUNTED:
            if left:
                found.append(_counted_middle(inside(open_), keys, v))
            out = found[0]
            for more in found[1:]:
                out = out.unionByName(more)
            return out.select(*keys, ((F.col("_m0") + F.col("_m1")) / 2).alias(name))
        at = F.least(F.floor((v - F.col("_lo")) / span * INTERVALS), F.lit(INTERVALS - 1)).cast("int")
        counts = inside(open_).groupBy(*keys, at.alias("_at")).agg(F.count("*").alias("_c"), F.min(v).alias("_min"), F.max(v).alias("_max"), F.max("_r0").alias("_r0"), F.max("_r1").alias("_r1"))
        before = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        holds = [(F.col("_b") <= F.col(r)) & (F.col(r) < F.col("_b") + F.col("_c")) for r in ("_r0", "_r1")]
        halves = [F.max(F.when(h, F.struct("_b", "_c", "_min", "_max"))).alias(f"_h{i}") for i, h in enumerate(holds)]
        middle = stored(counts.groupBy(*keys).agg(*halves, F.max("_r0").alias("_r0"), F.max("_r1").alias("_r1")))
        # the two middle values are on either side of an edge, or in the same interval
        same = F.col("_h0._b") == F.col("_h1._b")
        found.append(middle.where(~same).select(*keys, F.col("_h0._max").alias("_m0"), F.col("_h1._min").alias("_m1")))
        bounds = middle.where(same).select(
            *keys, F.col("_h0._min").alias("_lo"), F.col("_h0._max").alias("_hi"), F.col("_h0._c").alias("_n"),
            *[(F.col(r) - F.col("_h0._b")).alias(r) for r in ("_r0", "_r1")],
        ).select(*schema.names)
    counted = rows.withColumn("_x", v).groupBy(*keys, "_x").agg(F.count("*").alias("_n"))
    return ranged_median(cut_into_ranges(counted, [*keys, "_x"]), keys, [*keys, "_x"], "_x", "_n", name)


def _counted_middle(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """The values at places ``_r0`` and ``_r1`` of every group."""
    counts = rows.groupBy(*keys, value.alias("_x")).agg(F.count("*").alias("_c"), F.max("_r0").alias("_r0"), F.max("_r1").alias("_r1"))
    before = Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    holds = [(F.col("_b") <= F.col(r)) & (F.col(r) < F.col("_b") + F.col("_c")) for r in ("_r0", "_r1")]
    return counts.groupBy(*keys).agg(*[F.max(F.when(h, F.col("_x"))).alias(f"_m{i}") for i, h in enumerate(holds)])


def ranged_median(ranged: DataFrame, keys: list[str], order: list[str], value: str, weight: str, name: str) -> DataFrame:
    """Median per group of values that stand ``weight`` times each, from ranges in the order of keys and value."""
    started = running_start(ranged, order, weight)
    groups = started.groupBy(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]).agg(
        F.min("start").alias("_base"), F.sum(weight).alias("_total")
    )
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_g{i}"))
    placed = started.join(groups, on).withColumn("_at", F.col("start") - F.col("_base"))
    holds = lambda r: (F.col("_at") <= r) & (r < F.col("_at") + F.col(weight))
    middle = [F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)]
    picked = placed.where(holds(middle[0]) | holds(middle[1])).groupBy(*keys).agg(
        *[F.max(F.when(holds(m), F.col(value).cast("double"))).alias(f"_m{i}") for i, m in enumerate(middle)]
    )
    return picked.select(*keys, ((F.col("_m0") + F.col("_m1")) / 2).alias(name))
