"""Stored forms: sketches, bucketed merges, clustered scans, statistics from footers."""

import glob
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from statspine.operators import partitioning as N
from statspine.operators import registry as M
from statspine.operators import sketches as K
from statspine.sources import store as I
from statspine.sources.bucketed import BucketedTable

T = datetime(2024, 1, 1)


def test_sketches_merge_over_any_span(spark, tmp_path):
    rng = random.Random(1)
    rows = [(g, p, rng.gauss(0, 10) + 100 * (g == "b"), rng.randrange(2000)) for g in "ab" for p in range(12) for _ in range(400)]
    rows += [("c", 0, None, None), ("c", 0, None, 5)]
    spark.createDataFrame(rows, "g string, p int, v double, k int").createOrReplaceTempView("sketch_rows")
    df = spark.table("sketch_rows").repartition(7)
    K.sketched(df, ["g", "p"], ("v",), ("k",)).write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert stored.count() == 25
    span = {r.g: r for r in K.estimated(K.merged(stored.where("p BETWEEN 3 AND 8"), ["g"])).collect()}
    for g in "ab":
        own = [r for r in rows if r[0] == g and 3 <= r[1] <= 8]
        below = sum(r[2] < span[g].v_quantile for r in own) / len(own)
        assert span[g]["rows"] == len(own) and abs(below - 0.5) <= K.RANK_ERROR
        exact = len({r[3] for r in own})
        assert abs(span[g].k_distinct - exact) <= K.COUNT_ERROR * exact
    (c,) = [r for r in K.estimated(K.merged(stored.where("p = 0"), ["g"])).collect() if r.g == "c"]
    assert (c["rows"], c.v_quantile, c.k_distinct) == (2, None, 1)
    (every,) = K.estimated(K.merged(stored, []), 0.9).collect()
    assert abs(sum(r[2] is not None and r[2] < every.v_quantile for r in rows) / 9600 - 0.9) <= K.RANK_ERROR
    assert K.merged(stored.where("false"), ["g"]).count() == 0


REGISTRY = "dataset_id long, name string, is_active boolean, updated_at timestamp"


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i}", True, T) for i in range(500)], REGISTRY)
    out = BucketedTable(str(tmp_path / "registry"), rows.schema, buckets=16)
    out.create(rows)
    return out


def files(table):
    return set(glob.glob(f"{table.path}/**/*.parquet", recursive=True))


def test_a_merge_rewrites_the_buckets_of_its_keys(spark, table):
    before = files(table)
    changes = spark.createDataFrame([(3, "new", False, T), (900, "added", False, T)], REGISTRY)
    met = {r.b for r in changes.select(table.bucket().alias("b")).collect()}
    assert table.merge(changes, M.upsert_latest) == met and 1 <= len(met) <= 2
    after = files(table)
    untouched = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in met}
    assert untouched <= after and not (before - untouched) & after
    got = {r.dataset_id: (r.name, r.is_active) for r in table.read(spark).collect()}
    assert len(got) == 501 and got[3] == ("new", True) and got[900] == ("added", True) and got[4] == ("n4", True)
    # the same again changes nothing
    assert table.merge(changes, M.upsert_latest) == set() and files(table) == after


def test_merges_that_only_mark_rows(spark, table):
    gone = spark.createDataFrame([(5,), (5,), (7777,), (None,)], "dataset_id long")
    deleted = lambda rows, ids: M.soft_delete(rows, ids, T)
    assert len(table.merge(gone, deleted)) == 1
    assert [r.dataset_id for r in table.read(spark).where("NOT is_active").collect()] == [5]
    assert table.merge(gone.limit(0), deleted) == set() and table.read(spark).count() == 500


def test_an_unfinished_version_is_the_next_merge_s_to_replace(spark, table):
    """Rows of an older version that was not deleted do not count."""
    changes = spark.createDataFrame([(3, "new", True, T)], REGISTRY)
    (bucket,) = {r.b for r in changes.select(table.bucket().alias("b")).collect()}
    old = table.read(spark, {bucket}).collect()
    table.merge(changes, M.upsert_latest)
    left = spark.createDataFrame(old, table.schema).withColumns({"bucket": F.lit(bucket), "version": F.lit(0)})
    left.write.mode("append").partitionBy("bucket", "version").parquet(table.path)
    assert {r.name for r in table.read(spark).where("dataset_id = 3").collect()} == {"new"} and table.read(spark).count() == 500
    assert BucketedTable(f"{table.path}-none", table.schema).read(spark).count() == 0


def scanned(df):
    """Rows that the scan handed on, after row groups were passed over."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value()


def test_a_scan_of_one_dataset_reads_its_row_groups(spark, tmp_path):
    ids = F.concat(F.lit("D"), F.format_string("%04d", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000)))
    rows = spark.range(200_000).select(ids.alias("dataset_id"), (F.col("id") % 30 + 1990).cast("string").alias("time_period"), F.col("id").cast("string").alias("obs_value"))
    I.write_clustered(rows, str(tmp_path / "c"), ["dataset_id", "time_period"], ["dataset_id", "obs_value"], row_group_bytes=64 << 10)
    stored = I.read_store(spark, str(tmp_path / "c"))
    assert stored.count() == 200_000
    one = I.scan_dataset(stored, "D0500")
    assert one.count() == 133 and scanned(one) < 20_000
    assert scanned(stored.where("dataset_id = 'D0500x'")) < 20_000
    # not clustered by this column: its filter tells
    value = stored.where("obs_value = '123456'")
    assert value.count() == 1 and scanned(value) < 40_000


def test_partition_statistics_come_from_footers(spark, tmp_path):
    rows = spark.createDataFrame([(i, 1990 + i % 25, ("IT", "FR1", None)[i % 3]) for i in range(300)], "id int, year int, territory_code string")
    N.write_partitioned(rows, str(tmp_path / "p"))
    stats = N.stored_partition_stats(spark, str(tmp_path / "p"), rows.schema)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(year), MAX(year)]" in plan and "PushedGroupBy: [decade, territory_group]" in plan
    want = N.with_partition_columns(rows).groupBy("decade", "territory_group").agg(F.count("*").alias("row_count"), F.min("year").alias("a"), F.max("year").alias("b"))
    assert sorted(map(tuple, stats.collect())) == sorted(map(tuple, want.collect()))
    assert "PushedAggregation: [COUNT" not in N.read_partitioned(spark, str(tmp_path / "p"), rows.schema).groupBy("decade").count()._jdf.queryExecution().executedPlan().toString()
