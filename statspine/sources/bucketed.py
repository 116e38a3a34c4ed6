"""A stored table in hash buckets of its key, of which a change rewrites only the buckets that it meets.

``<path>/bucket=<b>/version=<n>`` holds the rows of bucket b; the highest version counts. A merge writes new versions of the
buckets whose rows it changes, each complete before it shows, and then deletes the old ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statspine.session import scratch_dir

BUCKETS = 64


@dataclass
class BucketedTable:
    path: str
    schema: T.StructType
    key: str = "dataset_id"
    buckets: int = BUCKETS

    def bucket(self, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(key or self.key), F.lit(self.buckets)).cast("int")

    def _versions(self, spark: SparkSession) -> dict[int, list[tuple[int, str]]]:
        """Versions of each bucket with their folders, the one that counts last."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}/bucket=*/version=*")
        found: dict[int, list[tuple[int, str]]] = {}
        for f in at.getFileSystem(conf).globStatus(at) or []:
            folder = str(f.getPath().toString())
            bucket, version = folder.split("bucket=")[-1].split("/version=")
            found.setdefault(int(bucket), []).append((int(version), folder))
        return {b: sorted(v) for b, v in found.items()}

    def read(self, spark: SparkSession, buckets: set[int] | None = None) -> DataFrame:
        """The table's rows, or those of some buckets."""
        folders = [v[-1][1] for b, v in self._versions(spark).items() if buckets is None or b in buckets]
        return spark.read.schema(self.schema).parquet(*folders) if folders else spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame, version: Column) -> None:
        writer = rows.withColumn("version", version).repartition("bucket").sortWithinPartitions("bucket", self.key)
        writer.write.mode("append").partitionBy("bucket", "version").parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        self._write(rows.select(*self.schema.names).withColumn("bucket", self.bucket()), F.lit(0))

    def merge(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> set[int]:
        """Replace the rows of the buckets that ``changes`` fall into by ``apply(rows, changes)``; returns the buckets rewritten.

        A bucket whose rows stay as they are is left alone, so the same changes again write nothing. ``changes`` are read once.
        """
        spark = changes.sparkSession

        def stored(df: DataFrame, purpose: str) -> DataFrame:
            path = scratch_dir(spark, purpose)
            df.write.parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        changes = stored(changes, "changes")
        met = {r["b"] for r in changes.select(self.bucket().alias("b")).distinct().collect()}
        old = self.read(spark, met)
        new = stored(apply(old, changes).select(*self.schema.names).withColumn("bucket", self.bucket()), "merged")
        # a bucket's rows in any order: how many, and the sum of their hashes
        mark = [F.count("*").alias("n"), F.sum(F.xxhash64(*[self._hashable(f) for f in self.schema]).cast("decimal(38,0)")).alias("h")]
        was = {r["b"]: (r["n"], r["h"]) for r in old.groupBy(self.bucket().alias("b")).agg(*mark).collect()}
        now = {r["b"]: (r["n"], r["h"]) for r in new.groupBy(F.col("bucket").alias("b")).agg(*mark).collect()}
        changed = {b for b in now if now[b] != was.get(b)}
        if not changed:
            return changed
        before = self._versions(spark)
        version = 1 + max((v[-1][0] for v in before.values()), default=-1)
        self._write(new.where(F.col("bucket").isin(sorted(changed))), F.lit(version))
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for b in changed:
            for _, folder in before.get(b, []):
                at = jvm.org.apache.hadoop.fs.Path(folder)
                at.getFileSystem(conf).delete(at, True)
        return changed

    @staticmethod
    def _hashable(field: T.StructField) -> Column:
        return F.array_sort(F.map_entries(field.name)) if isinstance(field.dataType, T.MapType) else F.col(field.name)
