"""What several operators share: written tables, batches cut at group ends, local links, connected components."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statspine.session import outlives, scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package's Python files to the executors, once for each application."""
    context, root = spark.sparkContext, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if getattr(context, "_statspine_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="statspine-"), "statspine.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(archive)
    context._statspine_shipped = True


def written(df: DataFrame, purpose: str, result: bool = False) -> DataFrame:
    """``df`` written once to the shared scratch folder and read again: lineage ends there,
    and a lost executor costs no more than a read. A ``result`` stays when the present scratch scope is left."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    if result:
        outlives(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(rows: int, row_bytes: int, limit: int = 32 << 20) -> bool:
    """Whether so many rows may be broadcast; a join has to be shuffled beyond that."""
    return rows * row_bytes <= limit


def held_out(doc_id: str = "doc_id"):
    """Rows that no label may be learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """(text, label) of at most ``sample`` labelled rows, chosen by a hash of their id; none is held out."""
    known = labels.where(F.col(label).isNotNull() & ~held_out()).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = known.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 50) -> tuple[float, float]:
    """Intercept and slope by Newton steps, with a small ridge that keeps separable classes finite."""
    a = np.stack([np.ones_like(x), x], axis=1)
    b = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        move = np.linalg.solve(h, a.T @ (y - p) - ridge * b)
        b += move
        if np.abs(move).max() < 1e-9:
            break
    return float(b[0]), float(max(b[1], 0.0))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a group of equal ``keys`` ends; rows of a group must come together.

    A group is held in memory, so callers bound its size by dealing large groups into tiles.
    """
    kept: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        edge = np.zeros(rows.num_rows, dtype=bool)
        for k in keys:
            v = rows.column(k).to_numpy()
            edge[1:] |= v[1:] != v[:-1]
        changes = np.flatnonzero(edge)
        if kept and any(kept[-1].column(k)[-1].as_py() != rows.column(k)[0].as_py() for k in keys):
            yield pa.concat_tables(kept)
            kept = []
        if len(changes):
            yield pa.concat_tables([*kept, rows.slice(0, changes[-1])])
            kept = [rows.slice(changes[-1])]
        else:
            kept.append(rows)
    if kept:
        yield pa.concat_tables(kept)


def spanning(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that hold together what ``near`` links among ``n`` items, one less than its members for each group.

    ``near(i, others)`` tells which of ``others`` item i links with. Items once reached are not
    compared with each other again, so a dense group costs little more than one comparison for each member.
    """
    out: list[tuple[int, int]] = []
    rest = np.arange(n)
    while len(rest) > 1:
        first, rest = int(rest[0]), rest[1:]
        todo = [first]
        while todo and len(rest):
            at = todo.pop()
            hit = near(at, rest)
            found = rest[hit].tolist()
            out += [(at, x) for x in found]
            todo += found
            rest = rest[~hit]
    return out


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b: long) as (node, component), the smallest node naming a component.

    Alternating large-star and small-star steps: every step is a grouping with partial minima and a join, and
    ends in a written table, so a hub costs no more than its links and lineage stays short.
    """
    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    # each edge points from a larger node to a smaller one
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
