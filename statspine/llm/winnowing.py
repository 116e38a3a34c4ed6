"""Document fingerprints by winnowing.

Every run of ``K`` code points is hashed; of every ``WINDOW`` consecutive hashes the smallest is kept, the rightmost of
equal ones, with its position. Texts that share a passage of ``K + WINDOW - 1`` code points share a kept hash.

Defined results: a null text is empty; an empty text keeps nothing; a text shorter than ``K`` is hashed whole, and one
with fewer than ``WINDOW`` hashes is one window; two empty fingerprints are alike (1), an empty and another are not (0);
rows that share an id are ordered by a hash of their text, null ids come first; a table of one row is its own
successor; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, WINDOW = 12, 8
#: windows handled at a time; positions within them take 24 of the 64 bits that are compared
SPAN = 1 << 22
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
LOW = np.uint64((1 << 24) - 1)


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k code points: runs of twice the length from two neighbours, until k is made up."""
    power, size, run = int(BASE), 1, points.astype(np.uint64)
    total, done = None, 0
    n = len(points) - k + 1
    while True:
        if k & size:
            if total is None:
                total = run[:n].copy()
            else:
                total = total * np.uint64(power) + run[done : done + n]
            done += size
        if done == k:
            break
        run = run[: len(run) - size] * np.uint64(power) + run[size:]
        power, size = power * power % (1 << 64), size * 2
    total ^= total >> np.uint64(32)
    total *= MIX
    total ^= total >> np.uint64(32)
    total *= MIX
    return total & ~LOW


def winnow(text: str | None, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes and their positions, in order of position."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(points):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes = gram_hashes(points, min(k, len(points)))
    window = min(window, len(hashes))
    kept_hashes, kept_at = [], []
    for at in range(0, len(hashes) - window + 1, SPAN):
        part = hashes[at : at + SPAN + window - 1]
        # position from the end in the low bits: of equal hashes the rightmost is the smallest
        low = part | np.arange(len(part) - 1, -1, -1, dtype=np.uint64)
        size = 1
        while size * 2 <= window:
            low = np.minimum(low[: len(low) - size], low[size:])
            size *= 2
        if size < window:
            low = np.minimum(low[: len(low) - (window - size)], low[window - size :])
        low = low[np.r_[True, low[1:] != low[:-1]]]
        kept_hashes.append(low & ~LOW)
        kept_at.append(at + len(part) - 1 - (low & LOW).astype(np.int64))
    h, p = np.concatenate(kept_hashes), np.concatenate(kept_at)
    new = np.r_[True, p[1:] != p[:-1]]
    return h[new], p[new]


def name(hashes: np.ndarray, positions: np.ndarray) -> str:
    """A fingerprint as text: how many hashes, and a digest of hashes and positions."""
    return f"{len(hashes):x}-{xxhash.xxh3_128_hexdigest(hashes.tobytes() + positions.tobytes())}"


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common hashes among the distinct hashes of two fingerprints (sorted, distinct)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(a) + len(b) - shared)


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, hashes, positions) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnow(t, k, window) for t in batch.column("text").to_pylist()]
            hashes = pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64()))
            positions = pa.array([p for _, p in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), hashes, positions], names=["doc_id", "hashes", "positions"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, hashes array<long>, positions array<long>")


def with_successor(docs: DataFrame) -> DataFrame:
    """Rows (bucket, carry, doc_id, text) dealt into ranges of ids and sorted, each range followed by a carried row:
    the first of the next range, after the last range the first of all. Only these few rows are sent twice."""
    spark = docs.sparkSession
    slim = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    cuts = F.array(*map(F.lit, sorted(set(cuts)))).cast("array<long>")
    slim = slim.withColumn("bucket", F.coalesce(F.size(F.filter(cuts, lambda c: c <= F.col("doc_id"))), F.lit(0)))
    # one row for each range, their number is set above
    firsts = slim.groupBy("bucket").agg(F.min(F.struct("doc_id", "h")).alias("first")).orderBy("bucket").collect()
    edges = [(r["bucket"], firsts[i - 1]["bucket"], r["first"]["doc_id"], r["first"]["h"]) for i, r in enumerate(firsts)]
    edge = spark.createDataFrame(edges, "b int, target int, d long, first_h long")
    first = (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("first_h"))
    carried = slim.join(F.broadcast(edge), first).select(F.col("target").alias("bucket"), F.lit(True).alias("carry"), "doc_id", "h", "text")
    rows = slim.select("bucket", F.lit(False).alias("carry"), "doc_id", "h", "text").union(carried)
    return rows.repartition("bucket").sortWithinPartitions("bucket", "carry", "doc_id", "h").drop("h")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike these and the next document's are."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(c).to_pylist() for c in ("bucket", "carry", "doc_id", "text")]
            for bucket, carry, doc, text in zip(*cols):
                text = text or ""
                if before is None and carry:
                    continue  # a further copy of the carried row
                h, p = winnow(text, k, window)
                now = (bucket, doc, text, h, p, np.unique(h))
                if before is not None:
                    _, was, own, bh, bp, bset = before
                    new = edited(own, text)
                    eh, ep = winnow(new, k, window)
                    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((was, len(own), digest, name(bh, bp), name(eh, ep), likeness(bset, np.unique(eh)), likeness(bset, now[5])))
                before = None if carry else now
            if out:
                kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_successor(docs).mapInArrow(each, schema)
