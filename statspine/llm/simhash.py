"""SimHash near-duplicates: fingerprints of word shingles, matched through an inverted index on their bytes.

Two 64-bit fingerprints that differ in at most ``distance`` bits agree in at least ``8 - distance`` of their eight
bytes. The index therefore posts each distinct fingerprint under sets of byte positions with their values, so chosen
that any ``8 - distance`` positions contain one of the sets; fingerprints of one posting list are tallied for shared
bytes, those with the guaranteed minimum are verified by their bit distance.

Defined results: null and empty texts have no word and fingerprint zero, which links like any other; repeated rows keep
their rows; an empty table gives an empty table; rows with a null id take part, and a component of such rows alone has
a null id. Columns beside id and text are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statspine.llm.common import components, spanning, whole_groups, written

SHINGLE, DISTANCE = 4, 4
#: fingerprints of a posting list that meet in one task; longer lists are dealt into tiles of two such parts
PART = 4096
#: the mean posting list that a set of byte positions may have before another position is added to the sets
MEAN_LIST = 16
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is set where over half of the shingle hashes have it; as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], dtype="<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())], dtype="<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<i8")[0])


def fingerprints(text, shingle: int = SHINGLE):
    """Column of fingerprints of a text column."""

    @F.pandas_udf(T.LongType())
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(x, shingle) for x in texts], dtype="int64")

    return each(text)


def position_sets(width: int, distance: int = DISTANCE) -> list[tuple[int, ...]]:
    """Sets of ``width`` byte positions of which any ``8 - distance`` positions contain one, chosen greedily."""
    open_ = set(combinations(range(8), 8 - distance))
    every = list(combinations(range(8), width))
    chosen = []
    while open_:
        best = max(every, key=lambda s: sum(set(s) <= set(m) for m in open_))
        chosen.append(best)
        open_ = {m for m in open_ if not set(best) <= set(m)}
    return chosen


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that connect all fingerprints of ``prints`` (fp, distinct) within ``distance`` of each other.

    Not every pair is returned: within a posting list only as many as keep its groups connected.
    """
    shared = 8 - distance
    if not 0 <= distance < 8:
        raise ValueError("the index needs a distance of 0 to 7 bits")
    n = prints.count()
    width = next((w for w in range(1, shared + 1) if n / 256**w <= MEAN_LIST), shared)
    key = [
        F.concat(F.lit(bytes([i])), *(F.substring(F.to_binary(F.lpad(F.hex("fp"), 16, "0"), F.lit("hex")), p + 1, 1) for p in s))
        for i, s in enumerate(position_sets(width, distance))
    ]
    posted = prints.select("fp", F.explode(F.array(*key)).alias("key"))
    long_ = posted.groupBy("key").count().where(F.col("count") > PART)
    parts = F.coalesce(F.ceil(F.col("count") / PART), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    dealt = (
        posted.join(long_, "key", "left")
        .select("fp", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
        .select("fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("tile"))
    )

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["tile"]):
            fp, tile = rows.column("fp").to_numpy(), rows.column("tile").to_numpy()

            def linked(x):
                x = np.ascontiguousarray(x)
                tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= shared
                return tally & (np.bitwise_count(x.view(np.uint64)) <= distance)

            starts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
            sizes = np.diff(np.r_[starts, len(tile)])
            small = np.repeat(sizes <= 8, sizes)
            pairs = []
            for step in range(1, 8):
                at = np.flatnonzero(small[:-step] & (tile[step:] == tile[:-step]))
                at = at[linked(fp[at] ^ fp[at + step])] if len(at) else at
                pairs.append(np.stack([fp[at], fp[at + step]], axis=1))
            for start, size in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist()):
                own = fp[start : start + size]
                found = spanning(size, lambda i, rest, own=own: linked(own[i] ^ own[rest]))
                if found:
                    pairs.append(own[np.array(found)])
            out = np.unique(np.concatenate(pairs), axis=0)
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    sorted_ = dealt.repartition("tile").sortWithinPartitions("tile", "fp")
    return sorted_.mapInArrow(match, "a long, b long")


def near_duplicates(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``prints`` (doc_id, fp, written) with its component and the smallest id in it, as component_id."""
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    groups = components(links(classes.select("fp"), distance))
    reach = classes.join(groups, classes.fp == groups.node, "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    least = reach.groupBy("component").agg(F.min("first").alias("component_id"))
    return prints.join(reach.join(least, "component").select("fp", "component", "component_id"), "fp")


def components_of(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    prints = written(docs.select("doc_id", fingerprints(F.col("text"), shingle).alias("fp")), "simhash")
    return near_duplicates(prints, distance)


def keep_first(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each component, that with its smallest id (of repeated rows, any one)."""
    rows = written(
        docs.select(F.struct("*").alias("row"), "doc_id", fingerprints(F.col("text"), shingle).alias("fp")).withColumn(
            "at", F.monotonically_increasing_id()
        ),
        "simhash-rows",
    )
    found = near_duplicates(rows.select("doc_id", "fp", "at"), distance)
    one = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("at").alias("at"))
    return rows.join(one.select("at"), "at", "left_semi").select("row.*")


def fp_text(fp):
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
