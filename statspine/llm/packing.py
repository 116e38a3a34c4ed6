"""Best-fit packing of token sequences by bulk-synchronous rounds.

Pieces of one length are interchangeable, so documents and gaps are runs: a length and an interval of ranks, a gap and
an interval of sequence numbers. A table of runs has at most one row per length whatever the number of documents. Each
round takes the band of lengths down to half of the last, range-sorts its documents and the open gaps, and sweeps them
downwards: every document finds its successor gap, the smallest that holds it; of documents that want the same gap the
lower ranks get it, the others go to the next gap or open a sequence. Gaps are updated and the next band follows.
Documents get their places back by one join on length and rank.

Defined results: null texts are empty; an empty text is one piece that holds the closing id; repeated rows are packed
each for itself; an empty table gives an empty table; a null id is kept. Columns beside id and text are not read.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statspine.llm.common import written

CAPACITY = 2048
#: closes each document
CLOSE = 0
#: pieces of one length that one task numbers
PART = 20_000
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def encoder(ranks: str, pattern: str):
    """Byte-level BPE from a file of ranks; it gives the same ids as the JSON form of that vocabulary, several times faster."""
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={SPECIAL: len(table)})


def token_ids(text: str | None, ranks: str, pattern: str) -> array:
    """Ids of a text; the name of the special token stands for it, as where the JSON form is loaded with its defaults."""
    text, code = text or "", encoder(ranks, pattern)
    return array("I", code.encode(text, allowed_special="all") if SPECIAL in text else code.encode_ordinary(text))


def pieces(docs: DataFrame, ranks: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every document, ids as little-endian unsigned 32-bit numbers.

    Documents longer than ``capacity`` are cut so that only their first piece is shorter than that.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a few texts at a time: their ids take several times the room of the texts
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                cols: tuple[list, ...] = ([], [], [], [], [])
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = token_ids(text, ranks, pattern)
                    ids.append(CLOSE)
                    edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        for col, v in zip(cols, (doc, k, a, b - a, ids[a:b].tobytes())):
                            col.append(v)
                kinds = (batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids"]
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids binary")


RUN = "kind int, size long, start long, n long, seq long, gap long"


def sweep(capacity: int, first: int, docs: list[list[int]], gaps: list[list[int]]) -> Iterator[tuple]:
    """Runs of documents (size, rank, n) and gaps (gap, sequence, n): what was placed (kind 2) and the gaps left (kind 1).

    ``first`` numbers the sequences that are opened in this round.
    """
    heap = [(gap, seq, n) for gap, seq, n in gaps]
    waiting = sorted(heap, reverse=True)  # gaps below the present size, largest last in line for the next
    waiting.reverse()
    fits: list[tuple[int, int, int]] = []
    for size, rank, n in sorted(docs, reverse=True):
        while waiting and waiting[-1][0] >= size:
            heapq.heappush(fits, waiting.pop())
        while n:
            if fits:
                gap, seq, m = heapq.heappop(fits)
            else:
                m = -(-n // (capacity // size))
                gap, seq, first = capacity, first, first + m
            c = min(n, m)
            if m > c:
                heapq.heappush(fits, (gap, seq + c, m - c))
            yield 2, size, rank, c, seq, gap
            rank, n, gap = rank + c, n - c, gap - size
            if gap >= size:
                heapq.heappush(fits, (gap, seq, c))
            elif gap:
                at = len(waiting)
                while at and waiting[at - 1][0] > gap:
                    at -= 1
                waiting.insert(at, (gap, seq, c))
    for gap, seq, n in [*fits, *waiting]:
        yield 1, gap, seq, n, 0, 0


def best_fit(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (length from 1 to ``capacity``, and any other columns) with sequence_id and offset of their places."""
    spark = items.sparkSession
    items = written(items, "pack-items")
    sizes = written(items.groupBy(F.col("length").cast("long").alias("size")).agg(F.count("*").alias("n")), "pack-sizes")
    docs = sizes.select(
        F.lit(0).alias("kind"), "size", F.lit(0).cast("long").alias("start"), "n", F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("gap")
    )
    rounds, gaps, top, number = [], spark.createDataFrame([], RUN), capacity, 0
    while top:

        def one_round(batches: Iterator[pa.RecordBatch], number=number) -> Iterator[pa.RecordBatch]:
            # a run for each length and for each gap that a round left: the capacity bounds both
            runs = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pylist([], SCHEMA)])
            by_kind: tuple[list, list] = ([], [])
            for r in runs.to_pylist():
                by_kind[r["kind"]].append([r["size"], r["start"], r["n"]])
            out = list(sweep(capacity, number << 42, *by_kind))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), SCHEMA.types)], schema=SCHEMA)

        band = docs.where((F.col("size") <= top) & (F.col("size") > top // 2))
        runs = band.unionByName(gaps).coalesce(1).sortWithinPartitions("size")
        done = written(runs.mapInArrow(one_round, RUN), "pack-round")
        rounds.append(done.where("kind = 2"))
        gaps, top, number = done.where("kind = 1"), top // 2, number + 1
    placed = rounds[0]
    for more in rounds[1:]:
        placed = placed.unionByName(more)

    # ranks within a length, numbered in parts so that a common length is many tasks
    other = [c for c in items.columns if c != "length"]
    parted = items.join(sizes.withColumnRenamed("size", "length"), "length").withColumn(
        "_part", F.pmod(F.xxhash64(*other), F.ceil(F.col("n") / PART)).cast("int")
    )
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parted.groupBy("length", "_part").count().select("length", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_part").orderBy(*other)
    ranked = parted.join(base, ["length", "_part"]).withColumn("_rank", F.col("_base") + F.row_number().over(within) - 1)
    at = (F.col("length") == F.col("size")) & (F.col("_rank") >= F.col("start_")) & (F.col("_rank") < F.col("start_") + F.col("n_"))
    found = ranked.join(placed.select("size", F.col("start").alias("start_"), F.col("n").alias("n_"), "seq", "gap"), at)
    number_ = F.col("seq") + F.col("_rank") - F.col("start_")
    return found.select(*items.columns, number_.alias("sequence_id"), (capacity - F.col("gap")).alias("offset"))


SCHEMA = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("size", "start", "n", "seq", "gap"))])


def pack(docs: DataFrame, ranks: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its ids and its place."""
    return best_fit(pieces(docs, ranks, pattern, capacity), capacity)
