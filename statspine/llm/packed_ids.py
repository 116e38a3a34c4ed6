"""Token ids in files of fixed bit width, a Spark data source named ``packed_ids``.

An id takes the fewest bits that hold the vocabulary. A file is

    header   magic, bits, ids in a block
    blocks   ids one after the other, lowest bit first, each block filled up to whole bytes
    offsets  where each block begins, and where the last one ends
    docs     document id, whether that is null, and the number of ids up to the document's end, as three arrays
    trailer  ids, documents, blocks, place and checksum of the tables, magic

so that any run of ids is read from the blocks that hold it and unpacked by numpy at once. Tasks write one file each, under
a name of their own, and the driver lists the files that count, one line for each, in a manifest once all are written: a
task that runs twice leaves a file that nobody reads. Documents are in ascending id order within files and over the files.

Files are opened by ``pyarrow.fs`` from the folder's URI, in tasks: the folder has to be one that it can open on all machines.

Defined results: a null text is empty; an empty text is the closing id alone; a null doc_id comes first; rows with the same
doc_id are kept, ordered by a hash of their text; no documents give a manifest without files; other columns are not read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MAGIC = b"packids1"
HEADER = np.dtype([("magic", "S8"), ("bits", "<u4"), ("block", "<u4")])
TRAILER = np.dtype([("ids", "<u8"), ("docs", "<u8"), ("blocks", "<u8"), ("tables", "<u8"), ("crc", "<u4"), ("spare", "<u4"), ("magic", "S8")])
MANIFEST = "manifest.json"
#: ids in a block
BLOCK = 1 << 16
#: ids that a reader takes at a time, and more only for a longer document
READ = 1 << 20
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


def width(vocabulary: int) -> int:
    """Bits for ids from 0 to ``vocabulary`` - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, first: int, n: int) -> np.ndarray:
    """``n`` ids from the ``first`` one of a block or of blocks that follow each other."""
    room = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)])
    at = (first + np.arange(n, dtype=np.int64)) * bits
    byte, value = at >> 3, np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        value |= room[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class FileWriter:
    """One file; holds a block of ids and the table of its documents."""

    def __init__(self, out, bits: int, block: int):
        if block % 8:
            raise ValueError("a block has a multiple of 8 ids")
        self.out, self.bits, self.block = out, bits, block
        self.waiting, self.n_waiting, self.n_ids = [], 0, 0
        self.docs, self.nulls, self.ends = [], [], []
        out.write(np.array([(MAGIC, bits, block)], HEADER).tobytes())
        self.offsets = [HEADER.itemsize]

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        edge = len(ids) if last else len(ids) - len(ids) % self.block
        for at in range(0, edge, self.block):
            data = pack(ids[at : min(at + self.block, edge)], self.bits)
            self.out.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.waiting, self.n_waiting = [ids[edge:]], len(ids) - edge

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.ends.append(self.n_ids)
        if self.n_waiting >= self.block:
            self._flush(False)

    def close(self) -> None:
        self._flush(True)
        tables = np.array(self.offsets, "<u8").tobytes() + np.array(self.docs, "<i8").tobytes()
        tables += np.array(self.nulls, np.uint8).tobytes() + np.array(self.ends, "<u8").tobytes()
        self.out.write(tables)
        end = (self.n_ids, len(self.docs), len(self.offsets) - 1, self.offsets[-1], zlib.crc32(tables), 0, MAGIC)
        self.out.write(np.array([end], TRAILER).tobytes())


class PackedFile:
    """A file opened for random access; only its tables are held."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file, size = fs.open_input_file(path), fs.get_file_info(path).size
        head = np.frombuffer(self.file.read_at(HEADER.itemsize, 0), HEADER)[0]
        end = np.frombuffer(self.file.read_at(TRAILER.itemsize, size - TRAILER.itemsize), TRAILER)[0]
        if head["magic"] != MAGIC or end["magic"] != MAGIC:
            raise ValueError(f"{path} is no file of packed ids")
        place = int(end["tables"])
        tables = self.file.read_at(size - TRAILER.itemsize - place, place)
        if zlib.crc32(tables) != end["crc"]:
            raise ValueError(f"the tables of {path} are damaged")
        self.bits, self.block, self.n_ids, n = int(head["bits"]), int(head["block"]), int(end["ids"]), int(end["docs"])
        at = (int(end["blocks"]) + 1) * 8
        self.offsets = np.frombuffer(tables, "<u8", int(end["blocks"]) + 1).astype(np.int64)
        self.docs = np.frombuffer(tables, "<i8", n, at)
        self.nulls = np.frombuffer(tables, np.uint8, n, at + 8 * n).astype(bool)
        self.ends = np.frombuffer(tables, "<u8", n, at + 9 * n).astype(np.int64)
        self.starts = np.concatenate([np.zeros(1, np.int64), self.ends[:-1]]) if n else self.ends

    def ids(self, first: int, n: int) -> np.ndarray:
        """``n`` ids from the file's ``first`` one, read from the blocks that hold them."""
        if n <= 0:
            return np.zeros(0, "<u4")
        low, high = first // self.block, (first + n - 1) // self.block + 1
        data = self.file.read_at(int(self.offsets[high] - self.offsets[low]), int(self.offsets[low]))
        return unpack(data, self.bits, first - low * self.block, n)

    def batches(self, base: int, doc_type: pa.DataType = pa.int64()) -> Iterator[pa.RecordBatch]:
        """All documents as rows, ``base`` ids standing before the file."""
        at = 0
        while at < len(self.docs):
            upto = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + READ, "right")))
            raw = self.ids(int(self.starts[at]), int(self.ends[upto - 1] - self.starts[at])).tobytes()
            edges = (np.concatenate([self.starts[at : at + 1], self.ends[at:upto]]) - self.starts[at]) * 4
            columns = [
                pa.array(self.docs[at:upto], doc_type, mask=self.nulls[at:upto]), pa.array(self.starts[at:upto] + base),
                pa.array(self.ends[at:upto] - self.starts[at:upto]), pa.array([raw[a:b] for a, b in zip(edges, edges[1:])], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])
            at = upto


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    ids: int
    docs: int


@dataclass
class Part(InputPartition):
    name: str
    base: int


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, vocabulary: int, block: int):
        self.path, self.vocabulary, self.block = path.rstrip("/"), vocabulary, block

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = opened(self.path)
        fs.create_dir(folder, recursive=True)
        partition = TaskContext.get().partitionId()
        name = f"part-{partition:06d}-{uuid.uuid4().hex}.ids"
        with fs.open_output_stream(f"{folder}/{name}") as out:
            file = FileWriter(out, width(self.vocabulary), self.block)
            for batch in iterator:
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                    file.add(doc_id, np.frombuffer(ids.as_buffer() or b"", "<u4"))
            file.close()
        return Written(partition, name, file.n_ids, len(file.docs))

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = opened(self.path)
        fs.create_dir(folder, recursive=True)
        files = [{"name": m.name, "ids": m.ids, "docs": m.docs} for m in sorted((m for m in messages if m), key=lambda m: m.partition) if m.docs]
        with fs.open_output_stream(f"{folder}/{MANIFEST}.new") as out:
            out.write(json.dumps({"vocabulary": self.vocabulary, "bits": width(self.vocabulary), "block": self.block, "files": files}).encode())
        fs.move(f"{folder}/{MANIFEST}.new", f"{folder}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = opened(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{folder}/{m.name}")


def manifest(path: str) -> dict:
    fs, folder = opened(path.rstrip("/"))
    with fs.open_input_stream(f"{folder}/{MANIFEST}") as file:
        return json.loads(file.read())


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def partitions(self) -> list[Part]:
        parts, base = [], 0
        for f in manifest(self.path)["files"]:
            parts.append(Part(f["name"], base))
            base += f["ids"]
        return parts or [Part("", 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.name:
            fs, folder = opened(self.path)
            yield from PackedFile(fs, f"{folder}/{partition.name}").batches(partition.base)


class PackedIds(DataSource):
    """``spark.write.format("packed_ids").option("vocabulary", n).save(path)`` of (doc_id, ids), and its reading."""

    @classmethod
    def name(cls) -> str:
        return "packed_ids"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options["vocabulary"]), int(self.options.get("block", BLOCK)))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> int:
    """Ids of a tokenizer's JSON file, added ones included."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1


def tokens(docs: DataFrame, encode: Callable[[str | None], array], close: int | None = None) -> DataFrame:
    """(doc_id, ids) of every document, ``close`` after the ids of each; the order of the rows stays."""
    end = array("I", [] if close is None else [close])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a few texts at a time: their ids take several times the room of the texts
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [(encode(t) + end).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) cut into ranges of ascending ids; equal ids are dealt on by text and place, so that none fills a task."""
    tie = {"_hash": F.xxhash64("text"), "_at": F.monotonically_increasing_id()}
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns(tie)
    return rows.repartitionByRange("doc_id", "_hash", "_at").sortWithinPartitions("doc_id", "_hash", "_at").select("doc_id", "text")


def write(docs: DataFrame, path: str, encode: Callable[[str | None], array], size: int, close: int | None = None, block: int = BLOCK) -> None:
    """Encode ``docs`` with ids below ``size`` and write them under ``path`` in ascending order of doc_id."""
    docs.sparkSession.dataSource.register(PackedIds)
    rows = tokens(in_order(docs), encode, close)
    rows.write.format("packed_ids").option("vocabulary", max(size, (close or 0) + 1)).option("block", block).mode("append").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): documents in the files' order, ``start`` counting the ids before them in all files."""
    spark.dataSource.register(PackedIds)
    return spark.read.format("packed_ids").load(path)


def ids_at(path: str, start: int, n: int) -> np.ndarray:
    """``n`` ids from the ``start`` one of all files: only the blocks that hold them are read."""
    fs, folder = opened(path.rstrip("/"))
    out, base = [np.zeros(0, "<u4")], 0
    for f in manifest(path)["files"]:
        low, high = max(start, base), min(start + n, base + f["ids"])
        if low < high:
            out.append(PackedFile(fs, f"{folder}/{f['name']}").ids(low - base, high - low))
        base += f["ids"]
    return np.concatenate(out)
