"""Packed ids against the tokenizer itself, bit by bit, and by random access."""

import random
import zlib
from functools import partial

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from statspine.llm import packed_ids as P
from statspine.llm import packing, queries
from tests.conftest import SF_DIR

JSON = public_tokenizers.path("byte_bpe_50k.json")
SIZE = P.vocabulary(JSON)
encode = partial(packing.token_ids, ranks=queries.RANKS, pattern=queries.PATTERN)


@pytest.fixture
def many_parts(spark):
    """Partitions as they are dealt, however small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(JSON)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.data())
def test_packing_is_a_bit_string(bits, data):
    ids = data.draw(st.lists(st.integers(0, (1 << bits) - 1), max_size=80))
    packed = P.pack(np.array(ids, "<u4"), bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    number = int.from_bytes(packed, "little")
    assert [number >> (k * bits) & ((1 << bits) - 1) for k in range(len(ids))] == ids
    first = data.draw(st.integers(0, len(ids)))
    n = data.draw(st.integers(0, len(ids) - first))
    assert P.unpack(packed, bits, first, n).tolist() == ids[first : first + n]


def test_an_id_that_does_not_fit():
    with pytest.raises(ValueError):
        P.pack(np.array([4], "<u4"), 2)
    assert [P.width(n) for n in (1, 2, 3, 50_257, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


SPACES = [" ", "  ", "\n", " \n", "\n ", "\t", " ", "  ", "\x1f", "\x85", "\u200b", "\r\n "]


def test_ids_are_those_of_the_json_form(plain):
    rng = random.Random(3)
    bits = ["a", "the", "It's", "\u00e9t\u00e9", "'s", "7", "x9", "\u2026", "\U0001f642", "<|endoftext|>", "Don't", "!!", "\u65e5\u672c", "\x00"]
    texts = ["".join(rng.choice(rng.choice([bits, SPACES, [" "]])) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += [None, "", " ", "  a", "a  ", "x" * 5000, "a " * 5000]
    assert [encode(t).tolist() for t in texts] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def brute(rows, plain, close):
    out, start = [], 0
    for d, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, close]
        out.append((d, start, len(ids), ids))
        start += len(ids)
    return out


def test_files_round_trip(spark, plain, many_parts, tmp_path):
    rng = random.Random(5)
    rows = [(i * 37 % 1009, " ".join(rng.choices(["one", "two", "été", "x\n", ""], k=rng.randrange(40)))) for i in range(600)]
    rows += [(5000, None), (5001, ""), (5002, "long " * 30_000), (-4, "negative")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    P.write(docs, str(tmp_path / "ids"), encode, SIZE, close=2, block=64)
    want = brute(sorted(rows), plain, 2)
    got = P.read(spark, str(tmp_path / "ids")).collect()
    assert [(r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in sorted(got, key=lambda r: r.start)] == want
    head = P.manifest(str(tmp_path / "ids"))
    assert head["bits"] == 16 and len(head["files"]) > 1
    stream = [i for w in want for i in w[3]]
    for _ in range(50):
        at = rng.randrange(len(stream))
        n = rng.choice([1, 5, 64, 1000, 20_000])
        assert P.ids_at(str(tmp_path / "ids"), at, n).tolist() == stream[at : at + n]


def test_random_access_reads_only_its_blocks(tmp_path):
    class Counting:
        def __init__(self, file):
            self.file, self.n = file, 0

        def read_at(self, n, at):
            self.n += n
            return self.file.read_at(n, at)

    ids = np.arange(100_000, dtype="<u4") % 1000
    fs, path = P.opened(str(tmp_path / "one.ids"))
    with fs.open_output_stream(path) as out:
        file = P.FileWriter(out, 10, 512)
        for at in range(0, 100_000, 777):
            file.add(at, ids[at : at + 777])
        file.close()
    found = P.PackedFile(fs, path)
    found.file = Counting(found.file)
    assert found.ids(70_001, 600).tolist() == ids[70_001:70_601].tolist() and found.file.n <= 3 * 640
    data = (tmp_path / "one.ids").read_bytes()
    (tmp_path / "bad.ids").write_bytes(data[:-80] + bytes([data[-80] ^ 1]) + data[-79:])
    with pytest.raises(ValueError):
        P.PackedFile(fs, str(tmp_path / "bad.ids"))


def test_repeats_nulls_and_clashing_columns(spark, plain, many_parts, tmp_path):
    rows = [(7, "same", 1, "i")] * 300 + [(7, "other", 2, None), (None, "n", 3, None), (None, None, 4, None), (1, "a", 5, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long, ids string")
    P.write(docs, str(tmp_path / "r"), encode, SIZE, close=2, block=8)
    got = sorted(P.read(spark, str(tmp_path / "r")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got[:3]] == [None, None, 1] and [r.doc_id for r in got[3:]] == [7] * 301
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    same = np.array([*plain.encode("same").ids, 2], "<u4").tobytes()
    assert sum(r.ids == same for r in got) == 300


def test_a_task_that_ran_twice_counts_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    P.write(docs, str(tmp_path / "t"), encode, SIZE, close=2)
    name = P.manifest(str(tmp_path / "t"))["files"][0]["name"]
    (tmp_path / "t" / "part-000000-again.ids").write_bytes((tmp_path / "t" / name).read_bytes())
    assert P.read(spark, str(tmp_path / "t")).count() == 2


def test_empty(spark, tmp_path):
    P.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e"), encode, SIZE, close=2)
    assert P.read(spark, str(tmp_path / "e")).count() == 0 and P.ids_at(str(tmp_path / "e"), 0, 5).tolist() == []


def test_query_against_the_tokenizer(spark, plain):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    want = [(d, s, n, zlib.crc32(np.array(ids, "<u4").tobytes())) for d, s, n, ids in brute(sorted(tuple(r) for r in docs), plain, 2)]
    got = queries.QUERIES["op12_packed_ids"](spark, SF_DIR)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in got.collect()) == want
