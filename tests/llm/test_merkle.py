"""Merkle manifest against trees that are built one by one."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from statspine.llm import merkle, queries
from tests.conftest import SF_DIR
from tests.test_queries import canonical

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, **changed):
    values = [changed.get(c, doc[c]) for c in merkle.FIELDS]
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Root and, for each node, its siblings as (side, digest)."""
    paths, at = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        ups, held = [], []
        for k in range(0, len(nodes), 2):
            pair = nodes[k : k + 2]
            for j in range(len(pair)):
                for x in at[k + j]:
                    paths[x].append((j, pair[1 - j] if len(pair) > 1 else None))
            ups.append(H(*pair))
            held.append([x for a in at[k : k + 2] for x in a])
        nodes, at = ups, held
    return nodes[0], paths


def brute(docs):
    groups = {}
    for d in docs:
        groups.setdefault(d["lang"], []).append(d)
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    for v in langs:
        groups[v].sort(key=lambda d: (d["doc_id"] is None, d["doc_id"], leaf(d)))
    trees = {v: tree([leaf(d) for d in groups[v]]) for v in langs}
    root, tops = tree([trees[v][0] for v in langs])
    out = []
    for v, top in zip(langs, tops):
        for d, path in zip(groups[v], trees[v][1]):
            path = path + top
            node = leaf(d)
            if d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 7 == 0 and d["n_chars"] is not None:
                node = leaf(d, n_chars=d["n_chars"] + 1)
            for side, s in path:
                node = H(s or "", node) if side else H(node, s or "")
            proof = H(*(s for _, s in path if s))
            out.append((d["doc_id"], leaf(d), trees[v][0], root, proof, node, node == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def key(r):
    return tuple((v is not None, v) for v in r)


def check(spark, docs, schema=DOCS):
    rows = spark.createDataFrame([tuple(d.values()) for d in docs], schema)
    got = queries.manifest_rows(rows)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs), key=key)


@pytest.mark.parametrize("tier", [1, 2, 8])
def test_trees_of_many_sizes(spark, monkeypatch, tier):
    monkeypatch.setattr(merkle, "TIER", tier)
    rng, docs = random.Random(tier), []
    for k, n in enumerate((1, 2, 3, 5, 16, 17, 33)):
        docs += [dict(doc_id=rng.randrange(10**6), text=f"t {k} {i}", lang=f"l{k}", source="s", n_chars=i) for i in range(n)]
    rng.shuffle(docs)
    check(spark, docs)


def test_a_tree_of_three_tiers(spark, monkeypatch):
    monkeypatch.setattr(merkle, "TIER", 3)
    check(spark, [dict(doc_id=i, text=f"t{i}", lang="x" if i else None, source=None, n_chars=i) for i in range(140)])


def test_one_more_than_a_tier(spark):
    check(spark, [dict(doc_id=i, text=None, lang="x", source=None, n_chars=i) for i in range(257)])


def test_nulls_ties_repeats_and_clashing_columns(spark):
    blank = dict(doc_id=None, text=None, lang=None, source=None, n_chars=None)
    docs = [blank, blank, blank | {"lang": ""}, blank | {"doc_id": 0}, blank | {"doc_id": 0, "text": "é🙂" * 50_000}]
    docs += [dict(doc_id=k % 3, text="a", lang="é", source="s", n_chars=None if k % 2 else 2**63 - 1) for k in range(9)]
    docs += [dict(doc_id=14, text="same", lang="z", source="s", n_chars=4)] * 40
    check(spark, [d | dict(number=1, tree="t", digest="d") for d in docs], DOCS + ", number int, tree string, digest string")


def test_tampering_shows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = queries.QUERIES["op13_merkle_manifest"](spark, SF_DIR).join(docs, "doc_id")
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    assert out.where(F.col("verified") == touched).count() == 0 and out.where(touched).count() > 0


def test_empty(spark):
    assert queries.manifest_rows(spark.createDataFrame([], DOCS)).collect() == []


def test_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    got = queries.QUERIES["op13_merkle_manifest"](spark, SF_DIR)
    found = con.execute(queries.SQL["op13_merkle_manifest"])
    assert canonical(got.columns, got.collect()) == canonical([c[0] for c in found.description], found.fetchall())
