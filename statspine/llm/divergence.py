"""How sources of a language differ in their words, by a frequent-pattern tree of term rows.

A term's row lists the sources of a language in which it occurs, in a fixed order of sources, with its counts there. Equal
rows are one row with a multiplicity, and rows in sorted order are the paths of a tree: a node stands for all terms whose rows
begin alike, and as the rows are walked in order only the path to the present node is held. When a walk leaves a node, all its
terms are known, and the node gives each of its ancestors one correction to the pair of their sources, times its terms.

A smoothed share p of every kept term in a source is compared with that in another source, and the differences are added up:

    all terms             V * |a0 - b0|                                    a0, b0: shares of terms that do not occur
    terms in a            |a - b0| - |a0 - b0|                             from how many terms have each count in a
    terms in b            |b - a0| - |a0 - b0|                             likewise
    terms in both         |a - b| - |a - b0| - |b - a0| + |a0 - b0|        from the tree

so that neither rows of zeros nor pairs of sources by term are ever made. Shares are whole numbers, so sums are exact.

Defined results: null text, lang and source are empty; a term is a run of letters A to Z and characters beyond ASCII, A to Z
lower-cased; every row of the table is a document, repeated ones too; a group without kept terms has pairs of value 0 if its
language keeps none, else shares of terms that do not occur; an empty table gives an empty table; other columns are not read.
A term's row holds one entry for each source of its language that has it, and the result one row for every two sources.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statspine.llm.common import small_enough, written
from statspine.operators.ranking import top_k_per_group

#: documents of its language that a kept term occurs in
DOCUMENTS = 30
#: added to every count
SMOOTH = 5
UNIT = 1_000_000_000
TOP = 50
#: entries that a task holds before it passes them on: counted terms, corrected pairs
HELD = 1 << 18
#: bytes of a text that are taken apart at a time
PIECE = 1 << 22
#: copies of the groups that singles meet where the groups are no small table
SALTS = 32

LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, some megabytes at a time."""
    text, at = text.translate(LETTERS), 0
    while at < len(text):
        end = len(text) if len(text) - at <= PIECE else text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


COUNTS = "lang string, source string, term string, n long, docs long"


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of some documents: occurrences, and documents that have the term."""
    times: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), n in times.items():
            terms = list(n)
            columns = [
                pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array(n.values(), pa.int64()), pa.array([docs[lang, source][t] for t in terms], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        times.clear()
        docs.clear()

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
            n, d = times.setdefault((lang, source), Counter()), docs.setdefault((lang, source), Counter())
            seen: set[bytes] = set()
            for terms in pieces(text.as_py()):
                n.update(terms)
                seen.update(terms)
            d.update(seen)
            if len(n) > HELD // 8 and sum(map(len, times.values())) > HELD:
                yield from passed_on()
    yield from passed_on()


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + SMOOTH) / (total + SMOOTH * terms)), null where there are no terms."""
    up = (n.cast("decimal(20,0)") + SMOOTH) * F.lit(UNIT).cast("decimal(10,0)")
    down = (total + SMOOTH * terms).cast("decimal(20,0)")
    return F.when(terms > 0, 1 + F.call_function("div", up, F.when(terms > 0, down)))


def term_rows(docs: DataFrame) -> DataFrame:
    """(lang, term, items): kept terms with (source, n) of every source that has them."""
    counted = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text"))).mapInArrow(count_terms, COUNTS)
    # one exchange: counts of a term in one source, and then its row, stay in the same partition
    cells = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("items"))
    return written(rows.where(F.col("docs") >= DOCUMENTS).select("lang", "term", "items"), "divergence-rows")


def groups_of(docs: DataFrame, cells: DataFrame, rows: DataFrame) -> DataFrame:
    """(lang, source, s, total, lang_total, terms, zero): every group with its number in its language, smaller groups first."""
    every = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = rows.groupBy("lang").agg(F.count("*").alias("terms"), F.sum(F.aggregate("items", F.lit(0).cast("long"), lambda x, i: x + i.n)).alias("lang_total"))
    joined = every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("total", "source")).alias("s")
    return written(joined.select("lang", "source", number, "total", "lang_total", "terms", share(F.lit(0), F.col("total"), F.col("terms")).alias("zero")), "divergence-groups")


def guarded(df: DataFrame, row_bytes: int) -> DataFrame:
    """A written table, to be broadcast if its counted rows are few enough, else joined by shuffles."""
    return F.broadcast(df) if small_enough(df.count(), row_bytes) else df


def tree_rows(shares: DataFrame) -> DataFrame:
    """(lang, path, m): rows as paths of (s, n, p, zero) in the order of s, equal ones as one with their number, sorted."""
    paths = shares.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("s", "n", "p", "zero"))).alias("path"))
    rows = paths.groupBy("lang", "path").agg(F.count("*").alias("m"))
    return rows.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")


Node = tuple[int, int, int, int]


class Walk:
    """The path to the present node of a tree whose rows come in order, and what the nodes left so far correct."""

    def __init__(self):
        self.path: list[Node] = []
        self.terms: list[int] = []
        self.found: dict[tuple[int, int], int] = {}

    def leave(self, depth: int) -> None:
        """Go back up until ``depth`` nodes are left; each node that is left corrects its pairs with its ancestors once."""
        while len(self.path) > depth:
            (b, _, pb, zb), m = self.path.pop(), self.terms.pop()
            if self.terms:
                self.terms[-1] += m
            for a, _, pa_, za in self.path:
                fix = abs(pa_ - pb) - abs(pa_ - zb) - abs(pb - za) + abs(za - zb)
                if fix:
                    self.found[a, b] = self.found.get((a, b), 0) + m * fix

    def insert(self, row: list[Node], m: int) -> None:
        same = 0
        while same < min(len(row), len(self.path)) and row[same] == self.path[same]:
            same += 1
        self.leave(same)
        self.path += row[same:]
        self.terms += [0] * (len(row) - same)
        self.terms[-1] += m


def corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, x) of rows in order: sums of what the tree's nodes correct for sources a < b."""
    walk, lang = Walk(), None

    def passed_on() -> pa.RecordBatch:
        found = walk.found
        walk.found = {}
        columns = [pa.array([lang] * len(found), pa.string()), *(pa.array([k[i] for k in found], pa.int32()) for i in (0, 1)), pa.array(found.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "x"])

    for batch in batches:
        paths = batch.column("path")
        nodes = list(zip(*(paths.flatten().field(k).to_pylist() for k in range(4))))
        edges = (paths.offsets.to_numpy() - paths.offsets[0].as_py()).tolist()
        for k, (own, m) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("m").to_pylist())):
            if own != lang or len(walk.found) > HELD:
                walk.leave(0)
                yield passed_on()
                lang = own
            walk.insert(nodes[edges[k] : edges[k + 1]], m)
    walk.leave(0)
    yield passed_on()


def pair_values(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language, in both directions."""
    left = groups.select("lang", F.col("s").alias("a"), F.col("source").alias("a_name"), F.col("zero").alias("a_zero"), "terms")
    rest = groups.select("lang", F.col("s").alias("b"), F.col("source").alias("b_name"), F.col("zero").alias("b_zero"))
    zeros = F.coalesce(F.col("terms") * F.abs(F.col("a_zero") - F.col("b_zero")), F.lit(0))
    base = left.join(rest, "lang").where("a < b").select("lang", "a", "b", zeros.alias("x"), "a_name", "b_name")
    # terms by their count in one source
    single = shares.groupBy("lang", "s", "n", "p", "zero").agg(F.count("*").alias("m"))
    small = small_enough(groups.count(), 256)
    salts = 1 if small else SALTS
    others = rest.select("lang", "b", "b_zero", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    met = single.withColumn("salt", F.pmod(F.xxhash64("s", "n"), F.lit(salts)).cast("int")).join(F.broadcast(others) if small else others, ["lang", "salt"])
    alone = F.col("m") * (F.abs(F.col("p") - F.col("b_zero")) - F.abs(F.col("zero") - F.col("b_zero")))
    singles = met.where("s <> b").select("lang", F.least("s", "b").alias("a"), F.greatest("s", "b").alias("b"), alone.alias("x"))
    both = tree_rows(shares).mapInArrow(corrections, "lang string, a int, b int, x long")
    none = {"a_name": F.lit(None).cast("string"), "b_name": F.lit(None).cast("string")}
    parts = base.unionByName(singles.groupBy("lang", "a", "b").agg(F.sum("x").alias("x")).withColumns(none)).unionByName(both.withColumns(none))
    pairs = parts.groupBy("lang", "a", "b").agg(F.sum("x").alias("value"), F.max("a_name").alias("a_name"), F.max("b_name").alias("b_name"))
    ways = F.explode(F.array(F.struct(F.col("a_name").alias("source"), F.col("b_name").alias("item")), F.struct(F.col("b_name").alias("source"), F.col("a_name").alias("item"))))
    return pairs.select("lang", "value", ways.alias("w")).select("lang", "w.source", "w.item", "value")


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each other source is, and the terms that mark the source out."""
    rows = term_rows(docs)
    cells = rows.select("lang", "term", F.explode("items").alias("i")).select("lang", "term", "i.source", "i.n")
    groups = groups_of(docs, cells, rows)
    met = cells.join(guarded(groups, 256), ["lang", "source"])
    own = share(F.col("n"), F.col("total"), F.col("terms")).alias("p")
    shares = written(met.select("lang", "source", "term", "s", "n", own, "zero", "lang_total", "terms"), "divergence-shares")
    order = [F.col("value").desc(), F.col("item").asc()]
    by = Window.partitionBy("lang", "source").orderBy(*order)
    pairs = pair_values(groups, shares).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by).alias("rank"))
    in_lang = shares.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    above = shares.join(in_lang, ["lang", "term"]).select("lang", "source", F.col("term").alias("item"), (F.col("p") - q).alias("value")).where("value > 0")
    marks = top_k_per_group(above, ["lang", "source"], order, TOP, "rank")
    return pairs.unionByName(marks.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.col("rank").cast("int")))
