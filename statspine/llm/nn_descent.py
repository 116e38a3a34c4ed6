"""Near-duplicate embeddings by NN-descent.

Every vector keeps a list of its nearest known neighbours. Lists begin with the neighbours in several orders of the
vectors by random hyperplane codes. A round joins, at every vector, those that list it or that it lists, compares new
ones with all of them, and offers each vector what is nearer than the last of its list. Rounds go on until the links at
the threshold hardly grow; recall is then audited against brute force for each label and length by itself, on vectors
whose best known cosine is near the threshold and as many by hash, each link weighted by how unlikely its vector was to be
asked. Where it is too low, or where the audit met too few links to tell, lists get twice as long and rounds go on; what still fails, or is so small that another pass would
compare as many pairs, is compared as a whole. A list whose entries are all links may have been too short: it is enlarged
to the whole group it is linked with. Whole groups are compared tile by tile, of which only counts and a spanning set of
links are kept.

Vectors are compared only where labels are equal and not null and lengths agree, by cosine in double precision. Equal
vectors are one point before the search. Vectors that are null, empty or zero, or hold null or non-finite components,
link with nothing. Rows that share a vec_id are vectors each for itself; a null vec_id takes part, and names a component
only if there is no other; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statspine.llm.common import components, small_enough, spanning, whole_groups, written

THRESHOLD = 0.98
#: length of the lists, orders they begin with, places to either side in an order
LIST, ORDERS, REACH = 10, 6, 12
#: members of either kind that a vector joins in a round, for lists of ``LIST``; more as lists get longer
JOINED = 5
#: rounds at most between two audits, audits at most, growth of the links below which rounds end
ROUNDS, AUDITS, GROWTH = 6, 4, 0.002
#: vectors that an audit asks of a label and length, beside twice the root of their number, and the recall it asks for
AUDITED, RECALL = 100, 0.98
#: links that an audit must meet to tell anything: of so many, one is missed with 95% if recall is below RECALL
MET = 150
#: vectors of a linked group that meet in one tile, and of a label and length that is audited or compared as a whole
TILE, BLOCK = 512, 2048


def unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column of one length as unit vectors in double precision."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares stay finite
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def usable(v: str = "embedding"):
    """Whether a vector can link at all."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def points(vectors: DataFrame) -> DataFrame:
    """(id, label, size, v, n, first): distinct usable vectors, how many rows each stands for, their smallest vec_id."""
    own = vectors.where(F.col("label").isNotNull() & usable()).select("vec_id", "label", F.col("embedding").alias("v"))
    same = own.groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    return written(same.select(F.monotonically_increasing_id().alias("id"), "label", F.size("v").alias("size"), "v", "n", "first"), "points")


def first_lists(pts: DataFrame, seed: int = 0) -> DataFrame:
    """(u, v, cos): neighbours in orders by hyperplane codes; each order is cut into ranges, whatever its hot codes."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                v = unit(part.column("v"))
                for order in range(ORDERS):
                    planes = np.random.default_rng([seed, order, size]).standard_normal((size, 32))
                    bits = (v @ planes > 0).astype(np.uint8)
                    codes = np.packbits(bits, axis=1).view(">u4").ravel().astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), order, np.int32)), part.column("label"), part.column("size"), pa.array(codes), part.column("id"), part.column("v")],
                        names=["order", "label", "size", "code", "id", "v"],
                    )

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if kept is not None:
                rows = pa.concat_tables([kept, rows])
            kept = rows.slice(max(0, rows.num_rows - REACH))
            group = list(zip(*(rows.column(c).to_pylist() for c in ("order", "label", "size"))))
            ids = rows.column("id").to_numpy()
            at = 0
            while at < len(group):
                end = at + 1
                while end < len(group) and group[end] == group[at]:
                    end += 1
                v, own = unit(rows.column("v").slice(at, end - at)), ids[at:end]
                out = []
                for step in range(1, min(REACH, len(own) - 1) + 1):
                    cos = (v[:-step] * v[step:]).sum(axis=1)
                    out.append((np.r_[own[:-step], own[step:]], np.r_[own[step:], own[:-step]], np.r_[cos, cos]))
                if out:
                    u, w, c = (np.concatenate(x) for x in zip(*out))
                    # the best few of each from this order
                    by = np.lexsort((-c, u))
                    u, w, c = u[by], w[by], c[by]
                    rank = np.arange(len(u)) - np.repeat(np.flatnonzero(np.r_[True, u[1:] != u[:-1]]), np.diff(np.r_[np.flatnonzero(np.r_[True, u[1:] != u[:-1]]), len(u)]))
                    few = rank < LIST // 2
                    yield pa.RecordBatch.from_arrays([pa.array(u[few]), pa.array(w[few]), pa.array(c[few])], names=["u", "v", "cos"])
                at = end

    label = dict(pts.dtypes)["label"]
    kind = dict(pts.dtypes)["v"]
    coded = pts.select("label", "size", "id", "v").mapInArrow(code, f"order int, label {label}, size int, code long, id long, v {kind}")
    parts = int(pts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = coded.repartitionByRange(parts, "order", "label", "size", "code", "id").sortWithinPartitions("order", "label", "size", "code", "id")
    return dealt.mapInArrow(near, "u long, v long, cos double")


def shortened(offers: DataFrame, length: int) -> DataFrame:
    """The ``length`` nearest of each u; an entry is new unless it stood in a list before."""
    one = offers.groupBy("u", "v").agg(F.max("cos").alias("cos"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("cos"), "v"))
    return one.withColumn("rank", rank).where(F.col("rank") <= length)


def joined(length: int) -> int:
    return max(JOINED, JOINED * length // LIST)


def drawn(lists: DataFrame, length: int, turn: int) -> DataFrame:
    """(at, id, new): the members that meet at each vector in this turn; every turn draws others."""
    both = lists.select(F.col("u").alias("at"), F.col("v").alias("id"), "new").union(
        lists.select(F.col("v").alias("at"), F.col("u").alias("id"), "new")
    )
    both = both.groupBy("at", "id").agg(F.max("new").alias("new"))
    # a sample by hash of what is new and what is not; in parts first, so that a vector which many list is many tasks
    draw, most = F.xxhash64("at", "id", F.lit(turn)), joined(length)
    parted = both.withColumn("part", F.pmod(F.col("id"), F.lit(16)))
    some = parted.withColumn("r", F.row_number().over(Window.partitionBy("at", "new", "part").orderBy(draw, "id"))).where(F.col("r") <= most)
    few = some.withColumn("r", F.row_number().over(Window.partitionBy("at", "new").orderBy(draw, "id"))).where(F.col("r") <= 2 * most)
    return few.select("at", "id", "new")


def local_join(pts: DataFrame, lists: DataFrame, few: DataFrame, length: int) -> DataFrame:
    """(u, v, cos) offers: members that meet at a vector, if one of them is new there and u's list has worse or fewer."""
    lows = lists.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("n"), F.min("cos").alias("low"))
    low = F.when(F.col("n") >= length, F.col("low")).otherwise(-2.0).alias("low")
    member = pts.select("id", "v").join(lows, "id", "left").select("id", "v", low)
    meeting = few.join(member, "id").repartition("at").sortWithinPartitions("at", "id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["at"]):
            at, ids, new, low = (rows.column(c).to_numpy() for c in ("at", "id", "new", "low"))
            v = unit(rows.column("v")) if rows.num_rows else None
            edges = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1, len(at)].tolist()
            out = []
            for a, b in zip(edges, edges[1:]):
                if b - a < 2 or not new[a:b].any():
                    continue
                cos = v[a:b] @ v[a:b].T
                good = (new[a:b][:, None] | new[a:b][None, :]) & (cos > low[a:b][:, None])
                np.fill_diagonal(good, False)
                i, j = np.nonzero(good)
                out.append((ids[a + i], ids[a + j], cos[i, j]))
            if out:
                u, w, c = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(w), pa.array(c)], names=["u", "v", "cos"])

    return meeting.mapInArrow(meet, "u long, v long, cos double")


def after_join(lists: DataFrame, few: DataFrame) -> DataFrame:
    """(u, v, cos, new) of ``lists``: an entry that was drawn at its own vector is no longer new."""
    met = few.select(F.col("at").alias("u"), F.col("id").alias("v"), F.lit(True).alias("met"))
    return lists.join(met, ["u", "v"], "left").select("u", "v", "cos", (F.col("new") & F.col("met").isNull()).alias("new"))


def _guarded(df: DataFrame, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if small_enough(df.count(), row_bytes) else df


def asked(own: DataFrame, lists: DataFrame, threshold: float, turn: int = 0) -> DataFrame:
    """(id, weight) of the audited points: in every group about the same number by hash and by a best known cosine near
    ``threshold``; a point stands for ``weight`` points like it."""
    best = lists.groupBy(F.col("u").alias("id")).agg(F.abs(F.max("cos") - threshold).alias("far"))
    bin_ = F.least(F.coalesce(F.floor(F.col("far") * 2000), F.lit(1000)), F.lit(1000)).alias("bin")
    slim = written(own.select("gid", "id", "many").join(best, "id", "left").select("gid", "id", "many", bin_), "audit-bins")
    want = AUDITED + 2 * F.sqrt("many")
    half = F.when(want >= F.col("many"), F.col("many")).otherwise(want / 2)
    inside = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    bins = slim.groupBy("gid", "bin").agg(F.count("*").alias("c"), F.first("many").alias("many"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("gid").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = written(bins.select("gid", "bin", inside((half - before) / F.col("c")).alias("near"), inside(half / F.col("many")).alias("any")), "audit-shares")

    def chance(salt: int):
        return F.pmod(F.xxhash64("id", F.lit(2 * turn + salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    drawn_ = slim.join(_guarded(shares, 64), ["gid", "bin"]).where((chance(0) < F.col("near")) | (chance(1) < F.col("any")))
    return written(drawn_.select("id", (1 / (1 - (1 - F.col("near")) * (1 - F.col("any")))).alias("weight")), "audited")


def truth(own: DataFrame, who: DataFrame, threshold: float) -> DataFrame:
    """(gid, u, v): links of the points ``who`` (id) by brute force; they meet their group block by block."""
    parts = F.ceil(F.col("many") / F.lit(BLOCK)).cast("int")
    every = own.select("gid", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.lit(False).alias("asks"), "id", "v")
    asks = own.join(who, "id", "left_semi").select("gid", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(True).alias("asks"), "id", "v")
    met = every.union(asks).repartition("gid", "part").sortWithinPartitions("gid", "part")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["gid", "part"]):
            gid, part, asks, ids = (rows.column(c).to_numpy() for c in ("gid", "part", "asks", "id"))
            edges = np.r_[0, np.flatnonzero((gid[1:] != gid[:-1]) | (part[1:] != part[:-1])) + 1, len(ids)].tolist()
            for a, b in zip(edges, edges[1:]):
                q = asks[a:b]
                v, own_ids = unit(rows.column("v").slice(a, b - a)), ids[a:b]
                i, j = np.nonzero(v[q] @ v[~q].T >= threshold)
                u, w = own_ids[q][i], own_ids[~q][j]
                u, w = u[u != w], w[u != w]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), gid[a])), pa.array(u), pa.array(w)], names=["gid", "u", "v"])

    return met.mapInArrow(meet, "gid long, u long, v long")


def audited(own: DataFrame, lists: DataFrame, length: int, threshold: float, turn: int) -> DataFrame:
    """(gid, many, links, found) of every group, and whether it is ``settled``.

    A link of a saturated list counts as found: such lists are completed afterwards. A group of which fewer than ``MET``
    links were met is settled only if all its points were asked.
    """
    who = asked(own, lists, threshold, turn)
    true = written(truth(own, who, threshold), "audit")
    near = lists.where(F.col("cos") >= threshold)
    full = near.where(F.col("rank") == length).select("u", F.lit(True).alias("full")).distinct()
    either = near.select("u", "v").union(near.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().withColumn("listed", F.lit(True))
    met = true.join(either, ["u", "v"], "left").join(full, "u", "left").join(who.withColumnRenamed("id", "u"), "u")
    known = F.when(F.coalesce("listed", "full"), F.col("weight")).otherwise(0.0)
    met = met.groupBy("gid").agg(F.count("*").alias("met"), F.sum("weight").alias("links"), F.sum(known).alias("found"))
    asks = own.join(who, "id", "left_semi").groupBy("gid").agg(F.count("*").alias("asks"))
    each = own.groupBy("gid").agg(F.first("many").alias("many")).join(asks, "gid", "left").join(met, "gid", "left").na.fill(0)
    enough = (F.col("met") >= MET) & (F.col("found") >= RECALL * F.col("links"))
    whole = (F.col("asks") == F.col("many")) & (F.col("found") == F.col("links"))
    return written(each.withColumn("settled", enough | whole), "audit-groups")


def search(pts: DataFrame, threshold: float = THRESHOLD, length: int = LIST) -> tuple[DataFrame, float, DataFrame]:
    """Neighbour lists (u, v, cos, rank, full) of the groups whose audit is met, ``full`` telling that the last entry of a
    list is a link; the audited recall of links at ``threshold`` in them; and (gid, id, many) of the points of all others."""
    groups = written(pts.groupBy("label", "size").agg(F.count("*").alias("many")).withColumn("gid", F.monotonically_increasing_id()), "labels")
    named = pts.drop("n").join(_guarded(groups, 64).withColumnsRenamed({"label": "l", "size": "s"}), (F.col("label") == F.col("l")) & (F.col("size") == F.col("s")))
    own = written(named.select("gid", "id", "label", "size", "v", "many"), "labelled")
    lists = written(shortened(first_lists(own).withColumn("new", F.lit(True)), length), "lists")
    links = found = 0.0
    settled, failed = [], []
    for audit in range(AUDITS):
        held = 0
        for turn in range(ROUNDS):
            few = written(drawn(lists, length, audit * ROUNDS + turn), "drawn")
            offers = local_join(own, lists, few, length).withColumn("new", F.lit(True))
            lists = written(shortened(after_join(lists, few).union(offers), length), "lists")
            now = lists.where(F.col("cos") >= threshold).count()
            if held > 0 and now - held <= GROWTH * now:
                break
            held = now
        each = audited(own, lists, length, threshold, audit)
        # a group of so few points that another pass would compare as many pairs is compared as a whole
        few_enough = F.col("many") <= (ROUNDS * (4 * joined(2 * length)) ** 2 if audit < AUDITS - 1 else 1 << 62)
        state = F.when(F.col("settled"), "settled").when(few_enough, "failed").otherwise("open").alias("state")
        each = written(each.select("gid", "links", "found", state), "audit-states")
        counts = {r["state"]: r for r in each.groupBy("state").agg(F.sum("links").alias("links"), F.sum("found").alias("found")).collect()}
        if "settled" in counts:
            links, found = links + counts["settled"]["links"], found + counts["settled"]["found"]
        state_of = own.join(_guarded(each.select("gid", "state"), 48), "gid").select("gid", "id", "many", "state")
        full = ((F.col("rank") == length) & (F.col("cos") >= threshold)).alias("full")
        done = lists.join(state_of.where("state = 'settled'").select(F.col("id").alias("u")), "u", "left_semi")
        settled.append(written(done.select("u", "v", "cos", "rank", full), "settled"))
        failed.append(written(state_of.where("state = 'failed'").select("gid", "id", "many"), "failed"))
        if "open" not in counts:
            break
        left = state_of.where("state = 'open'").select("id")
        lists = written(lists.join(left.withColumnRenamed("id", "u"), "u", "left_semi").withColumn("new", F.lit(True)), "lists")
        own = written(own.join(left, "id", "left_semi"), "labelled")
        length *= 2
    return reduce(DataFrame.unionByName, settled), found / links if links else 1.0, reduce(DataFrame.unionByName, failed)


def compared(pts: DataFrame, inside: DataFrame, tile: int, threshold: float) -> DataFrame:
    """(id, links, other): the links of every point of ``inside`` (group, id) within its group, where other is null, and
    links (id, other) that hold together what is linked."""
    sizes = inside.groupBy("group").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = inside.join(_guarded(written(sizes, "sizes"), 24), "group").select("group", "id", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    pair = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    tiles = dealt.select("id", "group", "own", *pair).join(pts.select("id", "v", "n"), "id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["group", "i", "j"]):
            group, i, j, own, ids, n = (rows.column(c).to_numpy() for c in ("group", "i", "j", "own", "id", "n"))
            new = (group[1:] != group[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            edges = np.r_[0, np.flatnonzero(new) + 1, len(ids)].tolist()
            for a, b in zip(edges, edges[1:]):
                v = unit(rows.column("v").slice(a, b - a))
                linked = v @ v.T >= threshold
                np.fill_diagonal(linked, False)
                if i[a] != j[a]:
                    linked &= own[a:b][:, None] != own[a:b][None, :]  # pairs within a part belong to its own tile
                count = (linked @ n[a:b]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b]), pa.array(count), pa.nulls(b - a, pa.int64())], names=["id", "links", "other"])
                some = np.flatnonzero(count)
                held = spanning(len(some), lambda x, others: linked[some[x], some[others]])
                if held:
                    x, y = (ids[a + some[list(k)]] for k in zip(*held))
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.zeros(len(x), np.int64)), pa.array(y)], names=["id", "links", "other"])

    return written(tiles.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "id").mapInArrow(meet, "id long, links long, other long"), "compared")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, float]:
    """(vec_id, n_links, component_id) of every row of ``vectors``, and the audited recall of the search."""
    pts = points(vectors)
    lists, recall, failed = search(pts, threshold)
    near = written(lists.where(F.col("cos") >= threshold).select("u", "v", "full"), "near")
    either = near.select("u", "v").union(near.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    whole = compared(pts, failed.select(F.col("gid").alias("group"), "id"), BLOCK, threshold)
    held = whole.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))
    groups = written(components(near.select(F.col("u").alias("a"), F.col("v").alias("b")).union(held)), "groups")

    # lists that are all links: their groups are compared as a whole
    full = near.where("full").select(F.col("u").alias("node")).distinct()
    dense = groups.join(full, "node").select("component").distinct()
    inside = written(groups.join(dense, "component").select(F.col("component").alias("group"), F.col("node").alias("id")), "dense")
    counted = compared(pts, inside, TILE, threshold).union(whole).where("other IS NULL").groupBy("id").agg(F.sum("links").alias("links"))
    listed = either.join(pts.select(F.col("id").alias("v"), "n"), "v").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("links"))
    listed = listed.join(inside.select("id"), "id", "left_anti")
    links = listed.union(counted)
    least = groups.join(pts.select(F.col("id").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("least"))
    named = groups.join(least, "component").select(F.col("node").alias("id"), "least")
    known = pts.join(links, "id", "left").join(named, "id", "left").select(
        F.col("label").alias("l"), F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("least", "first").alias("component_id"),
    )
    rows = vectors.select("vec_id", "label", F.when(usable(), F.col("embedding")).alias("embedding"))
    found = rows.join(known, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("w")), "left")
    return found.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id")
    ), recall
