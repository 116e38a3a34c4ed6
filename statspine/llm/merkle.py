"""A Merkle manifest of a dataset by nested-interval labels.

Every row is a leaf, the SHA-256 of its fields. The leaves of a group are ranked, and every two consecutive nodes have a
parent until one is left, the group's subroot; the subroots, in the order of their groups, have the same kind of tree above
them. A node carries the interval of leaf ranks that it covers, so that where it belongs is told by labels alone:

- a node's parent is the one of the level above whose interval holds the node's own; both are joined on the level's bucket,
  the rank without its lowest bits;
- what the parent's interval holds beside the node's own is the interval of its sibling, or empty;
- the ancestors of a leaf are the nodes whose intervals hold its rank, one in each level, attached the same way.

Levels are taken ``TIER`` at a time: 2^TIER nodes that stand together give the nodes of the next levels in one step, and a
leaf is joined with the siblings of the lowest levels only. What stands above these is the same for all 2^TIER leaves and is
found once for them. So rows grow with the leaves, times TIER, not with the height of the tree.

Defined results: a field that is null is ``-``, any other its length in bytes, ``:`` and its value; a null group is a group
of its own, before the others; a null id comes last in its group; rows with the same id are ordered by their digests, and
identical rows are leaves each; a group with one row has that leaf as its subroot, one group its subroot as the root; an empty
table gives an empty table; columns that are no fields are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statspine.llm.common import small_enough, written
from statspine.operators.ranking import global_row_number

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: levels that are built together
TIER = 8
STEP = "struct<level: int, left: boolean, digest: binary>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """Hex digest of a row's fields, some of them changed."""
    return F.sha2(F.concat(*(field(changed.get(c, F.col(c))) for c in FIELDS)), 256)


def tampered_leaf() -> Column:
    """Digest of a row whose n_chars someone raised by one."""
    return leaf(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1)


def height(n: Column) -> Column:
    """Levels above ``n`` leaves."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def right(x: Column, bits: Column) -> Column:
    return F.call_function("shiftright", x, bits)


def left(x: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", x, bits)


def shown(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def parents(nodes: Column) -> Column:
    """Hex digests one level up: every two of ``nodes``, the last alone where their number is odd."""
    first = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(first, lambda i: F.sha2(F.concat(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))), 256))


def above(base: int) -> Column:
    """Levels that a tree of n leaves has in the tier above level ``base``."""
    return F.least(F.greatest(height(F.col("n")) - base, F.lit(0)), F.lit(TIER))


def tier_nodes(base: DataFrame, level: int) -> DataFrame:
    """(tree, n, level, lo, hi, digest) of ``base`` (tree, n, at, digest), nodes of ``level``, and of the tier above them."""
    own = F.array_sort(F.collect_list(F.struct("at", "digest")))
    blocks = base.groupBy("tree", "n", F.shiftright("at", TIER).alias("block")).agg(own.alias("own"))
    steps = F.when(above(level) > 0, F.sequence(F.lit(1), above(level))).otherwise(F.array().cast("array<int>"))
    hexes = F.transform("own", lambda x: shown(x.digest))
    rows = F.aggregate(steps, F.array(hexes), lambda done, _: F.concat(done, F.array(parents(F.element_at(done, -1)))))
    each = blocks.select("tree", "n", "block", F.posexplode(rows).alias("k", "row")).select("tree", "n", "block", "k", F.posexplode("row").alias("i", "hex"))
    at, here = left(F.col("block"), TIER - F.col("k")) + F.col("i"), F.col("k") + level
    return each.select(
        "tree", "n", here.alias("level"), left(at, here).alias("lo"), F.least(left(at + 1, here), F.col("n")).alias("hi"),
        F.unhex("hex").alias("digest"),
    )


def siblings(nodes: DataFrame) -> DataFrame:
    """(tree, level, lo, hi, left, digest): for every node with a parent in ``nodes``, the interval that it covers and the
    digest of its sibling, null where it has none; ``left`` tells that the sibling stands before it."""
    bucket = lambda lo, level: right(F.col(lo), level)
    child = nodes.select("tree", "level", "lo", "hi", (F.col("level") + 1).alias("up"), bucket("lo", F.col("level") + 1).alias("bucket"))
    parent = nodes.select(F.col("tree"), F.col("level").alias("up"), bucket("lo", F.col("level")).alias("bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"))
    held = child.join(parent, ["tree", "up", "bucket"]).where("lo >= p_lo AND hi <= p_hi")
    before = F.col("lo") > F.col("p_lo")
    rest = held.select(
        "tree", "level", "lo", "hi", before.alias("left"),
        F.when(before, F.col("p_lo")).otherwise(F.col("hi")).alias("s_lo"), F.when(before, F.col("lo")).otherwise(F.col("p_hi")).alias("s_hi"),
    )
    other = nodes.select("tree", "level", F.col("lo").alias("s_lo"), F.col("hi").alias("s_hi"), "digest")
    return rest.join(other, ["tree", "level", "s_lo", "s_hi"], "left").select("tree", "level", "lo", "hi", "left", "digest")


def tier_paths(base: DataFrame, level: int, steps: DataFrame) -> DataFrame:
    """(tree, at, path): the steps of every ancestor below the next tier, the node itself first."""
    levels = F.sequence(F.lit(level), level + above(level) - 1)
    wanted = base.where(above(level) > 0).select("tree", "at", F.shiftleft("at", level).alias("r"), F.explode(levels).alias("level"))
    wanted = wanted.withColumn("bucket", right(F.col("r"), F.col("level")))
    known = steps.withColumn("bucket", right(F.col("lo"), F.col("level")))
    met = wanted.join(known, ["tree", "level", "bucket"]).where("r >= lo AND r < hi")
    return met.groupBy("tree", "at").agg(F.array_sort(F.collect_list(F.struct("level", "left", "digest"))).alias("path"))


def guarded(df: DataFrame, row_bytes: int) -> DataFrame:
    """A written table, to be broadcast if its counted rows are few enough, else joined by shuffles."""
    return F.broadcast(df) if small_enough(df.count(), row_bytes) else df


def forest(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths (tree, at, path) of ``leaves`` (tree, n, at, digest; at from 0 to n - 1) that have a parent, and (tree, root)."""
    levels = leaves.agg(F.max(height(F.col("n")))).first()[0] or 0
    base, paths, roots = leaves, [], []
    for level in range(0, max(levels, 1), TIER):
        nodes = written(tier_nodes(base, level), "merkle-nodes")
        steps = written(siblings(nodes), "merkle-steps")
        paths.append(written(tier_paths(base, level, steps), "merkle-paths"))
        # a root is the only node of its level; it stands in the next tier's lowest level only where that has no root yet
        roots.append(nodes.where((F.col("level") == height(F.col("n"))) & ((F.col("level") > level) | F.lit(level == 0))).select("tree", F.col("digest").alias("root")))
        base = nodes.where((F.col("level") == level + TIER) & (height(F.col("n")) > level + TIER)).select("tree", "n", F.shiftright("lo", level + TIER).alias("at"), "digest")
    whole = paths[-1]
    for k in range(len(paths) - 2, -1, -1):
        upper = whole.select("tree", F.col("at").alias("block"), F.col("path").alias("rest"))
        joined = paths[k].withColumn("block", F.shiftright("at", TIER)).join(guarded(written(upper, "merkle-upper"), 1024), ["tree", "block"], "left")
        whole = joined.select("tree", "at", F.concat("path", F.coalesce("rest", F.array().cast(f"array<{STEP}>"))).alias("path"))
    top = roots[0]
    for more in roots[1:]:
        top = top.unionByName(more)
    return whole, written(top, "merkle-roots")


def manifest(leaves: DataFrame, group: str = "lang", order: str = "doc_id") -> DataFrame:
    """``leaves`` (group, order, digest as binary, and other columns) with subroot, root (hex) and path.

    ``path`` has one step for each level from the leaf to the root: its level, whether the sibling stands before, and the
    sibling's digest, null where there is none; levels of the tree over the groups are counted on from 0.
    """
    other = [c for c in leaves.columns if c not in (group, order, "digest")]
    rows = global_row_number(leaves.select(F.col(group).alias("g"), F.col(order).alias("o"), "digest", *(F.col(c).alias(f"x_{c}") for c in other)), ["g", "o", "digest"], "number")
    rows = written(rows, "merkle-leaves")
    groups = written(rows.groupBy("g").agg(F.min("number").alias("first"), F.count("*").alias("n")), "merkle-groups")
    ranked = global_row_number(groups.select(F.col("g").isNotNull().alias("known"), "g", "first", "n"), ["known", "g"], "tree")
    ranked = written(ranked.select((F.col("tree") - 1).alias("tree"), F.col("g").alias("tree_g"), "first", "n"), "merkle-trees")
    count, longest = ranked.agg(F.count("*"), F.coalesce(F.max(F.octet_length(F.col("tree_g").cast("string"))), F.lit(0))).first()
    trees = F.broadcast(ranked) if small_enough(count, 64 + longest) else ranked
    placed = rows.join(trees, F.col("g").eqNullSafe(F.col("tree_g"))).withColumn("at", F.col("number") - F.col("first")).drop("number", "first", "tree_g")
    placed = written(placed, "merkle-placed")
    paths, subroots = forest(placed.select("tree", "n", "at", "digest"))
    tops, root = forest(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("at"), F.col("root").alias("digest")))
    # one row for each group
    none = F.array().cast(f"array<{STEP}>")
    over = subroots.join(tops.select(F.col("at").alias("tree"), F.col("path").alias("top")), "tree", "left")
    whole = next((F.lit(r["root"]) for r in root.collect()), F.lit(None).cast("binary"))
    over = written(over.select("tree", F.col("root").alias("subroot"), F.coalesce("top", none).alias("top"), whole.alias("whole")), "merkle-groups")
    full = placed.join(paths, ["tree", "at"], "left").join(guarded(over, 2048), "tree")
    return full.select(
        F.col("g").alias(group), F.col("o").alias(order), "digest", *(F.col(f"x_{c}").alias(c) for c in other),
        shown(F.col("subroot")).alias("subroot"), shown(F.col("whole")).alias("root"), F.concat(F.coalesce("path", none), "top").alias("path"),
    )


def proof(path: Column) -> Column:
    """Hex digest of all sibling digests along a path."""
    found = F.filter(path, lambda s: s.digest.isNotNull())
    return F.sha2(F.array_join(F.transform(found, lambda s: shown(s.digest)), ""), 256)


def fold(leaf_hex: Column, path: Column) -> Column:
    """The root that a leaf's hex digest gives with the siblings along a path."""

    def up(node: Column, s: Column) -> Column:
        sibling = F.coalesce(shown(s.digest), F.lit(""))
        return F.sha2(F.when(s.left, F.concat(sibling, node)).otherwise(F.concat(node, sibling)), 256)

    return F.aggregate(path, leaf_hex, up)
