"""Mixing sources by temperature.

A source's share of the tokens is raised to an exponent and normalised: 1 keeps the corpus as it is, 0 gives every source
the same weight, and more than 1 sharpens it. The exponent is found by bisection, as the smallest that keeps within a limit
of repetition, or the one that meets a target entropy. The budget is such that the source which is used least is read once in full, so no document
is left out; every source then has a number of tokens to be drawn, some whole passes and a part of one more.

Documents of a source are dealt by hash into blocks of about ``BLOCK`` tokens. Each pass puts the blocks, and the
documents in a block, in an order of its own, and takes documents in that order until the source's tokens are drawn. The
place of a document, counted from 0 for each source and pass, is its place in that order.

Defined results: a null source is a source of its own; null and empty texts have no tokens and come with every whole
pass; sources without tokens are read once; rows with the same id and text share their place and come together; an
empty table gives an empty table; other columns are carried along whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statspine.llm.common import small_enough, written

#: tokens of a block
BLOCK = 1 << 18
#: most passes over any source
REPEATS = 2.0


def tokens(text: Column) -> Column:
    """Number of words between white space; the measure of a document unless another column is given."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Mix:
    """Exponent, weight and passes by source."""

    exponent: float
    weights: dict[str | None, float]
    passes: dict[str | None, float]


def _weights(shares: dict, exponent: float) -> dict:
    most = max(shares.values())
    raised = {k: (s / most) ** exponent for k, s in shares.items()}
    total = math.fsum(raised.values())
    return {k: r / total for k, r in raised.items()}


def solve(sizes: dict[str | None, int], repeats: float | None = REPEATS, entropy: float | None = None, steps: int = 60) -> Mix:
    """Bisect the exponent: for an ``entropy`` in nats (even weights if it is more than they have, an error if no exponent
    is low enough), or as low as ``repeats`` allows; passes are such that the source used least is read once."""
    total = sum(sizes.values())
    shares = {k: n / total for k, n in sorted(sizes.items(), key=lambda x: (x[0] is not None, x[0] or "")) if n}
    passes: dict[str | None, float] = {k: 1.0 for k in sizes}
    if not shares:
        return Mix(1.0, {}, passes)

    def rates(exponent):
        w = _weights(shares, exponent)
        if not all(w.values()):
            raise ValueError(f"no exponent that draws every source has an entropy of {entropy}")
        least = min(w[k] / shares[k] for k in shares)
        return w, {k: w[k] / shares[k] / least for k in shares}

    def too_flat(exponent):
        if entropy is not None:
            return -math.fsum(x * math.log(x) for x in _weights(shares, exponent).values() if x) > entropy
        _, rate = rates(exponent)
        return repeats is not None and max(rate.values()) > repeats

    low, high = 0.0, 1.0
    if entropy is not None and len(shares) > 1:
        while too_flat(high):
            low, high = high, 2 * high
            if high > 1 << 20:
                raise ValueError(f"no exponent has an entropy of {entropy}")
    if too_flat(low):
        for _ in range(steps):
            middle = (low + high) / 2
            low, high = (middle, high) if too_flat(middle) else (low, middle)
    else:
        high = low
    weights, rate = rates(high)
    return Mix(high, weights, passes | rate)


def mixed(docs: DataFrame, repeats: float | None = REPEATS, entropy: float | None = None, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` as often as the mix draws them, each with ``_mix``: (pass, block, weight, tokens, place)."""
    spark = docs.sparkSession
    key = F.xxhash64("doc_id", "text")
    slim = written(docs.select("source", key.alias("key"), tokens(F.col("text")).alias("tokens")), "mix-tokens")
    # one row for each source: configuration in size, as the weights themselves are
    sizes = {r["source"]: r["n"] for r in slim.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    mix = solve(sizes, repeats, entropy)
    plan = []
    for source, size in sizes.items():
        drawn = mix.passes[source]
        whole = int(drawn + 1e-9)
        plan.append((source, mix.weights.get(source, 0.0), whole, round((drawn - whole) * size), max(1, -(-size // block))))
    plan = F.broadcast(spark.createDataFrame(plan, "s string, weight double, whole int, rest long, blocks long"))
    dealt = slim.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed)), "blocks"))

    # the part of a pass: whole blocks in their order, then documents of the block at which the tokens end
    order = F.xxhash64("block", "whole", F.lit(seed))
    sums = dealt.where("rest > 0").groupBy("s", "weight", "whole", "rest", "block").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("s").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, -1)
    parts = written(sums.withColumn("used", F.coalesce(F.sum("n").over(before), F.lit(0))).where("used < rest"), "mix-blocks")
    taken = parts.where("used + n <= rest").select(F.col("s").alias("ps"), F.col("block").alias("pb"))
    cut = parts.where("used + n > rest").select(F.col("s").alias("ps"), F.col("block").alias("pb"), "used")
    same = F.col("s").eqNullSafe(F.col("ps")) & (F.col("block") == F.col("pb"))
    rest = dealt.where("rest > 0")
    inner = Window.partitionBy("ps", "pb").orderBy(F.xxhash64("key", "whole", F.lit(seed)), "key")
    part = rest.join(cut, same).withColumn("end", F.col("used") + F.sum("tokens").over(inner)).where("end <= rest")
    more = written(
        rest.join(taken, same, "left_semi").select("key").union(part.select("key")).distinct().select(F.col("key").alias("more")), "mix-part"
    )

    # every pass in its order: the blocks' totals before a block, then the places in it
    once = dealt.select("s", "key", "whole", "block").distinct().join(more, F.col("key") == F.col("more"), "left")
    times = F.col("whole") + F.col("more").isNotNull().cast("int")
    each = written(once.select("s", "key", "block", F.explode(F.sequence(F.lit(0), times - 1)).alias("pass")), "mix-passes")
    totals = each.groupBy("s", "pass", "block").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("s", "pass").orderBy(F.xxhash64("block", "pass", F.lit(seed)), "block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("s", "pass", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    base = base.withColumnsRenamed({"s": "bs", "pass": "bp", "block": "bb"})
    within = Window.partitionBy("s", "pass", "block").orderBy(F.xxhash64("key", "pass", F.lit(seed)), "key")
    ranked = each.withColumn("r", F.row_number().over(within))
    placed = ranked.join(base, F.col("s").eqNullSafe(F.col("bs")) & (F.col("pass") == F.col("bp")) & (F.col("block") == F.col("bb")))
    places = placed.groupBy(F.col("s").alias("of"), F.col("key").alias("at"), "block").agg(
        F.collect_list(F.struct("pass", (F.col("base") + F.col("r") - 1).alias("place"))).alias("places")
    )
    places = written(places, "mix-places")
    if small_enough(places.count(), 256):
        places = F.broadcast(places)

    rows = docs.select(F.struct("*").alias("row"), key.alias("key"), F.col("source").alias("src"), tokens(F.col("text")).alias("tokens"))
    drawn = rows.join(plan.select("s", "weight"), F.col("src").eqNullSafe(F.col("s")))
    drawn = drawn.join(places, (F.col("key") == F.col("at")) & F.col("src").eqNullSafe(F.col("of")))
    each = drawn.select("row", "block", "weight", "tokens", F.explode("places").alias("p"))
    about = F.struct(F.col("p.pass").alias("pass"), "block", "weight", "tokens", F.col("p.place").alias("place")).alias("_mix")
    return each.select("row", about).select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != "_mix"), "_mix")
