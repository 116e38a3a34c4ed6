"""Near-duplicate lines by an exact set-similarity join, in DataFrame functions only.

The tokens of a line are its word 5-grams, as a set; a line of fewer words is one token, its whole sequence of words. Words
are the parts of a lower-cased line between white space. Tokens are ordered by rarity, which is that of their rarest word, and
then by hash; words are counted in a table of hashed buckets whose size is fixed, so that a bucket's count says how often its
words occur among all words, whatever the size of the corpus. Any fixed order gives the same matches; this one keeps phrases
of common words out of the prefixes. A line of n tokens can reach a similarity of t only with lines that share one of its
first n - ceil(t n) + 1 tokens, have between t n and n / t tokens, and leave room for the overlap after the positions of the
shared token. What passes these filters is verified on the token sets.

Equal token sets are one class before the join. Within a list of classes that share a token, a class meets the earliest one
and the ``TRIED`` before it first; only classes that none of them removes meet those of the rest of the list that have a size
within reach, which is part of the join's key, and a signature within reach. A signature tells for 256 hashed parts of a set
whether the number of its tokens is odd: two of them differ in no more bits than the sets differ in tokens, so no match is
lost. So a large group of near copies costs a few pairs for each of its members, and one of lines that are alike but below
the similarity leaves hardly any pairs to verify. Pairs of the first meeting pass the signatures too, and only sets of pairs that are left move.

A line goes if an earlier line matches it, earlier meaning a smaller doc_id (null last), then a smaller hash of the
document, then a smaller line number. Documents are numbered in that order, and a line by its document's number and its
place, so that one long number names and orders it. An earlier line that matches removes a later one whether or not it stays.

Defined results: null texts stay null; empty texts stay empty; a line without words stays; a document that loses all lines
becomes an empty text and keeps its row; rows with the same id and text count as one document, and each copy gets the same
cleaned text; an empty table gives an empty table; other columns are carried along whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statspine.functions.columns import let
from statspine.llm.common import small_enough, written
from statspine.operators.ranking import global_row_number
from statspine.session import scratch_scope

WORDS = 5
SIMILARITY = 0.8
#: bits of a word's hash that choose its row in the table of word counts, whatever the corpus; the table stands in the plan
BITS = 16
#: bits of a line's number that are its place in the document; the others number documents
PLACE_BITS = 27
#: bytes of a table that may be broadcast
BROADCAST = 64 << 20
#: classes before it in a list that a class meets first
TRIED = 8
#: parts that the lines of repeated classes are dealt over where their table is not small
SALTS = 32
#: columns of a set's signature
SIGNS = ("s0", "s1", "s2", "s3")
SPACE = r"(?U)\s+"


def document_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.xxhash64(doc_id, text)


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def word_hashes(line: Column) -> Column:
    return F.transform(F.array_remove(F.split(line, SPACE), ""), lambda w: F.xxhash64(w))


def bucket(word_hash: Column) -> Column:
    """A word's bucket: the first bits of its hash."""
    return F.shiftrightunsigned(word_hash, 64 - BITS).cast("int")


def worded_lines(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep, line, h): hashes of the words of every line that has any."""
    # lines become words before they become rows: a filter on the rows would else split every line twice
    hashes = F.transform(lines(F.lower("text")), word_hashes)
    return docs.select(*keep, F.posexplode(hashes).alias("line", "h")).where(F.size("h") > 0)


def rarity(docs: DataFrame) -> Column:
    """Array of ranks by bucket, from rare to frequent, over all words."""
    each = docs.select(F.explode(F.split(F.lower("text"), SPACE)).alias("w")).where("w <> ''")
    counts = each.groupBy(bucket(F.xxhash64("w")).alias("b")).count().collect()
    ranks = [0] * (1 << BITS)
    for r in counts:
        # in steps of a quarter of a doubling, at most 255: counts that differ by chance share a rank
        ranks[r["b"]] = min(255, round(4 * math.log2(r["count"] + 1)))
    return F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<bigint>")


def gram(words: Column, at: Column) -> list[Column]:
    """The words at a place; beyond the end of a short line there is NULL, which neither ``least`` nor a hash counts."""
    return [F.get(words, at + i if i else at) for i in range(WORDS)]


def places(words: Column) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size(words) - WORDS, F.lit(0)))


def token_set(h: Column, ranks: Column) -> Column:
    """Tokens of a line in ascending order of rarity, each as the rank of its rarest word and 55 bits of its hash."""
    coded = F.transform(h, lambda x: F.shiftleft(F.get(ranks, bucket(x)), 55).bitwiseOR(F.shiftrightunsigned(x, 9)))

    def tokens(codes: Column) -> Column:
        def token(at: Column) -> Column:
            own = gram(codes, at)
            return F.least(*own).bitwiseAND(F.lit(255 << 55)).bitwiseOR(F.shiftrightunsigned(F.xxhash64(*own), 9))

        return F.transform(places(codes), token)

    return F.sort_array(F.array_distinct(let(coded, tokens)))


def bare_token_set(h: Column) -> Column:
    """Tokens of a line as hashes alone, in any order: all that similarity asks for."""
    return F.array_distinct(F.transform(places(h), lambda at: F.xxhash64(*gram(h, at))))


def overlap(n: Column, m: Column, similarity: float) -> Column:
    """Shared tokens that sets of n and m tokens need; in whole thousandths, so that no rounding decides."""
    t = round(similarity * 1000)
    return F.ceil((n + m) * t / F.lit(1000 + t))


def prefix_length(n: Column, similarity: float) -> Column:
    return (n - F.ceil(n * round(similarity * 1000) / F.lit(1000)) + 1).cast("int")


#: a posting's set size and position in one number
def packed(size: Column, pos: Column) -> Column:
    return F.shiftleft(size.cast("long"), 32).bitwiseOR(pos.cast("long"))


def possible(x: str, y: str, similarity: float) -> Column:
    """Length and positional filter of two packed columns, positions counted from 0."""
    t = round(similarity * 1000)
    n, m = F.shiftright(x, 32), F.shiftright(y, 32)
    low = F.lit((1 << 32) - 1)
    room = F.least(n - F.col(x).bitwiseAND(low), m - F.col(y).bitwiseAND(low))
    return (n * 1000 >= m * t) & (m * 1000 >= n * t) & (room >= overlap(n, m, similarity))


def _guarded(df: DataFrame, row_bytes: int) -> DataFrame:
    """A written table, to be broadcast if its counted rows are few enough, else joined by shuffles."""
    return F.broadcast(df) if small_enough(df.count(), row_bytes, BROADCAST) else df


def numbered(docs: DataFrame) -> DataFrame:
    """(n, key): documents numbered in their order; rows with the same id and text are one."""
    keys = docs.where("text IS NOT NULL").select("doc_id", document_key().alias("key")).distinct()
    return written(global_row_number(keys, ["doc_id", "key"], "n").select("n", "key"), "line-documents")


def line_number(n: Column, line: Column) -> Column:
    far = F.raise_error(F.lit(f"a document has more than 2^{PLACE_BITS} lines")).cast("long")
    return F.when(line < (1 << PLACE_BITS), F.shiftleft(n, PLACE_BITS).bitwiseOR(line.cast("long"))).otherwise(far)


def removals(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(key, lines): the lines that an earlier line matches, by document."""
    with scratch_scope(docs.sparkSession):
        return _removals(docs, similarity)


def _removals(docs: DataFrame, similarity: float) -> DataFrame:
    ranks, order = rarity(docs), numbered(docs)
    keyed = worded_lines(docs.withColumn("key", document_key()), "key").select("key", "line", token_set(F.col("h"), ranks).alias("tokens"))
    # lines shrink to their prefixes before they meet the numbers of their documents
    narrow = keyed.select(
        "key", "line", F.size("tokens").alias("size"), F.xxhash64("tokens").alias("h1"), F.hash("tokens").alias("h2"),
        F.slice("tokens", F.lit(1), prefix_length(F.size("tokens"), similarity)).alias("prefix"),
    )
    named = narrow.join(_guarded(order, 200), "key").select(line_number(F.col("n"), F.col("line")).alias("id"), "size", "h1", "h2", "prefix")
    each = written(named, "lines")
    copies = _copies(each)
    classes = each.join(_guarded(copies.select("id"), 100), "id", "left_anti")
    near = _later_classes(docs, order, classes, similarity)
    # a copy has an earlier line that equals it
    gone = near.union(copies.select("id")).distinct()
    line = F.col("id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    listed = gone.groupBy(F.shiftright("id", PLACE_BITS).alias("n")).agg(F.collect_set(line).alias("lines"))
    return written(listed.join(order, "n").select("key", "lines"), "line-removals", result=True)


def _copies(each: DataFrame) -> DataFrame:
    """(id) of every line whose token set an earlier line has."""
    repeated = each.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    repeated = written(repeated.select("h1", "h2", "first"), "line-repeated")
    rows = each.select("id", "h1", "h2")
    if small_enough(repeated.count(), 200, BROADCAST):
        met = rows.join(F.broadcast(repeated), ["h1", "h2"])
    else:
        # a line may be in a third of all documents: its rows are dealt over several tasks
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        met = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(repeated.select("*", salts), ["h1", "h2", "salt"])
    return written(met.where("id <> first").select("id").distinct(), "line-copies")


def band(size: Column, similarity: float) -> Column:
    """Number of a range of sizes: sets that can match are in the same or in neighbouring ones."""
    return F.floor(F.log(size.cast("double")) / math.log(1 / similarity) + 1e-9).cast("int")


def _later_classes(docs: DataFrame, order: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(id) of the classes whose first line an earlier line matches."""
    posting = classes.select("id", "size", F.posexplode("prefix").alias("pos", "token"))
    posting = posting.select("token", "id", packed(F.col("size"), F.col("pos")).alias("y"))
    by = Window.partitionBy("token").orderBy("id")
    ranked = posting.select("*", F.row_number().over(by).alias("nth"), F.lead("id").over(by).isNotNull().alias("more"))
    # a token of one class posts nothing
    lists = written(ranked.where((F.col("nth") > 1) | F.col("more")).select("token", "id", "y", "nth"), "line-lists")
    # every class meets the first of its list and those just before it
    entry = F.struct("id", "y")
    near = F.concat(F.collect_list(entry).over(by.rowsBetween(-TRIED, -1)), F.array(F.first(entry).over(by)))
    met = lists.select("id", "y", near.alias("near")).select("id", "y", F.explode("near").alias("x")).select(F.col("x.id").alias("x"), F.col("id").alias("y"), F.col("x.y").alias("x_at"), F.col("y").alias("y_at"))
    tried = met.where((F.col("x") < F.col("y")) & possible("x_at", "y_at", similarity)).select("x", "y").distinct()
    tried = written(tried, "line-pairs")
    # one row of a list that goes on beyond those
    long = written(lists.where(F.col("nth") == TRIED + 3).select("token"), "line-long")
    in_long = written(lists.join(_guarded(long, 60), "token"), "line-long-lists")
    ids = tried.select("x").union(tried.select("y")).union(in_long.select("id")).toDF("id").distinct()
    sets = _token_sets(docs, order, ids)
    signs = written(sets.select("id", F.size("tokens").alias("size"), signature(F.col("tokens")).alias("s")).select("id", "size", "s.*"), "line-signatures")
    gone = written(_verified(sets, written(_signed_alike(signs, tried, similarity), "line-pairs"), similarity), "line-gone")
    # the others meet the rest of their lists, as far as sizes are within reach and signatures are near
    signed = in_long.join(signs.drop("size"), "id")
    signed = written(signed.withColumn("band", band(F.shiftright("y", 32), similarity)), "line-signed")
    open_ = signed.where(F.col("nth") > TRIED + 2).join(_guarded(gone, 100), "id", "left_anti")
    x = signed.select("token", "band", F.col("id").alias("x"), F.col("y").alias("x_at"), *(F.col(c).alias(f"x_{c}") for c in SIGNS))
    near_bands = F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band")
    y = open_.select("token", F.col("id").alias("y_id"), F.col("y").alias("y_at"), *(F.col(c).alias(f"y_{c}") for c in SIGNS), near_bands)
    rest = y.join(x, ["token", "band"]).where((F.col("x") < F.col("y_id")) & possible("x_at", "y_at", similarity) & near_signs("x", "y", similarity))
    rest = rest.select("x", F.col("y_id").alias("y")).distinct()
    rest = written(rest.join(tried, ["x", "y"], "left_anti"), "line-pairs")
    return written(gone.union(_verified(sets, rest, similarity)), "line-gone")


def signature(tokens: Column) -> Column:
    """Whether the number of tokens is odd, for each of 256 hashed parts of a set, as the bits of four numbers."""

    def part(k: int) -> Column:
        def flip(bits: Column, x: Column) -> Column:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))
            return F.when(x.bitwiseAND(192) == k << 6, bits.bitwiseXOR(bit)).otherwise(bits)

        return F.aggregate(tokens, F.lit(0).cast("long"), flip)

    return F.struct(*[part(k).alias(c) for k, c in enumerate(SIGNS)])


def near_signs(x: str, y: str, similarity: float) -> Column:
    """Sets differ in at least as many tokens as their signatures do in bits: no more than the similarity allows."""
    n, m = F.shiftright(f"{x}_at", 32), F.shiftright(f"{y}_at", 32)
    bits = sum((F.bit_count(F.col(f"{x}_{c}").bitwiseXOR(F.col(f"{y}_{c}"))) for c in SIGNS[1:]), F.bit_count(F.col(f"{x}_{SIGNS[0]}").bitwiseXOR(F.col(f"{y}_{SIGNS[0]}"))))
    return bits <= n + m - 2 * overlap(n, m, similarity)


def _signed_alike(signs: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (x, y) whose signatures are near."""
    near = _guarded(signs, 200)
    for side in ("x", "y"):
        named = near.select(F.col("id").alias(side), packed(F.col("size"), F.lit(0)).alias(f"{side}_at"), *(F.col(c).alias(f"{side}_{c}") for c in SIGNS))
        pairs = pairs.join(named, side)
    return pairs.where(near_signs("x", "y", similarity)).select("x", "y")


def _token_sets(docs: DataFrame, order: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, tokens) of the lines ``ids``, written."""
    # only the wanted lines of documents that have any are taken apart again
    place = F.col("id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    by_document = ids.groupBy(F.shiftright("id", PLACE_BITS).alias("n")).agg(F.collect_list(place).alias("places"))
    whose = written(by_document.join(order, "n"), "line-whose")
    size = whose.agg(F.coalesce(F.sum(F.size("places") * 8 + 200), F.lit(0))).first()[0]
    keyed = docs.select("text", document_key().alias("key")).join(F.broadcast(whose) if small_enough(size, 1, BROADCAST) else whose, "key")
    picked = let(lines(F.lower("text")), lambda parts: F.transform("places", lambda i: F.struct(i.alias("line"), word_hashes(F.get(parts, i)).alias("h"))))
    found = keyed.select("n", F.explode(picked).alias("p")).select(line_number(F.col("n"), F.col("p.line")).alias("id"), "p.h")
    return written(found.select("id", bare_token_set(F.col("h")).alias("tokens")), "line-tokens")


def _verified(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """(id) of the y whose token set has the similarity with that of an x; ``pairs`` (x, y) is written."""
    t = round(similarity * 1000)
    # only the sets of these pairs move
    ids = written(pairs.select("x").union(pairs.select("y")).toDF("id").distinct(), "line-verified")
    sets = sets.join(_guarded(ids, 100), "id", "left_semi")
    x, y = sets.select(F.col("id").alias("x"), F.col("tokens").alias("a")), sets.select(F.col("id").alias("y"), F.col("tokens").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    same = shared * (1000 + t) >= (F.size("a") + F.size("b")) * t
    return pairs.join(x, "x").join(y, "y").where(same).select(F.col("y").alias("id")).distinct()


def clean(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the lines that an earlier line matches; n_lines and n_removed replace columns of these names."""
    gone = removals(docs, similarity).select(F.col("key").alias("_key"), F.col("lines").alias("_gone"))
    size = gone.agg(F.coalesce(F.sum(F.size("_gone") * 8 + 40), F.lit(0))).first()[0]
    small = small_enough(size, 1)
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("whole"), document_key().alias("_key"))
    joined = rows.join(F.broadcast(gone) if small else gone, "_key", "left")

    def left(parts: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_gone")
        return F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")

    text = F.when(F.col("_gone").isNull(), F.col("whole")).otherwise(let(lines(F.col("whole")), left)).alias("text")
    count = F.when(F.col("whole").isNull(), 0).otherwise(F.size(lines(F.col("whole")))).alias("n_lines")
    removed = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).alias("n_removed")
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*(text if c == "text" else F.col("row").getField(c).alias(c) for c in own), count, removed)
