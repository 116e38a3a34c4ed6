"""Many substrings in many texts, and substring search, over words and their grams.

A substring without a blank lies within one word, the text between two blanks. So texts are reduced to their distinct words,
all texts to one vocabulary, and only the vocabulary meets the keywords: each keyword is looked up by its rarest gram, and
``contains`` verifies what the gram finds. A keyword with blanks is looked up by its longest part and verified on the texts
that have that part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statspine.session import scratch_dir
from statspine.sources.store import write_clustered

GRAM = 3


def _stored(df: DataFrame, purpose: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Distinct words of a text."""
    return F.array_remove(F.array_distinct(F.split(text, " ")), "")


def longest_part(text: Column) -> Column:
    """The longest part between blanks, the first of several."""
    parts = F.split(text, " ")
    return F.element_at(F.array_sort(parts, lambda a, b: F.length(b) - F.length(a)), 1)


def grams(word: Column, size: int = GRAM) -> Column:
    """Distinct runs of ``size`` characters; a shorter word has none."""
    return F.array_distinct(F.regexp_extract_all(word, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def text_key(text: Column) -> list[Column]:
    """What names a text in the tables of its words."""
    return [F.xxhash64(text).alias("_k1"), F.hash(text).alias("_k2"), F.length(text).alias("_k3")]


KEY = ["_k1", "_k2", "_k3"]


def vocabulary_hits(vocabulary: DataFrame, keywords: DataFrame) -> DataFrame:
    """(word, keyword): words that contain the longest part of a keyword; ``vocabulary`` (word) and ``keywords`` (keyword) are distinct."""
    probes = _stored(keywords.select("keyword", longest_part(F.col("keyword")).alias("part")).where("part <> ''"), "probes")
    sizes = sorted(r["n"] for r in probes.select(F.least(F.length("part"), F.lit(GRAM)).alias("n")).distinct().collect())
    every = F.array().cast("array<string>")
    in_word = vocabulary.select("word", F.explode(F.flatten(F.array(every, *[grams(F.col("word"), n) for n in sizes]))).alias("gram"))
    own = F.coalesce(*[F.when(F.least(F.length("part"), F.lit(GRAM)) == n, grams(F.col("part"), n)) for n in sizes], every) if sizes else every
    in_part = probes.select("keyword", "part", F.explode(own).alias("gram"))
    # how many words have a keyword's grams: the rarest is looked up
    counts = in_word.join(in_part.select("gram").distinct(), "gram").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = in_part.join(counts, "gram", "left").groupBy("keyword", "part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    return in_word.join(rarest, "gram").where(F.contains("word", "part")).select("word", "keyword").distinct()


def keyword_hits(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(_k1, _k2, _k3, keyword): which texts (t) contain which keywords (keyword, distinct). An empty keyword is in none."""
    listed = _stored(texts.select(*text_key(F.col("t")), words(F.col("t")).alias("words")), "words")
    each = listed.select(*KEY, F.explode("words").alias("word"))
    found = _stored(vocabulary_hits(each.select("word").distinct(), keywords), "word-hits")
    hits = each.join(found, "word").select(*KEY, "keyword").distinct()
    blanks = F.col("keyword").contains(" ")
    if keywords.where(blanks).isEmpty():
        return hits
    some = hits.where(blanks).withColumnsRenamed({k: f"_{k}" for k in KEY})
    same = [F.col(k) == F.col(f"_{k}") for k in KEY]
    whole = texts.select("t", *text_key(F.col("t"))).join(some, same).where(F.contains("t", "keyword")).select(*KEY, "keyword").distinct()
    return hits.where(~blanks).unionByName(whole)


def write_search_index(rows: DataFrame, key: str, columns: list[str], path: str) -> None:
    """Words of each row by word, and words by gram, clustered so that a search reads its own row groups."""
    texts = F.transform(F.array(*[F.lower(F.col(c).cast("string")) for c in columns]), lambda t: F.coalesce(t, F.lit("")))
    every = F.array_distinct(F.flatten(F.transform(texts, words)))
    postings = rows.select(F.col(key).alias("key"), F.explode(every).alias("word"))
    write_clustered(postings, f"{path}/postings", ["word"], ["word"])
    vocabulary = rows.sparkSession.read.parquet(f"{path}/postings").select("word").distinct()
    write_clustered(vocabulary.select(F.explode(grams(F.col("word"))).alias("gram"), "word"), f"{path}/grams", ["gram"], ["gram"])


def search_indexed(spark: SparkSession, rows: DataFrame, key: str, columns: list[str], path: str, text: str) -> DataFrame:
    """Rows that contain ``text`` in any case in one of the columns, found through the index.

    A text whose longest part is shorter than a gram is looked for in the vocabulary, not in the rows.
    """
    wanted = text.strip().lower()
    part = max(wanted.split(" "), key=len)
    if len(part) >= GRAM:
        vocabulary = spark.read.parquet(f"{path}/grams").where(F.col("gram") == part[:GRAM]).select("word")
    else:
        vocabulary = spark.read.parquet(f"{path}/postings").select("word").distinct()
    held = vocabulary.where(F.col("word").contains(part))
    ids = spark.read.parquet(f"{path}/postings").join(held, "word", "left_semi").select(F.col("key").alias("_found")).distinct()
    found = rows.join(ids, F.col(key) == F.col("_found"), "left_semi")
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(wanted), F.lit(False))
    # a word that contains the part is proof enough only where that is all of the text
    return found if part == wanted else found.where(hit)
