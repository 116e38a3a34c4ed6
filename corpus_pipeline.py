"""A corpus pipeline: toxic documents out, repeated lines out, near copies out, sources mixed, sequences packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run`` writes every stage's
rows to the shared scratch folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statspine.llm import line_dedup, mixing, packing, simhash, toxicity
from statspine.llm.common import ship, table, written
from statspine.llm.queries import PATTERN, RANKS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    ship(spark)
    grammar = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scores(F.col("text"), grammar) < toxicity.THRESHOLD)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines, short ones too, that an earlier line matches; n_chars follows the text."""
    cleaned = line_dedup.clean(docs)
    chars = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return cleaned.withColumns(chars).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship(spark)
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice."""
    return mixing.mixed(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    ship(spark)
    cut = packing.pieces(docs, RANKS, PATTERN)
    return packing.best_fit(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: hashes that DuckDB lacks decide which copies are near and which blocks are drawn
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
