"""Registered queries of the training-data operators on the smallest tables, and the pipeline."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from statspine.llm import queries
from tests.conftest import SF_DIR
from tests.test_queries import TABLES, canonical


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    got = canonical(df.columns, df.collect())
    result = duck.execute(queries.SQL[name])
    assert got == canonical([c[0] for c in result.description], result.fetchall())


def test_all_ten_are_registered():
    names = [*entry.queries()]
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names and set(queries.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL])
def test_query_covers_its_table(spark, name):
    rows = queries.QUERIES[name](spark, SF_DIR).select("doc_id").distinct().count()
    assert rows == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()


NATIVE = ("op3_line_dedup", "op6_chat_formatting")


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_have_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept, before = docs, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, before, SF_DIR).cache()
        assert kept.dtypes == docs.dtypes, name
        assert kept.join(before, "doc_id", "left_anti").count() == 0
        before = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF_DIR)
    assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
    assert packed.where("piece = 0").count() == kept.count()


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 100


def test_pipeline_of_no_documents(spark):
    none = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF_DIR).count() == 0
