"""The pipeline against its stages done plainly, and the registered queries of the package."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from __spark_entry__ import queries
from shelfwise.llm.twins import TWINS

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the shared tables are missing")


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == docs.columns
        seen[name] = (docs.count(), kept.count())
        docs = kept
    before, after = seen["language ID"]
    assert after >= 0.99 * before
    assert seen["PII"][0] == seen["PII"][1]
    assert not docs.where("text rlike '[a-z0-9.]+@[a-z0-9]+[.]example[.]com'").count()


def test_pipeline_of_odd_rows(spark):
    from shelfwise.llm.common import table

    extra = "doc_id long, text string, lang string, source string, n_chars long, component_id string"
    rows = [(1, "the words of a first text stand in here", "en", "a", 40, "x"), (2, None, None, None, None, None),
            (3, "the words of a first text stand in here", None, "a", 40, "x"), (3, "", "en", "", 0, "x"), (None, "another text of some words", "en", None, 3, None)]
    docs = table(spark, FOLDER, "documents").selectExpr(
        "doc_id + 100 as doc_id", "text", "lang", "source", "n_chars", "'x' as component_id"
    ).unionByName(spark.createDataFrame(rows, extra))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    out = {r.doc_id for r in docs.collect()}
    assert 1 in out and 2 not in out and 3 not in out and None in out


def test_rows_go_by_themselves_whatever_their_id(spark):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").where("length(text) > 60").first().text
    docs = spark.createDataFrame([(None, item), (None, "a clean text"), (4, item), (4, "another clean text")], "doc_id long, text string")
    out = corpus_pipeline.decontaminated(spark, docs, FOLDER)
    assert {(r.doc_id, r.text) for r in out.collect()} == {(None, "a clean text"), (4, "another clean text")}


def test_empty_documents_give_no_row(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(TWINS))
def test_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cursor = duck.execute(TWINS[name])
    columns = sorted(d[0] for d in cursor.description)
    order = [[d[0] for d in cursor.description].index(c) for c in columns]
    expected = sorted(tuple(r[i] for i in order) for r in cursor.fetchall())
    out = queries()[name](spark, FOLDER)
    assert sorted(out.columns) == columns
    assert sorted(tuple(r[c] for c in columns) for r in out.collect()) == expected
