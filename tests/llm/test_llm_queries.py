"""The registered queries on the test tables, against SQL where there is one."""

import duckdb
import pytest

import corpus_pipeline
from contentflow.llm.queries import QUERIES, SQL

TABLES = "documents benchmark labels conversations embeddings".split()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, testdata, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{testdata}/{table}.parquet'")
    df = QUERIES[name](spark, testdata)
    columns = sorted(df.columns)
    order = ", ".join(f'"{c}"' for c in columns)
    want = duck.sql(f"SELECT {order} FROM ({SQL[name]})").fetchall()
    assert sorted(map(repr, df.select(*columns).collect() and [tuple(r) for r in df.select(*columns).collect()])) == sorted(map(repr, want))


def test_every_leaked_item_is_found(spark, testdata):
    exact = duckdb.sql(
        f"SELECT d.doc_id, b.item_id FROM '{testdata}/documents.parquet' d, '{testdata}/benchmark.parquet' b WHERE contains(d.text, b.text)"
    ).fetchall()
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op1_decontaminate"](spark, testdata).collect()}
    assert set(exact) <= got


def test_language_held_out_accuracy(spark, testdata):
    docs = spark.read.parquet(f"{testdata}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op4_language"](spark, testdata).where("held_out").join(docs, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)


def test_pipeline(spark, testdata):
    out = corpus_pipeline.run(spark, testdata)
    docs = spark.read.parquet(f"{testdata}/documents.parquet")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < out.count() < docs.count() and out.select("doc_id").distinct().count() == out.count()
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs.limit(20), testdata).columns == docs.columns
    empty = docs.limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, testdata).count() == 0
