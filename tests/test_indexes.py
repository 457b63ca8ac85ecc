"""Lookups over the indexes give what scans give, and read less."""

import random
import re

import pytest
from pyspark.sql import functions as F

from contentflow.operators import catalog, text_index, vector_index


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """Vectors around some directions, among them repeated, zero, missing and shorter ones."""
    rnd = random.Random(3)
    centres = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = []
    for i in range(600):
        centre, scale = rnd.choice(centres), rnd.choice([0.1, 1, 9])
        rows.append((i, [(x + rnd.gauss(0, 0.05)) * scale for x in centre]))
    rows += [(600, rows[5][1]), (601, rows[5][1]), (602, [0.0] * 16), (603, None), (604, []), (605, [1.0, 0.0]), (606, [2.0, 0.1])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    path = str(tmp_path_factory.mktemp("index") / "v")
    vector_index.build(df, "id", path, lists=24)
    return df, path


@pytest.mark.parametrize("seed, limit", [(5, 1), (5, 40), (77, 10), (300, 100), (9, 700), (602, 5), (605, 5), (12345, 5)])
def test_recommendations_from_the_index(vectors, seed, limit):
    df, path = vectors
    scan = [tuple(r) for r in catalog.recommend(df, "id", seed, limit).collect()]
    assert [tuple(r) for r in vector_index.recommend(path, df, "id", seed, limit).collect()] == scan


def test_recommendations_from_several(vectors):
    df, path = vectors
    for plus, minus in (([1, 2, 3], []), ([4, 8], [15, 16]), ([5], [600])):
        scan = [tuple(r) for r in catalog.recommend_from(df, "id", plus, minus, 20).collect()]
        assert [tuple(r) for r in vector_index.recommend_from(path, df, "id", plus, minus, 20).collect()] == scan


def test_few_lists_are_read(spark, vectors):
    df, path = vectors
    shares = []
    for seed in (5, 77, 300):
        target = df.where(F.col("id") == seed).first()["embedding"]
        near = vector_index.candidates(spark, path, target, 10, F.col("id") != seed, "id")
        text = near._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[\(?\(?list#\d+ (IN|INSET|=)", text), text
        shares.append(near.count() / df.count())
    assert max(shares) < 0.3, shares


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    vector_index.build(none, "id", str(tmp_path / "v"))
    assert vector_index.recommend(str(tmp_path / "v"), none, "id", 1).count() == 0


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rnd = random.Random(8)
    words = ["red", "Blue", "green", "été", "x_1", "7"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.choice([0, 3, 20, 200]))), f"t{i}") for i in range(500)] + [(500, None, "n")]
    folder = tmp_path_factory.mktemp("index")
    spark.createDataFrame(rows, "id long, text string, title string").write.parquet(str(folder / "table"))
    df, path = spark.read.parquet(str(folder / "table")), str(folder / "t")
    text_index.build(df, "id", "text", path, blocks=16)
    return df, path


@pytest.mark.parametrize(
    "query, offset, limit",
    [("red", 0, 10), ("Red blue", 5, 20), ("ÉTÉ; x_1 red red", 0, 7), ("w3 w4 w5 w6", 100, 50), ("nowhere", 0, 5), ("red", 400, 300), ("...", 0, 5), ("7", 0, 600)],
)
def test_pages_from_posting_lists(spark, texts, query, offset, limit):
    df, path = texts
    scan = sorted(map(tuple, catalog.search(df, "id", "text", query, offset, limit, ["id", "title"]).collect()))
    page = text_index.search(spark, path, df, "id", query, offset, limit, ["id", "title"])
    assert sorted(map(tuple, page.collect())) == scan
    assert "text:string" not in page._jdf.queryExecution().executedPlan().toString()


def test_blocks_that_cannot_reach_the_page_are_skipped(spark, texts):
    df, path = texts
    page = text_index.search(spark, path, df, "id", "red blue", 0, 5)
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert "block#" in plan and len(page.collect()) == 5
    blocks = spark.read.parquet(f"{path}/postings").select("block").distinct().count()
    read = plan.split("block#")[1]
    assert blocks > 8 and read.count(",") < blocks


@pytest.mark.parametrize("query, token", [("red", None), ("red blue green", None), ("red blue", 250), ("red nowhere", None)])
def test_documents_with_all_terms(spark, texts, query, token):
    df, path = texts
    scan = [r["id"] for r in catalog.bulk_page(df, "id", token, 1000, ["id"], "text", query).collect()]
    assert sorted(r["id"] for r in text_index.having_all(spark, path, "id", query, token).collect()) == sorted(scan)


def test_index_of_repeated_keys_without_local_rows(spark, tmp_path, monkeypatch):
    """Rows of a key in one block count together; a lookup starts no Python worker."""
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "red red"), (1, "red tea"), (2, "blue sea"), (None, "red")], "id long, text string")
    text_index.build(df, "id", "text", path, blocks=1)
    postings = spark.read.parquet(f"{path}/postings").where("term = 'red'").select("id", "n").collect()
    assert sorted(map(tuple, postings), key=str) == [(1, 3), (None, 1)]
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    assert [r["id"] for r in text_index.having_all(spark, path, "id", "sea blue").collect()] == [2]
