"""What the plans must look like to hold at scale."""

import re

import pytest

import __spark_entry__ as entry
from contentflow.plans import blog
from contentflow.workload import QUERIES

NO_PYTHON = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")
STREAMS = {"stream_ingest", "stream_high_water", "stream_apply_changes"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_python_and_no_product(spark, testdata, name):
    text = plan(entry.queries()[name](spark, testdata))
    assert not any(x in text for x in NO_PYTHON)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["dedupe_posts", "apply_changes", "author_papers"])
def test_top_rows_per_key_are_pruned_before_the_shuffle(spark, testdata, name):
    text = plan(entry.queries()[name](spark, testdata))
    assert re.search(r"WindowGroupLimit.*Partial", text)


@pytest.mark.parametrize(
    "name, pushed",
    [("paper_details", "EqualTo(p_partkey,77)"), ("autocomplete", "StringStartsWith(p_name,red)"),
     ("bulk_page", "GreaterThan(o_orderkey,700)"), ("paper_references_of_one", "EqualTo(l_orderkey,100)")],
)
def test_filters_reach_the_scan(spark, testdata, name, pushed):
    text = plan(entry.queries()[name](spark, testdata))
    assert pushed in text.replace(", ", ",")


def test_columns_are_pruned(spark, testdata):
    text = plan(entry.queries()["trending"](spark, testdata))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and all(set(x.split(":")[0] for x in s.split(",")) <= {"l_partkey", "l_shipdate"} for s in schemas)


def test_normalize_store_decodes_each_record_once(spark, tmp_path):
    """Escapes and quotes go, undated records too; only the date is decoded for the order, and the files' other columns are read once."""
    rows = [(0, ("2024-01-0\\u0032", "\\u00e9 \\/"), (['"a"', None, "\\u0062"],)), (1, (None, "x"), (["y"],)), (2, ("2024-03-01", None), (None,)), (3, ("soon", "https:\\/\\/h\\/"), ([],))]
    schema = "seq long, Metadata struct<date:string,title:string>, Content struct<body:array<string>>"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/records")
    df = blog.normalize_store(spark.read.parquet(f"{tmp_path}/records"), "seq")
    got = [(r["rank"], r.seq, r.Metadata.date, r.Metadata.title, r.Content.body) for r in df.orderBy("rank").collect()]
    assert got == [(1, 2, "2024-03-01", None, None), (2, 0, "2024-01-02", "é \\/", ["a", None, "b"]), (3, 3, "soon", "https://h/", [])]
    scans = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "ReadSchema" in x]
    assert sum("title" in x.split("ReadSchema")[1] for x in scans) == 1 < len(scans)
