"""Catalog queries on the test tables: parts and orders as papers, customers as authors."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentflow.operators import analytics as A, catalog as K, text_index, vector_index
from contentflow.session import shared_folder
from contentflow.workload.analytics import _DOCS, _LISTS, _ranked
from contentflow.workload.registry import SQL, query


@query("paper_details", "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_partkey = 77")
def paper_details(t):
    return K.details(t.part, "p_partkey", 77, ["p_partkey", "p_name", "p_retailprice"])


@query("author_details", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def author_details(t):
    return K.details(t.customer, "c_custkey", 42, ["c_custkey", "c_name"])


@query(
    "batch_details",
    """SELECT o_orderkey AS pos, o_custkey * 2 AS c_custkey, c_name, c_acctbal
FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2""",
)
def batch_details(t):
    """One request per order; about half of the asked ids do not exist."""
    asked = t.orders.select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") * 2).alias("c_custkey"))
    return K.batch_details(asked, t.customer, "c_custkey", ["c_custkey", "c_name", "c_acctbal"])


@query(
    "search",
    r"""SELECT doc_id, source, CAST(score AS INTEGER) AS score FROM (
  SELECT doc_id, source, len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'),
         lambda w: w IN ('the', 'and', 'ation', 'une'))) AS score FROM documents)
WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50 OFFSET 20""",
)
def search(t):
    return K.search(t.documents, "doc_id", "text", "The and ation une", 20, 50, ["doc_id", "source"])


@query(
    "search_authors",
    """SELECT c_custkey, c_name, CAST(1 AS INTEGER) AS score FROM customer
WHERE c_name IN ('Customer#000000007', 'Customer#000000011') ORDER BY c_custkey""",
)
def search_authors(t):
    return K.search(t.customer, "c_custkey", "c_name", "000000007 000000011", fields=["c_custkey", "c_name"])


@query(
    "title_match",
    """SELECT p_partkey, p_name, round(len(list_intersect(ws, q)) / len(list_distinct(list_concat(ws, q))), 6) AS similarity
FROM (SELECT p_partkey, p_name, string_split(p_name, ' ') AS ws, ['small', 'red', 'widget'] AS q FROM part)
ORDER BY similarity DESC, p_partkey LIMIT 1""",
)
def title_match(t):
    return K.title_match(t.part, "p_partkey", "p_name", "Small RED widget")


@query("search_indexed", SQL["search"])
def search_indexed(t):
    path = shared_folder(t.spark, "postings")
    text_index.build(t.documents, "doc_id", "text", path)
    return text_index.search(t.spark, path, t.documents, "doc_id", "The and ation une", 20, 50, ["doc_id", "source"])


@query(
    "bulk_page_indexed",
    r"""WITH hits AS (SELECT doc_id FROM documents WHERE doc_id > 50 AND list_has_all(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ['the', 'of']))
SELECT doc_id, CASE WHEN (SELECT count(*) FROM hits) > 40 THEN max(doc_id) OVER () END AS next_token
FROM (SELECT * FROM hits ORDER BY doc_id LIMIT 40)""",
)
def bulk_page_indexed(t):
    path = shared_folder(t.spark, "postings")
    text_index.build(t.documents, "doc_id", "text", path)
    return K.bulk_page(text_index.having_all(t.spark, path, "doc_id", "Of the", 50), "doc_id", None, 40)


@query("autocomplete", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red') ORDER BY p_name, p_partkey LIMIT 10")
def autocomplete(t):
    return K.autocomplete(t.part, "p_partkey", "p_name", "red")


@query(
    "bulk_page",
    """SELECT o_orderkey, o_totalprice,
  CASE WHEN (SELECT count(*) FROM orders WHERE o_orderkey > 700) > 500 THEN max(o_orderkey) OVER () END AS next_token
FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 700 ORDER BY o_orderkey LIMIT 500)""",
)
def bulk_page(t):
    return K.bulk_page(t.orders, "o_orderkey", 700, 500, ["o_orderkey", "o_totalprice"])


@query(
    "bulk_page_of_query",
    """WITH hits AS (SELECT p_partkey, p_retailprice FROM part
  WHERE p_partkey > 20 AND list_has_all(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}_]+'), ['red', 'widget']))
SELECT p_partkey, p_retailprice, CASE WHEN (SELECT count(*) FROM hits) > 10 THEN max(p_partkey) OVER () END AS next_token
FROM (SELECT * FROM hits ORDER BY p_partkey LIMIT 10)""",
)
def bulk_page_of_query(t):
    return K.bulk_page(t.part, "p_partkey", 20, 10, ["p_retailprice"], "p_name", "Widget-red")


def _authorship(t):
    return t.orders.select(F.col("o_orderkey").alias("paper_id"), F.col("o_custkey").alias("c_custkey"))


@query("paper_authors", "SELECT o_orderkey AS paper_id, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def paper_authors(t):
    return K.paper_authors(_authorship(t), t.customer, "c_custkey", ["c_name"])


@query(
    "paper_authors_of_one",
    "SELECT o_orderkey AS paper_id, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = 99",
)
def paper_authors_of_one(t):
    return K.paper_authors(_authorship(t), t.customer, "c_custkey", ["c_name"], paper_id=99)


def _edges(t):
    return t.lineitem.select(
        F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"), F.col("l_linenumber").alias("context")
    )


@query(
    "paper_references",
    """SELECT l_orderkey AS citing, l_partkey AS cited, l_linenumber AS context, p_name, p_brand
FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def paper_references(t):
    return K.paper_references(_edges(t), t.part, "p_partkey", ["p_name", "p_brand"])


@query(
    "paper_references_of_one",
    """SELECT l_orderkey AS citing, l_partkey AS cited, l_linenumber AS context, p_name
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = 100""",
)
def paper_references_of_one(t):
    return K.paper_references(_edges(t), t.part, "p_partkey", ["p_name"], 100)


@query(
    "paper_citations",
    """SELECT l_partkey AS cited, l_orderkey AS citing, l_linenumber AS context, o_orderpriority
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def paper_citations(t):
    return K.paper_citations(_edges(t), t.orders, "o_orderkey", ["o_orderpriority"])


@query(
    "paper_citations_of_one",
    """SELECT l_partkey AS cited, l_orderkey AS citing, l_linenumber AS context, o_orderpriority
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey = 5""",
)
def paper_citations_of_one(t):
    return K.paper_citations(_edges(t), t.orders, "o_orderkey", ["o_orderpriority"], 5)


@query(
    "author_papers",
    """SELECT o_custkey AS c_custkey, o_orderkey, o_totalprice FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer)
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) BETWEEN 3 AND 7""",
)
def author_papers(t):
    papers = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return K.author_papers(papers, t.customer, "c_custkey", "o_orderkey", ["o_totalprice"], 2, 5)


@query(
    "author_papers_of_one",
    """SELECT o_custkey AS c_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey = 10
ORDER BY o_orderkey LIMIT 5 OFFSET 1""",
)
def author_papers_of_one(t):
    papers = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return K.author_papers(papers, t.customer, "c_custkey", "o_orderkey", ["o_totalprice"], 1, 5, 10)


@query(
    "paper_embedding",
    """SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(CAST(v AS DOUBLE), 6) AS value
FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(v, i)""",
)
def paper_embedding(t):
    papers = t.embeddings.select(
        "vec_id", F.struct(F.col("embedding").alias("specter_v1"), F.reverse("embedding").alias("specter_v2")).alias("embedding")
    )
    vectors = K.paper_embedding(papers, "vec_id")
    return vectors.select("vec_id", F.posexplode("vector").alias("pos", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), 6)
    )


@query(
    "paper_tldr",
    f"WITH {_ranked(_DOCS, 5)}, {_LISTS} SELECT id AS doc_id, array_to_string(kw, ' ') AS tldr FROM lists WHERE id = 7",
)
def paper_tldr(t):
    summaries = A.keyword_summary(t.documents.select("doc_id", "text"), "doc_id", "text")
    return K.paper_tldr(summaries, "doc_id", 7)


_DIM = 64
_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * g[i]))"
_NORM = """(sqrt(list_sum(list_transform(g, lambda x: x * x)))
  * sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))))"""


def _mean(where: str) -> str:
    parts = ", ".join(f"avg(CAST(embedding[{i}] AS DOUBLE))" for i in range(1, _DIM + 1))
    return f"(SELECT [{parts}] FROM embeddings WHERE {where})"


def _mean_of_authors(where: str) -> str:
    inner = ", ".join(f"avg(CAST(embedding[{i}] AS DOUBLE)) AS a{i}" for i in range(1, _DIM + 1))
    outer = ", ".join(f"avg(a{i})" for i in range(1, _DIM + 1))
    return f"(SELECT [{outer}] FROM (SELECT label, {inner} FROM embeddings WHERE {where} GROUP BY label))"


def _nearest(goal: str, where: str, limit: int) -> str:
    return f"""WITH goal AS (SELECT {goal} AS g)
SELECT vec_id, round({_DOT} / {_NORM}, 4) AS score FROM embeddings, goal WHERE {where}
ORDER BY score DESC, vec_id LIMIT {limit}"""


def _minus(a: str, b: str) -> str:
    return f"(SELECT list_transform(range(1, 65), lambda i: p[i] - n[i]) FROM (SELECT {a} AS p, {b} AS n))"


@query(
    "recommend",
    _nearest("(SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) FROM embeddings WHERE vec_id = 3)", "vec_id <> 3", 20),
)
def recommend(t):
    return K.recommend(t.embeddings, "vec_id", 3, 20)


def _vector_index(t):
    path = shared_folder(t.spark, "vectors")
    vector_index.build(t.embeddings, "vec_id", path)
    return path


@query("recommend_indexed", SQL["recommend"])
def recommend_indexed(t):
    return vector_index.recommend(_vector_index(t), t.embeddings, "vec_id", 3, 20)


@query(
    "recommend_from_indexed",
    _nearest(_minus(_mean("vec_id IN (3, 14, 15)"), _mean("vec_id IN (9, 26)")), "vec_id NOT IN (3, 14, 15, 9, 26)", 20),
)
def recommend_from_indexed(t):
    return vector_index.recommend_from(_vector_index(t), t.embeddings, "vec_id", [3, 14, 15], [9, 26], 20)


@query(
    "recommend_from",
    _nearest(_minus(_mean("vec_id IN (3, 14, 15)"), _mean("vec_id IN (9, 26)")), "vec_id NOT IN (3, 14, 15, 9, 26)", 20),
)
def recommend_from(t):
    return K.recommend_from(t.embeddings, "vec_id", [3, 14, 15], [9, 26], 20)


@query(
    "recommend_from_positive",
    _nearest(_mean("vec_id IN (1, 2)"), "vec_id NOT IN (1, 2)", 15),
)
def recommend_from_positive(t):
    return K.recommend_from(t.embeddings, "vec_id", [1, 2], limit=15)


@query(
    "recommend_for_author",
    _nearest(_minus(_mean_of_authors("label IN (1, 2)"), _mean_of_authors("label IN (4)")), "label NOT IN (1, 2, 4)", 20),
)
def recommend_for_author(t):
    return K.recommend_for_author(t.embeddings, "vec_id", "label", [1, 2], [4], 20)


@query(
    "trending",
    """SELECT l_partkey, count(*) AS citations FROM lineitem
WHERE CAST(l_shipdate AS DATE) > (SELECT CAST(max(l_shipdate) AS DATE) - 365 FROM lineitem)
GROUP BY l_partkey ORDER BY citations DESC, l_partkey LIMIT 25""",
)
def trending(t):
    return K.trending(t.lineitem, "l_partkey", "l_shipdate", 365, 25)
