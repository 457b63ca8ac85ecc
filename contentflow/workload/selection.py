"""Selection, merging and change feeds on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentflow.operators import changes as C, selection as S, views as V
from contentflow.functions.text import PUNCTUATION, split_words
from contentflow.plans import release
from contentflow.sources.releases import read_diff_lines
from contentflow.workload import fixtures as fx, sqltext as s
from contentflow.workload.registry import query


@query("unseen", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unseen(t):
    return S.unseen(t.documents.select("doc_id", "source"), t.labels, "doc_id")


@query(
    "new_by_any_id",
    """
SELECT doc_id FROM documents d WHERE NOT EXISTS (
  SELECT 1 FROM labels l WHERE CASE WHEN l.doc_id % 2 = 0 THEN 'u' || l.doc_id ELSE 'x' || l.doc_id END
                             = CASE WHEN d.doc_id % 4 < 2 THEN 'u' || d.doc_id ELSE 'x' || d.doc_id END)""",
)
def new_by_any_id(t):
    def ids(df, in_uuid):
        k = F.col("doc_id")
        return df.select(
            "doc_id",
            F.when(in_uuid, F.concat(F.lit("u"), k)).alias("uuid"),
            F.when(~in_uuid, F.concat(F.lit("x"), k)).alias("unique_id"),
        )

    k = F.col("doc_id")
    return S.new_by_any_id(ids(t.documents, k % 4 < 2), ids(t.labels, k % 2 == 0)).select("doc_id")


@query(
    "first_page_only",
    """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
JOIN (SELECT l_partkey, min(l_linenumber) AS first FROM lineitem GROUP BY 1) f USING (l_partkey)
WHERE l_linenumber = first""",
)
def first_page_only(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return S.first_page_only(rows, "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


_PAGED = f"""WITH {s.POSTS}, paged AS (
  SELECT seq, seq // 25 AS page, md5(array_to_string(body, '|')) AS url, title || '#' || tags[1] || (seq // 10) AS title FROM posts
), known AS (
  SELECT title FROM paged WHERE seq > (SELECT 0.7 * max(seq) FROM paged)
), fresh AS (
  SELECT p.* FROM paged p JOIN (SELECT url, min(page) AS first FROM paged GROUP BY 1) f ON p.url = f.url AND p.page = f.first
), stops AS (
  SELECT page FROM (SELECT page, (SELECT count(*) FROM fresh f WHERE f.page = p.page) AS n,
                           (SELECT count(*) FROM fresh f JOIN known USING (title) WHERE f.page = p.page) AS k
                    FROM (SELECT DISTINCT page FROM paged) p)
  WHERE page > (SELECT min(page) FROM paged) AND (n = 0 OR k > 0)
)
SELECT seq, page, title FROM fresh WHERE page < coalesce((SELECT min(page) FROM stops), 1000000000)"""


@query("crawl_until_known", _PAGED)
def crawl_until_known(t):
    p = fx.posts(t)
    title = F.concat("title", F.lit("#"), F.col("tags")[0], F.floor(F.col("seq") / 10))
    paged = p.select(
        "seq", F.floor(F.col("seq") / 25).alias("page"), F.md5(F.array_join("body", "|")).alias("url"),
        title.alias("title"),
    )
    last = paged.agg((F.max("seq") * 0.7).alias("m")).scalar()
    known = paged.where(F.col("seq") > last).select("title")
    return S.crawl_until_known(paged, known, url="url").select("seq", "page", "title")


_DATED = """dated AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN 'N/A' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders)"""


def _dated(t):
    date = F.when(F.col("o_orderkey") % 100 == 0, "N/A").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", date.alias("date"))


@query(
    "after_high_water",
    f"""WITH {_DATED}, stored AS (SELECT * FROM dated WHERE date < '1998-01-01' OR date = 'N/A')
SELECT * FROM dated WHERE date = 'N/A' OR date > (SELECT max(date) FROM stored WHERE date <> 'N/A')""",
)
def after_high_water(t):
    rows = _dated(t)
    return S.after_high_water(rows, rows.where((F.col("date") < "1998-01-01") | (F.col("date") == "N/A")))


@query(
    "append_increment",
    f"""WITH {_DATED}, stored AS (SELECT * FROM dated WHERE date < '1997-06-01')
SELECT o_orderkey, date, CAST(0 AS INTEGER) AS batch FROM stored UNION ALL
SELECT o_orderkey, date, 1 FROM dated
WHERE (date = 'N/A' OR date > (SELECT max(date) FROM stored)) AND o_orderkey NOT IN (SELECT o_orderkey FROM stored)""",
)
def append_increment(t):
    rows = _dated(t)
    return C.append_increment(rows.where(F.col("date") < "1997-06-01"), rows, key="o_orderkey")


@query(
    "dedupe_posts",
    f"""WITH {s.POSTS} SELECT min(seq) AS seq, md5(array_to_string(body, '|')) AS url, title
FROM posts GROUP BY 2, 3""",
)
def dedupe_posts(t):
    rows = fx.posts(t).select("seq", F.md5(F.array_join("body", "|")).alias("url"), "title")
    return S.dedupe_posts(rows, ["url", "title"])


_MARKS = "['', ' ', '(', '#$%', '()', ')(', '-', 'a-']"


@query(
    "keyword_filter",
    f"""
SELECT doc_id, {s.joined(f"list_filter(list_concat({_MARKS}, list_filter(regexp_split_to_array(text, '[{s.SPACE}]+'), lambda w: w <> '')), "
       f"lambda k: trim(k, {s.SPACES}) <> '' AND instr({s.quoted(PUNCTUATION)}, k) = 0)")} AS keywords FROM documents""",
)
def keyword_filter(t):
    marks = F.array(*[F.lit(x) for x in ("", " ", "(", "#$%", "()", ")(", "-", "a-")])
    rows = t.documents.select("doc_id", F.concat(marks, split_words(F.col("text"))).alias("keywords"))
    return S.keyword_filter(rows).withColumn("keywords", F.array_join("keywords", "|"))


@query(
    "merge_new_first",
    """
SELECT doc_id, source, CAST(1 AS INTEGER) AS batch FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, source, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def merge_new_first(t):
    new = t.documents.select("doc_id", "source")
    return C.merge_new_first(new, new.join(t.labels.select("doc_id"), "doc_id", "left_semi"), "doc_id")


_FEED = """feed AS (
  SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op,
         user_id AS key, event_type || ':' || props AS payload FROM events)"""
APPLIED = f"""WITH {_FEED}, last AS (
  SELECT * FROM feed WHERE seq IN (SELECT max(seq) FROM feed GROUP BY key))
SELECT c_custkey AS key, c_name AS payload FROM customer WHERE c_custkey NOT IN (SELECT key FROM feed)
UNION ALL SELECT key, payload FROM last WHERE op = 'upsert'"""


@query("apply_changes", APPLIED)
def apply_changes(t):
    return C.apply_changes(fx.change_target(t), fx.changes(t), "key")


@query(
    "delete_misses",
    f"""WITH {_FEED}, h AS (SELECT *, lag(op) OVER (PARTITION BY key ORDER BY seq) AS prev FROM feed)
SELECT seq, key FROM h WHERE op = 'delete'
AND (prev = 'delete' OR (prev IS NULL AND key NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)))""",
)
def delete_misses(t):
    return C.delete_misses(fx.change_target(t).where("key % 3 <> 0"), fx.changes(t), "key")


_DIFFS = """diffs AS (
  SELECT row_number() OVER (ORDER BY event_id % 4, event_type = 'error', event_id) AS seq,
         CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, user_id AS key, event_type || ':' || props AS payload FROM events)"""


def _diff_lines(t):
    return read_diff_lines(t.spark, fx.diff_files(t), "key long, payload string")


@query(
    "apply_diffs",
    f"""WITH {_DIFFS}
SELECT c_custkey AS key, c_name AS payload FROM customer WHERE c_custkey NOT IN (SELECT key FROM diffs)
UNION ALL SELECT key, payload FROM diffs WHERE op = 'upsert' AND seq IN (SELECT max(seq) FROM diffs GROUP BY key)""",
)
def apply_diffs(t):
    return release.apply_diffs(fx.change_target(t), _diff_lines(t), "key")[0]


@query(
    "diff_misses",
    f"""WITH {_DIFFS}, h AS (SELECT *, lag(op) OVER (PARTITION BY key ORDER BY seq) AS prev FROM diffs)
SELECT key, count(*) AS misses FROM h WHERE op = 'delete'
AND (prev = 'delete' OR (prev IS NULL AND key NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0))) GROUP BY key""",
)
def diff_misses(t):
    missed = release.apply_diffs(fx.change_target(t).where("key % 3 <> 0"), _diff_lines(t), "key")[1]
    return missed.groupBy("key").agg(F.count(F.lit(1)).alias("misses"))


@query(
    "newest_first",
    f"""WITH {_DATED}
SELECT o_orderkey, date, row_number() OVER (
  ORDER BY CASE WHEN date = 'N/A' THEN NULL ELSE date END DESC NULLS LAST, o_orderkey) AS rank FROM dated""",
)
def newest_first(t):
    return V.newest_first(_dated(t), "date", "o_orderkey")


@query("preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def preview(t):
    return V.preview(t.orders.select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), "o_orderkey")
