"""Page jobs and sources on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentflow.operators import pages as P
from contentflow.session import shared_folder
from contentflow.sources import feeds, posts as S, releases
from contentflow.workload import fixtures as fx, sqltext as s
from contentflow.workload.registry import query

SITE = "https://site.example"

_POST_COLUMNS = f"""
SELECT "urlId", uuid, date, author, title, {s.joined('body')} AS body, '' AS images, {s.joined('tags')} AS tags, categories
FROM posts"""


@query("read_posts", f"WITH {s.POSTS} {_POST_COLUMNS}")
def read_posts(t):
    folder = shared_folder(t.spark, "posts")
    S.write_posts(fx.posts(t).drop("seq"), folder)
    df = S.read_posts(t.spark, folder)
    joined = [F.array_join(c, "|").alias(c) for c in ("body", "images", "tags")]
    return df.select("urlId", "uuid", "date", "author", "title", *joined, "categories")


@query("write_posts", f"WITH {s.POSTS} {_POST_COLUMNS}")
def write_posts(t):
    folder = shared_folder(t.spark, "posts")
    S.write_posts(fx.posts(t).drop("seq"), folder, fmt="parquet")
    df = t.spark.read.parquet(folder)
    joined = [F.array_join(c, "|").alias(c) for c in ("body", "images", "tags")]
    return df.select("urlId", "uuid", "date", "author", "title", *joined, "categories")


@query("read_pages", "SELECT page_id, url, html FROM pages")
def read_pages(t):
    return S.read_pages(t.spark, f"{t._folder}/pages.parquet")


_ITEMS = """
SELECT CASE WHEN page_id % 7 = 0 THEN 'No title' ELSE 'Page ' || page_id || ' & more' END AS title,
       CASE WHEN page_id % 4 = 0 THEN 'No date'
            ELSE strftime(DATE '2024-01-01' + CAST(page_id % 3650 AS INTEGER), '%Y-%m-%d') END AS date,
       CASE WHEN page_id % 5 = 0 THEN 'Uncategorized' ELSE 'c' || (page_id % 5) END AS category,
       CASE WHEN page_id % 8 = 0 THEN 'No summary' ELSE html END AS summary,
       CASE WHEN page_id % 6 = 0 THEN url ELSE url || '#feed' END AS link
FROM pages"""


@query("rss_items", _ITEMS)
def rss_items(t):
    return feeds.rss_items(fx.feeds(t.pages))


@query("read_rss", _ITEMS)
def read_rss(t):
    """The same feeds as files, one document in each."""
    folder = shared_folder(t.spark, "feeds")
    fx.feeds(t.pages).write.partitionBy("feed_id").text(folder)
    return feeds.read_rss(t.spark, folder).select("title", "date", "category", "summary", "link")


@query(
    "rss_union",
    f"SELECT link, title, CASE WHEN page_id % 2 = 1 THEN 'brief' END AS feed FROM "
    f"(SELECT i.*, p.page_id FROM ({_ITEMS.replace('FROM pages', ', page_id AS k FROM pages')}) i JOIN pages p ON p.page_id = i.k)",
)
def rss_union(t):
    even, odd = (fx.feeds(t.pages.where(F.col("page_id") % 2 == i)) for i in (0, 1))
    both = feeds.rss_union(
        feeds.rss_items(even), feeds.rss_items(odd.withColumn("feed", F.lit("brief")), keep=["feed"])
    )
    return both.select("link", "title", "feed")


@query("feed_list", f"SELECT link, title, date, category, summary FROM ({_ITEMS})")
def feed_list(t):
    from contentflow.operators.views import feed_list as view

    return view(feeds.rss_items(fx.feeds(t.pages)))


@query("read_release_lines", "SELECT event_id, user_id, event_type, value, props FROM events")
def read_release_lines(t):
    folder = shared_folder(t.spark, "release")
    columns = ["event_id", "user_id", "event_type", "value", "props"]
    t.events.select(columns).write.json(folder, compression="gzip")
    schema = "event_id long, user_id long, event_type string, value double, props string"
    return releases.read_release_lines(t.spark, folder, schema)


@query(
    "release_catalog",
    """
SELECT n_name AS name, 'dataset ' || n_name AS description, 'see ' || r_name AS readme,
       count(c_custkey) OVER (PARTITION BY n_name) AS n_files, 'files/' || c_name AS file
FROM nation JOIN region ON n_regionkey = r_regionkey
LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment <> 'BUILDING' AND n_nationkey <> 3""",
)
def release_catalog(t):
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    releases_ = F.explode(F.array(F.lit("2024-01-01"), F.lit("2024-02-01"))).alias("release_id")
    datasets = named.select(
        releases_, F.col("n_name").alias("name"), F.concat(F.lit("dataset "), "n_name").alias("description"),
        F.concat(F.lit("see "), "r_name").alias("readme"),
    )
    release = F.when(F.col("c_mktsegment") == "BUILDING", "2024-01-01").otherwise("2024-02-01")
    files = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).where("n_nationkey <> 3").select(
        release.alias("release_id"), F.col("n_name").alias("name"), F.concat(F.lit("files/"), "c_name").alias("file")
    )
    catalog = releases.release_catalog(datasets, files)
    return catalog.select("name", "description", "readme", "n_files", "file")


@query(
    "article_cards",
    """
SELECT CAST(o_orderkey // 25 AS BIGINT) AS page_id, '/brief/' || o_orderkey || '?a=1&b=2' AS "urlId",
       md5('/brief/' || o_orderkey || '?a=1&b=2') AS uuid,
       CASE WHEN o_orderkey % 11 = 0 THEN 'N/A' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date,
       CASE WHEN o_orderkey % 7 = 0 THEN 'N/A' WHEN o_orderkey % 5 = 0 THEN c_name || 'Jr' ELSE c_name END AS author,
       'Order ' || o_orderkey || ' &more' AS title,
       CASE WHEN o_orderkey % 13 = 0 THEN 'N/A' ELSE 'Status ' || o_orderstatus || ';' || o_orderpriority END AS excerpt,
       c_mktsegment AS categories
FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def article_cards(t):
    return P.article_cards(fx.index_pages(t), keep=["page_id"]).drop("card_idx")


@query(
    "html_blocks",
    f"""
SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, b[i] AS block
FROM (SELECT page_id, {s.blocks(s.article('html'))} AS b FROM pages), range(1, 100000) r(i)
WHERE i <= len(b)""",
)
def html_blocks(t):
    return P.html_blocks(t.pages, fx.article(), ["page_id"])


@query("html_text", f"SELECT page_id, {s.html_text('html')} AS html FROM pages")
def html_text(t):
    return P.html_text(t.pages.select("page_id", "html"), "html")


@query(
    "image_urls",
    """
SELECT page_id, CAST(0 AS INTEGER) AS pos, '/img/' || page_id || '.png' AS image FROM pages WHERE page_id % 3 = 0
UNION ALL
SELECT page_id, 1, 'https://cdn.example/' || page_id || '.jpg?a=1&b=2' FROM pages WHERE page_id % 3 = 0""",
)
def image_urls(t):
    return P.image_urls(fx.pages_with_extras(t), fx.article(), ["page_id"])


@query(
    "page_tags",
    rf"""
SELECT page_id, CASE WHEN page_id % 3 = 2 THEN {s.joined(
        "list_transform(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<a [^>]*>(.*?)</a>', 1), "
        "lambda x: " + s.html_text("x", "") + ")")} ELSE '' END AS tags
FROM pages""",
)
def page_tags(t):
    return P.page_tags(fx.pages_with_extras(t)).select("page_id", F.array_join("tags", "|").alias("tags"))


@query(
    "outbound_refs",
    """
SELECT page_id, CAST(0 AS INTEGER) AS pos, 'https://out.example/' || page_id AS reference FROM pages WHERE page_id % 3 = 1
UNION ALL SELECT page_id, 1, '#top' FROM pages WHERE page_id % 3 = 1
UNION ALL SELECT page_id, 2, 'mailto:desk@out.example' FROM pages WHERE page_id % 3 = 1""",
)
def outbound_refs(t):
    return P.outbound_refs(fx.pages_with_extras(t), fx.article(), SITE, ["page_id"])


@query(
    "text_urls",
    f"""
SELECT doc_id, {s.joined(f"regexp_extract_all(text, '{s.RE_LINK}', 1)")} AS urls,
       regexp_replace(text, '{s.RE_LINK}', '', 'g') AS cleaned FROM documents""",
)
def text_urls(t):
    return P.text_urls(t.documents, "text").select("doc_id", F.array_join("urls", "|").alias("urls"), "cleaned")


@query(
    "assemble_posts",
    rf"""
WITH fetched AS (
  SELECT page_id, url, CASE WHEN page_id % 10 = 9 THEN [] ELSE {s.blocks(s.article('html'))} END AS b FROM pages)
SELECT url AS "urlId", 'Page ' || page_id AS title,
       {s.joined(f"list_transform(b, lambda x: trim(regexp_replace(x, '{s.RE_LINK}', '', 'g'), {s.SPACES}))", "¶")} AS body,
       CASE WHEN page_id % 3 = 0 AND page_id % 10 <> 9
            THEN '/img/' || page_id || '.png|https://cdn.example/' || page_id || '.jpg?a=1&b=2' ELSE '' END AS images,
       {s.joined(
        "list_concat(CASE WHEN page_id % 3 = 1 AND page_id % 10 <> 9 THEN ['https://out.example/' || page_id, '#top', 'mailto:desk@out.example'] ELSE [] END, "
        f"flatten(list_transform(b, lambda x: regexp_extract_all(x, '{s.RE_LINK}', 1))))")} AS refs
FROM fetched""",
)
def assemble_posts(t):
    cards = t.pages.select(F.col("url").alias("urlId"), F.concat(F.lit("Page "), "page_id").alias("title"))
    fetched = fx.pages_with_extras(t).withColumn("html", F.when(F.col("page_id") % 10 != 9, F.col("html")))
    posts = P.assemble_posts(cards, P.page_content(fetched, SITE, fx.ARTICLE, "article"))
    return posts.select(
        "urlId", "title", F.array_join("body", "¶").alias("body"), F.array_join("images", "|").alias("images"),
        F.array_join("references", "|").alias("refs"),
    )
