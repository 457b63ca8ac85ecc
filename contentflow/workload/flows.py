"""Whole flows on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentflow.functions.text import PUNCTUATION
from contentflow.plans import blog, cleaner
from contentflow.session import stage
from contentflow.workload import analytics as wa, extraction as we, fixtures as fx, pages as wp, sqltext as s
from contentflow.workload.cleaning import _LEX, _chain, _lemmas, _plain
from contentflow.workload.registry import query


_TAGS = s.joined(
    "list_transform(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<a [^>]*>(.*?)</a>', 1), lambda x: "
    + s.html_text("x", "") + ")"
)


@query(
    "refresh_store",
    rf"""
WITH cut AS (SELECT 0.7 * max(page_id) AS lim FROM pages), stop AS (SELECT min(page_id // 25) AS p FROM pages, cut WHERE page_id > lim),
fetched AS (SELECT page_id, url, html, {s.blocks(s.article('html'))} AS b FROM pages, stop WHERE page_id // 25 < p)
SELECT url AS "urlId", 'Page ' || page_id AS title, CAST(0 AS INTEGER) AS batch,
       {s.joined(f"list_transform(b, lambda x: trim(regexp_replace(x, '{s.RE_LINK}', '', 'g'), {s.SPACES}))")} AS body,
       CASE WHEN page_id % 3 = 0 THEN '/img/' || page_id || '.png|https://cdn.example/' || page_id || '.jpg?a=1&b=2' ELSE '' END AS images,
       '2024-02-0' || (1 + page_id % 9) AS date, 'by ' || page_id AS author, md5(url) AS uuid,
       CASE WHEN page_id % 3 = 2 THEN {_TAGS} ELSE '' END AS tags,
       {s.joined("list_concat(CASE WHEN page_id % 3 = 1 THEN ['https://out.example/' || page_id, '#top', 'mailto:desk@out.example'] ELSE [] END, "
                 f"flatten(list_transform(b, lambda x: regexp_extract_all(x, '{s.RE_LINK}', 1))))")} AS refs
FROM fetched UNION ALL
SELECT url, 'Page ' || page_id, 1, 'old', '', NULL, 'of old', NULL, NULL, NULL FROM pages, cut WHERE page_id > lim""",
)
def refresh_store(t):
    p = F.col("page_id")
    card = F.concat(
        F.lit('<article class="blog-basic-grid--container"><a href="'), F.replace("url", F.lit("&"), F.lit("&amp;")),
        F.lit('">x</a><time>2/'), p % 9 + 1, F.lit('/24</time><span class="blog-author">by '), p,
        F.lit('</span><h1 class="blog-title">Page '), p, F.lit("</h1></article>"),
    )
    listed = t.pages.select(F.floor(p / 25).alias("page"), F.struct(p.alias("p"), card.alias("card")).alias("c"))
    # Groups of at most 25: the page id is unique.
    index = listed.groupBy("page").agg(F.array_sort(F.collect_list("c")).alias("c")).select(
        "page", F.array_join(F.transform("c", lambda x: x["card"]), "").alias("html")
    )
    last = t.pages.agg((F.max("page_id") * 0.7).alias("m")).scalar()
    none = F.array().cast("array<string>")
    stored = t.pages.where(p > last).select(
        F.col("url").alias("urlId"), F.concat(F.lit("Page "), p).alias("title"), F.array(F.lit("old")).alias("body"), none.alias("images"),
        F.lit("of old").alias("author"),
    )
    store = blog.refresh_store(index, fx.pages_with_extras(t), stored, wp.SITE, fx.ARTICLE, "article")
    joined = [F.array_join(c, "|").alias(c) for c in ("body", "images", "tags")]
    return store.select("urlId", "uuid", "title", "date", "author", "batch", *joined, F.array_join("references", "|").alias("refs"))


_PENDING = f"""{s.POSTS}, {s.chunks(we.LIMIT)}, told AS (SELECT seq, uuid, CASE WHEN seq % 7 = 0 THEN 'N/A' ELSE date END AS date FROM posts
), done AS (SELECT * FROM told WHERE date < '2024-09-01' AND seq % 3 <> 0 OR seq % 14 = 0
), asked AS (SELECT uuid, seq FROM told WHERE (date = 'N/A' OR date > (SELECT max(date) FROM done WHERE date <> 'N/A')) AND uuid NOT IN (SELECT uuid FROM done))"""


@query(
    "open_requests",
    f"""WITH RECURSIVE {_PENDING}
SELECT uuid, chunk_idx, {s.quoted(we._REQUEST[0])} || chunk || {s.quoted(we._REQUEST[1])} AS request FROM asked JOIN chunks ON doc_id = seq""",
)
def open_requests(t):
    """Posts past the mark, and undated ones that have no record yet."""
    posts = fx.posts(t).withColumn("date", F.when(F.col("seq") % 7 == 0, F.lit("N/A")).otherwise(F.col("date")))
    done = posts.where("date < '2024-09-01' AND seq % 3 <> 0 OR seq % 14 = 0").select(F.struct("uuid", "date").alias("Metadata"))
    return blog.open_requests(posts, done, max_words=we.LIMIT)


@query(
    "normalize_store",
    f"""WITH RECURSIVE {we._NESTED}
SELECT seq, row_number() OVER (ORDER BY date DESC, seq) AS rank, "urlId", replace(title, 'e', 'é') AS title,
       {s.joined('''list_transform(body, lambda x: replace(x, '"', ''))''')} AS body, image AS images,
       {s.joined('key_findings')} AS key_findings FROM nested WHERE seq % 4 <> 0""",
)
def normalize_store(t):
    nested = stage(we._nested(t, keep=["seq"]), "records")
    dated = F.when(F.col("seq") % 4 != 0, F.col("Metadata.date"))
    escaped = F.replace("Metadata.title", F.lit("e"), F.lit("\\u00e9"))
    link = F.lit("https:\\/\\/img\\/")
    nested = nested.withColumn(
        "Metadata", F.col("Metadata").withField("date", dated).withField("title", escaped)
    ).withColumn("Content", F.col("Content").withField("images", F.array(F.concat(link, "seq"))))
    return blog.normalize_store(nested, "seq").select(
        "seq", "rank", "Metadata.urlId", "Metadata.title", F.array_join("Content.body", "|").alias("body"),
        F.array_join("Content.images", "|").alias("images"), F.array_join("Research.key_findings", "|").alias("key_findings"),
    )


# Every sixth post has its id in the other column; posts of one source share their URL.
_FRESH = f"""{s.POSTS}, {_LEX}, fresh AS (
  SELECT * FROM posts WHERE seq NOT IN (SELECT doc_id FROM labels)
  QUALIFY row_number() OVER (PARTITION BY categories, title ORDER BY seq) = 1
), chained AS (
  SELECT seq, CASE WHEN seq % 6 = 0 THEN '' ELSE uuid END AS uuid, date, {s.clean('author')} AS author, {_chain('title')} AS title,
         {_chain(s.unescape("array_to_string(body, ' ')"))} AS body, {_chain('tags[1]')} AS lang, {_chain('tags[2]')} AS source FROM fresh
), polished AS (
  SELECT seq, uuid, date, author, {_lemmas('title')} AS title, {_lemmas('body')} AS body, [{_lemmas('lang')}, {_lemmas('source')}] AS tags FROM chained)"""


def _raw(t):
    sixth = F.col("seq") % 6 == 0
    posts = fx.posts(t).withColumn("urlId", F.col("categories"))
    return posts.withColumn("unique_id", F.when(sixth, F.col("uuid"))).withColumn("uuid", F.when(~sixth, F.col("uuid")))


def _cleaned(t):
    return t.labels.select(F.md5(F.concat(F.lit("/p/"), "doc_id")).alias("unique_id"), F.lit("old").alias("title"))


@query(
    "polish_store",
    f"""WITH RECURSIVE {_FRESH}, {wa._ranked('SELECT seq AS id, body AS text FROM polished', 10)}, {wa._LISTS}, {wa._GAZ.replace('FROM documents', 'FROM (SELECT seq AS doc_id, body AS text FROM polished)')}
SELECT seq, uuid, date, author, title, body, array_to_string(tags, '|') AS tags, array_to_string(kw[1:5], ' ') AS summary,
       array_to_string(list_filter(list_concat(tags, kw), lambda k: trim(k) <> '' AND instr({s.quoted(PUNCTUATION)}, k) = 0), '|') AS keywords,
       coalesce((SELECT string_agg(word || '/' || entity_group, ' ' ORDER BY pos) FROM found WHERE doc_id = seq), '') AS entities
FROM polished JOIN lists ON id = seq""",
)
def polish_store(t):
    done = cleaner.polish_store(_raw(t), _cleaned(t), fx.gazetteer(t), fx.lexicon(_plain(t), "text"))
    pairs = F.transform("entities", lambda e: F.concat(e["word"], F.lit("/"), e["entity_group"]))
    joined = [F.array_join(c, "|").alias(c) for c in ("tags", "keywords")]
    return done.select("seq", "uuid", "date", "author", "title", "body", *joined, "summary", F.array_join(pairs, " ").alias("entities"))


@query(
    "refresh_cleaned",
    f"""WITH {_FRESH} SELECT title, CASE WHEN seq % 6 = 0 THEN md5('/p/' || seq) ELSE uuid END AS id, CAST(0 AS INTEGER) AS batch FROM polished
UNION ALL SELECT 'old', md5('/p/' || doc_id), 1 FROM labels""",
)
def refresh_cleaned(t):
    store, _ = cleaner.refresh_cleaned(_raw(t), _cleaned(t), fx.gazetteer(t), fx.lexicon(_plain(t), "text"))
    return store.select("title", F.coalesce(F.nullif("uuid", F.lit("")), "unique_id").alias("id"), "batch")
