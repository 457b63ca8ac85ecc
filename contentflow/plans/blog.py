"""The blog flow: index pages and article pages to the post store, and on to nested records.

The flow is materialised where its tables are stored anyway, the post store and the requests and
responses handed to and from the extraction model, and where several branches read one result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from contentflow.functions.records import map_string_leaves
from contentflow.functions.text import decode_unicode, drop_quotes, unescape_slashes
from contentflow.operators import extraction as X, pages as P
from contentflow.operators.changes import merge_new_first
from contentflow.operators.selection import after_high_water, crawl_until_known, has_metadata_date, unseen
from contentflow.operators.views import newest_first
from contentflow.session import stage


def refresh_store(
    index_pages: DataFrame, article_pages: DataFrame, stored: DataFrame, site: str,
    opening: str = P.CONTENT_WRAPPER, tag: str = "div",
) -> DataFrame:
    """Stored posts with the new posts of a crawl ahead of them.

    ``index_pages(page, html)`` in crawl order, ``article_pages(url, html)``.  Which posts are new is
    settled on the cards; only the articles of new posts are taken apart.  Cards and new posts are
    staged: the crawl rule reads the cards several times, and they are small beside the pages.
    """
    cards = stage(P.article_cards(index_pages, keep=["page"]), "cards")
    listed = crawl_until_known(cards, stored)
    fresh = stage(unseen(listed, stored, "urlId").drop("page", "card_idx"), "new-posts")
    wanted = article_pages.join(fresh.select(F.col("urlId").alias("url")), "url", "left_semi")
    posts = P.assemble_posts(fresh, P.page_content(P.newest_fetch(wanted), site, opening, tag))
    return merge_new_first(posts, stored, "urlId")


def open_requests(posts: DataFrame, extracted: DataFrame, key: str = "uuid", max_words: int = X.MAX_WORDS) -> DataFrame:
    """Requests for the posts that are newer than everything extracted so far.

    Undated posts pass the mark at every run, so posts that are extracted already are left out by key.
    """
    done = extracted.select(F.col("Metadata.date").alias("date"), F.col(f"Metadata.{key}").alias(key))
    new = unseen(after_high_water(posts, done), done, key)
    return X.extraction_requests(X.chunk_text(new, key, "body", max_words), key)


def nested_records(posts: DataFrame, responses: DataFrame, key: str = "uuid", keep: list[str] = ()) -> DataFrame:
    """Posts and the responses to their requests as nested records."""
    results = X.merge_chunk_results(X.parse_responses(responses), key)
    return X.nest_record(posts, results, key, keep)


def normalize_store(records: DataFrame, seq: str) -> DataFrame:
    """Nested records with escapes decoded and quotes dropped, newest first (``rank``).

    Records without a date are left out; a date that cannot be read sorts last.  The order needs the date and ``seq`` only,
    so the date is decoded as a column of its own: what counts and cuts the order reads nothing else.
    """

    def decoded(c: Column) -> Column:
        # Every escape begins with a backslash; most strings have none.
        return F.when(c.contains("\\"), decode_unicode(unescape_slashes(c, only_urls=True))).otherwise(c)

    dated = has_metadata_date(records).withColumn("_date", decoded(F.col("Metadata.date")))
    plain = map_string_leaves(dated, decoded, skip=(seq, "_date"))
    body = drop_quotes(F.col("Content.body"))
    quoted = plain.withColumn("Content", F.col("Content").withField("body", body))
    return newest_first(quoted, "_date", seq).drop("_date")
