"""Which rows are new: anti-filters, crawl cut-off, high-water mark, duplicates.

Existing keys are matched by plain equi-joins: Spark broadcasts the smaller side when its measured
size is below the session's threshold, otherwise it shuffles and AQE splits skewed partitions.
"First wins" rules are ``row_number() = 1`` filters, which Spark prunes to one row per key in every
map task before the shuffle, so a group of copies never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from contentflow.functions.dates import iso_date
from contentflow.functions.text import keep_keywords
from contentflow.session import stage


def unseen(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """New rows whose key is not stored. A missing key counts as a key like any other."""
    stored = existing.select(F.col(key).alias("_stored"))
    return new.join(stored, F.col(key).eqNullSafe(F.col("_stored")), "left_anti")


def new_by_any_id(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Anti-filter on ``uuid`` or, where that is missing, ``unique_id``, on both sides."""

    def any_id(df: DataFrame) -> Column:
        return F.coalesce(*[F.col(c) for c in ("uuid", "unique_id") if c in df.columns])

    known = existing.select(any_id(existing).alias("_id"))
    return unseen(new.withColumn("_id", any_id(new)), known, "_id").drop("_id")


def first_page_only(posts: DataFrame, page: str = "page", url: str = "urlId") -> DataFrame:
    """Keep a URL only on the first page that shows it; repeats on that page stay."""
    first = posts.groupBy(F.col(url).alias("_url")).agg(F.min(page).alias("_page"))
    same = F.col(url).eqNullSafe(F.col("_url")) & (F.col(page) == F.col("_page"))
    return posts.join(first, same, "left_semi")


def crawl_until_known(
    posts: DataFrame, known_titles: DataFrame, page: str = "page", url: str = "urlId", title: str = "title"
) -> DataFrame:
    """Pages in order until nothing new turns up.

    The first page always counts.  The crawl stops before the first later page that shows no new
    URL, or on which one of the new posts has a stored title; a missing page number ends it too.

    ``posts`` is read twice.  The first pass leaves one row per URL, with the first page that shows it and whether its title is
    known there, and from that one row per page; both are staged.  The pages decide where the longest unbroken
    run ends, which is one number, and the second pass takes the rows before it.
    """
    known = known_titles.select(F.col(title).alias("_known")).distinct()
    told = posts.select(page, url, title).join(known, F.col(title) == F.col("_known"), "left")
    # Per page first: the partial aggregate of a URL that very many rows repeat is one row in every task.
    shown = told.groupBy(F.col(url).alias("_url"), F.col(page).alias("_page")).agg(F.max(F.col("_known").isNotNull()).alias("known"))
    firsts = stage(shown.groupBy("_url").agg(F.min(F.struct("_page", "known")).alias("f")).select("_url", "f.*"), "first-pages")
    pages = stage(firsts.groupBy("_page").agg(F.max("known").alias("blocked")), "crawl-pages")
    begin = pages.agg(F.min("_page")).scalar()
    taken = pages.where(~F.col("blocked") | (F.col("_page") == begin)).select("_page")
    # The page after each page that may be taken; the smallest that may not ends the crawl.
    stop = taken.select((F.col("_page") + 1).alias("_page")).join(taken, "_page", "left_anti").agg(F.min("_page")).scalar()
    wanted = firsts.where(F.col("_page") < stop)
    return posts.join(wanted, F.col(url).eqNullSafe(F.col("_url")) & (F.col(page) == F.col("_page")), "left_semi")


def after_high_water(new: DataFrame, existing: DataFrame, date: str = "date") -> DataFrame:
    """Rows newer than the newest stored date (strictly); undated rows pass, an empty store lets
    everything pass.  Undated stored rows do not count for the mark."""

    def as_date(df: DataFrame) -> Column:
        is_text = dict(df.dtypes)[date] == "string"
        return iso_date(F.col(date)) if is_text else F.col(date)

    mark = existing.agg(F.max(as_date(existing)).alias("mark")).scalar()
    return new.where(F.coalesce(as_date(new) > mark, F.lit(True)))


def has_metadata_date(df: DataFrame) -> DataFrame:
    """Records whose ``Metadata.date`` exists."""
    return df.where(F.col("Metadata.date").isNotNull())


def dedupe_posts(df: DataFrame, keys: list[str] = ("urlId", "title"), seq: str = "seq") -> DataFrame:
    """Of rows equal on ``keys`` the first in input order stays."""
    order = W.partitionBy(*keys).orderBy(seq)
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def keyword_filter(df: DataFrame, column: str = "keywords") -> DataFrame:
    """Drop blank keywords and those that are part of the punctuation string."""
    return df.withColumn(column, keep_keywords(F.col(column)))
