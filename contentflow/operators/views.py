"""Sorted results and the projections shown to readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from contentflow.functions.dates import iso_date
from contentflow.operators.ordering import with_rank


def newest_first(df: DataFrame, date: str = "date", seq: str = "seq") -> DataFrame:
    """Global ``rank`` by date descending, ties in input order, undated rows last."""
    is_text = dict(df.dtypes)[date] == "string"
    day = iso_date(F.col(date)) if is_text else F.col(date).cast("date")
    return with_rank(df, day, True, seq)


def preview(df: DataFrame, *order: str | Column, n: int = 5) -> DataFrame:
    """The first rows of a result under a total order."""
    return df.orderBy(*order).limit(n)


def post_cards(df: DataFrame) -> DataFrame:
    """Card view of nested records: uuid, first image, title, tldr."""
    return df.select(
        F.col("Metadata.uuid").alias("uuid"),
        F.try_element_at("Content.images", F.lit(1)).alias("image"),
        F.col("Metadata.title").alias("title"),
        F.array_join("Metadata.tldr", " ").alias("tldr"),
    )


def post_detail(df: DataFrame) -> DataFrame:
    """Detail view: title and the key findings, one per line."""
    return df.select(
        F.col("Metadata.uuid").alias("uuid"),
        F.col("Metadata.title").alias("title"),
        F.array_join("Research.key_findings", "\n").alias("key_findings"),
    )


def feed_list(items: DataFrame) -> DataFrame:
    """Feed view: link, title, date, category, summary."""
    return items.select("link", "title", "date", "category", "summary")
