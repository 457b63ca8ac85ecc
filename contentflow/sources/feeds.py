"""RSS and RDF feeds as item rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contentflow.functions.text import strip

# What a missing element reads as.
ITEM_DEFAULTS = {
    "title": "No title",
    "date": "No date",
    "category": "Uncategorized",
    "summary": "No summary",
    "link": "#",
}
_ITEM = "title string, `dc:date` string, category array<string>, description string, link string, `_rdf:about` string"


def _items(item: Column) -> list[Column]:
    parts = {
        "title": item["title"],
        "date": item["dc:date"],
        "category": F.try_element_at(item["category"], F.lit(1)),
        "summary": item["description"],
        # RDF feeds name the article in the item's own attribute.
        "link": F.coalesce(strip(item["link"]), item["_rdf:about"]),
    }
    return [F.coalesce(c, F.lit(ITEM_DEFAULTS[k])).alias(k) for k, c in parts.items()]


def rss_items(feeds: DataFrame, xml: str = "xml", keep: list[str] = ()) -> DataFrame:
    """One row per ``<item>`` of each feed document in column ``xml``.

    Items sit below ``channel`` in RSS and beside it in RDF, so they are cut out first and parsed
    one by one; a broken item does not take its feed along.
    """
    found = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<item[\s>].*?</item>"), F.lit(0))
    parsed = feeds.select(*keep, F.explode(found).alias("_item")).withColumn(
        "_item", F.from_xml("_item", _ITEM, {"mode": "PERMISSIVE"})
    )
    return parsed.select(*keep, *_items(F.col("_item")))


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Feed files as item rows."""
    raw = spark.read.format("xml").option("rowTag", "item").schema(_ITEM).load(path)
    return raw.select(*_items(F.struct(*[F.col(f"`{c}`") for c in raw.columns])))


def rss_union(*feeds: DataFrame) -> DataFrame:
    """Items of several feeds as one table; columns a feed lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)
