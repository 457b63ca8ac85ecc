"""Page jobs: crawled pages to cards, blocks, links and whole posts.

Everything is computed inside the row, so these jobs never shuffle; only ``assemble_posts`` joins
the cards with their pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from contentflow.functions import markup, text
from contentflow.functions.binding import let
from contentflow.functions.dates import MISSING, parse_us_date
from contentflow.functions.text import post_id

# Class names of the crawled site.
CARD_CLASS = "blog-basic-grid--container"
CONTENT_WRAPPER = markup.open_tag("div", css_class="blog-item-content-wrapper")


def article_cards(pages: DataFrame, html: str = "html", keep: list[str] = ()) -> DataFrame:
    """One row per article card of an index page; missing parts read 'N/A'.

    The page is taken apart once; cards, and the parts of a card, are elements cut by depth, so they may hold elements
    of their own kind.
    """
    cut = let(markup.outline(F.col(html)), lambda o: markup.elements(o, "article", CARD_CLASS))
    cards = pages.select(*keep, F.posexplode(cut).alias("card_idx", "_card"))
    c = F.col("_card")

    def part(tag: str, css_class: str | None = None) -> Column:
        return markup.marked_text(markup.first_element(c, tag, css_class))

    link = F.filter(c, lambda e: (e["name"] == "a") & (e["change"] >= 0) & markup.has_attr(e["tag"], "href"))
    raw = {
        "urlId": markup.raw_attr(F.get(link, F.lit(0))["tag"], "href"),
        "date": part("time"),
        "author": part("span", "blog-author"),
        "title": part("h1", "blog-title"),
        "excerpt": part("div", "blog-excerpt-wrapper"),
        "categories": part("a", "blog-categories"),
    }
    # All parts of a card are decoded in one pass, as a column of its own.
    decoded = cards.select(
        *keep, "card_idx", F.transform(F.array(*raw.values()), markup.unescape_html).alias("_parts")
    )
    at = {name: F.get("_parts", F.lit(i)) for i, name in enumerate(raw)}

    def text_of(name: str) -> Column:
        return F.coalesce(markup.join_nodes(at[name], ""), F.lit(MISSING)).alias(name)

    time = F.replace(at["date"], F.lit(markup.MARK), F.lit(""))
    return decoded.select(
        *keep,
        "card_idx",
        at["urlId"].alias("urlId"),
        post_id(at["urlId"]).alias("uuid"),
        parse_us_date(time).alias("date"),
        text_of("author"),
        text_of("title"),
        text_of("excerpt"),
        text_of("categories"),
    )


def content_of(html: Column, opening: str = CONTENT_WRAPPER, tag: str = "div") -> Column:
    """Markup inside the content wrapper; NULL when the page has none."""
    return markup.wrapper_inner(markup.mark_invisible(html), opening, tag)


def html_blocks(pages: DataFrame, content: Column, keep: list[str]) -> DataFrame:
    """One row per text block of the content: position and text."""
    return pages.select(*keep, F.posexplode(markup.text_blocks(content)).alias("pos", "block"))


def html_text(df: DataFrame, column: str) -> DataFrame:
    """Replace markup by its plain text."""
    return df.withColumn(column, markup.html_text(F.col(column)))


def image_urls(pages: DataFrame, content: Column, keep: list[str]) -> DataFrame:
    """One row per image of the content."""
    return pages.select(*keep, F.posexplode(markup.image_sources(content)).alias("pos", "image"))


def page_tags(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add the ``tags`` list of each page; no tag box gives an empty list."""
    return pages.withColumn("tags", markup.tag_labels(F.col(html)))


def outbound_refs(pages: DataFrame, content: Column, site: str, keep: list[str]) -> DataFrame:
    """One row per link that leaves the site."""
    links = markup.outbound_links(content, site)
    return pages.select(*keep, F.posexplode(links).alias("pos", "reference"))


def text_urls(df: DataFrame, column: str) -> DataFrame:
    """Add the links found in the text as ``urls``, and the text without them as ``cleaned``."""
    c = F.col(column)
    return df.withColumn("urls", text.text_urls(c)).withColumn("cleaned", text.without_urls(c))


def newest_fetch(pages: DataFrame, url: str = "url", html: str = "html", order: str | None = None) -> DataFrame:
    """One row per URL: the last non-empty fetch by ``order``, without it the one with the most markup.

    A ``row_number() = 1`` filter, pruned in every task before the shuffle.
    """
    empty = F.coalesce(F.length(html), F.lit(0)) == 0
    last = [F.desc_nulls_last(order)] if order else []
    w = W.partitionBy(url).orderBy(empty, *last, F.desc(F.length(html)), html)
    return pages.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def page_content(pages: DataFrame, site: str, opening: str = CONTENT_WRAPPER, tag: str = "div") -> DataFrame:
    """The four list fields of a post for each page ``(url, html)``.

    Links written out in the text move from the body to the references.
    """
    empty = F.array().cast("array<string>")
    cut = pages.select("url", "html", content_of(F.col("html"), opening, tag).alias("_content"))
    blocks = cut.select(
        "url",
        F.coalesce(markup.text_blocks(F.col("_content")), empty).alias("_blocks"),
        F.coalesce(markup.image_sources(F.col("_content")), empty).alias("images"),
        markup.tag_labels(F.col("html")).alias("tags"),
        F.coalesce(markup.outbound_links(F.col("_content"), site), empty).alias("_anchors"),
    )
    found = F.flatten(F.transform("_blocks", text.text_urls))
    # Paragraphs are plain text by now; only their white space needs care.
    body = F.transform("_blocks", lambda b: text.strip(text.without_urls(b)))
    return blocks.select(
        "url", body.alias("body"), "images", "tags", F.concat("_anchors", found).alias("references")
    )


def assemble_posts(cards: DataFrame, content: DataFrame) -> DataFrame:
    """One post per card: cards joined with the content of their page by URL.

    A page that could not be fetched leaves empty lists; of a URL with several contents the longest counts.
    """
    lists = ["body", "images", "tags", "references"]
    empty = F.array().cast("array<string>")
    longest = W.partitionBy("url").orderBy(F.desc(F.size("body")), F.desc(F.length(F.array_join("body", ""))), F.to_json(F.struct(*lists)))
    once = content.withColumn("_n", F.row_number().over(longest)).where("_n = 1").drop("_n")
    joined = cards.join(once.withColumnRenamed("url", "urlId"), "urlId", "left")
    return joined.select(
        *cards.columns, *[F.coalesce(F.col(c), empty).alias(c) for c in lists]
    )
