"""Inputs of the registered queries, derived by Spark from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from contentflow.functions import markup
from contentflow.functions.text import split_words
from contentflow.operators.pages import content_of
from contentflow.schemas import RESULT_KEYS
from contentflow.session import shared_folder, stage
from contentflow.workload.registry import Tables

ARTICLE = markup.open_tag("article")


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x != "")


def article(html: str = "html") -> Column:
    """The test pages keep their content in an ``article`` element."""
    return content_of(F.col(html), ARTICLE, "article")


def posts(t: Tables) -> DataFrame:
    """Documents as flat posts; ``seq`` is the input order."""
    url = F.concat(F.lit("/p/"), F.col("doc_id"))
    body = lines(F.col("text"))
    none = F.array().cast("array<string>")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 3650).cast("int"))
    return t.documents.select(
        F.col("doc_id").alias("seq"),
        url.alias("urlId"),
        F.md5(url).alias("uuid"),
        F.date_format(day, "yyyy-MM-dd").alias("date"),
        F.concat(F.lit("  "), F.col("source"), F.lit("\ndesk ")).alias("author"),
        F.try_element_at(body, F.lit(1)).alias("title"),
        F.try_element_at(body, F.lit(-1)).alias("excerpt"),
        body.alias("body"),
        none.alias("images"),
        F.array("lang", "source").alias("tags"),
        none.alias("references"),
        F.col("source").alias("categories"),
    )


def index_pages(t: Tables) -> DataFrame:
    """Index pages of up to 25 cards, one card per order.

    Every 7th card lacks its author, every 13th its excerpt, every 11th has no valid date.  Parts hold elements of their own
    kind, and attributes hold ``>``.
    """
    k = F.col("o_orderkey")
    date = F.when(k % 11 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "M/d/yy"))
    author = F.when(k % 7 != 0, F.concat(F.lit('<span class="by blog-author"> <span>'), "c_name", F.lit(" </span>"),
        F.when(k % 5 == 0, F.lit("<span><span>J</span>r</span>")).otherwise(F.lit("")), F.lit(" </span>")))
    excerpt = F.when(
        k % 13 != 0,
        F.concat(
            F.lit('<div class="blog-excerpt-wrapper"><div>Status '), "o_orderstatus",
            F.lit("; </div><div>"), "o_orderpriority", F.lit("</div></div>"),
        ),
    )
    card = F.concat(
        F.lit('<article data-q="<article>" class="hentry blog-basic-grid--container"><div><a name="c">.</a><a class="img" title="more > less" href="/brief/'),
        k, F.lit('?a=1&amp;b=2"><b></b></a><time class="blog-date">'), date, F.lit("</time>"),
        F.coalesce(author, F.lit("")), F.lit('<h1 data-x="1>0" class="blog-title"><a href="/x">Order '), k,
        F.lit(" &amp; <em>more</em></a></h1>"), F.coalesce(excerpt, F.lit("")),
        F.lit('<a href="/c" class="blog-categories">'), "c_mktsegment", F.lit("</a></div></article>"),
    )
    cards = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.floor(k / 25).alias("page_id"), k.alias("k"), card.alias("card")
    )
    # Groups of at most 25: the order key is unique.
    grouped = cards.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("k", "card"))).alias("c"))
    html = F.concat(
        F.lit("<html><body><!-- <article class='blog-basic-grid--container'></article> -->"),
        F.array_join(F.transform("c", lambda x: x["card"]), "\n"), F.lit("</body></html>"),
    )
    return grouped.select("page_id", html.alias("html"))


def pages_with_extras(t: Tables) -> DataFrame:
    """Pages with images, absolute links and a tag box put in, by ``page_id``."""
    p = F.col("page_id").cast("string")
    images = F.concat(
        F.lit('<article><img alt="see src=foo > bar" src="/img/'), p, F.lit('.png"><img src=""><IMG SRC=\'https://cdn.example/'),
        p, F.lit(".jpg?a=1&amp;b=2'/>"),
    )
    links = F.concat(
        F.lit('<article><a title="a > b href=x" href="https://out.example/'), p,
        F.lit('">o</a><a href="https://site.example/in">i</a><a class=z href=#top>t</a>'
              '<a href="mailto:desk@out.example">m</a><a href="/local">l</a><a name="n">n</a>'),
    )
    html = F.col("html")
    with_images = F.replace(html, F.lit("<article>"), images)
    with_links = F.replace(html, F.lit("<article>"), links)
    boxed = F.replace(
        F.replace(html, F.lit("<nav>"), F.lit('<div class="blog-meta-item blog-meta-item--tags"><div>-</div>')),
        F.lit("</nav>"), F.lit("</div>"),
    )
    boxed = F.replace(boxed, F.lit("<li><a href="), F.lit('<li><a data-n="a>b" class="t blog-item-tag" href='))
    third = F.col("page_id") % 3
    return t.pages.select(
        "page_id", "url",
        F.when(third == 0, with_images).when(third == 1, with_links).otherwise(boxed).alias("html"),
    )


def _xml(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(F.replace(c, F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def feeds(pages: DataFrame) -> DataFrame:
    """Feed documents of up to 10 items, one item per page, some elements left out."""
    p = F.col("page_id")

    def element(name: str, value: Column, missing: int) -> Column:
        x = F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
        return F.when(p % missing != 0, x).otherwise(F.lit(""))

    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (p % 3650).cast("int")), "yyyy-MM-dd")
    item = F.concat(
        F.lit('<item rdf:about="'), _xml(F.col("url")), F.lit('">'),
        element("title", F.concat(F.lit("Page "), p, F.lit(" &amp; more")), 7),
        element("dc:date", day, 4),
        element("category", F.concat(F.lit("c"), p % 5), 5),
        element("description", _xml(F.col("html")), 8),
        element("link", F.concat(F.lit("\n "), _xml(F.col("url")), F.lit("#feed\n")), 6),
        F.lit("</item>"),
    )
    rows = pages.select(F.floor(p / 10).alias("feed_id"), p.alias("p"), item.alias("item"))
    # Groups of at most 10: the page id is unique.
    grouped = rows.groupBy("feed_id").agg(F.array_sort(F.collect_list(F.struct("p", "item"))).alias("i"))
    xml = F.concat(
        F.lit('<rdf:RDF xmlns:rdf="r" xmlns:dc="d"><channel><title>feed</title></channel>'),
        F.array_join(F.transform("i", lambda x: x["item"]), ""), F.lit("</rdf:RDF>"),
    )
    return grouped.select("feed_id", xml.alias("xml"))


def lexicon(texts: DataFrame, column: str) -> DataFrame:
    """Words ending in s whose form without it occurs as well."""
    # Written once, as it is read twice.
    words = stage(texts.select(F.explode(F.array_distinct(split_words(F.col(column)))).alias("word")).distinct(), "lexicon-words", True)
    plural = words.where(F.col("word").endswith("s")).select(
        "word", F.expr("substr(word, 1, length(word) - 1)").alias("lemma")
    )
    return plural.join(words.select(F.col("word").alias("lemma")), "lemma", "left_semi").where("lemma <> ''")


def gazetteer(t: Tables) -> DataFrame:
    """Distinct words of the benchmark items and some of their runs of two and three words, with a group by length."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)).alias("ws")
    runs = F.explode(F.expr("flatten(transform(ws, (w, i) -> transform(sequence(1, 3), n -> slice(ws, i + 1, n))))")).alias("r")
    runs = t.benchmark.select(words).select(runs).select(F.array_join("r", " ").alias("term"), F.size("r").alias("n"))
    some = "n = 1 AND length(term) >= 5 OR n = 2 AND length(term) % 4 = 0 OR n = 3 AND length(term) % 5 = 0"
    terms = runs.where(some).select("term").distinct()
    group = F.when(F.length("term") % 3 == 0, "ORG").when(F.length("term") % 3 == 1, "PER").otherwise("LOC")
    return terms.select("term", group.alias("entity_group"))


def responses(rows: DataFrame, keys: list[str], n: Column, text: Column) -> DataFrame:
    """A JSON answer per row: the words of the text dealt out over the 20 keys.

    Every 9th answer is cut off, every 13th has one string in place of its first list.
    """
    words = F.split(text, " ")
    rows = rows.select(*keys, n.alias("_n"), words.alias("_words"))

    def deal(j: int) -> Column:
        # Every 20th word by its place: no list looks at the words of the others.
        places = F.sequence(F.lit(j), F.size("_words") - 1, F.lit(20))
        dealt = F.when(F.size("_words") > j, F.transform(places, lambda i: F.get("_words", i))).otherwise(F.array().cast("array<string>"))
        return F.when(F.col("_words").isNotNull(), dealt)

    first = RESULT_KEYS[0]
    lists = F.struct(*[deal(j).alias(k) for j, k in enumerate(RESULT_KEYS)], F.lit("x").alias("unknown_key"))
    rows = rows.select(*keys, "_n", lists.alias("_lists"))
    single = F.struct(
        F.array_join(F.col("_lists")[first], " ").alias(first),
        *[F.col("_lists")[k].alias(k) for k in RESULT_KEYS[1:]],
    )
    n, whole = F.col("_n"), F.to_json("_lists")
    answer = (
        F.when(n % 9 == 0, F.lit('{"summary": ["cut'))
        .when(n % 13 == 0, F.to_json(single))
        .when(n % 5 == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
        .otherwise(whole)
    )
    return rows.select(*keys, answer.alias("response"))


def changes(t: Tables) -> DataFrame:
    """Events as a change feed on users: errors delete, everything else upserts."""
    return t.events.select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"),
        F.col("user_id").alias("key"),
        F.concat_ws(":", "event_type", "props").alias("payload"),
    )


def diff_files(t: Tables) -> DataFrame:
    """The change feed as JSON-lines files of four diffs, and the list of these files.

    A diff's files come in the order of the events; every fourth event is in the same diff.
    """
    root = shared_folder(t.spark, "diffs")
    lines = changes(t).select((F.col("seq") % 4).cast("int").alias("diff_idx"), "op", "key", "payload", "seq")
    placed = lines.repartitionByRange(5, "seq").sortWithinPartitions("diff_idx", "op", "seq")
    placed.drop("seq").write.partitionBy("diff_idx", "op").json(root)
    named = t.spark.read.text(root).select("diff_idx", "op", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"))
    order = W.partitionBy("diff_idx", "op").orderBy("name")
    return named.distinct().select("diff_idx", "op", (F.row_number().over(order) - 1).alias("file_idx"), "path")


def change_target(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("payload"))


def slices(df: DataFrame, seq: str, n: int) -> list[DataFrame]:
    """The table cut into ``n`` consecutive ranges of ``seq`` of equal width."""
    ends = df.agg(F.min(seq).alias("lo"), ((F.max(seq) - F.min(seq) + 1) / n).alias("w")).first()
    cut = F.floor((F.col(seq) - ends["lo"]) / ends["w"])
    return [df.where(cut == i) for i in range(n)]
