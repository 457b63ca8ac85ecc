"""Queries on a catalog of papers, authors, citation edges and vectors.

``fields`` lists name the wanted columns, nested ones with dots; Catalyst prunes the scan to them.
Lookups by id filter on a literal, which reaches the Parquet scan.  Without an id the same query
answers for all papers or authors at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from contentflow.functions.text import candidate_words

TERM = r"[\p{L}\p{N}_]+"


def _fields(names: list[str] | None, default: DataFrame) -> list[Column]:
    return [F.col(n).alias(n.replace(".", "_")) for n in (names or default.columns)]


def details(table: DataFrame, key: str, wanted, fields: list[str] | None = None) -> DataFrame:
    """One paper or author by id."""
    return table.where(F.col(key) == F.lit(wanted)).select(*_fields(fields, table))


def batch_details(
    requests: DataFrame, table: DataFrame, key: str, fields: list[str], pos: str = "pos"
) -> DataFrame:
    """Many ids at once: ``requests(pos, key)`` keep their order and count; an unknown id gives a
    row of NULLs."""
    found = table.select(F.col(key).alias("_id"), *_fields([f for f in fields if f != key], table))
    return requests.join(found, F.col(key) == F.col("_id"), "left").drop("_id").select(
        pos, key, *[f.replace(".", "_") for f in fields if f != key]
    )


def search(
    table: DataFrame, key: str, text: str, query: str, offset: int = 0, limit: int = 100,
    fields: list[str] | None = None,
) -> DataFrame:
    """Keyword search with paging; the score counts occurrences of query terms, ties by id.

    Query and text are cut into terms alike: runs of letters, digits and underscores of any length.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    asked = F.regexp_extract_all(F.lower(F.lit(query)), F.lit(TERM), F.lit(0))
    score = F.size(F.filter(words, lambda w: F.array_contains(asked, w)))
    hits = table.withColumn("score", score).where("score > 0")
    page = hits.orderBy(F.desc("score"), key).offset(offset).limit(limit)
    return page.select(*_fields(fields or [key], table), "score")


def title_match(table: DataFrame, key: str, title: str, query: str, fields: list[str] | None = None) -> DataFrame:
    """The title closest to the query by token Jaccard, ties by id, with the wanted ``fields``."""
    asked = F.array_distinct(candidate_words(F.lit(query)))
    have = candidate_words(F.col(title))
    shared = F.size(F.array_intersect(have, asked))
    similarity = F.round(shared / F.size(F.array_union(have, asked)), 6)
    scored = table.select(*_fields(fields or [key, title], table), similarity.alias("similarity")).where("similarity > 0")
    return scored.orderBy(F.desc("similarity"), key).limit(1)


def autocomplete(table: DataFrame, key: str, title: str, prefix: str, limit: int = 10) -> DataFrame:
    """Titles that start with the prefix; the test is pushed to the scan."""
    return table.where(F.col(title).startswith(prefix)).select(key, title).orderBy(title, key).limit(limit)


def bulk_page(
    table: DataFrame, key: str, token=None, n: int = 1000, fields: list[str] | None = None,
    text: str | None = None, query: str | None = None,
) -> DataFrame:
    """The ``n`` rows after the token, each with the token of the next page, NULL on the last page.

    Keyset paging: row-group statistics skip what lies before the token.  With ``query`` only rows
    count whose column ``text`` has all of its terms.  The key is among the columns in any case.
    """
    rest = table if token is None else table.where(F.col(key) > F.lit(token))
    if query is not None:
        words = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
        asked = F.regexp_extract_all(F.lower(F.lit(query)), F.lit(TERM), F.lit(0))
        rest = rest.where(F.size(F.array_except(asked, words)) == 0)
    wanted = fields or table.columns
    page = rest.select(*_fields([key, *[f for f in wanted if f != key]], table)).orderBy(key).limit(n + 1)
    # The window sees one page, at most n + 1 rows; the last one only tells that there are more.
    whole = W.partitionBy(F.lit(1)).orderBy(key)
    numbered = page.withColumn("_n", F.row_number().over(whole))
    every = W.partitionBy(F.lit(1))
    last = F.max(F.when(F.col("_n") == n, F.col(key))).over(every)
    more = F.max("_n").over(every) > n
    return numbered.withColumn("next_token", F.when(more, last)).where(F.col("_n") <= n).drop("_n")


def _one_or_all(df: DataFrame, key: str, wanted) -> DataFrame:
    return df if wanted is None else df.where(F.col(key) == F.lit(wanted))


def paper_authors(authorship: DataFrame, authors: DataFrame, author: str, fields: list[str],
                  paper: str = "paper_id", paper_id=None) -> DataFrame:
    """Authors of one paper, or of all papers."""
    edges = _one_or_all(authorship, paper, paper_id).select(paper, author)
    return edges.join(authors.select(author, *fields), author).select(paper, author, *fields)


def paper_references(edges: DataFrame, papers: DataFrame, paper: str, fields: list[str], paper_id=None,
                     citing: str = "citing", cited: str = "cited") -> DataFrame:
    """Outgoing edges with the fields of the cited paper."""
    out = _one_or_all(edges, citing, paper_id)
    other = papers.select(F.col(paper).alias(cited), *fields)
    return out.join(other, cited).select(citing, cited, *[c for c in out.columns if c not in (citing, cited)], *fields)


def paper_citations(edges: DataFrame, papers: DataFrame, paper: str, fields: list[str], paper_id=None,
                    citing: str = "citing", cited: str = "cited") -> DataFrame:
    """Incoming edges with the fields of the citing paper."""
    into = _one_or_all(edges, cited, paper_id)
    other = papers.select(F.col(paper).alias(citing), *fields)
    return into.join(other, citing).select(cited, citing, *[c for c in into.columns if c not in (citing, cited)], *fields)


def author_papers(authorship: DataFrame, authors: DataFrame, author: str, paper: str, fields: list[str],
                  offset: int = 0, limit: int = 100, author_id=None) -> DataFrame:
    """A page of papers of one author, or of every author.

    Over all authors the page is a rank filter that each task applies before the shuffle.
    """
    known = authors.select(author)
    mine = _one_or_all(authorship, author, author_id).select(author, paper, *fields)
    if author_id is not None:
        return mine.join(known, author, "left_semi").orderBy(paper).offset(offset).limit(limit)
    # Ranked before the join: the join would bring all papers of an author into one task.
    nth = F.row_number().over(W.partitionBy(author).orderBy(paper))
    page = mine.withColumn("_n", nth).where(F.col("_n") <= offset + limit).where(F.col("_n") > offset)
    return page.drop("_n").join(known, author, "left_semi")


# --- vectors ---------------------------------------------------------------------------------

def dot(a: Column, b: Column) -> Column:
    """Inner product of two vectors of any length; vectors of different length have none (NULL)."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def mean_vector(df: DataFrame, keys: list[str], vector: str, name: str) -> DataFrame:
    """Component-wise mean per ``keys``, as one array each.

    Sums are made per component before the shuffle, so a group of any size costs no task more than
    one row for each of its components.
    """
    parts = df.select(*keys, F.posexplode(vector).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    cells = F.array_sort(F.collect_list(F.struct("_i", "_x")))  # one per component
    out = parts.groupBy(*keys).agg(F.transform(cells, lambda c: c["_x"]).alias(name))
    return out.where(F.size(name) > 0)


def paper_embedding(papers: DataFrame, key: str, model: str = "specter_v1", paper_id=None,
                    column: str = "embedding") -> DataFrame:
    """The vector of one model version, of one paper or of all."""
    return _one_or_all(papers, key, paper_id).select(key, F.col(f"{column}.{model}").alias("vector"))


def paper_tldr(summaries: DataFrame, key: str, paper_id=None, column: str = "summary") -> DataFrame:
    return _one_or_all(summaries, key, paper_id).select(key, F.col(column).alias("tldr"))


def _length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def _nearest(candidates: DataFrame, target: DataFrame, key: str, vector: str, limit: int, fields: list[str] | None) -> DataFrame:
    """Top ``limit`` by cosine to the one target row; vectors of length zero or of another dimension are left out."""
    goal = target.select(F.struct("_t", _length(F.col("_t")).alias("_norm")).alias("_goal"))
    aimed = candidates.withColumn("_goal", goal.scalar()).where("_goal._norm > 0")
    size = _length(F.col(vector))
    score = F.when(size > 0, F.round(dot(F.col(vector), F.col("_goal._t")) / (size * F.col("_goal._norm")), 4))
    ranked = aimed.select(*_fields(fields or [key], candidates), score.alias("score")).where("score IS NOT NULL")
    return ranked.orderBy(F.desc("score"), key).limit(limit)


def recommend(vectors: DataFrame, key: str, seed, limit: int = 100, vector: str = "embedding", fields: list[str] | None = None) -> DataFrame:
    """Papers nearest to one paper, which is left out."""
    target = vectors.where(F.col(key) == F.lit(seed)).select(F.col(vector).cast("array<double>").alias("_t")).limit(1)
    return _nearest(vectors.where(F.col(key) != F.lit(seed)), target, key, vector, limit, fields)


def _difference(positive: DataFrame, negative: DataFrame | None) -> DataFrame:
    """Mean of the positives minus mean of the negatives: two one-row frames in, one row out."""
    if negative is None:
        return positive.select(F.col("_m").alias("_t"))
    both = positive.withColumn("_n", negative.scalar())
    minus = F.zip_with("_m", "_n", lambda p, n: p - F.coalesce(n, F.lit(0.0)))
    return both.select(F.when(F.col("_n").isNull(), F.col("_m")).otherwise(minus).alias("_t"))


def _among(column: str, ids: list) -> Column:
    """Whether the column is one of ``ids``; a NULL is not."""
    return F.coalesce(F.col(column).isin(list(ids)), F.lit(False))


def recommend_from(vectors: DataFrame, key: str, positive: list, negative: list = (), limit: int = 100,
                   vector: str = "embedding", fields: list[str] | None = None) -> DataFrame:
    """Papers ranked by cosine to the mean of the positives minus that of the negatives."""
    def mean(ids: list) -> DataFrame:
        return mean_vector(vectors.where(_among(key, ids)), [], vector, "_m")

    target = _difference(mean(positive), mean(negative) if negative else None)
    return _nearest(vectors.where(~_among(key, [*positive, *negative])), target, key, vector, limit, fields)


def recommend_for_author(vectors: DataFrame, key: str, author: str, positive: list, negative: list = (),
                         limit: int = 100, vector: str = "embedding", fields: list[str] | None = None) -> DataFrame:
    """As ``recommend_from`` with authors: the mean of the authors' centroids counts, and the
    authors' own papers are left out.  Papers without an author stay."""
    def mean(ids: list) -> DataFrame:
        centroids = mean_vector(vectors.where(_among(author, ids)), [author], vector, "_c")
        return mean_vector(centroids, [], "_c", "_m")

    target = _difference(mean(positive), mean(negative) if negative else None)
    return _nearest(vectors.where(~_among(author, [*positive, *negative])), target, key, vector, limit, fields)


def trending(citations: DataFrame, paper: str, date: str, days: int = 30, limit: int = 100) -> DataFrame:
    """Most cited papers of the last ``days`` days of the data, ties by id."""
    newest = citations.agg(F.max(date).cast("date").alias("d"))
    # The column itself is compared with the first moment after the day, so the scan can use the bound.
    bound = newest.select(F.date_add("d", 1 - days).cast(dict(citations.dtypes)[date]).alias("d")).scalar()
    counted = citations.where(F.col(date) >= bound).groupBy(paper).agg(F.count(F.lit(1)).alias("citations"))
    return counted.orderBy(F.desc("citations"), paper).limit(limit)
