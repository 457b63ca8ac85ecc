"""Keywords, summaries and entities.

Texts are dealt out by document and their words counted there, so that no word is shuffled before it is counted.  The counts
are written once.  Words that many documents have come back as a small table, which needs no shuffle of the counts; only the
other words, the smaller part of the counts, meet by word.  The top-n filter is pruned in every task before the last shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from contentflow.functions.binding import let, scan
from contentflow.functions.text import KEYWORD_STOP_WORDS, ONE_SPACE, candidate_words, keep_keywords, squeeze
from contentflow.session import stage

KEYWORDS = 10  # fixed value: keywords per post
SUMMARY_WORDS = 5  # fixed value: words per summary
FREQUENT = 1000  # one of so many documents has a frequent word, so their number grows with the length of texts only


def keywords(
    df: DataFrame, key: str, text: str, top_n: int = KEYWORDS, stop_words: list[str] = KEYWORD_STOP_WORDS
) -> DataFrame:
    """The ``top_n`` words of each document by TF-IDF: ``(key, rank, word, score)``.

    Scores are rounded before ranking, ties go by word.  Text without candidates gives no row.
    """
    tf = df.select(key, text).repartition(key).select(key, F.explode(candidate_words(F.col(text))).alias("word"))
    tf = stage(tf.where(~F.col("word").isin(stop_words)).groupBy(key, "word").agg(F.count(F.lit(1)).alias("tf")), "words", True)
    docs = df.agg(F.count(F.lit(1)).alias("docs")).scalar()
    spread = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    frequent = stage(spread.where(F.col("df") * FREQUENT >= docs), "frequent", True)
    # No hint: Spark chooses by the size of the written table.
    told = tf.join(frequent, "word", "left")
    rare = told.where("df IS NULL").withColumn("df", F.count(F.lit(1)).over(W.partitionBy("word")))
    idf = F.log((docs + 1) / (F.col("df") + 1)) + 1
    scored = told.where("df IS NOT NULL").unionByName(rare).select(
        key, "word", F.round(F.col("tf") * idf, 6).alias("score")
    )
    best = W.partitionBy(key).orderBy(F.desc("score"), "word")
    return (
        scored.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top_n)
        .select(key, "rank", "word", "score")
    )


def keyword_lists(df: DataFrame, key: str, text: str, top_n: int = KEYWORDS) -> DataFrame:
    """``(key, keywords)`` for every document; blank text gives an empty list.

    At most ``top_n`` rows per document are collected.
    """
    ranked = keywords(df, key, text, top_n).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("_kw")
    )
    words = F.coalesce(F.transform("_kw", lambda x: x["word"]), F.array().cast("array<string>"))
    return df.select(key).join(ranked, key, "left").select(key, words.alias("keywords"))


def keyword_summary(df: DataFrame, key: str, text: str, n: int = SUMMARY_WORDS) -> DataFrame:
    """``(key, summary)``: the top words joined by blanks; blank text gives ''."""
    return keyword_lists(df, key, text, n).select(key, F.array_join("keywords", " ").alias("summary"))


# A word, and a word with what follows it up to the next one.
_TERM_WORD = r"[\p{L}\p{N}_]+"
_TERM_PIECE = r"(?s)[\p{L}\p{N}_]+[^\p{L}\p{N}_]*"


def _grams(texts: DataFrame, key: str, lengths: list[int]) -> DataFrame:
    """Every run of words of one of the ``lengths`` in ``_text``: ``key, pos, n, word``, with what stands between its words as written.

    The words beside a word come from the same array, shifted, so a run is put together in its own row.
    """
    # Runs of white space lie between words, so they are collapsed once for the whole text.
    squeezed = texts.select(key, F.regexp_replace("_text", f"{ONE_SPACE}+", " ").alias("_text"))
    cut = squeezed.select(key, *[F.regexp_extract_all("_text", F.lit(p), F.lit(0)).alias(c) for c, p in (("_w", _TERM_WORD), ("_p", _TERM_PIECE))])
    longest = max(lengths)
    shifted = lambda c, i: F.slice(c, F.lit(i + 1), F.size(c)) if i else F.col(c)
    beside = [shifted("_w", n - 1).alias(f"w{n}") for n in lengths] + [shifted("_p", i).alias(f"p{i}") for i in range(longest - 1)]
    named = cut.select(key, *beside)
    rows = named.select(key, F.posexplode(F.arrays_zip(*named.columns[1:])).alias("pos", "_s"))
    runs = [F.struct(F.lit(n).alias("n"), F.concat(*[F.col("_s")[f"p{i}"] for i in range(n - 1)], F.col("_s")[f"w{n}"]).alias("word")) for n in lengths]
    return rows.select(key, "pos", F.explode(F.array(*runs)).alias("g")).select(key, "pos", "g.*").where("word IS NOT NULL")


def _phrases(gazetteer: DataFrame) -> DataFrame:
    """``term, n, entity_group``: terms as their words stand in a text, in lower case; one row each."""
    whole = F.regexp_extract(F.lower("term"), rf"(?s){_TERM_WORD}(?:.*{_TERM_WORD})?", 0)
    normal = gazetteer.select(squeeze(whole).alias("term"), "entity_group").where("term <> ''")
    counted = normal.withColumn("n", F.regexp_count("term", F.lit(_TERM_WORD)))
    return counted.groupBy("term", "n").agg(F.min("entity_group").alias("entity_group"))


def _longest_first(hits: Column) -> Column:
    """Of overlapping hits (place first, then the negative length) the leftmost one, of those that begin together the longest; the others go."""

    def step(state: Column, h: Column) -> Column:
        free = h["pos"] >= state["end"]
        return F.struct(F.when(free, h["pos"] + h["n"]).otherwise(state["end"]).alias("end"), free.alias("kept"))

    start = F.struct(F.lit(0).alias("end"), F.lit(False).alias("kept"))

    def chosen(xs: Column) -> Column:
        return let(scan(xs, start, step, lambda s: s["kept"], "boolean"), lambda keep: F.filter(xs, lambda _, i: F.get(keep, i)))

    # Sorted by place, then the longest first.
    return let(F.sort_array(hits), chosen)


def _found_terms(df: DataFrame, gazetteer: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, found)``: the terms of each text that has any, in order.

    Runs of words meet the gazetteer by the lengths that it has, in one join; only hits are grouped
    again, and those of a text came out of one row.
    """
    terms = stage(_phrases(gazetteer), "terms")
    # One short list: the numbers of words that terms have.
    lengths = terms.agg(F.sort_array(F.collect_set("n"))).first()[0]
    grams = _grams(df.select(key, F.col(text).alias("_text")), key, lengths or [1])
    hits = grams.join(terms.drop("n"), F.lower("word") == F.col("term"))
    found = hits.groupBy(key).agg(F.collect_list(F.struct("pos", (-F.col("n")).alias("_less"), "n", "word", "entity_group")).alias("found"))
    return found.select(key, _longest_first(F.col("found")).alias("found"))


def tag_entities(df: DataFrame, gazetteer: DataFrame, key: str, text: str) -> DataFrame:
    """Gazetteer terms found in the text: ``(key, pos, word, entity_group)``, repeats kept.

    ``gazetteer(term, entity_group)`` holds terms of one or several words in any case; white space between words counts as
    one blank, other characters as they are.  ``pos`` counts words.  Of overlapping terms the leftmost counts, of those that begin
    at one word the longest.  A term with several groups has the first of them.
    """
    found = _found_terms(df, gazetteer, key, text).select(key, F.explode("found").alias("f"))
    return found.select(key, "f.pos", "f.word", "f.entity_group")


def entity_lists(df: DataFrame, gazetteer: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, entities)`` with the pairs of each document in text order, [] without any."""
    found = _found_terms(df, gazetteer, key, text)
    pairs = F.transform("found", lambda x: F.struct(x["word"], x["entity_group"]))
    empty = F.array().cast("array<struct<word:string,entity_group:string>>")
    return df.select(key).join(found, key, "left").select(key, F.coalesce(pairs, empty).alias("entities"))


def merge_tags_keywords(tags: Column, keywords: Column) -> Column:
    """Tags followed by keywords, blanks and bare punctuation left out."""
    return keep_keywords(F.concat(tags, keywords))
