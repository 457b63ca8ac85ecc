"""The cleaning flow: raw posts to polished posts with summary, keywords and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from contentflow.functions.dates import standardize_date
from contentflow.functions.markup import clean_url
from contentflow.functions.records import fill_missing, flatten_record
from contentflow.operators import analytics as A
from contentflow.operators.cleaning import encoding_audit, fix_encoding, polish_columns, row_key
from contentflow.operators.selection import dedupe_posts, new_by_any_id
from contentflow.session import stage


def polish_store(raw: DataFrame, cleaned: DataFrame, gazetteer: DataFrame, lexicon: DataFrame | None = None, seq: str = "seq") -> DataFrame:
    """New posts, polished, each with ``summary``, ``keywords`` and ``entities``; one row per post that ``dedupe_posts`` keeps.

    What tells these posts apart is URL and title.  A key made of both is put on them before they are polished, as ids may be
    missing and URLs repeat; everything that is computed beside the post comes back by it.  The
    polished text feeds three branches, so it is staged.
    """
    fresh = new_by_any_id(fix_encoding(raw), cleaned)
    filled = fill_missing(flatten_record(fresh))
    linked = filled.withColumn("body", F.transform("body", clean_url)).withColumn("date", standardize_date(F.col("date")))
    keyed = dedupe_posts(linked, seq=seq).withColumn("_row", row_key("urlId", "title"))
    posts = stage(polish_columns(keyed, lexicon=lexicon, key="_row"), "polished")
    words = A.keyword_lists(posts, "_row", "body").withColumnRenamed("keywords", "_kw")
    entities = A.entity_lists(posts, gazetteer, "_row", "body")
    # The summary's words are the first of the keywords: same ranking, smaller n.
    summary = F.array_join(F.slice("_kw", 1, A.SUMMARY_WORDS), " ")
    return (
        posts.join(words, "_row")
        .join(entities, "_row")
        .withColumn("summary", summary)
        .withColumn("keywords", A.merge_tags_keywords(F.col("tags"), F.col("_kw")))
        .drop("_kw", "_row")
    )


def refresh_cleaned(
    raw: DataFrame, cleaned: DataFrame, gazetteer: DataFrame, lexicon: DataFrame | None = None, seq: str = "seq"
) -> tuple[DataFrame, DataFrame]:
    """The cleaned store with the new posts ahead (``batch`` 0 new, 1 stored), and what in them cannot be serialised.

    Stored posts keep the columns they have.  The audit lists ``(seq, field, path)``.
    """
    new = stage(polish_store(raw, cleaned, gazetteer, lexicon, seq), "cleaned")
    store = new.withColumn("batch", F.lit(0)).unionByName(cleaned.withColumn("batch", F.lit(1)), allowMissingColumns=True)
    return store, encoding_audit(new, seq)
