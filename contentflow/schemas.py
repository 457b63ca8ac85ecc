"""Declared schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())


def _struct(text: list[str], lists: list[str] = ()) -> T.StructType:
    fields = [T.StructField(n, T.StringType()) for n in text]
    return T.StructType(fields + [T.StructField(n, STRINGS) for n in lists])


# A post as scraped. ``date`` stays text: the store holds 'N/A' for unknown dates.
POST = T.StructType(
    [
        T.StructField("urlId", T.StringType()),
        T.StructField("uuid", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("excerpt", T.StringType()),
        T.StructField("body", STRINGS),
        T.StructField("images", STRINGS),
        T.StructField("tags", STRINGS),
        T.StructField("references", STRINGS),
        T.StructField("categories", T.StringType()),
    ]
)

# The list fields of an extraction result, by the group they are stored in.
METADATA_LISTS = ["summary", "tldr", "keywords", "synonyms_acronyms", "entities", "locations"]
MEDICAL_LISTS = [
    "diseases", "variants", "genetic_information", "symptoms", "medications",
    "treatments", "medical_tests", "diagnoses", "causes",
]
RESEARCH_LISTS = [
    "key_findings", "causal_relationships", "scientific_facts",
    "practical_implications", "policy_recommendations",
]
RESULT_KEYS = METADATA_LISTS + MEDICAL_LISTS + RESEARCH_LISTS

NESTED_POST = T.StructType(
    [
        T.StructField(
            "Metadata",
            _struct(["uuid", "urlId", "date", "author", "title", "excerpt"], METADATA_LISTS),
        ),
        T.StructField(
            "Content",
            T.StructType(
                [
                    T.StructField("body", STRINGS),
                    T.StructField("images", STRINGS),
                    T.StructField("tags", STRINGS),
                    T.StructField("references", STRINGS),
                    T.StructField("categories", T.StringType()),
                ]
            ),
        ),
        T.StructField("Medical", _struct([], MEDICAL_LISTS)),
        T.StructField("Research", _struct([], RESEARCH_LISTS)),
    ]
)

FEED_ITEM = _struct(["title", "date", "category", "summary", "link"])

PAGE = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
