"""Cleaning operators on post tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from contentflow.functions import markup, text
from contentflow.functions.binding import let
from contentflow.functions.records import map_string_leaves, map_strings
from contentflow.session import stage


def fix_encoding(df: DataFrame) -> DataFrame:
    """Remove invalid UTF-8 from every string, list and nested record."""
    return map_string_leaves(df, text.drop_invalid_utf8)


def _defects(c: Column, dtype: T.DataType, path: Column) -> Column | None:
    """Paths of the strings inside a value that are not UTF-8, as an array; None for a type without strings."""
    none = F.array().cast("array<string>")
    if isinstance(dtype, T.StringType):
        return F.when(~F.is_valid_utf8(c), F.array(path)).otherwise(none)
    if isinstance(dtype, T.StructType):
        parts = [_defects(c[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in dtype]
        parts = [p for p in parts if p is not None]
        return F.concat(*parts) if parts else None

    def each(items: Column, element: T.DataType, where: Column) -> Column | None:
        at = lambda i: F.concat(where, F.lit("["), i.cast("string"), F.lit("]"))
        if _defects(F.lit(None), element, where) is None:
            return None
        return F.coalesce(F.flatten(F.transform(items, lambda x, i: _defects(x, element, at(i)))), none)

    if isinstance(dtype, T.ArrayType):
        return each(c, dtype.elementType, path)
    if isinstance(dtype, T.MapType):
        # A broken key cannot name its entry: keys and values go by their position.
        parts = [
            each(F.map_keys(c), dtype.keyType, F.concat(path, F.lit(".keys"))),
            each(F.map_values(c), dtype.valueType, F.concat(path, F.lit(".values"))),
        ]
        parts = [p for p in parts if p is not None]
        return F.concat(*parts) if parts else None
    return None


def encoding_audit(df: DataFrame, row_id: str, fields: list[str] | None = None) -> DataFrame:
    """Strings that cannot be serialised: ``(row id, field, path)``, one row per string.

    The schema is walked into structs, arrays and maps; ``path`` leads from the column to the string, with positions from 0, such
    as ``body[3]``, ``Metadata.title`` or ``labels.values[0].name``.
    """
    named = lambda name: lambda p: F.struct(F.lit(name).alias("field"), p.alias("path"))
    found = []
    for name in fields or [f.name for f in df.schema if f.name != row_id]:
        paths = _defects(F.col(f"`{name}`"), df.schema[name].dataType, F.lit(name))
        if paths is not None:
            found.append(F.transform(paths, named(name)))
    kind = "array<struct<field:string,path:string>>"
    return df.select(row_id, F.explode(F.concat(*found) if found else F.array().cast(kind)).alias("_d")).select(row_id, "_d.*")


def row_key(*columns: str) -> Column:
    """A key of a row from columns that tell rows apart: the same on every run, for missing values too."""
    return F.md5(F.to_json(F.struct(*columns)))


SEGMENT = 512  # words looked up against one map; map look-ups scan their keys


def _segments(words: Column) -> Column:
    """A word array cut into arrays of at most SEGMENT words."""
    return let(
        words,
        lambda ws: F.transform(
            F.sequence(F.lit(0), F.floor(F.greatest(F.size(ws) - 1, F.lit(0)) / SEGMENT).cast("int")),
            lambda k: F.slice(ws, k * SEGMENT + 1, F.lit(SEGMENT)),
        ),
    )


def lemmatize(df: DataFrame, lexicon: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Replace each word of whitespace-separated text columns by its lemma; unknown words stay.

    ``key`` tells rows apart.  ``lexicon(word, lemma)``; of several lemmas of a word the first in order counts.  Every row
    sends the distinct words of its segments once, and only those the lexicon changes come back, as one
    small map per segment.  The text itself is not taken apart in the shuffle.
    """
    single = lexicon.groupBy("word").agg(F.min("lemma").alias("lemma")).where("word <> lemma")
    types = dict(df.dtypes)

    def words_of(c: str) -> Column:
        if types[c].startswith("array"):
            return F.flatten(F.transform(c, text.split_words))
        return text.split_words(F.col(c))

    def numbered(i: int, c: str) -> Column:
        parts = F.coalesce(_segments(words_of(c)), F.array().cast("array<array<string>>"))
        return F.transform(
            parts, lambda ws, k: F.struct(F.lit(i).alias("c"), k.alias("k"), F.array_distinct(ws).alias("ws"))
        )

    parts = F.concat(*[numbered(i, c) for i, c in enumerate(columns)])
    words = df.select(key, F.explode(parts).alias("_p")).select(
        key, "_p.c", "_p.k", F.explode("_p.ws").alias("word")
    )
    changes = (
        words.join(single, "word")
        .groupBy(key, "c", "k")
        .agg(F.map_from_entries(F.collect_set(F.struct("word", "lemma"))).alias("m"))
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct(F.struct("c", "k"), "m"))).alias("_maps"))
    )

    def swap(words: Column, lemmas: Column) -> Column:
        return let(lemmas, lambda m: F.transform(words, lambda w: F.coalesce(F.try_element_at(m, w), w)))

    def lemmas_of(i: int, k: Column) -> Column:
        return F.try_element_at("_maps", F.struct(F.lit(i).alias("c"), k.alias("k")))

    def lemmatized(i: int, c: str) -> Column:
        if types[c].startswith("array"):
            # Looked up in the map of the segment; an element may sit in any, so all are merged.
            own = F.map_filter("_maps", lambda k, m: k["c"] == i)
            entries = F.flatten(F.transform(F.map_values(own), F.map_entries))
            merged = F.map_from_entries(F.array_distinct(entries))
            return F.transform(c, lambda x: F.array_join(swap(text.split_words(x), merged), " "))
        swapped = F.transform(_segments(words_of(c)), lambda ws, k: swap(ws, lemmas_of(i, k)))
        return F.array_join(F.flatten(swapped), " ")

    number = {c: i for i, c in enumerate(columns)}
    joined = df.join(changes, key, "left")
    return joined.select(
        *[lemmatized(number[c], c).alias(c) if c in number else F.col(f"`{c}`") for c in df.columns]
    )


# The polished columns. The author's name only gets its white space cleaned.
POLISHED = ["title", "author", "excerpt", "body", "tags", "categories"]


def polish_columns(
    df: DataFrame, columns: list[str] = POLISHED, lexicon: DataFrame | None = None, key: str = "uuid"
) -> DataFrame:
    """Clean, normalise, drop stop words and, with a lexicon, lemmatise every text column.

    All but the last step are one projection, whose rows are written before the last one: its words and its texts are both
    read from there.  Body paragraphs are joined by a blank; tags stay a list.
    """

    def chain(c: Column) -> Column:
        return text.remove_stopwords(markup.normalize_text(text.clean_text(c)))

    def polished(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if f.name not in columns:
            return c
        if f.name == "author":
            return text.clean_text(c).alias(f.name)
        if f.name == "body" and isinstance(f.dataType, T.ArrayType):
            return chain(F.array_join(c, " ")).alias(f.name)
        return map_strings(c, f.dataType, chain).alias(f.name)

    done = df.select([polished(f) for f in df.schema])
    if lexicon is None:
        return done
    worded = [c for c in df.columns if c in columns and c != "author"]
    return lemmatize(stage(done, "polished-columns", True), lexicon, key, worded)
