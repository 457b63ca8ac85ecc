"""Chunking, extraction requests and responses, nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from contentflow.functions.text import unescape_slashes, word_count
from contentflow.schemas import MEDICAL_LISTS, METADATA_LISTS, RESEARCH_LISTS, RESULT_KEYS

MAX_WORDS = 128_000  # fixed value: chunk size in words
SENTENCE_SEP = ". "

# What an answer should hold, by result key; the keys themselves are fixed values.
ASKED = dict(
    zip(
        RESULT_KEYS,
        """A short account in plain words.
The same in a single plain sentence.
Words a reader would search for.
Abbreviations and other names of the main terms.
People, organisations and products named.
Places named.
Illnesses and conditions named.
Variants of genes or proteins.
Genes, their products and how they are inherited.
Signs and complaints described.
Drugs named.
Therapies and procedures described.
Tests and examinations described.
Findings that a clinician settled on.
What brought a condition about.
The main results.
What depends on or leads to what.
Statements of fact that the passage makes or relies on.
What follows for practice.
What policy makers are advised to do.""".split("\n"),
    )
)


def request_head() -> str:
    """The fixed part of a request, everything before the chunk."""
    fields = [f"- {key}: {what}" for key, what in ASKED.items()]
    return "\n".join(
        ["Read the passage and fill in the fields below.", "Every field is a list of strings; leave it empty if the passage says nothing on it.",
         *fields, "", "Passage:", ""]
    )


def format_note() -> str:
    """The fixed part after the chunk: the answer's shape."""
    empty = ", ".join(f'"{key}": []' for key in ASKED)
    return "\n".join(["", "", "Reply with a single JSON object of this shape and nothing else:", "{" + empty + "}"])


def _sentences(body: Column, is_list: bool) -> Column:
    joined = F.array_join(body, SENTENCE_SEP) if is_list else body
    # An empty body gives no chunk.
    pieces = F.split(joined, r"\. ")
    return F.when(F.size(body) > 0, pieces) if is_list else F.when(body != "", pieces)


def chunk_column(body: Column, is_list: bool, max_words: int = MAX_WORDS) -> Column:
    """Pack sentences greedily into chunks of at most ``max_words`` words.

    A fold inside the row finds the first sentence of each chunk.  A sentence that is longer than
    the limit makes a chunk of its own.
    """
    sentences = _sentences(body, is_list)
    counted = F.transform(
        sentences, lambda s, i: F.struct(i.alias("i"), word_count(s).cast("long").alias("n"))
    )
    start = F.struct(F.lit(0).cast("long").alias("words"), F.array(F.lit(0)).alias("starts"))

    def step(acc: Column, s: Column) -> Column:
        new = (acc["words"] + s["n"] > max_words) & (s["i"] > F.element_at(acc["starts"], -1))
        return F.struct(
            F.when(new, s["n"]).otherwise(acc["words"] + s["n"]).alias("words"),
            F.when(new, F.array_append(acc["starts"], s["i"])).otherwise(acc["starts"]).alias("starts"),
        )

    folded = F.aggregate(counted, start, step)["starts"]

    def cut(parts: Column) -> Column:
        all_sentences, starts = parts["sentences"], parts["starts"]

        def chunk(first: Column, k: Column) -> Column:
            end = F.coalesce(F.try_element_at(starts, k + 2), F.size(all_sentences))
            return F.array_join(F.slice(all_sentences, first + 1, end - first), SENTENCE_SEP)

        return F.transform(starts, chunk)

    whole = F.struct(sentences.alias("sentences"), folded.alias("starts"))
    return F.when(sentences.isNotNull(), F.flatten(F.transform(F.array(whole), cut)))


def chunk_text(df: DataFrame, key: str, body: str, max_words: int = MAX_WORDS) -> DataFrame:
    """One row per chunk: ``(key, chunk_idx, chunk)``. The body is a list of paragraphs or text."""
    is_list = dict(df.dtypes)[body].startswith("array")
    chunks = chunk_column(F.col(body), is_list, max_words)
    return df.select(key, F.posexplode(chunks).alias("chunk_idx", "chunk"))


def extraction_requests(chunks: DataFrame, key: str, chunk: str = "chunk") -> DataFrame:
    """One request text per chunk."""
    text = F.concat(F.lit(request_head()), F.col(chunk), F.lit(format_note()))
    return chunks.select(key, "chunk_idx", text.alias("request"))


# The list of a key, or its single string as a list, or an empty list.
_VALUES = """
coalesce(
  try_variant_get(_v, '$.{key}', 'array<string>'),
  filter(array(try_variant_get(_v, '$.{key}', 'string')), x -> x is not null)
)"""


def parse_responses(responses: DataFrame, column: str = "response") -> DataFrame:
    """Replace the response text by one list column per result key.

    Text that is not JSON gives empty lists.  A single string counts as one element, unknown keys
    are ignored.  The JSON may stand in a fenced block.  Of a key that comes twice the last one counts;
    Spark reads that from the session's ``spark.sql.variant.allowDuplicateKeys``, which is set here.
    """
    responses.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    c = F.col(column)
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    parsed = responses.withColumn(
        "_v", F.try_parse_json(F.when(fenced != "", fenced).otherwise(c))  # of a repeated key the last value counts
    ).drop(column)
    others = [x for x in parsed.columns if x != "_v"]
    return parsed.select(*others, *[F.expr(_VALUES.format(key=k)).alias(k) for k in RESULT_KEYS])


def merge_chunk_results(parsed: DataFrame, key: str, idx: str = "chunk_idx") -> DataFrame:
    """One row per document: the lists of its chunks one after the other.

    The group is the chunks of one document, which came out of one row, so its size is bounded by
    that row.  All lists travel in one struct: one aggregate, one sort.
    """
    lists = F.struct(idx, *RESULT_KEYS)
    grouped = parsed.groupBy(key).agg(F.array_sort(F.collect_list(lists)).alias("_chunks"))
    # A field of an array of structs is the array of that field.
    return grouped.select(key, *[F.expr(f"flatten(_chunks.{k})").alias(k) for k in RESULT_KEYS])


def nest_record(posts: DataFrame, results: DataFrame, key: str = "uuid", keep: list[str] = ()) -> DataFrame:
    """Flat post and its results to the nested record.

    Missing text reads '', missing lists are empty, escaped slashes are repaired in links.  ``keep``
    names columns to carry along, such as the input order.
    """
    joined = posts.join(results, key, "left")

    def text(*names: str) -> list[Column]:
        return [F.expr(f"coalesce({n}, '')").alias(n) for n in names]

    def items(*names: str) -> list[Column]:
        return [F.expr(f"coalesce(`{n}`, cast(array() as array<string>))").alias(n) for n in names]

    def links(name: str) -> Column:
        return F.transform(items(name)[0], lambda x: unescape_slashes(x)).alias(name)

    return joined.select(
        *keep,
        F.struct(
            *text("uuid"),
            unescape_slashes(text("urlId")[0]).alias("urlId"),
            *text("date", "author", "title", "excerpt"),
            *items(*METADATA_LISTS),
        ).alias("Metadata"),
        F.struct(
            *items("body"), links("images"), *items("tags"), links("references"), *text("categories")
        ).alias("Content"),
        F.struct(*items(*MEDICAL_LISTS)).alias("Medical"),
        F.struct(*items(*RESEARCH_LISTS)).alias("Research"),
    )
