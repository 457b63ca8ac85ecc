"""Chunking, requests, responses and nested records on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentflow.functions.records import flatten_record as flatten
from contentflow.operators import extraction as X, selection as S, views as V
from contentflow.schemas import RESULT_KEYS
from contentflow.workload import fixtures as fx, sqltext as s
from contentflow.workload.registry import query

LIMIT = 200


def _chunks(t):
    rows = t.documents.select("doc_id", fx.lines(F.col("text")).alias("body"))
    return X.chunk_text(rows, "doc_id", "body", LIMIT)


@query("chunk_text", f"WITH RECURSIVE {s.chunks(LIMIT)} SELECT doc_id, chunk_idx, chunk FROM chunks")
def chunk_text(t):
    return _chunks(t)


# The request as it has to read, around its chunk.
_REQUEST = """Read the passage and fill in the fields below.
Every field is a list of strings; leave it empty if the passage says nothing on it.
- summary: A short account in plain words.
- tldr: The same in a single plain sentence.
- keywords: Words a reader would search for.
- synonyms_acronyms: Abbreviations and other names of the main terms.
- entities: People, organisations and products named.
- locations: Places named.
- diseases: Illnesses and conditions named.
- variants: Variants of genes or proteins.
- genetic_information: Genes, their products and how they are inherited.
- symptoms: Signs and complaints described.
- medications: Drugs named.
- treatments: Therapies and procedures described.
- medical_tests: Tests and examinations described.
- diagnoses: Findings that a clinician settled on.
- causes: What brought a condition about.
- key_findings: The main results.
- causal_relationships: What depends on or leads to what.
- scientific_facts: Statements of fact that the passage makes or relies on.
- practical_implications: What follows for practice.
- policy_recommendations: What policy makers are advised to do.

Passage:
#

Reply with a single JSON object of this shape and nothing else:
{"summary": [], "tldr": [], "keywords": [], "synonyms_acronyms": [], "entities": [], "locations": [], "diseases": [], \
"variants": [], "genetic_information": [], "symptoms": [], "medications": [], "treatments": [], "medical_tests": [], \
"diagnoses": [], "causes": [], "key_findings": [], "causal_relationships": [], "scientific_facts": [], \
"practical_implications": [], "policy_recommendations": []}""".split("#")


@query(
    "extraction_requests",
    f"WITH RECURSIVE {s.chunks(LIMIT)} SELECT doc_id, chunk_idx, {s.quoted(_REQUEST[0])} || chunk || {s.quoted(_REQUEST[1])} AS request FROM chunks",
)
def extraction_requests(t):
    return X.extraction_requests(_chunks(t), "doc_id")


def _dealt(words: str, n: str) -> dict[str, str]:
    """Expected lists per key for the words of a text and its row number."""
    out = {}
    for j, key in enumerate(RESULT_KEYS):
        items = f"list_filter({words}, lambda w, i: (i - 1) % 20 = {j})"
        if j == 0:
            items = f"CASE WHEN {n} % 13 = 0 THEN [array_to_string({items}, ' ')] ELSE {items} END"
        out[key] = f"CASE WHEN {n} % 9 = 0 THEN [] ELSE {items} END"
    return out


def _joined_keys(df, *keys):
    return df.select(*keys, *[F.array_join(k, "|").alias(k) for k in RESULT_KEYS])


@query(
    "parse_responses",
    "SELECT conv_id, turn, "
    + ", ".join(f"{s.joined(e)} AS {k}" for k, e in _dealt("ws", "(conv_id + turn)").items())
    + " FROM (SELECT *, string_split(text, ' ') AS ws FROM conversations)",
)
def parse_responses(t):
    rows = fx.responses(t.conversations, ["conv_id", "turn"], F.col("conv_id") + F.col("turn"), F.col("text"))
    return _joined_keys(X.parse_responses(rows), "conv_id", "turn")


def _results(t, key="doc_id"):
    n = F.col("doc_id") + F.col("chunk_idx")
    return X.parse_responses(fx.responses(_chunks(t), ["doc_id", "chunk_idx"], n, F.col("chunk")))


_RESULTS = f"""{s.chunks(LIMIT)}, parsed AS (
  SELECT doc_id, chunk_idx, {", ".join(f"{e} AS {k}" for k, e in _dealt("ws", "(doc_id + chunk_idx)").items())}
  FROM (SELECT *, string_split(chunk, ' ') AS ws FROM chunks)
), merged AS (
  SELECT doc_id, {", ".join(f"flatten(list({k} ORDER BY chunk_idx)) AS {k}" for k in RESULT_KEYS)} FROM parsed GROUP BY doc_id
)"""


@query(
    "merge_chunk_results",
    f"WITH RECURSIVE {_RESULTS} SELECT doc_id, {', '.join(f'{s.joined(k)} AS {k}' for k in RESULT_KEYS)} FROM merged",
)
def merge_chunk_results(t):
    return _joined_keys(X.merge_chunk_results(_results(t), "doc_id"), "doc_id")


def _nested(t, keep=()):
    posts = fx.posts(t).withColumn("images", F.array(F.concat(F.lit("https:\\/\\/img\\/"), F.col("seq"))))
    posts = posts.withColumn("urlId", F.concat(F.lit("\\/p\\/"), F.col("seq")))
    posts = posts.withColumn("excerpt", F.when(F.col("seq") % 3 != 0, F.col("excerpt")))
    results = X.merge_chunk_results(_results(t), "doc_id").withColumnRenamed("doc_id", "seq")
    # Every fifth post has no results yet.
    return X.nest_record(posts, results.where("seq % 5 <> 0"), "seq", keep)


_NESTED = f"""{s.POSTS}, {_RESULTS}, nested AS (
  SELECT p.*, 'https://img/' || seq AS image, {", ".join(f"CASE WHEN seq % 5 = 0 THEN [] ELSE {k} END AS {k}" for k in RESULT_KEYS)}
  FROM posts p LEFT JOIN merged ON doc_id = seq)"""


@query(
    "nest_record",
    f"""WITH RECURSIVE {_NESTED}
SELECT "urlId", uuid, date, author, title, CASE WHEN seq % 3 = 0 THEN '' ELSE excerpt END AS excerpt, image AS images,
       {s.joined('body')} AS body, {s.joined('tags')} AS tags, '' AS refs, categories,
       {", ".join(f"{s.joined(k)} AS {k}" for k in RESULT_KEYS)} FROM nested""",
)
def nest_record(t):
    flat = flatten(_nested(t))
    short = {c: c.split(".")[-1] for c in flat.columns}
    lists = ["images", "body", "tags", "references", *RESULT_KEYS]
    named = flat.toDF(*short.values())
    return named.select(
        *[F.array_join(c, "|").alias("refs" if c == "references" else c) if c in lists else c for c in named.columns]
    )


@query(
    "has_metadata_date",
    f"""WITH {s.POSTS} SELECT uuid, date FROM posts WHERE seq % 4 <> 0""",
)
def has_metadata_date(t):
    date = F.when(F.col("seq") % 4 != 0, F.col("date")).alias("date")
    rows = fx.posts(t).select(F.struct("uuid", date).alias("Metadata"))
    return S.has_metadata_date(rows).select("Metadata.uuid", "Metadata.date")


@query(
    "post_cards",
    f"""WITH RECURSIVE {_NESTED} SELECT uuid, image, title, array_to_string(tldr, ' ') AS tldr FROM nested""",
)
def post_cards(t):
    return V.post_cards(_nested(t))


@query(
    "post_detail",
    f"""WITH RECURSIVE {_NESTED} SELECT uuid, title, array_to_string(key_findings, chr(10)) AS key_findings FROM nested""",
)
def post_detail(t):
    return V.post_detail(_nested(t))
