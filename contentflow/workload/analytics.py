"""Keywords, summaries and entities on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentflow.functions import markup
from contentflow.functions.text import KEYWORD_STOP_WORDS, PUNCTUATION
from contentflow.operators import analytics as A
from contentflow.workload import fixtures as fx, sqltext as s
from contentflow.workload.registry import query


def _ranked(rows: str, n: int) -> str:
    """CTEs ending in ``ranked(id, rank, word, score)`` for a query giving ``(id, text)``."""
    return rf"""src AS ({rows}), words AS (
  SELECT id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS word FROM src
), tf AS (
  SELECT id, word, count(*) AS tf FROM words WHERE word NOT IN ({s.word_list(KEYWORD_STOP_WORDS)}) GROUP BY ALL
), spread AS (SELECT word, count(*) AS df FROM tf GROUP BY ALL), scored AS (
  SELECT id, word, round(tf * (ln((SELECT count(*) FROM src) + 1.0::DOUBLE) - ln(df + 1.0::DOUBLE) + 1), 6) AS score
  FROM tf JOIN spread USING (word)
), ranked AS (
  SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, word) AS INTEGER) AS rank, word, score FROM scored
  QUALIFY rank <= {n})"""


_DOCS = "SELECT doc_id AS id, text FROM documents"
_LISTS = """lists AS (
  SELECT src.id, coalesce(list(word ORDER BY rank) FILTER (word IS NOT NULL), []) AS kw
  FROM src LEFT JOIN ranked USING (id) GROUP BY src.id)"""


@query("keywords", f"WITH {_ranked(_DOCS, 10)} SELECT id AS doc_id, rank, word, score FROM ranked")
def keywords(t):
    return A.keywords(t.documents.select("doc_id", "text"), "doc_id", "text")


_PAGE_TEXT = s.normalize(f"array_to_string({s.blocks(s.article('html'))}, ' ')", markup=False)


@query(
    "page_keywords",
    f"WITH {_ranked(f'SELECT page_id AS id, {_PAGE_TEXT} AS text FROM pages', 10)} SELECT id AS page_id, rank, word, score FROM ranked",
)
def page_keywords(t):
    """The flagship: pages to blocks to normalised text to top keywords."""
    blocks = F.array_join(markup.text_blocks(fx.article()), " ")
    texts = t.pages.select("page_id", markup.normalize_plain(blocks).alias("text"))
    return A.keywords(texts, "page_id", "text")


@query(
    "keyword_summary",
    f"WITH {_ranked(_DOCS, 5)}, {_LISTS} SELECT id AS doc_id, array_to_string(kw, ' ') AS summary FROM lists",
)
def keyword_summary(t):
    return A.keyword_summary(t.documents.select("doc_id", "text"), "doc_id", "text")


# Of overlapping hits a head, which nothing before reaches, is always taken; from it on the next free one is.
_GAZ = rf"""benchmark_words AS (SELECT regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS ws FROM benchmark
), gaz AS (
  SELECT DISTINCT array_to_string(ws[i:i + n - 1], ' ') AS term, CASE length(term) % 3 WHEN 0 THEN 'ORG' WHEN 1 THEN 'PER' ELSE 'LOC' END AS entity_group
  FROM benchmark_words, range(1, 100000) r(i), range(1, 4) q(n) WHERE i <= len(ws)
  AND CASE len(ws[i:i + n - 1]) WHEN 1 THEN length(term) >= 5 WHEN 2 THEN length(term) % 4 = 0 ELSE length(term) % 5 = 0 END
), spelled AS (
  SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS ws, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+[^\p{{L}}\p{{N}}_]*') AS ps FROM documents
), grams AS (
  SELECT doc_id, i - 1 AS pos, n, CASE WHEN n = 1 THEN ws[i] ELSE {s.squeeze("array_to_string(ps[i:i + n - 2], '') || ws[i + n - 1]")} END AS word
  FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM spelled), range(1, 4) q(n) WHERE i + n - 1 <= len(ws)
), best AS (
  SELECT doc_id, pos, n, word, entity_group FROM grams JOIN gaz ON lower(word) = term
  QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY n DESC) = 1
), headed AS (
  SELECT *, pos >= coalesce(max(pos + n) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS head FROM best
), linked AS (
  SELECT a.*, b.pos AS nxt FROM headed a ASOF LEFT JOIN best b ON a.doc_id = b.doc_id AND a.pos + a.n <= b.pos
), chosen AS (
  SELECT doc_id, pos, nxt FROM linked WHERE head
  UNION SELECT l.doc_id, l.pos, l.nxt FROM chosen c JOIN linked l ON l.doc_id = c.doc_id AND l.pos = c.nxt WHERE NOT l.head
), found AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, word, entity_group FROM best SEMI JOIN chosen USING (doc_id, pos))"""


@query("tag_entities", f"WITH RECURSIVE {_GAZ} SELECT doc_id, pos, word, entity_group FROM found")
def tag_entities(t):
    return A.tag_entities(t.documents, fx.gazetteer(t), "doc_id", "text")


@query(
    "entity_lists",
    f"""WITH RECURSIVE {_GAZ} SELECT d.doc_id, coalesce(string_agg(word || '/' || entity_group, ' ' ORDER BY pos), '') AS entities
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id""",
)
def entity_lists(t):
    rows = A.entity_lists(t.documents, fx.gazetteer(t), "doc_id", "text")
    pairs = F.transform("entities", lambda e: F.concat(e["word"], F.lit("/"), e["entity_group"]))
    return rows.select("doc_id", F.array_join(pairs, " ").alias("entities"))


@query(
    "merge_tags_keywords",
    f"""WITH {_ranked(_DOCS, 10)}, {_LISTS}
SELECT doc_id, array_to_string(list_filter(list_concat([lang, source, '-', ' '], kw),
       lambda k: trim(k) <> '' AND instr({s.quoted(PUNCTUATION)}, k) = 0), '|') AS keywords
FROM documents JOIN lists ON id = doc_id""",
)
def merge_tags_keywords(t):
    kw = A.keyword_lists(t.documents.select("doc_id", "text"), "doc_id", "text")
    tags = F.array("lang", "source", F.lit("-"), F.lit(" "))
    merged = A.merge_tags_keywords(tags, F.col("keywords"))
    return t.documents.join(kw, "doc_id").select("doc_id", F.array_join(merged, "|").alias("keywords"))
