"""Cleaning operators on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentflow.functions import dates, markup, records, text
from contentflow.operators import cleaning as C
from contentflow.session import stage
from contentflow.workload import fixtures as fx, sqltext as s
from contentflow.workload.registry import query

_BAD = "CASE WHEN o_orderkey % 11 = 0 THEN 'N/A' WHEN o_orderkey % 13 = 0 THEN 'N/A' WHEN o_orderkey % 17 = 0 THEN 'N/A'"


@query("parse_us_date", f"SELECT o_orderkey, {_BAD} ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders")
def parse_us_date(t):
    k, short = F.col("o_orderkey"), F.date_format("o_orderdate", "M/d/yy")
    raw = F.when(k % 11 == 0, "soon").when(k % 13 == 0, F.lit(None)).when(k % 17 == 0, F.concat(F.lit(" "), short))
    return t.orders.select("o_orderkey", dates.parse_us_date(raw.otherwise(short)).alias("date"))


@query(
    "standardize_date",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders""",
)
def standardize_date(t):
    k = F.col("o_orderkey")
    raw = F.when(k % 11 == 0, "soon")
    for i, fmt in enumerate(["yyyy-MM-dd", "M/d/yyyy", "MMMM d, yyyy", "d MMM yyyy", "M/d/yy"]):
        raw = raw.when(k % 5 == i, F.date_format("o_orderdate", fmt))
    return t.orders.select("o_orderkey", dates.standardize_date(raw).alias("date"))


@query(
    "unescape_slashes",
    r"""SELECT page_id, url, 'a/b' AS path, 'a\/b' AS kept, url || '|' || url AS links FROM pages""",
)
def unescape_slashes(t):
    escaped = F.replace("url", F.lit("/"), F.lit("\\/"))
    links = F.transform(F.array(escaped, escaped), lambda x: text.unescape_slashes(x))
    return t.pages.select(
        "page_id",
        text.unescape_slashes(escaped, only_urls=True).alias("url"),
        text.unescape_slashes(F.lit("a\\/b")).alias("path"),
        text.unescape_slashes(F.lit("a\\/b"), only_urls=True).alias("kept"),
        F.array_join(links, "|").alias("links"),
    )


@query("decode_unicode", r"""SELECT doc_id, replace(text, 'qu', chr(128512)) || '\u12' AS text FROM documents""")
def decode_unicode(t):
    escaped = F.col("text")
    for letter in "eaé":
        escaped = F.replace(escaped, F.lit(letter), F.lit(f"\\u{ord(letter):04x}"))
    escaped = F.replace(escaped, F.lit("qu"), F.lit("\\ud83d\\ude00"))
    return t.documents.select("doc_id", text.decode_unicode(F.concat(escaped, F.lit("\\u12"))).alias("text"))


@query("clean_url", f"SELECT page_id, replace({s.unescape('html')}, chr(92), '') AS html FROM pages")
def clean_url(t):
    return t.pages.select("page_id", markup.clean_url(F.col("html")).alias("html"))


@query(
    "drop_quotes",
    """SELECT doc_id, array_to_string(list_filter(string_split(replace(text, '"', ''), chr(10)), lambda x: true), '|') AS body FROM documents""",
)
def drop_quotes(t):
    body = text.drop_quotes(F.split("text", "\n"))
    return t.documents.select("doc_id", F.array_join(body, "|").alias("body"))


def _broken(column):
    """Text with an invalid byte after its first line break, in every 10th row."""
    whole = F.col(column)
    cut = F.locate("\n", whole)
    bytes_ = F.concat(
        F.substr(whole, F.lit(1), cut).cast("binary"), F.unhex(F.lit("FF")), F.substr(whole, cut + 1).cast("binary")
    )
    return F.when(F.col("doc_id") % 10 == 0, bytes_.cast("string")).otherwise(whole)


@query("fix_encoding", "SELECT doc_id, text, lang || '|' || text AS body, text AS note FROM documents")
def fix_encoding(t):
    rows = t.documents.select("doc_id", "lang", _broken("text").alias("text"))
    nested = rows.select(
        "doc_id", "text", F.array("lang", "text").alias("body"), F.struct(F.struct("text").alias("b")).alias("a")
    )
    return C.fix_encoding(nested).select("doc_id", "text", F.array_join("body", "|").alias("body"), F.col("a.b.text").alias("note"))


@query(
    "encoding_audit",
    """SELECT doc_id, unnest(['text', 'body', 'deep', 'deep', 'named']) AS field,
  unnest(['text', 'body[1]', 'deep.notes[0].t', 'deep.notes[2].t', 'named.values[1]']) AS path FROM documents WHERE doc_id % 10 = 0
UNION ALL SELECT doc_id, unnest(['lang', 'deep', 'named']), unnest(['lang', 'deep.lang', 'named.keys[1]']) FROM documents WHERE doc_id % 7 = 0""",
)
def encoding_audit(t):
    lang = F.when(F.col("doc_id") % 7 == 0, F.unhex(F.lit("61C3")).cast("string")).otherwise(F.col("lang"))
    rows = t.documents.select("doc_id", lang.alias("lang"), _broken("text").alias("text"), "source")
    note = lambda c: F.struct(F.col(c).alias("t"), F.lit(1).alias("n"))
    deep = F.struct(F.array(note("text"), note("source"), note("text")).alias("notes"), "lang")
    named = F.create_map(F.lit("source"), "source", "lang", "text")
    return C.encoding_audit(rows.select("*", F.array("source", "text").alias("body"), deep.alias("deep"), named.alias("named")), "doc_id")


@query("clean_text", f"SELECT doc_id, {s.clean('text')} AS text FROM documents")
def clean_text(t):
    return t.documents.select("doc_id", text.clean_text(F.col("text")).alias("text"))


@query(
    "normalize_text",
    f"SELECT page_id AS id, {s.normalize('html')} AS text FROM pages UNION ALL SELECT -1 - doc_id, {s.normalize('text')} FROM documents",
)
def normalize_text(t):
    both = t.pages.select(F.col("page_id").alias("id"), F.col("html").alias("text")).union(
        t.documents.select(-1 - F.col("doc_id"), "text")
    )
    return both.select("id", markup.normalize_text(F.col("text")).alias("text"))


@query("remove_stopwords", f"SELECT doc_id, {s.without_stop_words('text')} AS text FROM documents")
def remove_stopwords(t):
    return t.documents.select("doc_id", text.remove_stopwords(F.col("text")).alias("text"))


@query(
    "special_tokens",
    r"""
SELECT doc_id, array_to_string(list_concat(list_concat(
  regexp_extract_all(text, '\b[a-zA-Z]{2,}[0-9]+\b'), regexp_extract_all(text, '\b[0-9]+[.,]?[0-9]*\b')),
  regexp_extract_all(text, '"[^"]*"')), '|') AS tokens FROM documents""",
)
def special_tokens(t):
    return t.documents.select("doc_id", F.array_join(text.special_tokens(F.col("text")), "|").alias("tokens"))


_LEX = f"""toks AS (
  SELECT doc_id, w, i FROM (SELECT doc_id, string_split({s.normalize('text')}, ' ') AS ws FROM documents),
  unnest(ws) WITH ORDINALITY AS u(w, i)
), vocab AS (SELECT DISTINCT w FROM toks), lex AS (
  SELECT v.w AS word, b.w AS lemma FROM vocab v JOIN vocab b ON v.w = b.w || 's' WHERE b.w <> '')"""


def _plain(t):
    """Normalised texts, staged: the word list and the texts themselves read them."""
    return stage(t.documents.select("doc_id", markup.normalize_text(F.col("text")).alias("text")), "plain")


@query(
    "lemmatize",
    f"""WITH {_LEX} SELECT doc_id, string_agg(coalesce(lemma, w), ' ' ORDER BY i) AS text
FROM toks LEFT JOIN lex ON w = word GROUP BY doc_id""",
)
def lemmatize(t):
    plain = _plain(t)
    return C.lemmatize(plain, fx.lexicon(plain, "text"), "doc_id", ["text"])


@query(
    "fill_missing",
    """SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), '') AS quality,
       coalesce('t' || toxic, '') AS toxic, CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS n
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def fill_missing(t):
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left").select(
        "doc_id", F.col("quality").cast("string"), F.concat(F.lit("t"), "toxic").alias("toxic"),
        F.when(F.col("quality").isNotNull(), F.array(F.col("quality").cast("string"))).alias("items"),
    )
    return records.fill_missing(rows).select("doc_id", "quality", "toxic", F.size("items").alias("n"))


@query(
    "flatten_record",
    """SELECT event_id, event_type AS "event.type", user_id AS "event.by.user",
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS "event.props.k", props || '|' || event_type AS tags FROM events""",
)
def flatten_record(t):
    props = F.from_json("props", "k bigint").alias("props")
    event = F.struct(F.col("event_type").alias("type"), F.struct(F.col("user_id").alias("user")).alias("by"), props)
    rows = t.events.select("event_id", event.alias("event"), F.array("props", "event_type").alias("tags"))
    return records.flatten_record(rows).withColumn("tags", F.array_join("tags", "|"))


@query(
    "post_id",
    "SELECT page_id, md5(url) AS uuid FROM pages",
)
def post_id(t):
    return t.pages.select("page_id", text.post_id(F.col("url")).alias("uuid"))


def _chain(x: str) -> str:
    return s.without_stop_words(s.normalize(s.clean(x)))


_POLISHED = f"""{s.POSTS}, polished AS (
  SELECT seq, {s.clean('author')} AS author, {_chain('title')} AS title, {_chain('excerpt')} AS excerpt,
         {_chain("array_to_string(body, ' ')")} AS body,
         [{_chain('tags[1]')}, {_chain('tags[2]')}] AS tags, {_chain('categories')} AS categories FROM posts)"""


@query(
    "polish_columns",
    f"WITH {_POLISHED} SELECT seq, author, title, excerpt, body, array_to_string(tags, '|') AS tags, categories FROM polished",
)
def polish_columns(t):
    rows = fx.posts(t).select("seq", "author", "title", "excerpt", "body", "tags", "categories")
    return C.polish_columns(rows).withColumn("tags", F.array_join("tags", "|"))


def _lemmas(x: str) -> str:
    return f"""(SELECT coalesce(string_agg(coalesce(lemma, w), ' ' ORDER BY i), '')
  FROM unnest(list_filter(string_split({x}, ' '), lambda y: y <> '')) WITH ORDINALITY AS u(w, i) LEFT JOIN lex ON w = word)"""


@query(
    "polish_and_lemmatize",
    f"""WITH {_POLISHED}, {_LEX}
SELECT seq, author, {_lemmas('title')} AS title, {_lemmas('body')} AS body,
       {_lemmas('tags[1]')} || '|' || {_lemmas('tags[2]')} AS tags FROM polished""",
)
def polish_and_lemmatize(t):
    rows = fx.posts(t).select("seq", "author", "title", "body", "tags")
    lex = fx.lexicon(_plain(t), "text")
    return C.polish_columns(rows, lexicon=lex, key="seq").withColumn("tags", F.array_join("tags", "|"))
