"""Building blocks of the checking SQL (DuckDB dialect)."""

from __future__ import annotations

# The checking side has patterns of its own, as the test pages need them.
_IN_TAG = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
TAG = rf"<[/!?]?[A-Za-z]{_IN_TAG}>"
INVISIBLE = r"(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)"
BLOCK_OPEN = rf"(?i)<(?:p|h[1-4]|ol|ul)(?:[\s/]{_IN_TAG})?>"
BLOCK_CLOSE = r"(?i)</(?:p|h[1-4]|ol|ul)\s*>"
from contentflow.functions.text import LINK_DOMAINS, SPACE, STOP_WORDS

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
RE_LINK = rf"(https?://[^{SPACE}]+|www\.[^{SPACE}]+|[^{SPACE}]+\.(?:{'|'.join(LINK_DOMAINS)}))"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def word_list(words: list[str]) -> str:
    return ", ".join(quoted(w) for w in words)


STOP_LIST = word_list(STOP_WORDS)


def unescape(x: str) -> str:
    """The entities that occur in the tables, the ampersand last."""
    for entity, code in (("quot", 34), ("copy", 169), ("middot", 183), ("lt", 60), ("gt", 62)):
        x = f"replace({x}, '&{entity};', chr({code}))"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def nodes(marked: str, sep: str) -> str:
    return (
        f"array_to_string(list_filter(list_transform(string_split({unescape(marked)}, chr(1)), "
        f"lambda s: trim(s, {SPACES})), lambda s: s <> ''), {quoted(sep)})"
    )


def visible(html: str) -> str:
    return f"regexp_replace({html}, {quoted(INVISIBLE)}, chr(1), 'g')"


def html_text(html: str, sep: str = " ") -> str:
    return nodes(f"regexp_replace({visible(html)}, {quoted(TAG)}, chr(1), 'g')", sep)


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'), ' ')"


def normalize(x: str, markup: bool = True) -> str:
    if markup:
        x = f"regexp_replace({x}, {quoted(INVISIBLE)}, '', 'g')"
        x = unescape(f"regexp_replace({x}, {quoted(TAG)}, '', 'g')")
    return squeeze(f"regexp_replace(lower({x}), '[^a-z0-9{SPACE}]', '', 'g')")


def clean(x: str) -> str:
    return f"trim(translate({x}, chr(13) || chr(10), '  '), {SPACES})"


def without_stop_words(x: str) -> str:
    return (
        f"array_to_string(list_filter(string_split({squeeze(x)}, ' '), "
        f"lambda w: w <> '' and w not in ({STOP_LIST})), ' ')"
    )


def article(html: str) -> str:
    return rf"regexp_extract({visible(html)}, '(?is)<article(?:\s[^>]*)?>(.*?)(?:</article\s*>|\z)', 1)"


def blocks(content: str) -> str:
    x = f"regexp_replace({content}, {quoted(BLOCK_OPEN)}, chr(2), 'g')"
    x = f"regexp_replace({x}, {quoted(BLOCK_CLOSE)}, chr(3), 'g')"
    x = f"regexp_replace({x}, {quoted(TAG)}, chr(1), 'g')"
    return (
        rf"list_filter(list_transform(regexp_extract_all({x}, '\x02([^\x02\x03]*)', 1), "
        f"lambda b: {nodes('b', '')}), lambda b: b <> '')"
    )


def joined(items: str, sep: str = "|") -> str:
    return f"array_to_string({items}, {quoted(sep)})"


# Posts made from the documents table; see fixtures.posts.
POSTS = """posts AS (
  SELECT doc_id AS seq, '/p/' || doc_id AS "urlId", md5('/p/' || doc_id) AS uuid,
         strftime(DATE '2024-01-01' + CAST(doc_id % 3650 AS INTEGER), '%Y-%m-%d') AS date,
         '  ' || source || chr(10) || 'desk ' AS author, lines[1] AS title, lines[-1] AS excerpt,
         lines AS body, [lang, source] AS tags, source AS categories
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS lines FROM documents)
)"""

# Greedy packing of sentences, one sentence per step; see extraction.chunk_text.
def chunks(limit: int) -> str:
    return rf"""sents AS (
  SELECT doc_id, string_split(array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), '. '), '. ') AS s
  FROM documents
), counted AS (
  SELECT doc_id, s, list_transform(s, lambda x: len(regexp_extract_all(x, '[^{SPACE}]+'))) AS n FROM sents
), packed AS (
  SELECT doc_id, s, n, 1 AS i, n[1] AS words, 0 AS chunk_idx FROM counted
  UNION ALL
  SELECT doc_id, s, n, i + 1,
         CASE WHEN words + n[i + 1] > {limit} THEN n[i + 1] ELSE words + n[i + 1] END,
         CASE WHEN words + n[i + 1] > {limit} THEN chunk_idx + 1 ELSE chunk_idx END
  FROM packed WHERE i < len(s)
), chunks AS (
  SELECT doc_id, chunk_idx, string_agg(s[i], '. ' ORDER BY i) AS chunk FROM packed GROUP BY doc_id, chunk_idx
)"""
