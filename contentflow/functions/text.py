"""Plain-text column expressions.

Whitespace is meant as Unicode whitespace throughout.  The ``\\s`` of Java (and of RE2) knows
ASCII only and SQL ``trim`` strips blanks only, so the class is spelled out here once.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from contentflow.functions.binding import let

# Unicode whitespace, as a character list and as a regex class body.
SPACES = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)
SPACE = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# How a class is written decides how fast Java tests a character: single Latin-1 characters become one
# table look-up, every range one more call, and a negated union of ranges is ten times slower again.
# So the patterns below settle the common characters first and leave the rare ones to a second test.
_LATIN_SPACE = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0"
_OTHER_SPACE = r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ONE_SPACE = rf"[{_LATIN_SPACE}[[\x{{1680}}-\x{{3000}}]&&[{_OTHER_SPACE}]]]"
NON_SPACE = (
    r"[\x{21}-\x{7e}[\x{a1}-\x{167f}[\x{0}-\x{8}\x{e}-\x{1b}\x{7f}-\x{84}\x{86}-\x{9f}"
    r"\x{1681}-\x{1fff}\x{200b}-\x{2027}\x{202a}-\x{202e}\x{2030}-\x{205e}\x{2060}-\x{2fff}"
    r"\x{3001}-\x{10ffff}]]]"
)
# Neither whitespace nor a lower-case ASCII letter or digit.
_PLAIN = "abcdefghijklmnopqrstuvwxyz0123456789"
NOT_PLAIN = rf"[[^{_PLAIN}{_LATIN_SPACE}]&&[^{_OTHER_SPACE}]]"

# ASCII punctuation.
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""

# English stop words.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
yourselves he him his himself she she's her hers herself it it's its itself they them their
theirs themselves what which who whom this that that'll these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at
by for with about against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don
don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn
doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn
needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()
# What keyword extraction leaves out on top of the stop words.
KEYWORD_STOP_WORDS = STOP_WORDS + list(PUNCTUATION) + ["``", "''"]

# Top-level domains that make a bare word a link.
LINK_DOMAINS = (
    "com org net edu gov mil biz info io co us uk ca de jp fr au ru ch it nl se no es br fi be "
    "at dk pl cz me tv io"
).split()

# A bare ``host.tld`` can only start where a run of non-blanks starts: the greedy run before the
# dot already reaches the last known domain of that run.  Saying so with a look-behind keeps the
# search linear on very long unbroken runs.
LINK = (
    rf"https?://{NON_SPACE}+|www\.{NON_SPACE}+"
    rf"|(?<!{NON_SPACE}){NON_SPACE}+\.(?:{'|'.join(LINK_DOMAINS)})"
)

WORD = r"[\p{L}\p{N}_]{2,}"


def strip(c: Column) -> Column:
    """Trim Unicode whitespace at both ends."""
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Collapse whitespace runs to one blank and trim."""
    return F.btrim(F.regexp_replace(c, f"{ONE_SPACE}+", " "), F.lit(" "))


def split_words(c: Column) -> Column:
    """Split on whitespace runs; blank text gives an empty array."""
    return F.regexp_extract_all(c, F.lit(f"{NON_SPACE}+"), F.lit(0))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"{NON_SPACE}+"))


def candidate_words(c: Column) -> Column:
    """Lower-case words of at least two word characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def clean_text(c: Column) -> Column:
    """Line breaks become blanks, ends are trimmed."""
    return strip(F.translate(c, "\r\n", "  "))


def drop_quotes(c: Column) -> Column:
    """Remove double quotes from each paragraph of an array column."""
    return F.transform(c, lambda p: F.replace(p, F.lit('"'), F.lit("")))


def remove_stopwords(c: Column, words: list[str] = STOP_WORDS) -> Column:
    """Drop stop words from whitespace-separated text; the comparison is case-sensitive."""
    return F.array_join(F.filter(split_words(c), lambda w: ~w.isin(words)), " ")


def special_tokens(c: Column) -> Column:
    """Alphanumeric codes, then numbers, then quoted spans, each in text order."""
    patterns = [r"(?U)\b[a-zA-Z]{2,}\d+\b", r"(?U)\b\d+[.,]?\d*\b", r'"[^"]*"']
    return F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in patterns])


def text_urls(c: Column) -> Column:
    """Links found in running text."""
    return F.regexp_extract_all(c, F.lit(LINK), F.lit(0))


def without_urls(c: Column) -> Column:
    """The text with its links removed."""
    return F.regexp_replace(c, LINK, "")


def keep_keywords(c: Column) -> Column:
    """Drop blank keywords and those that occur inside the punctuation string."""
    return F.filter(
        c, lambda k: (strip(k) != "") & (F.position(k, F.lit(PUNCTUATION)) == 0)
    )


# --- escapes ---------------------------------------------------------------------------------

# Backslash-u escapes: a surrogate pair, or one code unit outside the surrogate range.
_ESCAPE = (
    r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    r"|\\u[0-9a-ce-fA-CE-F][0-9a-fA-F]{3}|\\u[dD][0-7][0-9a-fA-F]{2}"
)


def decode_unicode(c: Column) -> Column:
    """Decode ``\\uXXXX`` escapes; lone surrogates and malformed escapes stay as they are."""
    def piece(p: Column) -> Column:
        units = F.unhex(F.replace(p, F.lit("\\u"), F.lit("")))
        is_escape = p.rlike(f"^(?:{_ESCAPE})$")
        return F.when(is_escape, F.decode(units, "UTF-16BE")).otherwise(p)

    def decoded(x: Column) -> Column:
        pieces = F.regexp_extract_all(x, F.lit(rf"(?s){_ESCAPE}|[^\\]+|\\"), F.lit(0))
        return F.when(x.contains("\\u"), F.array_join(F.transform(pieces, piece), "")).otherwise(x)

    return let(c, decoded)


def unescape_slashes(c: Column, only_urls: bool = False) -> Column:
    """``\\/`` to ``/``; with ``only_urls`` just where the text holds ``://``."""
    fixed = F.replace(c, F.lit("\\/"), F.lit("/"))
    # An escaped link reads ``:\/\/``, so the test looks at the repaired text.
    return F.when(fixed.contains("://"), fixed).otherwise(c) if only_urls else fixed


def drop_invalid_utf8(c: Column) -> Column:
    """Remove byte sequences that are not UTF-8.

    ``make_valid_utf8`` marks them with U+FFFD.  Replacement characters that were in the text
    before are put aside first, so only the marks are removed.
    """
    mark, aside = F.lit(chr(0xFFFD)), chr(0xE000)
    held_aside, held_mark = F.lit(aside + chr(0xE001)), F.lit(aside + chr(0xE002))

    def repaired(x: Column) -> Column:
        y = F.replace(F.replace(x, F.lit(aside), held_aside), mark, held_mark)
        y = F.replace(F.make_valid_utf8(y), mark, F.lit(""))
        y = F.replace(F.replace(y, held_mark, mark), held_aside, F.lit(aside))
        return F.when(F.is_valid_utf8(x), x).otherwise(y)

    return let(c, repaired)


def post_id(url: Column) -> Column:
    """A stable id: the same URL gets the same id on every run and every retry."""
    return F.md5(url)
