"""Markup column expressions: HTML in, text, attributes and text blocks out.

Everything that is not text (tags, comments, scripts, styles) is first replaced by a one-character
mark, so a text node is what lies between two marks.  Entities are decoded once, after the tags are
gone; a decoded ``&lt;p&gt;`` is therefore text and never a tag.
"""

from __future__ import annotations

import json
import re
from html.entities import html5

from pyspark.sql import Column, functions as F

from contentflow.functions.binding import let
from contentflow.functions.text import NOT_PLAIN, squeeze, strip

REPLACEMENT = chr(0xFFFD)
MARK, OPEN, CLOSE = "\x01", "\x02", "\x03"

INVISIBLE = (
    r"(?is)<(?:script\b[^>]*>.*?(?:</script\s*>|\z)"
    r"|style\b[^>]*>.*?(?:</style\s*>|\z)"
    r"|!--.*?(?:-->|\z))"
)
# Inside a tag: a quoted value, which may hold ">", follows a "="; a quote elsewhere is a character like any other.
ATTRS = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+"""
TAG = rf"<[/!?]?[A-Za-z]{ATTRS}>"
# The elements whose text makes a paragraph of the body.
BLOCK_TAGS = ["p", "h1", "h2", "h3", "h4", "ol", "ul"]
_BLOCKS = "|".join(BLOCK_TAGS)
BLOCK_OPEN = rf"(?i)<(?:{_BLOCKS})(?:[\s/]{ATTRS})?>"
BLOCK_CLOSE = rf"(?i)</(?:{_BLOCKS})\s*>"


# --- entities --------------------------------------------------------------------------------

def _entity_tables() -> str:
    """Named and numeric special cases as JSON, keyed by first character, then by name.

    Map lookups scan their keys, so two levels keep a lookup to about a hundred comparisons.
    Numbers 128 to 159 mean Windows-1252 where that page defines them.
    """
    table: dict[str, dict[str, str]] = {}
    for name, text in html5.items():
        table.setdefault(name[0], {})[name] = text
    numbers = {0: REPLACEMENT, 13: "\r"}
    for code in range(128, 160):
        try:
            numbers[code] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            numbers[code] = chr(code)
    table["#"] = {str(k): v for k, v in numbers.items()}
    return json.dumps(table)


_TABLES = _entity_tables()
# Names that are also decoded without their semicolon, longest first.
_BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
_PIECE = r"(?s)&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z][A-Za-z0-9]{1,31};?|[^&]+|&"


def _decode_number(p: Column, tables: Column) -> Column:
    digits = F.regexp_extract(p, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
    base16 = F.lower(F.substring(p, 3, 1)) == "x"

    def code_of(text: Column) -> Column:
        return (
            F.when(text == "", F.lit(0).cast("bigint"))
            .when(F.length(text) > 8, F.lit(0x110000).cast("bigint"))
            .when(base16, F.conv(text, 16, 10).cast("bigint"))
            .otherwise(text.try_cast("bigint"))
        )

    def character(code: Column) -> Column:
        low = F.pmod(code, F.lit(0x10000))
        nothing = (
            code.between(0x1, 0x8) | (code == 0xB) | code.between(0xE, 0x1F) | (code == 0x7F)
            | code.between(0xFDD0, 0xFDEF) | low.isin(0xFFFE, 0xFFFF)
        )
        return F.coalesce(
            F.try_element_at(F.try_element_at(tables, F.lit("#")), code.cast("string")),
            F.when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), REPLACEMENT)
            .when(nothing, F.lit(""))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")),
        )

    return let(let(digits, code_of), character)


def _decode_name(p: Column, tables: Column) -> Column:
    """A known name, else the longest known bare name it starts with, else the text as it is."""
    name = F.substr(p, F.lit(2))
    bare = F.regexp_extract(name, f"^({_BARE})", 1)
    return let(
        F.try_element_at(tables, F.substring(name, 1, 1)),
        lambda names: F.coalesce(
            F.try_element_at(names, name),
            F.when(
                bare != "",
                F.concat(F.try_element_at(names, bare), F.substr(name, F.length(bare) + F.lit(1))),
            ),
            p,
        ),
    )


def unescape_html(c: Column) -> Column:
    """Decode all HTML5 character references, once."""

    def decoded(x: Column) -> Column:
        # Constant folding turns the tables into one literal.
        tables = F.from_json(F.lit(_TABLES), "map<string,map<string,string>>")
        pieces = F.regexp_extract_all(x, F.lit(_PIECE), F.lit(0))

        def piece(p: Column, known: Column) -> Column:
            return (
                F.when(~p.startswith("&") | (p == "&"), p)
                .when(p.startswith("&#"), _decode_number(p, known))
                .otherwise(_decode_name(p, known))
            )

        text = let(tables, lambda known: F.array_join(F.transform(pieces, lambda p: piece(p, known)), ""))
        return F.when(x.contains("&"), text).otherwise(x)

    return let(c, decoded)


def clean_url(c: Column) -> Column:
    """Decode entities and drop every backslash."""
    return F.replace(unescape_html(c), F.lit("\\"), F.lit(""))


# --- text ------------------------------------------------------------------------------------

def mark_invisible(html: Column) -> Column:
    """Replace scripts, styles and comments by a mark."""
    return F.regexp_replace(html, INVISIBLE, MARK)


def mark_tags(html: Column) -> Column:
    """Replace everything that is not text by a mark."""
    return F.regexp_replace(mark_invisible(html), TAG, MARK)


def join_nodes(text: Column, sep: str) -> Column:
    """Text nodes between the marks trimmed, empty ones left out, joined."""
    parts = F.transform(F.split(text, MARK), strip)
    return F.array_join(F.filter(parts, lambda x: x != ""), sep)


def _nodes(marked: Column, sep: str) -> Column:
    return join_nodes(unescape_html(marked), sep)


def html_text(html: Column, sep: str = " ") -> Column:
    """Markup to text: every text node trimmed, joined by ``sep``."""
    return _nodes(mark_tags(html), sep)


def raw_text(html: Column) -> Column:
    """Markup to text as written: text nodes neither trimmed nor separated."""
    return unescape_html(
        F.regexp_replace(F.regexp_replace(html, INVISIBLE, ""), TAG, "")
    )


def normalize_plain(c: Column) -> Column:
    """Lower-case, drop everything but ASCII letters, digits and whitespace, collapse whitespace."""
    return squeeze(F.regexp_replace(F.lower(c), f"{NOT_PLAIN}+", ""))


def normalize_text(c: Column) -> Column:
    """``normalize_plain`` after stripping markup.

    Patterns such as numbers are not restored afterwards: their normalised form is already in the
    text (see ``special_tokens`` for collecting them)."""
    return normalize_plain(raw_text(c))


# --- elements --------------------------------------------------------------------------------

# One attribute of a tag: a name, and a value after "=", which may be quoted.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
_PAIR = rf"""[^\s=/>][^\s=/>]*+(?:\s*+=\s*+{_VALUE}?+)?+"""


def _class_pair(token: str) -> str:
    """A class attribute that has the token among others."""
    t = re.escape(token)
    return rf"""class\s*+=\s*+(?:"(?:[^"]*\s)?{t}(?=[\s"])[^"]*+"|'(?:[^']*\s)?{t}(?=[\s'])[^']*+'|{t}(?=[\s>]))"""


def open_tag(tag: str, css_class: str | None = None, exact_class: str | None = None) -> str:
    """Pattern of an opening tag, by class token or by the whole class attribute.

    Attributes are walked from the left, so neither a ``>`` nor a ``class=`` inside a quoted value misleads it.
    """
    before = rf"<{tag}(?:[\s/]++(?!class[\s=/>]){_PAIR})*+[\s/]++"
    if exact_class is not None:
        return rf"""{before}class\s*+=\s*+(?:"{re.escape(exact_class)}"|'{re.escape(exact_class)}'){ATTRS}>"""
    if css_class is not None:
        return rf"{before}{_class_pair(css_class)}{ATTRS}>"
    return rf"<{tag}(?:\s{ATTRS})?>"


# Elements that have no content and no closing tag.
VOID_TAGS = "area base br col embed hr img input link meta param source track wbr".split()


#: Tags of one inner fold of ``_depths``; the text that a fold builds grows by copying.
_RUN = 512


def _depths(codes: Column) -> Column:
    """The number of open elements behind each tag; ``codes`` are ``name``, ``/name`` and '' as ``outline`` makes them.

    A closing tag closes the nearest open element of its name with all that is open inside, or nothing.  The
    state is the names of the open elements, innermost first, as one text with a "/" before each name and at the end.  A fold in two
    levels: what a step finds is added to a text, and the copying grows with the number of runs.
    """

    def step(acc: Column, e: Column) -> Column:
        stack = acc["stack"]
        # The "/" behind the name tells names apart that begin alike.
        at = F.position(F.concat(e, F.lit("/")), stack)
        return F.struct(
            F.when(e == "", stack)
            .when(~e.startswith("/"), F.concat(F.lit("/"), e, stack))
            .when(stack.startswith(F.concat(e, F.lit("/"))), F.substr(stack, F.length(e) + 1))
            .when(at > 0, F.substr(stack, at + F.length(e)))
            .otherwise(stack)
            .alias("stack"),
            # What was open before this tag: the state behind a tag is told by the next step.
            F.concat(acc["outs"], _names_in(stack), F.lit(",")).alias("outs"),
        )

    def run(acc: Column, k: Column) -> Column:
        return F.aggregate(F.slice(codes, k * _RUN + 1, F.lit(_RUN)), acc, step)

    start = F.struct(F.lit("/").alias("stack"), F.lit("").alias("outs"))
    runs = F.sequence(F.lit(0), F.floor((F.size(codes) - 1) / _RUN).cast("int"))
    folded = let(F.aggregate(runs, start, run), lambda d: F.concat(d["outs"], _names_in(d["stack"])))
    told = F.split(folded, ",").cast("array<int>")
    return F.when(F.size(codes) > 0, let(told, lambda d: F.slice(d, F.lit(2), F.size(d)))).otherwise(F.array().cast("array<int>"))


def _names_in(stack: Column) -> Column:
    return (F.length(stack) - F.length(F.replace(stack, F.lit("/"), F.lit(""))) - 1).cast("string")


def outline(html: Column) -> Column:
    """The tags of the markup in order: ``name, change, tag, text, depth``.

    ``change`` is 1 for a tag that opens an element, -1 for a closing tag and 0 for one that does neither; ``text`` reaches up
    to the next tag; ``depth`` counts the elements open behind the tag.  One pass over the markup, after which every
    element is a slice (see ``elements``).
    """
    visible = mark_invisible(html)
    plain = F.when(html.contains(OPEN) | html.contains(CLOSE), F.translate(visible, OPEN + CLOSE, "")).otherwise(visible)
    marked = F.regexp_replace(plain, f"({TAG})", f"{OPEN}$1{CLOSE}")
    # Each field is one search over the whole markup. What comes before the first tag belongs to no element.
    found = lambda c, pattern: F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    neither = rf"<[!?]|<(?:{'|'.join(VOID_TAGS)})[\s/>]|<(?!/)[^{CLOSE}]*/>{CLOSE}"

    def fields(m: Column) -> Column:
        low = F.lower(m)
        return F.struct(
            found(low, rf"{OPEN}(?:</?([^\s/>!?][^\s/>]*))?").alias("name"),
            found(low, rf"{OPEN}(?:{neither}|<(/?[^\s/>]*))").alias("code"),
            found(m, f"{OPEN}([^{CLOSE}]*)").alias("tag"),
            found(m, f"{CLOSE}([^{OPEN}]*)").alias("text"),
        )

    def entries(f: Column) -> Column:
        change = F.transform(f["code"], lambda e: F.when(e == "", 0).when(e.startswith("/"), -1).otherwise(1))
        return F.arrays_zip(f["name"], change.alias("change"), f["tag"], f["text"], _depths(f["code"]).alias("depth"))

    return let(let(marked, fields), entries)


def has_class(tag: Column, token: str) -> Column:
    # Most tags do not hold the token anywhere; only the others are walked.
    classes = F.concat(F.lit(" "), F.regexp_replace(raw_attr(tag, "class"), r"\s+", " "), F.lit(" "))
    return tag.contains(token) & classes.contains(f" {token} ")


def _starts(o: Column, name: str, css_class: str | None) -> Column:
    """Positions of the opening tags of the matching elements; NULL in place of every other tag."""

    def here(e: Column, i: Column) -> Column:
        of_kind = (e["change"] == 1) & (e["name"] == name)
        return F.when(of_kind & has_class(e["tag"], css_class) if css_class else of_kind, i)

    return F.transform(o, here)


#: Tags behind an opening one that are searched first for the end of its element.
_NEAR = 64


def _element(o: Column, i: Column) -> Column:
    """The entries of the element that opens at ``i``; unclosed ones end with the element around them."""
    depth, last = F.get(o, i)["depth"], F.size(o) - 1

    def behind(upto: Column) -> Column:
        """The first tag up to a place that leaves the element."""
        return F.array_min(F.filter(F.sequence(i + 1, F.greatest(upto, i + 1)), lambda j: F.get(o, j)["depth"] < depth))

    # Most elements hold no other one, then the next tag closes them; most others are short.
    next_ = F.when(F.get(o, i + 1)["depth"] < depth, i + 1)
    end = F.coalesce(next_, behind(F.least(last, i + _NEAR)), behind(last), F.size(o))
    return F.transform(F.sequence(i, F.greatest(end - 1, i)), lambda j: F.get(o, j))


def elements(o: Column, name: str, css_class: str | None = None) -> Column:
    """The matching elements of an outline, nested ones as well: of each its own tag and all tags inside."""
    return F.transform(F.array_compact(_starts(o, name, css_class)), lambda i: _element(o, i))


def first_element(o: Column, name: str, css_class: str | None = None) -> Column:
    """The first matching element of an outline; NULL without one."""
    return let(F.array_min(_starts(o, name, css_class)), lambda i: F.when(i.isNotNull(), _element(o, i)))


def marked_text(element: Column) -> Column:
    """Text of an element as written, its text nodes parted by marks."""
    return F.array_join(F.transform(element, lambda e: e["text"]), MARK)


def wrapper_inner(html: Column, opening: str, tag: str) -> Column:
    """Inner markup of the first matching element with nested elements of the same kind counted.

    The rest of the page is cut before each opening or closing ``tag``; a fold over the pieces
    keeps those up to the balancing close.
    """
    rest = F.try_element_at(F.regexp_extract_all(html, F.lit(rf"(?is){opening}(.*)\z"), F.lit(1)), F.lit(1))
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("kept"))

    def step(acc: Column, p: Column) -> Column:
        change = (
            F.when(p.rlike(rf"(?i)^</{tag}[\s>/]"), F.lit(-1))
            .when(p.rlike(rf"(?i)^<{tag}[\s>/]"), F.lit(1))
            .otherwise(F.lit(0))
        )
        depth = F.when(acc["depth"] == 0, F.lit(0)).otherwise(acc["depth"] + change)
        return F.struct(
            depth.alias("depth"),
            F.when(depth == 0, acc["kept"]).otherwise(acc["kept"] + 1).alias("kept"),
        )

    def balanced(pieces: Column) -> Column:
        return F.array_join(F.slice(pieces, F.lit(1), F.aggregate(pieces, start, step)["kept"]), "")

    def inner(x: Column) -> Column:
        # Most wrappers hold none of their own kind: no fold is needed then.
        simple = F.regexp_extract(x, rf"(?is)^(.*?)(?:</{tag}\s*>|\z)", 1)
        nested = let(F.split(x, rf"(?i)(?=</?{tag}[\s>/])"), balanced)
        return let(simple, lambda s: F.when(s.rlike(rf"(?i)<{tag}[\s>/]"), nested).otherwise(s))

    return let(rest, inner)


def _walk(name: str) -> str:
    """Pattern of a tag up to the end of its attributes; the group holds the value of the last one called ``name``."""
    return rf"(?is)^<[a-z][^\s/>]*+(?:[\s/]++(?:{name}(?![^\s=/>])(?:\s*+=\s*+({_VALUE})?+)?+|{_PAIR}))*+"


def has_attr(tag: Column, name: str) -> Column:
    """Whether an opening tag has the attribute, with or without a value."""
    return tag.rlike(rf"(?is)^<[a-z][^\s/>]*+(?:[\s/]++(?!{name}[\s=/>]){_PAIR})*+[\s/]++{name}[\s=/>]")


def raw_attr(tag: Column, name: str) -> Column:
    """Attribute value of an opening tag as written; '' when absent."""
    value = F.regexp_extract(tag, _walk(name), 1)

    def unquoted(v: Column) -> Column:
        is_quoted = v.startswith('"') | v.startswith("'")
        return F.when(is_quoted, F.substr(v, F.lit(2), F.length(v) - F.lit(2))).otherwise(v)

    return let(value, unquoted)


def attr(tag: Column, name: str) -> Column:
    """Attribute value with its entities decoded."""
    return unescape_html(raw_attr(tag, name))


def tags(html: Column, name: str) -> Column:
    """All opening tags of one kind."""
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{name}(?:\s{ATTRS})?>"), F.lit(0))


def text_blocks(content: Column) -> Column:
    """Text of the block elements in order, empty ones dropped.

    A block ends at the next block tag, opening or closing, so no text comes twice.
    """
    x = F.regexp_replace(mark_invisible(content), BLOCK_OPEN, OPEN)
    x = F.regexp_replace(F.regexp_replace(x, BLOCK_CLOSE, CLOSE), TAG, MARK)
    raw = F.regexp_extract_all(x, F.lit(f"{OPEN}([^{OPEN}{CLOSE}]*)"), F.lit(1))
    return F.filter(F.transform(raw, lambda b: _nodes(b, "")), lambda b: b != "")


def image_sources(content: Column) -> Column:
    """Non-empty ``src`` of the images, in order."""
    return F.filter(
        F.transform(tags(mark_invisible(content), "img"), lambda t: attr(t, "src")),
        lambda s: s != "",
    )


def tag_labels(html: Column) -> Column:
    """Labels of the tag links inside the tag box; without a box an empty array."""
    opening = open_tag("div", exact_class="blog-meta-item blog-meta-item--tags")
    box = outline(wrapper_inner(mark_invisible(html), opening, "div"))
    labels = let(box, lambda o: F.transform(elements(o, "a", "blog-item-tag"), lambda a: _nodes(marked_text(a), "")))
    return F.coalesce(labels, F.array().cast("array<string>"))


def outbound_links(content: Column, site: str) -> Column:
    """Link targets that are neither site-relative nor on the site; order and repeats kept."""
    anchors = F.filter(tags(mark_invisible(content), "a"), lambda t: has_attr(t, "href"))
    return F.filter(
        F.transform(anchors, lambda t: attr(t, "href")),
        lambda h: ~h.startswith("/") & ~h.startswith(site),
    )
