"""Column functions on hand-written values: the semantics decisions and the corner cases."""

import html
import html.parser
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from contentflow.functions import dates, markup, records, text
from contentflow.functions.binding import let
from contentflow.operators import pages


@pytest.mark.parametrize(
    "raw, want",
    [
        ("1/2/68", "2068-01-02"), ("01/02/69", "1969-01-02"), ("12/31/99", "1999-12-31"),
        ("7/4/24", "2024-07-04"), (" 7/4/24", "N/A"), ("13/1/24", "N/A"), ("N/A", "N/A"), (None, "N/A"),
    ],
)
def test_two_digit_years(one, raw, want):
    assert one(dates.parse_us_date, raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [("2024-03-01", "2024-03-01"), ("3/1/2024", "2024-03-01"), ("March 1, 2024", "2024-03-01"),
     ("1 Mar 2024", "2024-03-01"), ("2024-03-01T10:11:12", "2024-03-01"), ("soon", None), ("", None)],
)
def test_standardize_date(one, raw, want):
    assert one(dates.standardize_date, raw) == want


ENTITIES = [
    "a &amp; b", "&amp;lt;", "&lt;p&gt;", "&eacute;&Eacute;", "&copyright;", "&notit;", "&ampere", "&unknown;",
    "&", "&&amp", "&#233;", "&#xE9;", "&#XE9", "&#128;", "&#150;", "&#0;", "&#x110000;", "&#xD800;",
    "&#1;", "&#x1F600;", "&#99999999999999999999;", "&#13;", "&#xFFFE;", "&#", "&#x;", "&#;", "&NotEqualTilde;", "&frac12x",
    "no entity", "", "&nbsp;x",
]


def test_unescape_like_the_standard_library(spark):
    df = spark.createDataFrame([(x,) for x in ENTITIES], "x string")
    got = {r.x: r.y for r in df.select("x", markup.unescape_html(F.col("x")).alias("y")).collect()}
    assert got == {x: html.unescape(x) for x in ENTITIES}


def test_all_named_entities(spark):
    from html.entities import html5

    names = [f"&{n}" for n in html5]
    df = spark.createDataFrame([(x,) for x in names], "x string")
    got = {r.x: r.y for r in df.select("x", markup.unescape_html(F.col("x")).alias("y")).collect()}
    assert got == {x: html.unescape(x) for x in names}


def test_clean_url(one):
    assert one(markup.clean_url, "https:\\/\\/a.b\\/?x=1&amp;y=2") == "https://a.b/?x=1&y=2"


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p><p>no</p>";</script></head>
<body><div class="nav"><p>outside</p></div>
<div class="x blog-item-content-wrapper" id="c"><h1> Head &amp; <em>more</em> </h1><div><p>one <b>two</b></p></div>
<!-- <p>hidden</p> --><p></p><ul><li>a</li><li> b </li></ul><p>open <p>next<br>line</p>
<img src="/a.png"><img><IMG alt=x SRC='b.png?x=1&amp;y=2'><img src=""></div>
<div class="blog-meta-item blog-meta-item--tags"><a class="blog-item-tag" href="/t/1"> Tag <b>One</b></a>
<a class="other" href="/o">no</a><a href="/t/2" class="x blog-item-tag">Two</a></div>
<p>after</p></body></html>"""


def content(c):
    from contentflow.operators.pages import content_of

    return content_of(c)


def test_blocks(one):
    # The unclosed paragraph ends where the next begins; list items stick together.
    assert one(lambda c: markup.text_blocks(content(c)), PAGE) == [
        "Head &more", "onetwo", "ab", "open", "nextline",
    ]


def test_double_escaped_text_is_decoded_once(one):
    page = '<div class="blog-item-content-wrapper"><p>&amp;lt;p&amp;gt; &lt;b&gt;</p></div>'
    assert one(lambda c: markup.text_blocks(content(c)), page) == ["&lt;p&gt; <b>"]


def test_images_tags_links(one):
    assert one(lambda c: markup.image_sources(content(c)), PAGE) == ["/a.png", "b.png?x=1&y=2"]
    assert one(markup.tag_labels, PAGE) == ["TagOne", "Two"]
    assert one(markup.tag_labels, "<p>no box</p>") == []
    links = '<a href="/x">a</a><a href="https://s.it/y">b</a><a href="#z">c</a><a href=\'mailto:q\'>d</a><a name=n>e</a><a href="">f</a>'
    assert one(lambda c: markup.outbound_links(c, "https://s.it"), links) == ["#z", "mailto:q", ""]


def test_page_without_wrapper(one):
    assert one(content, "<p>x</p>") is None
    assert one(content, None) is None


def test_html_text(one):
    assert one(markup.html_text, "<p>a<em>b</em> c</p><script>x</script><!-- y -->\n d &nbsp;") == "a b c d"
    assert one(markup.html_text, "plain 1 < 2 & 3") == "plain 1 < 2 & 3"


def test_normalize(one):
    raw = "The <b>QUICK</b>, brown fox ran 3.5 km (\"fast\") – BRCA1!"
    assert one(markup.normalize_text, raw) == "the quick brown fox ran 35 km fast brca1"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=40), min_size=1, max_size=40))
def test_normalize_is_idempotent(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    once = df.select(markup.normalize_plain(F.col("x")).alias("a"))
    rows = once.select("a", markup.normalize_plain(F.col("a")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_whitespace_classes_agree(spark):
    codes = [c for c in range(0x3100) if chr(c).isspace() or c % 7 == 0]
    df = spark.createDataFrame([(chr(c),) for c in codes], "x string")
    rows = df.select("x", text.strip(F.col("x")).alias("s"), F.col("x").rlike(text.NON_SPACE).alias("n"),
                     F.col("x").rlike(f"[{text.SPACE}]").alias("p")).collect()
    for r in rows:
        assert (r.s == "") == r.x.isspace() == (not r.n) == r.p


LINKS = [
    "see https://a.b/c and www.x.y, also foo.com! end", "mail me@host.org.", "no link here. None", "www. x", "a.community",
    "x" * 5000 + " http://q " + "y" * 5000, "visit (example.co.uk/path)", ".com alone", "A.COM upper", "one.iowa two.tv", "",
    "xhttp://z.net/q?r.com#s t.de", "http:// www.", "a.com.b.c www.www.x",
]


def test_links_in_text(spark):
    domains = "|".join(text.LINK_DOMAINS)
    pattern = re.compile(rf"(http[s]?://\S+|www\.\S+|\S+\.({domains}))")
    df = spark.createDataFrame([(x,) for x in LINKS], "x string")
    rows = df.select("x", text.text_urls(F.col("x")).alias("u"), text.without_urls(F.col("x")).alias("c")).collect()
    for r in rows:
        assert r.u == [m[0] for m in pattern.findall(r.x)]
        assert r.c == pattern.sub("", r.x)


def test_special_tokens(one):
    raw = 'BRCA1 and é12 x9 "a b" 3.5, 12. (7) p53x "q"'
    want = [m for p in (r"\b[a-zA-Z]{2,}\d+\b", r"\b\d+[.,]?\d*\b", r'"[^"]*"') for m in re.findall(p, raw)]
    assert one(text.special_tokens, raw) == want


def test_stop_words_are_case_sensitive(one):
    assert one(text.remove_stopwords, " The cat  and the\nhat isn't ") == "The cat hat"
    assert one(text.remove_stopwords, "  ") == ""


def test_keep_keywords(one):
    raw = ["a", "", "  ", "(", "()", "#$%", ")(", "a-"]
    import string

    want = [k for k in raw if k.strip() and k not in string.punctuation]
    assert one(text.keep_keywords, raw, "array<string>") == want


@pytest.mark.parametrize(
    "raw, want",
    [("caf\\u00e9", "café"), ("\\ud83d\\ude00!", "😀!"), ("\\u12 \\ud83d x", "\\u12 \\ud83d x"), ("a\\nb", "a\\nb"),
     ("é stays", "é stays"), ("", ""), (None, None)],
)
def test_decode_unicode(one, raw, want):
    assert one(text.decode_unicode, raw) == want


def test_unescape_slashes(one):
    assert one(text.unescape_slashes, "a\\/b") == "a/b"
    assert one(lambda c: text.unescape_slashes(c, True), "a\\/b") == "a\\/b"
    assert one(lambda c: text.unescape_slashes(c, True), "http:\\/\\/x\\/y") == "http://x/y"


def test_drop_invalid_utf8_keeps_genuine_replacement_characters(one):
    genuine = chr(0xFFFD) + chr(0xE000) + chr(0xE001)
    raw = bytearray("aé".encode() + b"\xff" + genuine.encode() + b"\xc3")
    fixed = one(lambda c: text.drop_invalid_utf8(c.cast("string")), raw, "binary")
    assert fixed == "aé" + genuine


def test_clean_text(one):
    assert one(text.clean_text, " a\r\nb\n ") == "a  b"


def test_map_flatten_fill(spark):
    df = spark.createDataFrame(
        [(1, "a", ["b", None], (("c", 2),)), (2, None, None, None)],
        "n int, s string, l array<string>, r struct<q:struct<t:string,m:int>>",
    )
    up = records.map_string_leaves(df, F.upper).collect()
    assert up[0].asDict(True) == {"n": 1, "s": "A", "l": ["B", None], "r": {"q": {"t": "C", "m": 2}}}
    assert up[1].asDict(True) == {"n": 2, "s": None, "l": None, "r": None}
    flat = records.flatten_record(df)
    assert flat.columns == ["n", "s", "l", "r.q.t", "r.q.m"]
    filled = records.fill_missing(flat).orderBy("n").collect()[1].asDict()
    assert filled == {"n": 2, "s": "", "l": [], "r.q.t": "", "r.q.m": None}


@pytest.mark.parametrize(
    "html, want",
    [('<p data-x="1>0">hi</p>', "hi"), ("<p title='a > b'>hi</p>", "hi"), ("<p title=it's>hi</p>", "hi"), ('<a title = "x>y" href="z">b</a>', "b")],
)
def test_values_may_hold_the_end_mark(one, html, want):
    assert one(markup.html_text, html) == want


def test_links_and_images_with_end_marks_in_values(one):
    assert one(markup.image_sources, '<img alt="a > b" src="/x.png">') == ["/x.png"]
    assert one(lambda c: markup.outbound_links(c, "https://s"), '<a title="a > b" href="https://o/">x</a>') == ["https://o/"]
    assert one(markup.text_blocks, '<p title="a > b">hi</p>') == ["hi"]


@pytest.mark.parametrize(
    "text",
    ["2024-03-01T10:11:12Z", "2024-03-01T10:11:12.123", "2024-03-01T10:11:12+00:00", "2024-03-01 10:11", "Fri, 01 Mar 2024 10:11:12 GMT",
     "20240301", "Mar 1 2024", "March 1 2024", "1 Mar 2024"],
)
def test_dates_with_times_and_zones(one, text):
    assert one(dates.standardize_date, text) == "2024-03-01"


class Tree(html.parser.HTMLParser):
    """Texts of the elements of one name and class, found by the standard library's parser."""

    def __init__(self, name, token):
        super().__init__(convert_charrefs=True)
        self.name, self.token, self.open, self.found = name, token, [], []

    def handle_starttag(self, tag, attrs):
        hit = tag == self.name and (self.token is None or self.token in (dict(attrs).get("class") or "").split())
        if tag not in markup.VOID_TAGS:
            texts = [] if hit else None
            if hit:
                self.found.append(texts)
            self.open.append((tag, texts))

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        at = max((i for i, (t, _) in enumerate(self.open) if t == tag), default=None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        for _, texts in self.open:
            if texts is not None:
                texts.append(data)


def test_elements_against_a_parser(spark):
    """Random nesting, unclosed elements, stray closing tags and misleading attributes."""
    rnd = random.Random(12)
    parts = ["x", "y ", " z", "<b>", "</b>", "<div>", "</div>", '<div class="k">', "<div title='a > b class=k'>", '<DIV data-x="1>0" class=" a k b ">',
             "<b class=k>", "</B >", "<br>", "<img alt='</div>'>", "<div/>", "<p>", "</p>", "<!-- <div class=k> -->"]
    pages = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    pages += ["<div class=k>" * 500 + "deep" + "</div>" * 500, "<b>" + "<div class=k>q</div>" * 400]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")

    def texts(o, name, token):
        return F.transform(markup.elements(o, name, token), lambda e: markup.join_nodes(markup.marked_text(e), ""))

    o = F.col("o")
    got = df.select("id", markup.outline(F.col("html")).alias("o")).select(
        "id", texts(o, "div", "k").alias("dk"), texts(o, "div", None).alias("d"), texts(o, "b", "k").alias("bk"),
        markup.join_nodes(markup.marked_text(markup.first_element(o, "div", "k")), "").alias("first"),
    )
    for r in got.collect():
        for column, name, token in (("dk", "div", "k"), ("d", "div", None), ("bk", "b", "k")):
            tree = Tree(name, token)
            tree.feed(pages[r["id"]])
            tree.close()
            want = ["".join(t.strip() for t in e) for e in tree.found]
            # A run of text that a comment or a stray tag parts is several text nodes here and in the parser.
            assert r[column] == want, pages[r["id"]]
        assert r["first"] == (r["dk"][0] if r["dk"] else None)


@pytest.mark.parametrize(
    "tag, name, value, there",
    [('<a title="href=x" data-href=q href = \'y z\'>', "href", "y z", True), ("<a href>", "href", "", True), ("<a data-href=1 >", "href", "", False),
     ('<img src=a alt="src=b" src="c">', "src", "c", True), ("<a title='href=x'>", "href", "", False), ("<a/href=x>", "href", "x", True),
     ('<a href=""q>', "href", "", True)],
)
def test_attributes_are_walked_from_the_left(one, tag, name, value, there):
    assert one(lambda c: markup.raw_attr(c, name), tag) == value and one(lambda c: markup.has_attr(c, name), tag) is there


def test_opening_tags_by_class(one):
    tags = ['<div data-a="x>y" class="a k">', "<div class='k'>", "<div class=k id=1>", '<div title="class=k">', '<div class="kk">', "<div data-class=k>", "<divk class=k>"]
    pattern = "(?is)" + markup.open_tag("div", css_class="k")
    assert [one(lambda c: c.rlike(pattern), t) for t in tags] == [True] * 3 + [False] * 4


def test_nested_parts_of_cards_and_tag_boxes(spark):
    card = """<article class="blog-basic-grid--container"><a title="a > b" href="/p/1">x</a><span class="blog-author">By <span>Jane</span> Doe</span>
    <h1 data-x="1>0" class="blog-title">T</h1><div class="blog-excerpt-wrapper"><div>One</div><div>Two</div></div></article>"""
    box = '<div class="blog-meta-item blog-meta-item--tags"><div><a class="blog-item-tag">A</a></div><div><a class="blog-item-tag">B<i>!</i></a></div></div>'
    r = pages.article_cards(spark.createDataFrame([(card,)], "html string")).first()
    assert (r.urlId, r.author, r.title, r.excerpt) == ("/p/1", "ByJaneDoe", "T", "OneTwo")
    assert pages.page_tags(spark.createDataFrame([(box + '<a class="blog-item-tag">C</a>',)], "html string")).first().tags == ["A", "B!"]


def test_outline_of_names_that_begin_alike(spark):
    """A closing tag meets its own name only, and void and closed tags change nothing; the open names are no list that every tag copies."""
    html = "t<a>1<ab>2</A>3<b/>4<BR>5</br>6<!x>7<a/ >8</ab >9<x-y></x></x-y>"
    df = spark.createDataFrame([(html,), ("no tags",), (None,)], "html string").select(markup.outline(F.col("html")).alias("o"))
    want = [("a", 1, "<a>", "1", 1), ("ab", 1, "<ab>", "2", 2), ("a", -1, "</A>", "3", 0), ("b", 0, "<b/>", "4", 0), ("br", 0, "<BR>", "5", 0), ("br", -1, "</br>", "6", 0),
            ("", 0, "<!x>", "7", 0), ("a", 1, "<a/ >", "8", 1), ("ab", -1, "</ab >", "9", 1), ("x-y", 1, "<x-y>", "", 2), ("x", -1, "</x>", "", 2), ("x-y", -1, "</x-y>", "", 1)]
    got = [r.o for r in df.collect()]
    assert [tuple(e) for e in got[0]] == want and got[1:] == [[], None]
    assert "array_position" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_long_elements_on_long_pages(spark):
    """Elements of more tags than are searched first, and short ones behind them."""
    long = "<p>" + "<i>x</i>" * 100 + "</p>"
    df = spark.createDataFrame([((long + "<p>a<b>c</b></p>") * 30 + "<p>" + "<i>y</i>" * 70,)], "html string")
    cut = let(markup.outline(F.col("html")), lambda o: markup.elements(o, "p"))
    sizes = df.select(F.transform(cut, F.size).alias("n")).first().n
    assert sizes == [201, 3] * 30 + [141]
