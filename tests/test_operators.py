"""Operators on small frames, against brute force where the rule is order-dependent."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from contentflow.operators import analytics, catalog, changes, cleaning, extraction, ordering, pages, selection, views
from contentflow.schemas import POST, RESULT_KEYS
from contentflow.sources import feeds, posts as store, releases


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- selection -------------------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(6))
def test_crawl_until_known(spark, seed):
    rnd = random.Random(seed)
    listed = [(p, f"u{rnd.randrange(30)}", f"t{rnd.randrange(60)}") for p in range(1, 9) for _ in range(4) if not (seed == 5 and p == 4)]
    known = {f"t{rnd.randrange(60)}" for _ in range(seed)}
    df = spark.createDataFrame(listed, "page int, urlId string, title string")
    titles = spark.createDataFrame([(t,) for t in known], "title string")
    got = rows(selection.crawl_until_known(df, titles), "page", "urlId", "title")
    # Rows on the first page of their URL; a page is good if it has such rows and none of them is known.
    first = {u: min(p for p, v, _ in listed if v == u) for _, u, _ in listed}
    fresh = [x for x in listed if first[x[1]] == x[0]]
    good = {p for p, _, _ in fresh} - {p for p, _, t in fresh if t in known} | {1}
    run = max(n for n in range(1, 9) if set(range(1, n + 1)) <= good)
    assert got == sorted(x for x in fresh if x[0] <= run)


def test_crawl_reads_the_posts_twice(spark, tmp_path, monkeypatch):
    """Once for the summary of the pages, once for the rows that are taken."""
    path, plans = str(tmp_path / "crawled"), []
    spark.createDataFrame([(p, f"u{p}", f"t{p}") for p in range(1, 9)], "page int, urlId string, title string").write.parquet(path)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    staged = selection.stage
    monkeypatch.setattr(selection, "stage", lambda df, name: plans.append(plan(df)) or staged(df, name))
    known = spark.createDataFrame([("t6",)], "title string")
    out = selection.crawl_until_known(spark.read.parquet(path), known)
    assert rows(out, "page") == [(p,) for p in range(1, 6)]
    columns = [p for p in [*plans, plan(out)] if "title#" in p.split("Relation")[-1]]
    assert sum(p.count("Relation [page#") for p in [*plans, plan(out)]) == 2 and columns


def test_a_url_on_most_pages(spark):
    listed = [(p, "hot", "h") for p in range(1, 400)] + [(p, f"u{p}", f"t{p}") for p in range(1, 400) if p != 300]
    df = spark.createDataFrame(listed, "page int, urlId string, title string")
    got = selection.crawl_until_known(df, df.limit(0).select("title")).groupBy("urlId").count().collect()
    assert len(got) == 300 and {r["count"] for r in got} == {1}


def test_first_page_may_hold_known_titles(spark):
    df = spark.createDataFrame([(1, "a", "known"), (2, "b", "x"), (3, "c", "known"), (4, "d", "y")], "page int, urlId string, title string")
    known = spark.createDataFrame([("known",)], "title string")
    assert rows(selection.crawl_until_known(df, known), "urlId") == [("a",), ("b",)]


def test_high_water(spark):
    new = spark.createDataFrame([(1, "2024-01-02"), (2, "2024-01-03"), (3, "N/A"), (4, None)], "id int, date string")
    old = spark.createDataFrame([(9, "2024-01-02"), (8, "N/A")], "id int, date string")
    assert rows(selection.after_high_water(new, old), "id") == [(2,), (3,), (4,)]
    assert selection.after_high_water(new, old.limit(0)).count() == 4


def test_new_by_any_id(spark):
    new = spark.createDataFrame([("a", None), (None, "b"), ("c", "x")], "uuid string, unique_id string")
    old = spark.createDataFrame([("b",), ("x",)], "unique_id string")
    assert rows(selection.new_by_any_id(new, old).where("uuid is not null"), "uuid") == [("a",), ("c",)]


def test_dedupe_keeps_first(spark):
    df = spark.createDataFrame([(3, "u", "t"), (1, "u", "t"), (2, "u", "s"), (4, None, "t"), (5, None, "t")], "seq int, urlId string, title string")
    assert rows(selection.dedupe_posts(df), "seq") == [(1,), (2,), (4,)]


def test_merge_twice_is_merge_once(spark):
    new = spark.createDataFrame([("a",), ("b",)], "urlId string")
    old = spark.createDataFrame([("b",), ("c",)], "urlId string")
    once = changes.merge_new_first(new, old, "urlId")
    assert rows(once, "batch", "urlId") == [(0, "a"), (1, "b"), (1, "c")]
    twice = changes.merge_new_first(new, once.drop("batch"), "urlId")
    assert rows(twice, "urlId") == rows(once, "urlId")


# --- ordered operators -----------------------------------------------------------------------

@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_with_previous_on_a_hot_key(spark, buckets):
    rnd = random.Random(1)
    data = [(i, "hot" if i % 3 == 0 else f"k{rnd.randrange(20)}", rnd.randrange(2)) for i in range(600)]
    df = spark.createDataFrame(data, "seq long, key string, v int")
    got = {r.seq: r.before for r in ordering.with_previous(df, ["key"], "seq", "v", "before", buckets).collect()}
    last, want = {}, {}
    for seq, key, v in data:
        want[seq], last[key] = last.get(key), v
    assert got == want


@pytest.mark.parametrize("buckets", [1, 5, 100])
def test_global_rank(spark, buckets):
    rnd = random.Random(2)
    data = [(i, None if i % 17 == 0 else 2 if i % 3 == 0 else rnd.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(data, "seq long, g int")
    got = {r.seq: r.rank for r in ordering.with_rank(df, F.col("g"), True, "seq", buckets=buckets).collect()}
    order = sorted(data, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    assert got == {seq: i + 1 for i, (seq, _) in enumerate(order)}


def test_ranges_hold_even_numbers_of_rows(spark):
    """One outlier among 100,000 rows, gaps, and a value that many rows share."""
    n = 100_000
    seq = F.when(F.col("id") == 7, 10**15).when(F.col("id") < n / 2, F.col("id")).otherwise(F.col("id") * 1000)
    df = spark.range(n).withColumn("seq", seq)
    sizes = [r["count"] for r in ordering.with_bucket(df, "seq", 512).groupBy("_bucket").count().collect()]
    assert sum(sizes) == n and len(sizes) > 480 and max(sizes) <= 3 * n / 512
    tied = ordering.with_bucket(df.withColumn("seq", F.least("seq", F.lit(500))), "seq", 64).groupBy("seq").agg(F.countDistinct("_bucket").alias("b"))
    assert tied.where("b > 1").count() == 0 and ordering.with_bucket(df.limit(0), "seq", 8).count() == 0


def test_ordered_operators_with_an_outlier(spark):
    rnd = random.Random(5)
    numbers = sorted(rnd.sample(range(10**6), 3000)) + [10**15]
    data = [(x, "hot" if i % 3 else f"k{rnd.randrange(9)}", rnd.randrange(2)) for i, x in enumerate(numbers)]
    df = spark.createDataFrame(data, "seq long, key string, v int")
    last, want = {}, {}
    for seq, key, v in data:
        want[seq], last[key] = last.get(key), v
    assert {r.seq: r.before for r in ordering.with_previous(df, ["key"], "seq", "v", "before").collect()} == want
    ranks = {r.seq: r.rank for r in ordering.with_rank(df, F.col("v"), False, "seq").collect()}
    assert ranks == {x[0]: i for i, x in enumerate(sorted(data, key=lambda x: (x[2], x[0])), 1)}


def test_newest_first_puts_bad_dates_last(spark):
    df = spark.createDataFrame([(1, "N/A"), (2, "2024-01-01"), (3, "2024-05-01"), (4, "2024-01-01")], "seq long, date string")
    got = {r.seq: r.rank for r in views.newest_first(df).collect()}
    assert got == {3: 1, 2: 2, 4: 3, 1: 4}


@pytest.mark.parametrize("seed", range(3))
def test_changes_follow_the_last_change_of_a_key(spark, seed):
    rnd = random.Random(seed)
    target = [(k, f"t{k}") for k in range(0, 20, 2)]
    feed = [
        (i, rnd.choice(["upsert", "delete"]), 7 if rnd.random() < 0.4 else rnd.randrange(25), rnd.choice([f"p{i}", None]))
        for i in range(200)
    ]
    t = spark.createDataFrame(target, "key int, payload string")
    c = spark.createDataFrame(feed, "seq long, op string, key int, payload string")
    # A key's row is that of its last change; a key without changes keeps its own.
    history = {k: [x for x in feed if x[2] == k] for k in {x[2] for x in feed}}
    want = {(k, v) for k, v in target if k not in history} | {(k, h[-1][3]) for k, h in history.items() if h[-1][1] == "upsert"}
    assert {(r.key, r.payload) for r in changes.apply_changes(t, c, "key").collect()} == want
    # A delete misses behind a delete, or as the first change of a key that the target lacks.
    stored = dict(target)
    gone = [h[i][0] for h in history.values() for i in range(len(h)) if h[i][1] == "delete" and (h[i - 1][1] == "delete" if i else h[i][2] not in stored)]
    assert sorted(seq for seq, _ in rows(changes.delete_misses(t, c, "key"), "seq", "key")) == sorted(gone)


def test_diff_order(spark):
    feed = [(0, "delete", 0, 0, "a"), (0, "upsert", 5, 9, "a"), (1, "upsert", 0, 0, "b"), (1, "upsert", 0, 1, "b")]
    c = spark.createDataFrame(feed, "diff_idx int, op string, file_idx int, line_idx int, key string")
    last = changes.latest_changes(changes.linearize(c), "key")
    # Inside a diff the delete files come after all update files.
    assert rows(last, "key", "op", "line_idx") == [("a", "delete", 0), ("b", "upsert", 1)]


# --- pages and feeds -------------------------------------------------------------------------

def test_cards_with_missing_parts(spark):
    html = """<article class="blog-basic-grid--container"><a href="/p/1"><h1 class="blog-title"> T &amp; U </h1></a>
    <time>3/4/69</time><span class="blog-author"></span></article>
    <article class="x"><a href="/no">n</a></article>
    <article class="a blog-basic-grid--container b"><a href="/p/2">x</a><time> 3/4/24</time></article>"""
    df = spark.createDataFrame([(html,)], "html string")
    got = [r.asDict() for r in pages.article_cards(df).orderBy("card_idx").drop("card_idx", "uuid").collect()]
    assert got == [
        {"urlId": "/p/1", "date": "1969-03-04", "author": "", "title": "T & U", "excerpt": "N/A", "categories": "N/A"},
        {"urlId": "/p/2", "date": "N/A", "author": "N/A", "title": "N/A", "excerpt": "N/A", "categories": "N/A"},
    ]


def test_posts_of_failed_pages_are_empty(spark):
    wrapper = '<div class="blog-item-content-wrapper"><p>see www.x.org now</p><a href="https://o">o</a></div>'
    cards = spark.createDataFrame([("/1", "a"), ("/2", "b"), ("/3", "c")], "urlId string, title string")
    fetched = spark.createDataFrame([("/1", wrapper), ("/2", None)], "url string, html string")
    got = {r.urlId: (r.body, r.images, r.tags, r.references) for r in pages.assemble_posts(cards, pages.page_content(fetched, "https://s")).collect()}
    assert got == {"/1": (["see  now"], [], [], ["https://o", "www.x.org"]), "/2": ([], [], [], []), "/3": ([], [], [], [])}


def test_feed_defaults_and_files(spark, tmp_path):
    item = '<item rdf:about="http://r/1"><title>A</title><dc:date>2024</dc:date><category>c</category><category>d</category></item>'
    rss = f'<rss><channel><title>f</title>{item}<item><link> http://l </link><description>&lt;p&gt;</description></item></channel></rss>'
    df = spark.createDataFrame([(rss,)], "xml string")
    want = [("A", "2024", "c", "No summary", "http://r/1"), ("No title", "No date", "Uncategorized", "<p>", "http://l")]
    assert rows(feeds.rss_items(df), "title", "date", "category", "summary", "link") == want
    (tmp_path / "f.xml").write_text(rss.replace("<rss>", '<rss xmlns:rdf="r" xmlns:dc="d">'))
    assert rows(feeds.read_rss(spark, str(tmp_path)), "title", "date", "category", "summary", "link") == want


def test_store_round_trip_and_missing_path(spark, tmp_path):
    assert store.read_posts(spark, str(tmp_path / "none")).schema == POST
    post = {f.name: None for f in POST} | {"urlId": "/é", "body": ["a", "ü"]}
    df = spark.createDataFrame([post], POST)
    store.write_posts(df, str(tmp_path / "s"))
    assert store.read_posts(spark, str(tmp_path / "s")).collect() == df.collect()
    (tmp_path / "a.json").write_text('[{"urlId": "/1"},\n {"urlId": "/2"}]', encoding="utf-8")
    assert store.read_posts(spark, str(tmp_path / "a.json"), array_file=True).count() == 2


def test_release_catalog_has_a_row_per_file(spark):
    datasets = spark.createDataFrame([("r1", "old"), ("r2", "hot"), ("r2", "one"), ("r2", "none")], "release_id string, name string")
    datasets = datasets.withColumn("description", F.lit("d")).withColumn("readme", F.lit("r"))
    names = [("r2", "hot", f"f{i:03}") for i in range(500)] + [("r2", "one", "x"), ("r1", "old", "o"), ("r1", "hot", "old-file")]
    files = spark.createDataFrame(names, "release_id string, name string, file string")
    got = sorted((r["name"], r["n_files"], r["file"] or "") for r in releases.release_catalog(datasets, files).collect())
    assert got == [("hot", 500, f"f{i:03}") for i in range(500)] + [("none", 0, ""), ("one", 1, "x")]


def test_missing_keys_are_keys(spark):
    target = spark.createDataFrame([(None, "a"), (1, "b")], "key long, payload string")
    feed = spark.createDataFrame([(1, "upsert", None, "c"), (2, "delete", 1, None), (3, "delete", 1, None)], "seq long, op string, key long, payload string")
    assert sorted(map(tuple, changes.apply_changes(target, feed, "key").collect()), key=repr) == [(None, "c")]
    gone = spark.createDataFrame([(1, "delete", None, None), (2, "delete", None, None)], "seq long, op string, key long, payload string")
    assert [tuple(r) for r in changes.delete_misses(target, gone, "key").collect()] == [(2, None)]


def test_vectors_of_any_length(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [10.0, 10.0], None), (3, [0.0, 0.0], 2), (4, [2.0, 0.1], 2), (5, [1.0, 0.0, 0.0], 3)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, author long")
    assert [tuple(r) for r in catalog.recommend(df, "id", 1).collect()] == [(4, 0.9988), (2, 0.7071)]
    assert 2 in [r["id"] for r in catalog.recommend_for_author(df, "id", "author", [1]).collect()]
    long = spark.createDataFrame([(i, [float(i == 1 or j == 127 and i == 2) for j in range(128)], i) for i in (1, 2, 3)], "id long, embedding array<double>, author long")
    assert [tuple(r) for r in catalog.recommend(long, "id", 1, fields=["id", "author"]).collect()] == [(2, 2, 0.0884)]


def test_last_page_has_no_token(spark):
    df = spark.range(1, 6).withColumnRenamed("id", "key")
    assert {r["next_token"] for r in catalog.bulk_page(df, "key", None, 5, []).collect()} == {None}
    assert {r["next_token"] for r in catalog.bulk_page(df, "key", 1, 3).collect()} == {4}


# --- chunks and responses --------------------------------------------------------------------

def test_chunks(spark):
    rnd = random.Random(3)
    bodies = [[], [""], ["a b c d e f g h i j k"], ["x y. z", "q"], ["one. two. three four five six seven eight. nine"]]
    bodies += [[" ".join(rnd.choice(["w", "v.", "u"]) for _ in range(rnd.randrange(30))) for _ in range(4)] for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body array<string>")
    for limit in (1, 5, 1000):
        got = {}
        for r in extraction.chunk_text(df, "id", "body", limit).orderBy("id", "chunk_idx").collect():
            got.setdefault(r.id, []).append(r.chunk)
        assert set(got) == {i for i, b in enumerate(bodies) if b}
        for i, chunks in got.items():
            # The chunks joined give the text; each fits or is one sentence; the next sentence would not have fitted.
            assert ". ".join(chunks) == ". ".join(bodies[i])
            assert all(len(c.split()) <= limit or ". " not in c for c in chunks)
            assert all(len(c.split()) + len(d.split(". ")[0].split()) > limit for c, d in zip(chunks, chunks[1:]))


def test_chunks_of_text(spark):
    df = spark.createDataFrame([(1, "a b. c d. e"), (2, ""), (3, None)], "id int, body string")
    got = rows(extraction.chunk_text(df, "id", "body", 2), "id", "chunk_idx", "chunk")
    assert got == [(1, 0, "a b"), (1, 1, "c d"), (1, 2, "e")]


def test_responses(spark):
    answers = ['{"summary": ["a", "b"], "tldr": "one", "extra": 1}', "not json", '```json\n{"causes": ["x"]}\n```', None, '{"symptoms": [1, 2]}', "{"]
    df = spark.createDataFrame(list(enumerate(answers)), "id int, response string")
    got = {r.id: {k: r[k] for k in RESULT_KEYS if r[k]} for r in extraction.parse_responses(df).collect()}
    assert got == {0: {"summary": ["a", "b"], "tldr": ["one"]}, 1: {}, 2: {"causes": ["x"]}, 3: {}, 4: {"symptoms": ["1", "2"]}, 5: {}}


def test_chunk_results_keep_chunk_order(spark):
    df = spark.createDataFrame([("d", 2, '{"summary": ["c"]}'), ("d", 0, '{"summary": ["a"]}'), ("d", 1, "bad")], "doc string, chunk_idx int, response string")
    merged = extraction.merge_chunk_results(extraction.parse_responses(df), "doc").first()
    assert merged.summary == ["a", "c"] and merged.tldr == []


def test_nested_record_defaults(spark):
    post = {f.name: None for f in POST} | {"uuid": "u", "urlId": "\\/p", "images": ["https:\\/\\/i"]}
    posts = spark.createDataFrame([post], POST)
    none = extraction.merge_chunk_results(extraction.parse_responses(spark.createDataFrame([], "uuid string, chunk_idx int, response string")), "uuid")
    r = extraction.nest_record(posts, none).first()
    assert (r.Metadata.urlId, r.Metadata.title, r.Content.images, r.Content.body, r.Medical.causes) == ("/p", "", ["https://i"], [], [])
    card = views.post_cards(extraction.nest_record(posts, none)).first()
    assert (card.uuid, card.image) == ("u", "https://i")


# --- text analytics --------------------------------------------------------------------------

def test_keywords_ties_and_blank_text(spark):
    df = spark.createDataFrame([(1, "zeta beta beta alpha"), (2, "the and"), (3, "  ")], "id int, text string")
    lists = {r.id: r.keywords for r in analytics.keyword_lists(df, "id", "text", 2).collect()}
    assert lists == {1: ["beta", "alpha"], 2: [], 3: []}
    assert {r.id: r.summary for r in analytics.keyword_summary(df, "id", "text").collect()}[3] == ""


def test_entities_keep_repeats_and_order(spark):
    df = spark.createDataFrame([(1, "Paris met Rome; paris."), (2, "nothing")], "id int, text string")
    gaz = spark.createDataFrame([("paris", "LOC"), ("rome", "LOC")], "term string, entity_group string")
    got = {r.id: [tuple(e) for e in r.entities] for r in analytics.entity_lists(df, gaz, "id", "text").collect()}
    assert got == {1: [("Paris", "LOC"), ("Rome", "LOC"), ("paris", "LOC")], 2: []}


GAZETTEER = [("york", "LOC"), ("New  York", "LOC"), ("new york city", "ORG"), ("City Paris", "X"), ("St. Louis", "LOC"), ("paris", "LOC"), ("paris", "AAA"), ("b c", "Y"), ("a b", "Z")]


@pytest.mark.parametrize(
    "text, want",
    [("New York beside York", ["New York", "York"]), ("new\n york city paris", ["new york city", "paris"]), ("New, York", ["York"]),
     ("in St. Louis, St Louis", ["St. Louis"]), ("a b c", ["a b"]), ("x b c", ["b c"]), ("New Yorker", []), ("", []), (None, [])],
)
def test_terms_of_several_words(spark, text, want):
    gaz = spark.createDataFrame(GAZETTEER, "term string, entity_group string")
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = analytics.entity_lists(df, gaz, "id", "text").first().entities
    assert [e.word for e in got] == want and all(e.entity_group == "AAA" for e in got if e.word == "paris")


def test_terms_against_a_scan(spark):
    """Long texts, in which many terms overlap: at each word the longest term, then on behind it."""
    rnd = random.Random(9)
    terms = {" ".join(rnd.choices("abcd", k=rnd.randint(1, 4))) for _ in range(25)}
    texts = [rnd.choices("abcde", k=rnd.randint(0, 900)) for _ in range(12)]
    gaz = spark.createDataFrame([(x, "G") for x in terms], "term string, entity_group string")
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "id int, text string")
    want = []
    for i, w in enumerate(texts):
        longest = [max((n for n in range(1, 5) if " ".join(w[j : j + n]) in terms and j + n <= len(w)), default=0) for j in range(len(w))]
        j = 0
        while j < len(w):
            want += [(i, j, " ".join(w[j : j + longest[j]]))] * (longest[j] > 0)
            j += max(longest[j], 1)
    assert rows(analytics.tag_entities(df, gaz, "id", "text"), "id", "pos", "word") == sorted(want)


def test_no_terms_at_all(spark):
    df = spark.createDataFrame([(1, "a b")], "id int, text string")
    assert analytics.entity_lists(df, spark.createDataFrame([], "term string, entity_group string"), "id", "text").first().entities == []


def test_lemmatize_long_text(spark):
    rnd = random.Random(4)
    words = [f"w{rnd.randrange(300)}" for _ in range(3000)]
    lex = spark.createDataFrame([(f"w{i}", f"l{i}") for i in range(0, 300, 2)] + [("w1", "w1")], "word string, lemma string")
    df = spark.createDataFrame([(1, " ".join(words), ["w2 w3", "w4"]), (2, "", [])], "id int, text string, tags array<string>")
    got = {r.id: (r.text, r.tags) for r in cleaning.lemmatize(df, lex, "id", ["text", "tags"]).collect()}
    want = " ".join(f"l{w[1:]}" if int(w[1:]) % 2 == 0 else w for w in words)
    assert got == {1: (want, ["l2 w3", "l4"]), 2: ("", [])}


def test_several_lemmas_and_rows_of_one_key(spark):
    lex = spark.createDataFrame([("axes", "axis"), ("axes", "axe"), ("axes", "axis"), ("cats", "cat")], "word string, lemma string")
    df = spark.createDataFrame([(1, "axes cats"), (1, "cats axes cats")], "id int, text string")
    assert rows(cleaning.lemmatize(df, lex, "id", ["text"]), "text") == [("axe cat",), ("cat axe cat",)]


CLEAN = [
    ("u1", None, "/a", "T one", "Cats met dogs in New York."), ("u1", None, "/a", "T two", "Dogs slept."), ("u1", None, "/a", "T one", "again"),
    (None, "x1", "/b", "B", "Cats"), (None, "x2", "/c", "B", "Dogs"), (None, "x3", None, None, ""), (None, "gone", "/d", "D", "stored already"), ("u9", None, "/e", "", "York"),
]


def test_the_cleaning_flow_keeps_one_row_per_post(spark):
    """Repeated URLs and ids, missing ids, URLs and titles, several lemmas of a word."""
    from contentflow.plans.cleaner import refresh_cleaned

    raw = [(i, u, x, "2024-01-02", "An", url, title, "e", [body], ["topic"], "c") for i, (u, x, url, title, body) in enumerate(CLEAN)]
    raw = spark.createDataFrame(raw, "seq int, uuid string, unique_id string, date string, author string, urlId string, title string, excerpt string, body array<string>, tags array<string>, categories string")
    stored = spark.createDataFrame([("gone", "old", "s")], "unique_id string, title string, summary string")
    gaz = spark.createDataFrame([("new york", "LOC"), ("york", "LOC"), ("cat", "PET")], "term string, entity_group string")
    lex = spark.createDataFrame([("cats", "cat"), ("dogs", "dog"), ("dogs", "doggy")], "word string, lemma string")
    store, audit = refresh_cleaned(raw, stored, gaz, lex)
    got = {r.seq: r for r in store.where("batch = 0").collect()}
    assert sorted(got) == [0, 1, 3, 4, 5, 7] and store.count() == 7 and audit.count() == 0
    assert [[e.word for e in got[i].entities] for i in (0, 1, 3, 4, 5, 7)] == [["cat", "new york"], [], ["cat"], [], [], ["york"]]
    assert got[1].body == "dog slept" and set(got[1].keywords) == {"topic", "dog", "slept"} and got[5].summary == "" and got[5].keywords == ["topic"]
    assert tuple(store.where("batch = 1").select("unique_id", "title", "summary").first()) == ("gone", "old", "s")


def test_audit_of_nested_columns(spark):
    df = spark.range(2).withColumn("bad", F.when(F.col("id") == 1, F.unhex(F.lit("C3")).cast("string")).otherwise(F.lit("fine")))
    deep = F.struct(F.array(F.struct(F.lit("ok").alias("t")), F.lit(None), F.struct(F.col("bad").alias("t"))).alias("l"), F.lit(None).cast("string").alias("n"))
    named = F.create_map(F.lit("k"), F.array("bad"), F.col("bad"), F.array(F.lit("v")))
    df = df.select("id", deep.alias("deep"), named.alias("m"), F.lit(None).cast("array<string>").alias("none"), F.lit(1).alias("n"))
    assert rows(cleaning.encoding_audit(df, "id"), "id", "path") == [(1, "deep.l[2].t"), (1, "m.keys[1]"), (1, "m.values[0][0]")]
    assert cleaning.encoding_audit(df, "id", ["n"]).count() == 0 and cleaning.encoding_audit(df, "id", ["m"]).count() == 2


def test_diff_flow(spark):
    from contentflow.plans.release import apply_diffs

    feed = [
        (0, "delete", 0, 0, "a", None), (0, "upsert", 1, 3, "a", "1"), (0, "upsert", 0, 0, "b", "2"),
        (1, "delete", 0, 0, "c", None), (1, "delete", 0, 1, "a", None), (1, "upsert", 0, 0, "b", "3"),
    ]
    c = spark.createDataFrame(feed, "diff_idx int, op string, file_idx int, line_idx int, key string, payload string")
    target = spark.createDataFrame([("c", "0"), ("d", "9")], "key string, payload string")
    table, missed = apply_diffs(target, c, "key")
    assert rows(table, "key", "payload") == [("b", "3"), ("d", "9")]
    assert rows(missed, "key") == [("a",)]


def test_lines_of_diff_files_are_numbered_across_splits(spark, tmp_path):
    """Files that are read in many splits, with blank lines, a compressed one and an empty one."""
    rnd = random.Random(3)
    lines = {"u b.json": 400, "a.json": 1, "d.json": 150, "none.json": 0}
    for name, n in lines.items():
        text = "".join(json.dumps({"key": f"{name}{i}", "payload": "x" * rnd.randrange(60)}) + "\n" + "\n" * (i % 7 == 0) for i in range(n))
        (tmp_path / name).write_text(text)
    with gzip.open(tmp_path / "z.json.gz", "wt") as f:
        f.write("".join(json.dumps({"key": f"z{i}", "payload": None}) + "\n" for i in range(30)))
    listed = [(0, "upsert", 1, "u b.json"), (0, "upsert", 0, "a.json"), (0, "delete", 0, "d.json"), (1, "upsert", 0, "none.json"), (1, "upsert", 1, "z.json.gz")]
    files = spark.createDataFrame([(d, op, i, str(tmp_path / f)) for d, op, i, f in listed], "diff_idx int, op string, file_idx int, path string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        read = releases.read_diff_lines(spark, files, "key string, payload string")
        got = rows(read, "diff_idx", "op", "file_idx", "line_idx", "key")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(d, op, i, k + (0 if f.startswith("z") else (k + 6) // 7), f"{f.split('.')[0] if f.startswith('z') else f}{k}")
            for d, op, i, f in listed for k in range(30 if f.startswith("z") else lines[f])]
    assert got == sorted(want)
    assert releases.read_diff_lines(spark, files.limit(0), "key string, payload string").columns == read.columns
    (tmp_path / "bad.json").write_text("{\n")
    bad = spark.createDataFrame([(0, "upsert", 0, str(tmp_path / "bad.json"))], files.schema)
    with pytest.raises(Exception, match="(?i)malformed"):
        releases.read_diff_lines(spark, bad, "key string")


def test_written_diffs_are_applied_in_order(spark, tmp_path):
    from contentflow.plans.release import apply_diffs

    parts = {(0, "upsert", 0): "aab", (0, "delete", 0): "bx", (1, "upsert", 0): "c", (1, "upsert", 1): "b", (1, "delete", 0): "aa"}
    for (d, op, i), keys in parts.items():
        (tmp_path / f"{d}{op}{i}").write_text("".join(json.dumps({"key": k, "payload": f"{d}.{n}"}) + "\n" for n, k in enumerate(keys)))
    files = spark.createDataFrame([(*k, str(tmp_path / "{}{}{}".format(*k))) for k in parts], "diff_idx int, op string, file_idx int, path string")
    target = spark.createDataFrame([("x", "0"), ("y", "0")], "key string, payload string")
    table, missed = apply_diffs(target, releases.read_diff_lines(spark, files, "key string, payload string"), "key")
    assert rows(table, "key", "payload") == [("b", "1.0"), ("c", "1.0"), ("y", "0")]
    assert rows(missed, "key") == [("a",)]


def test_open_requests_are_those_past_the_mark(spark):
    from contentflow.plans.blog import nested_records, open_requests

    posts = [{f.name: None for f in POST} | {"uuid": f"u{i}", "date": f"2024-01-0{i}", "body": ["a b", "c"]} for i in (1, 2, 3)]
    df = spark.createDataFrame(posts, POST)
    no_answers = spark.createDataFrame([], "uuid string, chunk_idx int, response string")
    done = nested_records(df.where("date < '2024-01-03'"), no_answers)
    asked = open_requests(df, done, max_words=2).collect()
    assert sorted((r.uuid, r.chunk_idx) for r in asked) == [("u3", 0), ("u3", 1)]
    assert sorted(r.request.split("Passage:\n")[1].split("\n")[0] for r in asked) == ["a b", "c"]


def test_rows_without_a_key_are_kept_and_merged_once(spark):
    posts = spark.createDataFrame([(1, None, "t"), (2, None, "t"), (2, "u", "s")], "page int, urlId string, title string")
    assert selection.first_page_only(posts).count() == 2
    new = posts.select("urlId").distinct()
    once = changes.merge_new_first(new, new.where("urlId = 'u'"), "urlId").drop("batch")
    assert changes.merge_new_first(new, once, "urlId").count() == once.count() == 2


def test_repeated_json_keys_and_fetches(spark):
    df = spark.createDataFrame([(1, '{"summary": ["a"], "summary": ["b"], "tldr": "t"}')], "id int, response string")
    r = extraction.parse_responses(df).first()
    assert r["summary"] == ["b"] and r["tldr"] == ["t"]
    fetched = spark.createDataFrame([("u", "", 3), ("u", "<p>old</p>", 1), ("u", "<p>n</p>", 2), ("v", None, 1)], "url string, html string, at int")
    assert sorted(map(tuple, pages.newest_fetch(fetched, order="at").select("url", "html").collect())) == [("u", "<p>n</p>"), ("v", None)]


def test_keywords_of_repeated_and_missing_keys(spark):
    """Words are counted over all rows of a key; frequent and rare words are weighed alike."""
    from math import log

    n = 3 * analytics.FREQUENT
    spread = spark.range(n).selectExpr("id", "concat('common w', id, CASE WHEN id < 2 THEN ' twice' ELSE '' END) AS text")
    rows = spark.createDataFrame([(0, "common again"), (None, "lone pair"), (None, "pair")], "id long, text string")
    df = spread.unionAll(rows)
    got = analytics.keywords(df, "id", "text")
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in text.split("WindowGroupLimit")[-1], "a count is shuffled before its top n are taken"
    idf = lambda d: log((n + 3 + 1) / (d + 1)) + 1
    told = {(r.id, r.word): r.score for r in got.where("id < 2 OR id IS NULL").collect()}
    want = {(0, "common"): 2 * idf(n), (0, "w0"): idf(1), (0, "twice"): idf(2), (1, "common"): idf(n), (1, "w1"): idf(1),
            (1, "twice"): idf(2), (None, "lone"): idf(1), (None, "pair"): 2 * idf(1)}
    assert told == {k: pytest.approx(v, abs=2e-6) for k, v in want.items()}


def test_terms_are_put_together_without_a_function_per_run(spark):
    gaz = spark.createDataFrame([("big  apple", "LOC"), ("apple pie shop", "ORG"), ("pie", "MISC")], "term string, entity_group string")
    df = spark.createDataFrame([(1, "Big\t\n Apple pie  shop, pie."), (2, "apple  pie\nshop"), (3, None)], "id long, text string")
    got = analytics.tag_entities(df, gaz, "id", "text")
    assert "flatten(transform" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [
        (1, 0, "Big Apple", "LOC"), (1, 2, "pie", "MISC"), (1, 4, "pie", "MISC"), (2, 0, "apple pie shop", "ORG")]
    assert analytics.tag_entities(df, gaz.limit(0), "id", "text").count() == 0


def test_polished_texts_are_made_once(spark):
    rows = spark.createDataFrame([(1, "The <b>Cats</b> &amp; dogs"), (2, None), (2, "dogs")], "id long, title string")
    lexicon = spark.createDataFrame([("cats", "cat"), ("dogs", "dog")], "word string, lemma string")
    got = cleaning.polish_columns(rows, ["title"], lexicon, "id")
    # Both the words and the texts come from what was written.
    assert "regexp_replace" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.id, r.title) for r in got.where("id = 1 OR title IS NULL").collect()} <= {(1, "cat dog"), (2, None), (2, "")}
    assert [r.title for r in got.where("id = 1").collect()] == ["cat dog"]
