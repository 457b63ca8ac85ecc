"""Every operator on awkward rows: nulls, empty and long texts, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from contentflow.llm import bpe, chat, dedup, graph, hmm, language, leaks, passages, personal, quality, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, row string, score double"
WORDS = "river stone cloud amber quiet harbor lantern meadow copper window garden silver thunder velvet marble forest".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ed", "ing", "y"]) + str(r.choice("abcdef")) for _ in range(n))


BASE = prose(1, 120)
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE.replace("amber", "gold", 1), "en", None), (3, BASE, None, "a"),
    (4, None, "en", "b"), (5, "", None, None), (6, " \n\t ", "de", "b"), (None, prose(2, 80), "de", "b"), (7, prose(3, 30000), "en", "a"),
    (8, "one two", "en", "a"), (8, "one two", "en", "a"), (9, "Mail a.b@c.de or +1 (212) 555-0100, card 4111 1111 1111 1111 at 10.0.0.1", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), 5, "x", 0.5) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_numbers_follow_the_words():
    texts = ["A b\x0bc", None, "", "b  a", "x" * 600_000 + " a", "é É"]
    w = tokens.words(pa.array(texts))
    seen = {}
    for i, t in enumerate(texts):
        want = (t or "").encode().lower().split()
        got = w.number[w.at[i] : w.at[i + 1]].tolist()
        assert len(want) == len(got)
        for k, v in zip(want, got, strict=True):
            assert seen.setdefault(k, v) == v
    assert len(set(seen.values())) == len(seen)


def test_slices_change_nothing():
    t = pa.array([prose(i, i) for i in range(60)] + [None, ""])
    f = lambda c: pa.array([len(x) for x in tokens.shingle_sets(c, 3)])
    assert tokens.in_slices(f, 500)(t).equals(f(t)) and len(tokens.in_slices(f)(t[:0])) == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (200, 201), (200, 201), (7, 7)] + [(500, x) for x in range(501, 560)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[98], got[100]} == {98} and got[201] == 200
    assert all(got[x] == 500 for x in range(500, 560))
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(docs, nothing):
    rows = dedup.near_duplicates(docs, 3, 85).collect()
    assert len(rows) == len(ROWS)
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append(r)
    assert of[1][0]["component_id"] == of[2][0]["component_id"] == 1 and of[1][0]["kept"] and not of[2][0]["kept"]
    assert {r["component_id"] for r in of[3]} == {1}
    assert [r["n_shingles"] for i in (4, 5, 6) for r in of[i]] == [0, 0, 0] and all(of[i][0]["component_id"] == i for i in (4, 5, 6))
    assert [r["n_shingles"] for r in of[8]] == [1, 1] and all(r["kept"] for r in of[8])
    assert of[None][0]["component_id"] is None and not of[None][0]["kept"]
    assert dedup.near_duplicates(nothing).count() == 0 and dedup.one_of_each_group(nothing).count() == 0


def test_one_of_each_group(docs):
    left = dedup.one_of_each_group(docs, 3, 85)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in left.collect()) == [-1, 1, 4, 5, 6, 7, 8, 9]


def test_all_pairs_of_a_cluster_are_found(spark):
    """Copies with varied edits, against brute force."""
    r = random.Random(4)
    base = prose(9, 150).split()
    texts = []
    for i in range(80):
        w = list(base)
        for _ in range(r.randint(0, 14)):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = tokens.shingle_sets(pa.array(texts), 3)
    root = list(range(80))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(80):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in dedup.near_duplicates(df, 3, 85).collect()}
    assert got == {i: find(i) for i in range(80)}


def test_signature_guarantee():
    for percent in (70, 80, 85, 95):
        sh = dedup.shape(percent)
        assert sh.distance == 2 * sh.chunks - 1
        assert dedup._chances(sh.positions, 1 - percent / 100)[sh.distance] < 1e-4


def test_quality(docs, nothing):
    rows = quality.judged(docs).select("row.doc_id", "c.*", "base_failed", "kept").collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        if r["doc_id"] in (4, 5, 6, 8):
            assert r["base_failed"] and not r["kept"]
    long = next(r for r in rows if r["doc_id"] == 7)
    assert long["n_words"] == 30000
    assert quality.passing(docs).columns == docs.columns and quality.passing(nothing).count() == 0


def test_quality_counts(spark):
    text = "a b c a b c\n\nx #y\nx #y\n \n"
    r = spark.createDataFrame([(text,)], "text string").select(quality.counts()("text").alias("c")).first()["c"]
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_lines"]) == (10, 12, 2, 1, 3)
    assert r["n_repeat_words"] == 6


def test_bpe_tree_is_exact():
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS))
    r = random.Random(5)
    parts = ["a", "don't", "'s", "'", " ", "  ", "\n", "\t", " ", "　", "12", "é", "日本", "!", "'r", "e", "\x1c", "\x85", "\r", "😀", "'ll"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 50)))
        ids = bpe.encode(enc, t, r.randint(1, 6), r.randint(1, 4))
        assert ids == enc.encode_ordinary(t) and bpe.decode(enc, ids, 3).decode() == t


def test_bpe(docs, nothing):
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS))
    want = sorted((str(i), *_digests(enc, t or "")) for i, t, *_ in ROWS)
    assert sorted((str(r[0]), *r[1:]) for r in bpe.digested(docs, leaf=64).collect()) == want
    assert {r["decoded"] == (r["text"] or "") for r in bpe.encoded(docs, leaf=64).collect()} == {True}
    assert bpe.digested(nothing).count() == 0


def _digests(enc, text):
    ids = enc.encode_ordinary(text)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_chat(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, 2, None, "<|end|>"), (1, 2, None, "<|end|>"), (None, 0, "ann", ""), (2, None, "x", "y")]
    got = chat.rotated(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 4 * 3 + 1 + 1
    for key in {(r["conv_id"], r["perspective"]) for r in got}:
        part = sorted((r for r in got if (r["conv_id"], r["perspective"]) == key), key=lambda r: r["seq"])
        whole = "".join(r["rendered"] for r in part)
        assert [r["seq"] for r in part] == list(range(1, len(part) + 1))
        for r in part:
            assert whole[r["start"] : r["end"]] == r["rendered"] and r["trained"] == (r["speaker"] == key[1])
            if r["trained"]:
                assert r["rendered"].startswith(chat.OWN) and whole[r["mask_start"] : r["mask_end"]].endswith(chat.ENDING)
            else:
                assert r["mask_start"] is None and f"name={r['speaker']}|>" in r["rendered"]
    assert chat.rotated(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


FIXED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(int(x) if i % 2 == 0 else 2 * int(x) - 9 * (x > "4") for i, x in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def spans_of(text):
    out = []
    for rank, (kind, pattern) in enumerate(FIXED.items()):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if _valid(kind, m.group())]
    return sorted(out)


def test_fixed_patterns_against_brute_force(spark):
    r = random.Random(8)
    parts = ["a", "b_c", "@", ".", "d.e", " ", "1", "255", "256", "0.0", "+", "4111111111111111", "-", "(", ")", "é", "😀", "\n", "555-0100", "00007"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(400)]
    texts += ["x@y.zz_q@r.st", "1" * 50_000, "a" * 50_000, "+1" + " " * 20_000, "é 10.0.0.1.2 😀 +49 30 1234567", "a@b.c@d.e"]
    got = personal.annotated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect()
    for r in got:
        assert [(x["start"], x["ord"], x["end"], x["kind"]) for x in r["base"]] == spans_of(texts[r["row"]["doc_id"]])


def test_bootstrap_finds_what_the_patterns_miss(spark):
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "6011000990139424", "3530111333300000"]
    rows = [(i, f"{prose(i, 9)} pay with {c} {prose(i + 50, 9)}") for i, c in enumerate(cards)]
    rows += [(90, "please pay with 4111111111111112 today"), (91, "about 4111111111111113 of them"), (92, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["row"]["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["more"]] for r in personal.annotated(df, ["doc_id"]).collect()}
    assert got[90] == [("card", 16, 32)] and got[91] == [] and got[92] == []


def test_bootstrap_finds_other_forms(spark):
    rows = [(i, f"{prose(i, 9)} please call {p} {prose(i + 50, 9)}") for i, p in enumerate(f"+1 212 555 01{k}0" for k in range(10, 16))]
    rows += [(10 + i, f"{prose(i, 9)} write to {m} {prose(i + 50, 9)}") for i, m in enumerate(f"a{k}.b@c.org" for k in range(6))]
    rows += [(20 + i, f"{prose(i, 9)} pay with {c} {prose(i + 50, 9)}") for i, c in enumerate(["4111111111111111", "5500005555555559", "4012888888881881", "6011000990139424"])]
    odd = {90: ("please call", "212-555-0199", "phone"), 91: ("write to", "jane.doe at example dot org", "email"), 92: ("pay with", "4111 1111 1111 1112", "card")}
    rows += [(k, f"{before} {x}, they said") for k, (before, x, _) in odd.items()]
    rows += [(93, "we looked at 212-555-0199x and jane at home dot com"), (94, "room 12 34 at noon")]
    got = {r["row"]["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["more"]] for r in personal.annotated(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    for k, (before, x, kind) in odd.items():
        assert got[k] == [(kind, len(before) + 1, len(before) + 1 + len(x))], (k, got[k])
    assert got[93] == [] and got[94] == []


def test_redaction(docs, nothing):
    out = personal.redacted(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert text[9] == "Mail [EMAIL] or [PHONE], card [CARD] at [IP]" and text[4] is None and text[1] == BASE
    assert personal.redacted(nothing).count() == 0


def test_toxicity(spark, docs, nothing):
    r = random.Random(2)
    rows = []
    for i in range(400):
        w, bad = prose(i, 30).split(), i % 3 == 0
        w += ["nasty", "folk"] if bad else [r.choice(["nasty", "folk"])]
        r.shuffle(w)
        rows.append((i, " ".join(w), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.fit(df.select(toxicity.packed()("text").alias("terms"), "toxic"))
    got = toxicity.scored(df, machine).collect()
    assert np.mean([x["predicted"] == x["toxic"] for x in got]) > 0.97  # only the pair tells
    assert toxicity.scored(docs, machine).where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    empty = toxicity.fit(nothing.select(toxicity.packed()("text").alias("terms"), F.lit(1).alias("toxic")))
    assert {x["predicted"] for x in toxicity.scored(docs, empty).collect()} == {0}


def test_language(spark, docs, nothing):
    rows = [(prose(i, 40), "xx") for i in range(30)] + [("река камень облако " * 10, "ru")] * 3 + [("дождь тихо", None), (None, "xx")]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    text = prose(77, 12) + " " + "облако река камень " * 4
    df = spark.createDataFrame([(1, text), (2, None), (3, "12 34 !"), (4, ""), (5, "река")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.identified(df, model).collect()}
    assert [s.split(":")[0] for s in got[1]["spans"].split(",")] == ["xx", "ru"]
    assert [got[i]["lang_pred"] for i in (2, 3, 4, 5)] == ["und", "und", "und", "ru"] and got[3]["score"] == 0
    assert language.identified(docs, language.fit(nothing)).where("lang_pred <> 'und'").count() == 0


def test_viterbi_against_brute_force():
    r = np.random.default_rng(1)
    at = np.array([0, 5, 5, 6, 10])
    score = r.normal(size=(10, 3)).astype(np.float32) * 3
    got = language.best_path(score, at, 2.0)
    for a, b in zip(at[:-1], at[1:]):
        paths = np.array(np.meshgrid(*[range(3)] * (b - a))).T.reshape(-1, b - a) if b > a else np.zeros((1, 0), int)
        value = [score[np.arange(a, b), p].sum() - 2.0 * (p[1:] != p[:-1]).sum() for p in paths]
        assert abs(max(value) - (score[np.arange(a, b), got[a:b]].sum() - 2.0 * (got[a:b][1:] != got[a:b][:-1]).sum())) < 1e-4


def test_forward_against_brute_force():
    r = np.random.default_rng(2)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    k = hmm.STATES
    model = hmm.Model(norm(r.random(k), 0), norm(r.random(k), 0), norm(r.random((k, k)), 1), norm(r.random((hmm.CLASSES, k)), 0))
    seq, at = r.integers(0, hmm.CLASSES, 9), np.array([0, 4, 9])
    for got, a, b in zip(hmm.forward(model, seq, at), at[:-1], at[1:]):
        state = model.first * model.emit[seq[a]]
        for x in seq[a + 1 : b]:
            state = (state @ model.move) * model.emit[x]
        assert abs(got - np.log10(state.sum())) < 1e-9
    _, moves, emit, loglik = hmm._expected(model, seq, at[:-1], np.diff(at), np.array([True, True]))
    assert abs(loglik - hmm.forward(model, seq, at).sum()) < 1e-9
    assert abs(moves.sum() - 7) < 1e-9 and abs(emit.sum() - 9) < 1e-9


def test_language_model(spark, docs, nothing):
    out = hmm.scored(docs, F.col("doc_id").eqNullSafe(8), head=20, rounds=2).collect()
    assert len(out) == len(ROWS)
    train = [t or "" for i, t, *_ in ROWS if i != 8]
    counts = {}
    for t in train:
        for w in [*t.encode().lower().split(), None]:
            counts[w] = counts.get(w, 0) + 1
    total, kinds = sum(counts.values()), len(counts)
    for r in out:
        options = []
        for i, t, *_ in ROWS:
            if i == r["doc_id"]:
                w = [*(t or "").encode().lower().split(), None]
                options.append((len(w), sum(x in counts for x in w), sum(np.log10((counts.get(x, 0) + 1) / (total + kinds + 1)) for x in w)))
        assert r["train_tokens"] == total and r["score"] < 0
        assert any(n == r["n_tokens"] and k == r["n_known"] and abs(b - r["base_score"]) < 1e-6 * max(1, abs(b)) for n, k, b in options)
    alone = hmm.scored(docs, F.lit(True)).collect()
    assert {(r["n_known"], r["base_score"], r["score"]) for r in alone} == {(0, 0.0, 0.0)}
    assert hmm.scored(nothing, F.lit(False)).count() == 0


def test_leaks(spark, docs, nothing):
    items = [(i, prose(1000 + i, 40) + ". " + prose(2000 + i, 6) + ".") for i in range(12)]
    bench = spark.createDataFrame([*items, (99, None), (None, "x y z"), (98, "")], "item_id long, text string")
    reworded = items[5][1].split()
    for i in range(3, 40, 5):
        reworded[i] = "changed"
    rows = [(1, prose(5, 60) + "\n" + items[2][1] + " " + prose(6, 60)), (2, prose(7, 200)), (3, " ".join(reworded)), (4, None), (5, "")]
    found = leaks.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 2), (3, 5)}
    assert leaks.clean(docs, bench).columns == docs.columns and leaks.clean(docs, bench).count() == len(ROWS)
    assert leaks.clean(docs, bench.limit(0)).count() == len(ROWS) and leaks.leaks(nothing, bench).count() == 0


def test_whole_items_of_any_length_are_found(spark):
    """Copies of items of 1 to 30 words in texts made of the benchmark's own words, at the ends and in the middle."""
    r = random.Random(21)
    vocabulary = prose(77, 300).split()
    items = [(n * 10 + k, " ".join(r.choices(vocabulary, k=n))) for n in (1, 2, 4, 6, 9, 15, 23, 24, 30) for k in range(4)]
    rows = []
    for i, text in items:
        around = [" ".join(r.choices(vocabulary, k=r.choice([0, 3, 60]))) for _ in range(2)]
        rows.append((i, f"{around[0]} {text.upper()} {around[1]}".strip()))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = leaks.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(i, i) for i, _ in items} <= {(x["doc_id"], x["item_id"]) for x in found}
    text = dict(rows)
    for x in found:
        words = text[x["doc_id"]].lower().split()[x["first"] : x["end"]]
        assert x["overlap"] < 1 or len(words) >= len(dict(items)[x["item_id"]].split())


def test_half_reworded_items_at_any_size(spark):
    r = random.Random(8)
    items = [(i, prose(3000 + i, 40) + ". " + prose(4000 + i, 8) + ".") for i in range(30)]
    rows = []
    for i, text in items:
        w = text.split()
        for j in r.sample(range(40), 18):
            w[j] = f"else{r.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for more in (100, 2000):
        df = spark.createDataFrame(rows + [(1000 + i, f"filler {i}") for i in range(more)], "doc_id long, text string")
        got = {(x["doc_id"], x["item_id"]) for x in leaks.leaks(df, bench).collect()}
        assert len([1 for i, _ in items if (i, i) in got]) >= 29, (more, len(got))


def test_common_words_against_counts():
    r = np.random.default_rng(4)
    items = [(i, " ".join(r.choice(WORDS, r.integers(3, 30)))) for i in range(5)]
    words = [t.split() for _, t in items]
    text = list(r.choice([*WORDS, "elsewhere"], 400))
    number = tokens.words(pa.array([" ".join(text)]), separator=leaks.SEPARATOR).number
    space = leaks.Space(np.full(leaks.SLOTS, -1, np.int64), np.zeros((1, 1), np.float32), np.ones(1))
    block = leaks.block_of(space, items)
    item, lo = r.integers(0, 5, 50), r.integers(0, 380, 50)
    hi = np.minimum(lo + r.integers(1, 60, 50), 400)
    want = [sum(min(words[i].count(x), text[a:b].count(x)) for x in set(words[i])) for i, a, b in zip(item, lo, hi)]
    assert leaks._common(block, leaks._places(block, number), len(number), item, lo, hi).tolist() == want


def test_common_subsequence_against_brute_force():
    r = random.Random(3)
    for _ in range(200):
        a, b = ([r.randrange(4) for _ in range(r.randint(1, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert leaks.common_subsequence(np.array(a), np.array(b)).sum() == best[-1][-1]


def test_passages(spark, nothing):
    shared = prose(31, 70)
    fuzzy = shared.split()
    for i in (25, 50):
        fuzzy[i] = "other"
    rows = [(10, prose(1, 50) + " " + shared + " " + prose(2, 50)), (11, prose(3, 20) + " " + shared), (12, " ".join(fuzzy) + " " + prose(4, 30))]
    rows += [(13, prose(5, 100)), (14, None), (15, ""), (16, "a b"), (10, rows[0][1])]
    got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    of = {(r["doc_id"], r["other_id"]): r for r in got}
    assert set(of) == {(11, 10), (12, 10), (10, 10)}
    assert (of[11, 10]["start"], of[11, 10]["end"], of[11, 10]["other_start"]) == (20, 90, 50)
    assert of[12, 10]["start"] == 0 and of[12, 10]["end"] == 70 and of[12, 10]["n_same"] == 68 and of[10, 10]["n_same"] == 170
    assert passages.shared_passages(nothing).count() == 0


def test_passages_behind_earlier_partial_copies(spark):
    shared = prose(71, 51).split()
    rows = [(1, " ".join(shared[:26]) + " " + prose(72, 60)), (2, prose(73, 60) + " " + " ".join(shared[26:]))]
    rows += [(i, prose(70 + i, 30) + " " + " ".join(shared) + " " + prose(80 + i, 30)) for i in (4, 5)]
    got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert [(r["doc_id"], r["other_id"], r["start"], r["end"], r["n_same"]) for r in got] == [(5, 4, 30, 81, 51)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def hold(rows, found):
    """Of every ``size`` words in a row that an earlier row has, ``LONGER`` are told, and every told passage is one."""
    size = passages.LONGER + passages.K + passages.WINDOW - 2
    text, seen, told = {i: words_of(t) for i, t in rows}, set(), {}
    for r in found:
        told.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
        a, b = (text[r[i]][r[x] : r[y]] for i, x, y in (("doc_id", "start", "end"), ("other_id", "other_start", "other_end")))
        assert min(len(a), len(b)) >= passages.LEAST and r["n_same"] >= passages.SAME * max(len(a), len(b))
        number = {w: i for i, w in enumerate({*a, *b})}
        assert leaks.common_subsequence(np.array([number[w] for w in a]), np.array([number[w] for w in b])).sum() >= r["n_same"]
    repeated = 0
    for i, t in text.items():
        runs = [tuple(t[j : j + size]) for j in range(len(t) - size + 1)]
        for j, run in enumerate(runs):
            if run in seen:
                repeated += 1
                assert len(told.get(i, set()).intersection(range(j, j + size))) >= passages.LONGER, (i, j)
        seen.update(runs)
    return repeated


def test_passages_of_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").coalesce(1).collect()]
    assert len(rows) == len({i for i, _ in rows})
    assert hold(rows, passages.op10_passages(spark, "/root/testdata/sf0.001").collect()) > 0


def test_passages_of_frequent_seeds(spark):
    shared, n = prose(91, 60).split(), 2 * passages.FEW
    rows = [(i, prose(100 + i, 20) + " " + " ".join(shared[:34]) + " " + prose(200 + i, 20)) for i in range(n)]
    rows += [(n + i, prose(300 + i, 20) + " " + " ".join(shared[26:]) + " " + prose(400 + i, 20)) for i in range(n)]
    rows += [(2 * n + i, prose(500 + i, 30) + " " + " ".join(shared) + " " + prose(600 + i, 30)) for i in range(n)]
    rows += [(3 * n, rows[-1][1] + " "), (3 * n + 1, "spam " * 60 + prose(701, 20)), (3 * n + 2, prose(702, 20) + " spam" * 60)]
    got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert hold(rows, got) > 0
    whole = {r["doc_id"] for r in got if (r["start"], r["end"]) == (30, 90) and r["other_id"] == 2 * n}
    assert whole == set(range(2 * n + 1, 3 * n))
    assert [(r["other_id"], r["n_same"]) for r in got if r["doc_id"] == 3 * n] == [(3 * n - 1, 120)]
    assert [(r["start"], r["end"], r["n_same"]) for r in got if r["doc_id"] == 3 * n + 2] == [(20, 80, 60)]


def test_passages_with_many_changed_words():
    r = np.random.default_rng(5)
    new = lambda n: r.integers(0, 1 << 63, n).astype(np.uint64)

    def found(n, agree):
        first = new(n)
        second = first.copy()
        changed = 1 + r.choice(n - 2, round(n * (1 - agree)), False)  # both ends agree, so that the passage has n words
        second[changed] = new(len(changed))
        a, b = (np.concatenate([new(60), x, new(60)]) for x in (first, second))
        text, pos, seed = passages.seeds_of(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        at = dict(zip(seed[text == 0].tolist(), pos[text == 0].tolist()))
        x, y = np.array([(at[s], p) for s, p in zip(seed[text == 1].tolist(), pos[text == 1].tolist()) if s in at], int).reshape(-1, 2).T
        return len(x) > 1 and any(passages.passages_of(a, b, c[:, 0].tolist(), c[:, 1].tolist()) for c in passages.chains(x, y))

    share = {c: np.mean([found(*c) for _ in range(200)]) for c in ((50, 0.8), (60, 0.82), (50, 0.85), (50, 0.88), (80, 0.82))}
    assert min(share.values()) >= 0.9, share
    every_fifth = np.arange(5, 75, 5)
    first = new(80)
    second = first.copy()
    second[every_fifth] = new(len(every_fifth))
    assert passages.passages_of(first, second, [1], [1]) == [(0, 80, 0, 80, 66)]


def test_a_passage_behind_a_changed_stretch():
    first, second = np.arange(1, 96, dtype=np.uint64), np.arange(1, 96, dtype=np.uint64)
    second[8:23] += 1000
    match = np.array([0, 4, 23, 28, 40, 60])
    best = passages.chains(match, match)[0]
    assert passages.passages_of(first, second, best[:, 0].tolist(), best[:, 1].tolist()) == [(23, 95, 23, 95, 72)]


def test_chains_take_the_best_order():
    x = np.array([0, 10, 20, 30, 12])
    y = np.array([0, 10, 20, 30, 300])
    best = passages.chains(x, y)[0]
    assert best[:, 0].tolist() == [0] and best[0, 2] == 36 or best[:, 0].tolist() == [0, 10, 20, 30]


def test_held_out_rule_is_crc32(spark):
    got = spark.range(50).select("id", (F.crc32(F.col("id").cast("string").cast("binary")) % 5).alias("k")).collect()
    assert all(r["k"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)


def test_reworded_passages_whose_seeds_are_all_frequent(spark):
    """Pieces of the passage come first, apart and out of order, in more rows than FEW; only the last two rows have the whole of it."""
    shared, n = prose(801, 60).split(), 2 * passages.FEW
    pieces = [" ".join(shared[i : i + 12]) for i in range(0, 49, 3)]
    rows = []
    for i in range(n):
        order = random.Random(i).sample(pieces, len(pieces))
        rows.append((i, " ".join(f"{p} {' '.join(f'u{i}x{k}x{j}' for j in range(15))}" for k, p in enumerate(order))))
    reworded = [f"new{i}" if i in (20, 40) else w for i, w in enumerate(shared)]
    rows += [(n, prose(802, 30) + " " + " ".join(shared) + " " + prose(803, 30)), (n + 1, prose(804, 30) + " " + " ".join(reworded) + " " + prose(805, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = passages.shared_passages(docs, every_pair=True).collect()
    assert [(r["other_id"], r["start"], r["end"], r["n_same"]) for r in got if r["doc_id"] == n + 1] == [(n, 30, 90, 58)]


def test_every_pair_finds_what_the_limited_search_finds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    told = lambda found: {(r["doc_id"], i) for r in found.collect() for i in range(r["start"], r["end"])}
    some = told(passages.shared_passages(docs))
    assert some and some <= told(passages.shared_passages(docs, every_pair=True))


def told_words(found):
    return {(r["doc_id"], i) for r in found.collect() for i in range(r["start"], r["end"])}


def test_the_query_finds_reworded_passages_whose_seeds_are_all_frequent(spark):
    """As above, for several pairs of rows: the seeds of each are frequent, their first places have other surroundings, no ``LONGER`` words agree."""
    n, rows, want = 2 * passages.FEW, [], []
    for k in range(3):
        shared = prose(811 + k, 60).split()
        pieces = [" ".join(shared[i : i + 12]) for i in range(0, 49, 3)]
        for i in range(n):
            order = random.Random(100 * k + i).sample(pieces, len(pieces))
            rows.append((len(rows), " ".join(f"{p} {' '.join(f'u{k}x{i}x{q}x{j}' for j in range(15))}" for q, p in enumerate(order))))
        reworded = [f"new{k}x{i}" if i in (20, 40) else w for i, w in enumerate(shared)]
        first = len(rows)
        rows.append((first, f"{prose(820 + k, 30)} {' '.join(shared)} {prose(830 + k, 30)}"))
        rows.append((first + 1, f"{prose(840 + k, 30)} {' '.join(reworded)} {prose(850 + k, 30)}"))
        want.append((first + 1, first, 30, 90, 58))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r["doc_id"], r["other_id"], r["start"], r["end"], r["n_same"]) for r in passages.shared_passages(docs).collect())
    assert got == want


def test_the_query_tells_every_word_that_every_pair_tells(spark):
    """Among others a stretch of few seeds that sticks out of what is told of the first row."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").coalesce(1).collect()]
    line, junk = prose(861, 12), prose(862, 42) + " again" * 35
    own = lambda i, side: " ".join(f"own{i}x{side}x{j}" for j in range(25))
    rows += [(1000 + i, f"{own(1000 + i, 0)} {line} {own(1000 + i, 1)}") for i in range(40)]
    rows += [(2000 + i, f"{own(2000 + i, 0)} {' '.join(junk.split()[: 42 + i % 5 * 8])} {own(2000 + i, 1)}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    every = told_words(passages.shared_passages(docs, every_pair=True))
    assert {(2009, i) for i in range(25, 99)} <= every
    assert every <= told_words(passages.shared_passages(docs))


def plain_meetings(seed, uid, left, right, around):
    """All pairs of places, one by one, by the rule that ``meetings`` states; those that only tell the same run as an earlier place are marked."""
    ahead, behind, deep, out = around[:, : passages.SIDE], around[:, passages.SIDE :], passages.LEAST - passages.K, {}
    for j in range(len(seed)):
        for i in range(len(seed)):
            if seed[i] != seed[j] or uid[i] >= uid[j]:
                continue
            agreed, again = [], []
            for side in (behind, ahead):
                t = 0
                while t < passages.SIDE and side[i, t] and side[i, t] == side[j, t]:
                    t += 1
                agreed.append(t)
                x, y = ([tuple(s[t + k : t + k + passages.SYNC]) for k in range(passages.REACH + 1)] for s in (side[i], side[j]))
                again.append([t + k + passages.SYNC for k, w in enumerate(y) if t < deep and len(w) == passages.SYNC and all(w) and w in x])
            run = sum(agreed) + passages.K >= passages.LEAST
            beyond = left[j] < 0 or any(t > told for t, told in zip(agreed, (left[j], right[j]), strict=True) if told <= deep)
            near = [left[j] < 0 or beyond or any(u + passages.REACH > told for u in a) for a, told in zip(again, (left[j], right[j]), strict=True)]
            if run and beyond or any(a and ok for a, ok in zip(again, near, strict=True)):
                out[i, j] = run and not any(a and ok for a, ok in zip(again, near, strict=True))
    return out


def test_meetings_against_all_pairs():
    """Texts of few different words, and some with long runs, so that nodes fork everywhere."""
    r = np.random.default_rng(7)
    side = passages.SIDE
    for trial in range(6):
        n = 60
        base = r.integers(1, 40, 2 * side)
        around = np.where(r.random((n, 2 * side)) < (0.03, 0.1, 0.3)[trial % 3], r.integers(1, 40, (n, 2 * side)), base).astype(np.uint32)
        for i in range(0, n, 4):
            around[i, r.integers(0, side) : side] = 0
            around[i, side + r.integers(0, side) :] = 0
        seed, uid = np.sort(r.integers(0, 3, n)).astype(np.uint64), r.integers(0, 50, n)
        left, right = (r.choice([3, 10, 30, passages.ALL], n) for _ in range(2))
        untold = r.random(n) < 0.4
        left, right = np.where(untold, -1, left), np.where(untold, -1, right)
        want = plain_meetings(seed, uid, left, right, around)
        got = set(zip(*(x.tolist() for x in passages.meetings(seed, uid, left, right, around)), strict=True))
        assert got <= set(want)
        assert {p for p, only_run in want.items() if not only_run} <= got
        assert {j for _, j in want} == {j for _, j in got}
