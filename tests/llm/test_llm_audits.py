"""Divergence audit, Jaccard join and centroid clustering: awkward rows, and brute force beside the parts that make them fast."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from contentflow.llm import centroids, divergence, jaccard, tokens

WORDS = "river stone cloud amber quiet harbor lantern meadow copper window garden silver thunder velvet marble forest".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ed", "ing", "y"]) + str(r.choice("abcdef")) for _ in range(n))


# --- divergence audit


def audit(rows, least, top):
    """The audit of (text, lang, source) rows in plain Python."""
    rows = [tuple(x or "" for x in r) for r in rows]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [(lang, source, re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t.translate(low))) for t, lang, source in rows]
    texts, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in found:
        texts[lang].update(set(words))
        count[lang, source].update(words)
    out = []
    for lang in {r[1] for r in rows}:
        kept = [t for t, n in texts[lang].items() if n >= least]
        groups = {s: {t: c[t] for t in kept} for (g, s), c in count.items() if g == lang}
        whole = {t: sum(g[t] for g in groups.values()) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        for s in groups:
            pairs = [(o, sum(apart(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, apart(p[s][t], q[t])) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, of, most in (("pair", pairs, None), ("term", terms, top)):
                of.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, v, i) for i, (t, v) in enumerate(of[:most], 1)]
    return out


def test_divergence_against_brute_force(spark):
    r = random.Random(6)
    rows = []
    for i in range(400):
        words = [r.choice(WORDS[: 4 + i % 13]) + r.choice("éÉxX日") for _ in range(r.randint(0, 25))]
        rows.append((r.choice([" ", "\n", "-", "1"]).join(words), r.choice(["en", "en", "de", None]), r.choice(["a", "b", "c", None, "ü"])))
    rows += [(None, "fr", "a"), ("", "fr", "b"), ("lonely word", "it", "only"), (None, None, None)] + [("same row", "xx", "y")] * 12
    df = spark.createDataFrame([(*x, "t", 5, 1) for x in rows], "text string, lang string, source string, term string, n long, `s` int")
    assert sorted(map(tuple, divergence.audited(df).collect())) == sorted(audit(rows, divergence.LEAST_DOCS, divergence.TOP))
    assert divergence.audited(df.limit(0)).count() == 0


def test_a_very_long_text_counts_whole(spark):
    long = prose(1, 300_000)
    got = [divergence.audited(spark.createDataFrame(t, "text string, lang string, source string").coalesce(1)).collect() for t in
           ([(long, "en", "a")] + [(prose(2, 4000), "en", "b")] * 10, [(prose(2, 4000), "en", "b")] * 10 + [(long, "en", "a")])]
    assert sorted(got[0]) == sorted(got[1]) == sorted(audit([(long, "en", "a")] + [(prose(2, 4000), "en", "b")] * 10, 10, 10))


def test_skyband_against_brute_force():
    r = np.random.default_rng(3)
    for size in (1, 40, 900):
        more, less, rank = r.integers(0, 12, size), r.integers(0, 12, size), r.permutation(size)
        beats = (more[:, None] >= more) & (less[:, None] <= less) & (rank[:, None] < rank)
        for k in (1, 3, 10):
            assert (divergence.skyband(more, less, rank, k) == (beats.sum(axis=0) < k)).all()


def test_merged_skybands_hold_the_first_ranks():
    """Bands of parts, merged in small steps, keep each group's first ranks for any value that rises with n and falls with whole."""
    r = np.random.default_rng(4)
    n = 3000
    table = pa.table({
        "lang": r.choice(["a", "b"], n), "source": r.choice(["x", "y"], n), "term": [f"t{i:05}" for i in r.permutation(n)],
        "n": r.integers(1, 30, n), "whole": r.integers(1, 60, n), "p": np.zeros(n, int), "q": np.zeros(n, int),
    })
    run, small = divergence.skybands(5), table.to_batches(max_chunksize=100)
    bands = [b for part in (small[:10], small[10:]) for b in run(part)]
    merged = pa.Table.from_batches(run(bands)).to_pandas()
    assert len(merged) < n / 4
    for _, g in table.to_pandas().groupby(["lang", "source"]):
        for value in (g["n"] * 3 - g["whole"], g["n"] * 1.0 / g["whole"]):
            first = g.assign(v=value).sort_values(["v", "term"], ascending=[False, True])["term"][:5]
            assert set(first) <= set(merged["term"])


# --- Jaccard join

BASE = prose(1, 120)
ROWS = [
    (1, BASE), (2, BASE), (3, BASE.replace("amber", "gold", 1)), (3, BASE), (4, None), (5, ""), (6, " \n\t "), (None, prose(2, 80)),
    (7, prose(3, 30000)), (8, "one two"), (9, "ONE  two"), (10, "one two three"), (None, prose(2, 80)),
]


def test_join_on_awkward_rows(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, text string, n long, keys string")
    of = defaultdict(list)
    for r in jaccard.joined(df).collect():
        of[r["doc_id"]].append((r["n_shingles"], r["component_id"]))
    assert sum(map(len, of.values())) == len(ROWS)
    assert {c for i in (1, 2, 3) for _, c in of[i]} == {1} and of[None] == [(78, None)] * 2
    assert [of[i] for i in (4, 5, 6)] == [[(0, 4)], [(0, 5)], [(0, 6)]] and of[8] == [(1, 8)] and of[9] == [(1, 8)] and of[10] == [(1, 10)]
    assert jaccard.joined(df.limit(0)).count() == 0


@pytest.mark.parametrize("words, edits", [(150, 9), (14, 2), (700, 50)])
def test_join_against_brute_force(spark, words, edits):
    """Copies of some texts with varied edits, beside texts that share most of a passage."""
    r = random.Random(words)
    texts = []
    for k in range(4):
        base = prose(k, words).split()
        for _ in range(40):
            w = list(base)
            for _ in range(r.randint(0, edits)):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            texts.append(" ".join(w[r.randint(0, edits) :]))
    sets = tokens.shingle_sets(pa.array(texts), jaccard.LENGTH)
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(texts)):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 100 * k >= jaccard.PERCENT * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x["doc_id"]: x["component_id"] for x in jaccard.joined(df).collect()} == {i: find(i) for i in range(len(texts))}


def test_linked_sets_always_share_a_tile():
    r = np.random.default_rng(7)
    for percent in (80, 90, 95):
        for _ in range(400):
            n = int(r.integers(8, 400))
            x = np.unique(tokens.mix(r.integers(0, 1 << 62, n).astype(np.uint64)))
            drop = int(r.integers(0, n * (100 - percent) // percent + 2))
            add = int(r.integers(0, drop + 1))
            y = np.unique(np.append(r.permutation(x)[drop - add :], tokens.mix(r.integers(0, 1 << 62, add).astype(np.uint64))))
            both = len(np.intersect1d(x, y))
            if 100 * both >= percent * (len(x) + len(y) - both) and both < max(len(x), len(y)):
                assert len(np.intersect1d(jaccard.keys_of(x, percent), jaccard.keys_of(y, percent)))


def test_bitmaps_never_rule_out_a_link():
    r = np.random.default_rng(8)
    for _ in range(300):
        pool = tokens.mix(r.integers(0, 1 << 62, 700).astype(np.uint64))
        x, y = (np.unique(pool[a : a + r.integers(1, 600)]) for a in r.integers(0, 60, 2))
        bx, by = jaccard.folded([jaccard.bitmap(x), jaccard.bitmap(y)])
        only1, only2 = np.bitwise_count(bx & ~by).sum(), np.bitwise_count(by & ~bx).sum()
        both = len(np.intersect1d(x, y))
        assert only1 <= len(x) - both and only2 <= len(y) - both
        if 100 * both >= 90 * (len(x) + len(y) - both):
            assert jaccard.may_link(len(x), len(y), only1, only2, 90)


def test_rows_with_a_shared_key_come_out_once():
    r = random.Random(2)
    for _ in range(200):
        keys = sorted(r.choices(range(12), k=r.randint(0, 15)))
        rows = pa.table({"key": pa.array(keys, pa.int64()), "uid": pa.array(range(len(keys)), pa.int64())})
        got = [u for b in jaccard._shared(rows.to_batches(max_chunksize=r.randint(1, 4))) for u in b.column("uid").to_pylist()]
        assert got == [i for i, k in enumerate(keys) if keys.count(k) > 1]


# --- centroid clustering


def plain(rows, k, rounds):
    """Centroid clustering of (vec_id, vector) rows in plain Python."""
    rows = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows]
    order = sorted(rows, key=lambda r: hashlib.sha256(f"2:{r[0]}".encode()).hexdigest())
    centre = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centre))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in rows:
            of[near(v)[1]].append(v)
        centre = [[sum(x) // len(of[i]) for x in zip(*of[i])] if of[i] else c for i, c in enumerate(centre)]
    return sorted((i, near(v)[1], near(v)[0]) for i, v in rows), centre


def test_clusters_against_brute_force(spark):
    r = random.Random(9)
    rows = [(i, [r.choice([-0.5, 0.0, 0.25, 0.3]) for _ in range(64)]) for i in range(120)] + [(i, [0.25] * 64) for i in range(120, 140)]
    bad = [(900, None), (901, [0.1] * 63), (902, [None] + [0.1] * 63), (903, [float("nan")] + [0.1] * 63), (904, [float("inf")] * 64), (905, [])]
    df = spark.createDataFrame([(*x, 7, "s") for x in rows + bad], "vec_id long, embedding array<double>, cluster long, distance string")
    got = centroids.clustered(df, 7, 3).collect()
    want, centre = plain(rows, 7, 3)
    assert sorted((x["vec_id"], x["cluster"], x["distance"]) for x in got) == want
    for x in got:
        assert x["cluster_inertia"] == sum(d for _, c, d in want if c == x["cluster"]) and x["inertia"] == sum(d for *_, d in want)
        assert x["centroid_sha256"] == hashlib.sha256(",".join(map(str, centre[x["cluster"]])).encode()).hexdigest()
    few = centroids.clustered(df.where("vec_id < 3")).collect()
    assert sorted(x["distance"] for x in few) == [0, 0, 0] and centroids.clustered(df.limit(0)).count() == 0


def test_repeated_null_and_huge_vectors(spark):
    v = [0.5] * 64
    rows = [(1, v), (1, v), (None, v), (2, [1e30] * 64), (3, [-1.0] * 64)]
    got = {(x["vec_id"], x["cluster"], x["distance"]) for x in centroids.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 3, 1).collect()}
    assert len(got) == 4 and (2, None, None) in got and {d for i, _, d in got if i != 2} == {0}


def test_progressive_search_against_all_distances():
    r = np.random.default_rng(1)
    for spread in (3, 300, 1 << 22):
        x, c = r.integers(-spread, spread, (500, 64)), r.integers(-spread, spread, (40, 64))
        c[7] = c[3]  # a tie for every vector that is nearest to it
        x[:60] = c[r.integers(0, 40, 60)] + r.integers(-1, 2, (60, 64))
        whole = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        cluster, distance = centroids.nearest(centroids.transformed(x), centroids.transformed(c))
        assert (cluster == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()


def test_transform_keeps_distances():
    x = np.random.default_rng(2).integers(-100, 100, (50, 64))
    assert ((centroids.transformed(x) ** 2).sum(axis=1) == 64 * (x**2).sum(axis=1)).all()
    assert (centroids.transformed(np.ones((1, 64), np.int64))[0, 1:] == 0).all()
