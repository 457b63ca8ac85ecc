"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of ``WIDTH`` words, half overlapping.  Their TF-IDF rows (terms
hashed into ``SLOTS`` slots, document frequencies over all documents) get a randomised SVD: Spark
tasks multiply their rows with a thin matrix, the products are added by term in a shuffle, and only
matrices of a row per slot reach the driver.  Every passage of every document is projected with
the right singular vectors and compared with the items' passages by cosine, in blocks of at most
``ITEMS`` items, so what a task holds does not grow with the benchmark.

Items shorter than a passage make another direction in the space than the passage around them; whole copies of these are
also found by the number of their run of words, at any length.

A candidate is looked at if the item and the place have ``REWORDED`` of the item's words in common in any
order, without which they cannot have them in the same order.  It
counts if the longest common subsequence of the item and the place has ``COPIED`` of the
item's words, or ``REWORDED`` of them and ``ANSWERED`` of its answer: what follows its last question
mark or, without one, its last sentence.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from contentflow.llm import tokens
from contentflow.session import stage

SLOTS = 1 << 16
WIDTH = 24
RANK, EXTRA, POWERS = 160, 16, 3
ITEMS = 4096
#: Least cosine in the latent space.
COSINE = 0.55
COPIED, REWORDED, ANSWERED = 0.75, 0.5, 0.8
#: Words handled at a time.
BLOCK = 1 << 15

#: ASCII letters and digits and all longer code points make up words.
SEPARATOR = tokens.NOT_LETTER.copy()
SEPARATOR[ord("0") : ord("9") + 1] = False


def _slot(number: np.ndarray) -> np.ndarray:
    return (number & np.uint64(SLOTS - 1)).astype(np.int64)


def _halves(length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut texts of ``length`` words into half passages: start of each, its text, and whether the next belongs to the same text."""
    half = WIDTH // 2
    pieces = -(-length // half)
    text = np.repeat(np.arange(len(length)), pieces)
    number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(np.cumsum(length) - length, pieces) + number * half
    more = np.zeros(len(text), bool)
    more[:-1] = text[1:] == text[:-1]
    return start, text, more


def _projected(number: np.ndarray, length: np.ndarray, place: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the ``matrix`` rows of the words of each passage, with its first word and its text; the last row of ``matrix`` is zero."""
    start, text, more = _halves(length)
    part = np.zeros((len(start), matrix.shape[1]), np.float32)
    if not len(start):
        return part, start, text
    term = np.append(place[_slot(number)], -1)
    spot = start[:, None] + np.arange(WIDTH // 2)
    term = term[np.where(spot < np.cumsum(length)[text][:, None], spot, len(number))]
    # Word by word over blocks that stay in the cache.
    for i in range(0, len(start), 1024):
        total = matrix[term[i : i + 1024, 0]]
        for k in range(1, WIDTH // 2):
            total += matrix[term[i : i + 1024, k]]
        part[i : i + 1024] = total
    whole = part.copy()
    at = np.flatnonzero(more)
    whole[at] += part[at + 1]
    # The last half passage of a longer text is part of the passage before it.
    keep = more | (np.append(-1, text[:-1]) != text)
    return whole[keep], start[keep], text[keep]


def _frequencies(place: np.ndarray):
    """Batches ``text`` to rows ``term, n``: in how many texts each term of ``place`` comes."""

    def run(batches):
        for b in tokens.sliced_batches(batches):
            w = tokens.words(b.column("text"), separator=SEPARATOR)
            term = place[_slot(w.number)]
            row = np.repeat(np.arange(b.num_rows), np.diff(w.at))
            has = term >= 0
            width = int(place.max()) + 1
            once = np.unique(row[has] * width + term[has]) % width
            n = np.bincount(once, minlength=width)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(n)], names=["term", "n"])

    return run


def _terms(batches):
    """Batches ``text`` to rows ``slot``: the terms of a batch, each once."""
    for b in tokens.sliced_batches(batches):
        w = tokens.words(b.column("text"), separator=SEPARATOR)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slot(w.number)))], names=["slot"])


def _product(place: np.ndarray, weight: np.ndarray, thin: np.ndarray):
    """Batches ``text`` to rows ``term, d``: the partial sums of A'(A thin) over their passages."""

    def run(batches):
        total = np.zeros(thin.shape)
        one = np.arange(len(weight) + 1, dtype=np.int64)
        for b in tokens.sliced_batches(batches):
            w = tokens.words(b.column("text"), separator=SEPARATOR)
            length = np.diff(w.at)
            rows, start, text = _projected(w.number, length, place, np.vstack([weight[:, None] * thin, np.zeros((1, thin.shape[1]))]).astype(np.float32))
            end = np.minimum(start + WIDTH, np.cumsum(length)[text]) if len(start) else start
            for r, a, z in zip(rows, start.tolist(), end.tolist(), strict=True):
                term = place[_slot(w.number[a:z])]
                np.add.at(total, term, weight[term][:, None] * r[None, :])
        yield pa.RecordBatch.from_arrays([pa.array(one[:-1]), pa.array(list(total), pa.list_(pa.float64()))], names=["term", "d"])

    return run


class Space(NamedTuple):
    """``place[slot]`` is a term's row in ``matrix``: its weight times its right singular vectors; the last row, of other words, is zero."""

    place: np.ndarray
    matrix: np.ndarray
    weight: np.ndarray


def latent_space(docs: DataFrame, benchmark: DataFrame) -> Space:
    """The latent space of the benchmark's passages, with document frequencies of all ``docs``."""
    slots = sorted(r["slot"] for r in benchmark.select("text").mapInArrow(_terms, "slot long").distinct().collect())  # at most SLOTS
    place = np.full(SLOTS, -1, np.int64)
    place[slots] = np.arange(len(slots))
    if not slots:
        return Space(place, np.zeros((1, 1), np.float32), np.ones(1))
    rows = docs.select("text").mapInArrow(_frequencies(place), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    seen = np.zeros(len(slots))
    for r in rows.collect():  # one row per term
        seen[r["term"]] = r["n"]
    total = docs.count()
    weight = np.log((total + 1) / (seen + 1)) + 0.1
    width = min(RANK + EXTRA, len(slots))
    thin = np.linalg.qr(np.random.default_rng(1).normal(size=(len(slots), width)))[0]
    summed = [F.sum(F.col("d")[i]).alias(f"d{i}") for i in range(width)]
    for _ in range(POWERS):
        product = benchmark.select("text").mapInArrow(_product(place, weight, thin), "term long, d array<double>")
        got = product.groupBy("term").agg(*summed).toPandas().sort_values("term")  # one row per term
        image = np.zeros(thin.shape)
        image[got["term"].to_numpy()] = got.drop(columns="term").to_numpy()
        last, thin = thin, np.linalg.qr(image)[0]
    square, turned = np.linalg.eigh((last.T @ image + image.T @ last) / 2)
    vectors = last @ turned[:, np.argsort(-square)[:RANK]]
    matrix = np.vstack([weight[:, None] * vectors, np.zeros((1, vectors.shape[1]))])
    return Space(place, matrix.astype(np.float32), np.append(weight, np.log(total + 1) + 0.1))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-6)


def common_subsequence(item: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which words of ``item`` a longest common subsequence with ``place`` has; a row of bits per word of ``place``."""
    spots: dict[int, int] = {}
    for i, x in enumerate(item.tolist()):
        spots[x] = spots.get(x, 0) | 1 << i
    full = (1 << len(item)) - 1
    v, history = full, []
    for x in place.tolist():
        m = spots.get(x, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
        history.append(v)
    used = np.zeros(len(item), bool)
    i, j = len(item), len(place)
    # Back from the end: a zero bit is a step of the length at that word of the item.
    while i and j:
        if history[j - 1] >> (i - 1) & 1:
            i -= 1
        elif j > 1 and not history[j - 2] >> (i - 1) & 1:
            j -= 1
        else:
            used[i - 1] = True
            i, j = i - 1, j - 1
    return used


class Items(NamedTuple):
    """Items of a block: ids, words, first word of the answer, passages' unit rows, the item of each passage,
    all different words, the different words of each item (as places in those) with their numbers and borders, and by length
    the numbers of the whole items shorter than a passage, sorted, with their items."""

    id: list
    words: list
    answer: list
    unit: np.ndarray
    of: np.ndarray
    vocabulary: np.ndarray
    kind: np.ndarray
    times: np.ndarray
    at: np.ndarray
    whole: dict


def _answer_start(text: str, words: int) -> int:
    """Number of words before the answer of an item."""
    at = text.rfind("?")
    if at < 0 or not text[at + 1 :].strip():
        body = text.rstrip(" \n\t.!?")
        at = max(body.rfind(c) for c in ".!\n")
    before = tokens.words(pa.array([text[: at + 1]]), separator=SEPARATOR)
    return len(before.number) if len(before.number) < words else 0


def block_of(space: Space, rows: list[tuple[int, str]]) -> Items:
    """The items of a block."""
    w = tokens.words(pa.array([t for _, t in rows], pa.string()), separator=SEPARATOR)
    passages, _, of = _projected(w.number, np.diff(w.at), space.place, space.matrix)
    words = [w.number[a:b] for a, b in zip(w.at[:-1], w.at[1:], strict=True)]
    answer = [_answer_start(t or "", len(x)) for (_, t), x in zip(rows, words, strict=True)]
    item = np.repeat(np.arange(len(rows)), np.diff(w.at))
    vocabulary, kind = np.unique(w.number, return_inverse=True)
    each, times = np.unique(item * (len(vocabulary) + 1) + kind, return_counts=True)
    of_item, kind = np.divmod(each, len(vocabulary) + 1)
    at = np.searchsorted(of_item, np.arange(len(rows) + 1))
    whole = {}
    for n in sorted({len(x) for x in words if 0 < len(x) < WIDTH}):
        which = np.array([i for i, x in enumerate(words) if len(x) == n])
        number = np.array([tokens.runs(words[i], n, n)[0] for i in which], np.uint64)
        whole[n] = (np.sort(number), which[np.argsort(number, kind="stable")])
    return Items([i for i, _ in rows], words, answer, _unit(passages), of, vocabulary, kind, times, at, whole)


def _whole(items: Items, number: np.ndarray, at: np.ndarray):
    """Where texts hold an item shorter than a passage word for word: text, item, first word."""
    if not items.whole or not len(number):
        return
    begin = np.unique([items.words[i][0] for _, which in items.whole.values() for i in which])
    # Only words that an item begins with are looked at further.
    start = np.flatnonzero(begin[np.minimum(np.searchsorted(begin, number), len(begin) - 1)] == number)
    left = at[np.searchsorted(at, start, "right")] - start
    for n, (wanted, which) in items.whole.items():
        place = start[left >= n]
        # The number that ``tokens.runs`` gives the run.
        factor = tokens.random_numbers(n, n) | np.uint64(1)
        run = np.zeros(len(place), np.uint64)
        for k in range(n):
            run += number[place + k] * factor[k]
        run = tokens.mix(run)
        low, high = (np.searchsorted(wanted, run, side) for side in ("left", "right"))
        for k in np.flatnonzero(high > low).tolist():
            text = int(np.searchsorted(at, place[k], "right")) - 1
            for i in which[low[k] : high[k]].tolist():
                yield text, i, int(place[k])


def _places(items: Items, number: np.ndarray) -> np.ndarray:
    """The places of the items' words in the words ``number``, sorted by word, as ``word * (len(number) + 1) + place``."""
    kind = np.minimum(np.searchsorted(items.vocabulary, number), len(items.vocabulary) - 1)
    place = np.flatnonzero(items.vocabulary[kind] == number)
    return np.sort(kind[place] * (len(number) + 1) + place)


def _common(items: Items, places: np.ndarray, size: int, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """How many words each ``item`` and the words ``lo:hi`` of ``size`` words have in common, in any order."""
    if not len(item):
        return np.zeros(0, np.int64)
    n = items.at[item + 1] - items.at[item]
    border = np.cumsum(n) - n
    at = np.arange(n.sum()) + np.repeat(items.at[item] - border, n)
    key = items.kind[at] * (size + 1)
    there = np.searchsorted(places, key + np.repeat(hi, n)) - np.searchsorted(places, key + np.repeat(lo, n))
    return np.add.reduceat(np.minimum(there, items.times[at]), border)


def _may_hold(items: Items, places: np.ndarray, size: int, p: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which candidates (passage ``p`` of ``text``, ``item``, its window) share ``REWORDED`` of the item's words.

    Windows of neighbouring passages are almost the same: up to three of them are counted as one window first, which has at
    least the words of each, and only where that has enough are they counted by themselves.
    """
    need = REWORDED * np.array([len(x) for x in items.words])[item]
    order = np.lexsort((p, item))
    at, it, tx = p[order], item[order], text[order]
    run = np.append(True, (it[1:] != it[:-1]) | (tx[1:] != tx[:-1]) | (at[1:] != at[:-1] + 1))
    begin = np.flatnonzero(run)
    in_run = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    first = np.flatnonzero(in_run % 3 == 0)
    last = np.append(first[1:], len(order)) - 1
    enough = np.zeros(len(p), bool)
    wide = np.zeros(len(first), bool)
    for i in range(0, len(first), BLOCK):
        f, z = first[i : i + BLOCK], last[i : i + BLOCK]
        wide[i : i + BLOCK] = _common(items, places, size, it[f], lo[order[f]], hi[order[z]]) >= need[order[f]]
    left = order[np.repeat(wide, last - first + 1)]
    for i in range(0, len(left), BLOCK):
        x = left[i : i + BLOCK]
        enough[x] = _common(items, places, size, item[x], lo[x], hi[x]) >= need[x]
    return enough


FOUND = "array<struct<item_id:bigint,first:int,end:int,cosine:double,overlap:double,answer:double>>"


def search(space: Space, items: Items):
    """Arrow function: text to the items it holds, with the place in words, cosine and shares of the item and its answer."""
    kind = pa.list_(
        pa.struct(
            [("item_id", pa.int64()), ("first", pa.int32()), ("end", pa.int32())] + [(n, pa.float64()) for n in ("cosine", "overlap", "answer")]
        )
    )

    def run(text: pa.Array) -> pa.Array:
        w = tokens.words(text, separator=SEPARATOR)
        found: list[dict] = [{} for _ in range(len(text))]
        rows, start, of = _projected(w.number, np.diff(w.at), space.place, space.matrix)
        for d, i, at in _whole(items, w.number, w.at):
            first = at - int(w.at[d])
            found[d].setdefault(i, {"item_id": items.id[i], "first": first, "end": first + len(items.words[i]), "cosine": 1.0, "overlap": 1.0, "answer": 1.0})
        places = _places(items, w.number)
        size = np.array([len(x) for x in items.words])
        for a in range(0, len(rows), 2048):
            near = _unit(rows[a : a + 2048]) @ items.unit.T
            p, q = np.nonzero(near >= COSINE)
            _, once = np.unique(p * len(items.id) + items.of[q], return_index=True)
            p, q = p[once], q[once]
            item = items.of[q]
            lo = np.maximum(w.at[of[a + p]], start[a + p] - size[item])
            hi = np.minimum(w.at[of[a + p] + 1], start[a + p] + WIDTH + size[item])
            enough = _may_hold(items, places, len(w.number), p, item, lo, hi, of[a + p])
            for p, q, lo, hi in zip(p[enough].tolist(), q[enough].tolist(), lo[enough].tolist(), hi[enough].tolist(), strict=True):
                d, i = int(of[a + p]), int(items.of[q])
                item = items.words[i]
                known = found[d].get(i)
                if known and known["overlap"] > 0.95:
                    continue
                used = common_subsequence(item, w.number[lo:hi])
                overlap, answer = float(used.mean()), float(used[items.answer[i] :].mean())
                if overlap < COPIED and not (overlap >= REWORDED and answer >= ANSWERED):
                    continue
                if not known or overlap > known["overlap"]:
                    found[d][i] = {
                        "item_id": items.id[i], "first": lo - int(w.at[d]), "end": hi - int(w.at[d]),
                        "cosine": float(near[p, q]), "overlap": overlap, "answer": answer,
                    }
        return pa.array([sorted(x.values(), key=lambda r: r["item_id"]) for x in found], kind)

    return F.arrow_udf(tokens.in_slices(run), FOUND)


def searches(docs: DataFrame, benchmark: DataFrame) -> list:
    """One Arrow function for each block of items.  Items without words or id are left out."""
    known = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    known = stage(known, "benchmark")
    space = latent_space(docs, known)
    blocks = -(-known.count() // ITEMS)
    out = []
    for k in range(blocks):
        # Blocks by hash: their sizes differ little from ITEMS.
        rows = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        rows = sorted({(r["item_id"], r["text"]) for r in rows})
        block = block_of(space, rows)
        if len(block.unit):
            out.append(search(space, block))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, first, end, cosine, overlap, answer``: the benchmark items that each row of ``docs`` holds.

    Null and empty texts hold none.  Rows stand for themselves, so a repeated row has its items again.
    """
    found = docs.select("doc_id").where("false").select("doc_id", F.lit(None).cast(FOUND).alias("f"))
    for s in searches(docs, benchmark):
        found = found.unionAll(docs.select("doc_id", s("text").alias("f")))
    return found.select("doc_id", F.explode("f").alias("f")).select("doc_id", "f.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    for s in searches(docs, benchmark):
        docs = docs.where(F.size(s("text")) == 0)
    return docs


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
