"""A hidden Markov language model over whole documents.

Words are 64-bit numbers of lower-cased words.  Counts of all training words are a table.  A word's
class is its own for the ``OWN`` most frequent ones and one of ``REST`` hashed ones otherwise; the end
of a text is a class.  A state emits a class, and the class its word in proportion to the add-one
unigram chance.  Each hashed class has one unknown word of its own, so that chances sum to 1.

Baum-Welch: every round reads all training texts, tasks add up expected counts, a shuffle adds those
of the tasks.  For training, texts are cut into segments of ``SEGMENT`` tokens, of which first and
later ones have starting chances of their own; no token is left out.  Scoring does not cut: the
scaled forward recursion runs over each text from its first token to its end.

The base score needs the count of every token.  The counts of at most ``HEAD`` words go to the tasks
with the model; the other words of the texts meet the table of counts in a shuffled join.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from contentflow.llm import tokens
from contentflow.session import stage

STATES, OWN, REST = 8, 1535, 512
HEAD = 1 << 18
SEGMENT, ROUNDS = 64, 4
END = OWN + REST
CLASSES = END + 1
#: Tokens that forward and backward values are held for at a time.
BLOCK = 400_000


def _word_counts(batches):
    """Batches ``text`` to rows ``word, n``."""
    for b in tokens.sliced_batches(batches, size=1 << 24):
        word, n = np.unique(tokens.words(b.column("text")).number, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])


class Vocabulary(NamedTuple):
    """Known words in order of their number with counts and classes; log10 unigram chances of classes."""

    word: np.ndarray
    count: np.ndarray
    class_: np.ndarray
    ends: int
    total: int
    kinds: int
    log_class: np.ndarray

    def log_all(self, unknown: int) -> float:
        """log10 of what add-one counts are divided by, for so many unknown words."""
        return float(np.log10(self.total + self.kinds + unknown))

    def look_up(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0 if not in the head) and class of words."""
        if not len(self.word):
            at, hit = np.zeros(len(number), np.int64), np.zeros(len(number), bool)
        else:
            at = np.minimum(np.searchsorted(self.word, number), len(self.word) - 1)
            hit = self.word[at] == number
        rest = (OWN + ((number >> np.uint64(40)) & np.uint64(REST - 1))).astype(np.int64)
        if not len(self.word):
            return np.zeros(len(number), np.int64), rest
        class_ = np.where(hit, self.class_[at], -1)
        return np.where(hit, self.count[at], 0), np.where(class_ >= 0, class_, rest)


def vocabulary(counts: DataFrame, ends: int, head: int = HEAD) -> Vocabulary:
    """The vocabulary of a table ``word, n``; the head are the words that come often enough for at most ``head`` to do so."""
    hashed = F.shiftrightunsigned("word", 40).bitwiseAND(F.lit(REST - 1))
    by_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).collect()
    least, words = 1 << 62, 0
    for r in by_count:
        if words + r["k"] > head:
            break
        words, least = words + r["k"], r["n"]
    total = sum(r["n"] * r["k"] for r in by_count) + ends
    kinds = sum(r["k"] for r in by_count) + (ends > 0)
    rows = counts.where(F.col("n") >= least).collect()  # at most ``head`` rows
    number = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    count = np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(number)
    number, count = number[order], count[order]
    class_ = np.full(len(number), -1, np.int64)
    top = np.lexsort((number, -count))[:OWN]
    class_[top] = np.arange(len(top))
    mass = np.zeros(CLASSES)
    for r in counts.groupBy(hashed.alias("b")).agg(F.sum(F.col("n") + 1).alias("m")).collect():
        mass[OWN + r["b"]] = r["m"]
    np.subtract.at(mass, (OWN + ((number[top] >> np.uint64(40)) & np.uint64(REST - 1))).astype(np.int64), count[top] + 1)
    mass[OWN:END] += 1
    mass[: len(top)] = count[top] + 1
    mass[END] = ends + 1
    with np.errstate(divide="ignore"):
        return Vocabulary(number, count, class_, ends, total, kinds, np.log10(mass / (total + kinds + REST)))


class Model(NamedTuple):
    """Starting chances of first and later segments, transitions and emissions (classes x states)."""

    first: np.ndarray
    later: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _sequences(vocab: Vocabulary, text: pa.Array) -> tuple[tokens.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their counts, and the classes of all tokens (with ends) with the border of each text."""
    w = tokens.words(text)
    count, class_ = vocab.look_up(w.number)
    at = w.at + np.arange(len(w.at))
    out = np.empty(at[-1], np.int64)
    is_end = np.zeros(at[-1], bool)
    is_end[at[1:] - 1] = True
    out[is_end] = END
    out[~is_end] = class_
    return w, count, out, at


def _expected(model: Model, seq: np.ndarray, start: np.ndarray, length: np.ndarray, is_first: np.ndarray):
    """Expected counts of the segments ``seq[start:start + length]``: starts (first, later), moves, emissions, and log likelihood."""
    order = np.argsort(-length, kind="stable")
    start, length, is_first = start[order], length[order], is_first[order]
    steps, n = int(length[0]), len(start)
    alive = np.searchsorted(-length, -np.arange(steps), "left")
    alpha = np.zeros((steps, n, STATES))
    scale = np.ones((steps, n))
    at = np.where(is_first[:, None], model.first, model.later)
    for t in range(steps):
        m = alive[t]
        if t:
            at = alpha[t - 1, :m] @ model.move
        at = at[:m] * model.emit[seq[start[:m] + t]]
        scale[t, :m] = at.sum(axis=1)
        alpha[t, :m] = at / scale[t, :m, None]
    moves = np.zeros((STATES, STATES))
    beta = np.ones((n, STATES))
    for t in range(steps - 1, -1, -1):
        m = alive[t]
        here = beta[:m] * model.emit[seq[start[:m] + t]] / scale[t, :m, None]
        if t:
            moves += alpha[t - 1, :m].T @ here
        alpha[t, :m] *= beta[:m]
        beta[:m] = here @ model.move.T
    moves *= model.move
    starts = np.stack([alpha[0][is_first].sum(axis=0), alpha[0][~is_first].sum(axis=0)])
    emit = np.zeros((CLASSES, STATES))
    live = np.arange(n)[None, :] < alive[:, None]
    class_ = seq[(start[None, :] + np.arange(steps)[:, None])[live]]
    gamma = alpha[live]
    for k in range(STATES):
        emit[:, k] = np.bincount(class_, gamma[:, k], CLASSES)
    return starts, moves, emit, float(np.log10(scale).sum())


def _tallied(vocab: Vocabulary, model: Model):
    """Batches ``text`` to rows ``cell, value``: the expected counts of a task."""

    def run(batches):
        starts, moves, emit, loglik = np.zeros((2, STATES)), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES)), 0.0
        for b in tokens.sliced_batches(batches):
            _, _, seq, at = _sequences(vocab, b.column("text"))
            if not len(seq):
                continue
            pieces = -(-np.diff(at) // SEGMENT)
            number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.repeat(at[:-1], pieces) + number * SEGMENT
            length = np.minimum(np.repeat(at[1:], pieces) - start, SEGMENT)
            for i in range(0, len(start), BLOCK // SEGMENT):
                part = slice(i, i + BLOCK // SEGMENT)
                s, m, e, ll = _expected(model, seq, start[part], length[part], number[part] == 0)
                starts, moves, emit, loglik = starts + s, moves + m, emit + e, loglik + ll
        value = np.concatenate([[loglik], starts.ravel(), moves.ravel(), emit.ravel()])
        cell = np.flatnonzero(value)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(value[cell])], names=["cell", "value"])

    return run


def train(texts: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over the column ``text``; emissions start at the class chances, shaken."""
    chance = 10.0**vocab.log_class
    shaken = np.exp(np.random.default_rng(3).normal(0, 0.7, (CLASSES, STATES)))
    even = np.full(STATES, 1 / STATES)
    move = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(move, 0.9)
    emit = chance[:, None] * shaken
    model = Model(even, even, move, emit / emit.sum(axis=0))
    if not vocab.total:
        return model
    for _ in range(rounds):
        rows = texts.mapInArrow(_tallied(vocab, model), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
        value = np.zeros(1 + 2 * STATES + STATES**2 + CLASSES * STATES)
        for r in rows.collect():  # at most one row per parameter
            value[r["cell"]] = r["value"]
        starts, moves, emit = np.split(value[1:], [2 * STATES, 2 * STATES + STATES**2])
        starts = starts.reshape(2, STATES) + 0.1
        moves = moves.reshape(STATES, STATES) + 0.1
        emit = emit.reshape(CLASSES, STATES) + chance[:, None]
        model = Model(
            *(starts / starts.sum(axis=1, keepdims=True)), moves / moves.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)
        )
    return model


def forward(model: Model, seq: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log10 likelihood of each whole sequence ``seq[at[i]:at[i + 1]]``."""
    length = np.diff(at)
    order = np.argsort(-length, kind="stable")
    start, sorted_length = at[:-1][order], length[order]
    out = np.zeros(len(order))
    steps = int(sorted_length[0]) if len(order) else 0
    alive = np.searchsorted(-sorted_length, -np.arange(steps), "left")
    state = np.tile(model.first, (len(order), 1))
    for t in range(steps):
        m = alive[t]
        state = state[:m] @ model.move if t else state[:m]
        state = state * model.emit[seq[start[:m] + t]]
        scale = state.sum(axis=1)
        out[:m] += np.log10(scale)
        state /= scale[:, None]
    back = np.empty(len(order))
    back[order] = out
    return back


def _parts(vocab: Vocabulary, model: Model):
    """Arrow function: text to token count, known head tokens, the sums of log10 (count + 1) and of the model, and its other words."""
    fields = [
        pa.field("n", pa.int64()), pa.field("known", pa.int64()), pa.field("logs", pa.float64()), pa.field("hidden", pa.float64()),
        pa.field("word", pa.list_(pa.int64())), pa.field("times", pa.list_(pa.int32())),
    ]

    def run(text: pa.Array) -> pa.Array:
        w, count, seq, at = _sequences(vocab, text)
        size = len(text)
        row = np.repeat(np.arange(size), np.diff(w.at))
        logs = np.bincount(row, np.log10(count + 1.0), size) + np.log10(vocab.ends + 1)
        known = np.bincount(row, count > 0, size).astype(np.int64) + (vocab.ends > 0)
        classes = np.bincount(np.repeat(np.arange(size), np.diff(at)), vocab.log_class[seq], size)
        hidden = forward(model, seq, at) - classes
        words, times, border = [], [], [0]
        rare = count == 0
        of_text = np.searchsorted(row[rare], np.arange(size + 1))
        number = w.number[rare]
        for a, b in zip(of_text[:-1].tolist(), of_text[1:].tolist(), strict=True):
            x, n = np.unique(number[a:b], return_counts=True)
            words.append(x.view(np.int64))
            times.append(n.astype(np.int32))
            border.append(border[-1] + len(x))
        borders = pa.array(border, pa.int32())
        flat = lambda parts, kind: pa.ListArray.from_arrays(borders, pa.array(np.concatenate(parts) if parts else [], kind))
        return pa.StructArray.from_arrays(
            [pa.array(np.diff(at)), pa.array(known), pa.array(logs), pa.array(hidden), flat(words, pa.int64()), flat(times, pa.int32())],
            fields=fields,
        )

    return F.arrow_udf(tokens.in_slices(run, 1 << 23), "struct<n:bigint,known:bigint,logs:double,hidden:double,word:array<bigint>,times:array<int>>")


def scored(docs: DataFrame, held_out: Column, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of ``docs`` (``doc_id``, ``text``).

    Rows where ``held_out`` is false are learned from.  A null text is one end token.  Repeated rows
    are learned from and scored one by one, whatever their ids.  Without a row to learn from every
    chance is 1 and both scores are 0.
    """
    docs = docs.select("doc_id", F.col("text").alias("text"), held_out.alias("held_out"))
    train_texts = docs.where("NOT held_out").select("text")
    counts = train_texts.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stage(counts, "counts")
    vocab = vocabulary(counts, train_texts.count(), head)
    model = train(train_texts, vocab, rounds)
    rows = docs.select("doc_id", "held_out", F.monotonically_increasing_id().alias("uid"), _parts(vocab, model)("text").alias("p"))
    # Written once: the running numbers have to stay as they are.
    rows = stage(rows.select("doc_id", "held_out", "uid", "p.*"), "scored")
    rare = rows.select("uid", F.explode(F.arrays_zip("word", "times")).alias("x")).select("uid", "x.word", "x.times")
    found = rare.join(counts.select("word", F.col("n").alias("c")), "word")
    found = found.groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"), F.sum(F.col("times").cast("long")).alias("met")
    )
    known = F.col("known") + F.coalesce("met", F.lit(0))
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0))
    base = logs - F.col("n") * F.lit(vocab.log_all(1))
    score = logs - F.col("n") * F.lit(vocab.log_all(REST)) + F.col("hidden")
    return rows.join(found, "uid", "left").select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        known.alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (score if vocab.total else base).alias("score"),
    )


def op9_hmm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return scored(docs, held_out)
