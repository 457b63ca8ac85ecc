"""Toxicity by a factorization machine over hashed terms.

A document is the set of its lower-case letter runs, hashed into ``SLOTS`` slots; the score is the
logistic function of a bias, a weight for each term and the inner products of the terms' factors, so
a pair of terms can count for more, or less, than the two alone.

Term counts by label cover all labelled training texts, each different set of terms once, so a group
of copies is not evidence many times over.  Terms that come in enough texts and lean to a label beyond
``LEAN`` standard errors take part.  The machine is fitted on about ``SAMPLE`` texts at most, those with the
smallest hash, by rounds of gradient steps on partitions whose models are averaged; the model has
``SLOTS`` rows at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from contentflow.llm import tokens
from contentflow.session import stage

SLOTS = 1 << 18
FACTORS = 4
#: Least number of texts of a term, and of standard errors by which its share of toxic texts is off.
TEXTS, LEAN = 8, 4.0
SAMPLE = 50_000
SHARDS, ROUNDS, PASSES = 8, 6, 4
RATE, DECAY = 0.3, 1e-4
_FULL = 0xFFFF


def _slots(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of each term of each text, every pair once, in order of rows."""
    w = tokens.words(text, separator=tokens.NOT_LETTER)
    row = np.repeat(np.arange(len(text)), np.diff(w.at))
    both = np.unique(row * SLOTS + (w.number & np.uint64(SLOTS - 1)).astype(np.int64))
    return both // SLOTS, both % SLOTS


def packed():
    """Arrow function: text to its terms, as the differences of rising slots in 16 bits; the largest value only adds up."""

    def run(text: pa.Array) -> pa.Array:
        row, slot = _slots(text)
        step = slot.copy()
        step[1:] -= np.where(row[1:] == row[:-1], slot[:-1], 0)
        width = 1 + step // _FULL
        end = np.cumsum(width)
        out = np.full(int(end[-1]) if len(end) else 0, _FULL, np.uint16)
        out[end - 1] = step % _FULL
        at = np.append(0, end)[np.searchsorted(row, np.arange(len(text) + 1))] * 2
        return pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out)])

    return F.arrow_udf(tokens.in_slices(run), "binary")


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of each term of packed terms."""
    data, offset = tokens.texts(column)
    step = np.frombuffer(data.tobytes(), np.uint16).astype(np.int64)
    at = offset // 2
    upto = np.append(0, np.cumsum(step))
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ends = step != _FULL
    return row[ends], (upto[1:] - upto[at[:-1]][row])[ends]


def _by_label(batches):
    """Batches ``terms, toxic`` to rows ``slot, texts, toxic``."""
    for b in batches:
        row, slot = _unpacked(b.column("terms"))
        toxic = b.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        kinds, at = np.unique(slot, return_inverse=True)
        texts = np.bincount(at, minlength=len(kinds))
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds), pa.array(texts), pa.array(np.bincount(at, toxic[row], len(kinds)).astype(np.int64))],
            names=["slot", "texts", "toxic"],
        )


def _featured(place: np.ndarray):
    """Batches ``terms, toxic, shard`` to rows ``shard, toxic, terms`` with the numbers of the terms that take part."""

    def run(batches):
        for b in batches:
            row, slot = _unpacked(b.column("terms"))
            term = place[slot]
            row, term = row[term >= 0], term[term >= 0]
            at = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            terms = pa.ListArray.from_arrays(pa.array(at), pa.array(term.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("toxic"), terms], names=["shard", "toxic", "terms"])

    return run


class Machine:
    """Bias, weights and factors; ``place[slot]`` is a term's row, or -1."""

    def __init__(self, place: np.ndarray, w: np.ndarray, v: np.ndarray, bias: float):
        self.place, self.w, self.v, self.bias = place, w, v, bias

    def scores(self, text: pa.Array) -> np.ndarray:
        row, slot = _slots(text)
        term = self.place[slot]
        row, term = row[term >= 0], term[term >= 0]
        n = len(text)
        v = self.v[term]
        total = np.stack([np.bincount(row, v[:, f], n) for f in range(v.shape[1])]) if len(row) else np.zeros((FACTORS, n))
        square = np.bincount(row, (v * v).sum(axis=1), n) if len(row) else np.zeros(n)
        linear = np.bincount(row, self.w[term], n) if len(row) else np.zeros(n)
        z = self.bias + linear + 0.5 * ((total**2).sum(axis=0) - square)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _steps(w: np.ndarray, v: np.ndarray, bias: float, turn: int):
    """Gradient steps over the rows of a partition, from the model given; one row with the model it ends at."""

    def run(batches):
        rows = [(y, np.asarray(t, np.int64)) for b in batches for y, t in zip(b.column("toxic").to_pylist(), b.column("terms").to_pylist(), strict=True)]
        if not rows:
            return
        a, c, z0 = w.copy(), v.copy(), bias
        ga, gc, gz = np.ones_like(a), np.ones_like(c), 1.0
        order = np.random.default_rng(turn)
        for _ in range(PASSES):
            for i in order.permutation(len(rows)):
                y, t = rows[i]
                f = c[t]
                total = f.sum(axis=0)
                z = z0 + a[t].sum() + 0.5 * float((total**2).sum() - (f**2).sum())
                g = 1 / (1 + np.exp(-min(max(z, -40), 40))) - y
                da, dc = g + DECAY * a[t], g * (total - f) + DECAY * f
                ga[t] += da**2
                gc[t] += dc**2
                gz += g * g
                a[t] -= RATE * da / np.sqrt(ga[t])
                c[t] -= RATE * dc / np.sqrt(gc[t])
                z0 -= RATE * g / np.sqrt(gz)
        flat = np.concatenate([[len(rows), z0], a, c.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([flat.tolist()], pa.list_(pa.float64()))], names=["model"])

    return run


def fit(labelled: DataFrame) -> Machine:
    """The machine learned from rows ``terms`` (see ``packed``) and ``toxic`` (0 or 1).

    Equal sets of terms count once, with the larger label; rows without a label are left out.
    Without any row the bias is -2 and no term takes part.
    """
    known = labelled.where("toxic IS NOT NULL")
    once = known.groupBy(F.md5("terms").alias("key")).agg(F.max("toxic").cast("long").alias("toxic"), F.first("terms").alias("terms"))
    once = stage(once, "labelled")
    size = once.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    n, bad = size["n"], size["toxic"]
    place = np.full(SLOTS, -1, np.int32)
    if not n:
        return Machine(place, np.zeros(0), np.zeros((0, FACTORS)), -2.0)
    share = (bad + 1) / (n + 2)
    counts = once.select("terms", "toxic").mapInArrow(_by_label, "slot bigint, texts bigint, toxic bigint")
    counts = counts.groupBy("slot").agg(F.sum("texts").alias("texts"), F.sum("toxic").alias("toxic")).where(f"texts >= {TEXTS}")
    off = F.abs(F.col("toxic") - F.col("texts") * share) / F.sqrt(F.col("texts") * share * (1 - share))
    chosen = sorted(r["slot"] for r in counts.where(off >= LEAN).select("slot").collect())  # at most SLOTS rows
    place[chosen] = np.arange(len(chosen), dtype=np.int32)
    sample = once.where(F.pmod(F.xxhash64("key"), F.lit(1 << 32)) < int(min(1, SAMPLE / n) * (1 << 32)))
    shard = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(SHARDS)).cast("int").alias("shard")
    rows = sample.select("terms", "toxic", shard).mapInArrow(_featured(place), "shard int, toxic bigint, terms array<int>")
    rows = stage(rows.repartition(SHARDS, "shard"), "features")
    w = np.zeros(len(chosen))
    v = np.random.default_rng(7).normal(0, 0.05, (len(chosen), FACTORS))
    bias = float(np.log(share / (1 - share)))
    for turn in range(ROUNDS):
        models = np.array([r["model"] for r in rows.mapInArrow(_steps(w, v, bias, turn), "model array<double>").collect()])
        mean = np.average(models[:, 1:], axis=0, weights=models[:, 0])
        bias, w, v = float(mean[0]), mean[1 : 1 + len(w)], mean[1 + len(w) :].reshape(v.shape)
    return Machine(place, w, v, bias)


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on); a null text counts as empty."""

    def run(text: pa.Array) -> pa.Array:
        return pa.array(machine.scores(text), pa.float64())

    out = docs.withColumn("score", F.arrow_udf(tokens.in_slices(run), "double")("text"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    # The terms are a small part of a text.  The same join at any size, so that costs grow evenly.
    terms = docs.where(~held_out).select("doc_id", packed()("text").alias("terms"))
    machine = fit(terms.join(labels.hint("merge"), "doc_id").select("terms", "toxic"))
    return scored(docs, machine).select("doc_id", held_out.alias("held_out"), "score", "predicted")
