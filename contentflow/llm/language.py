"""Language of spans: script ranges narrow the candidates, Viterbi chooses with a penalty for switching.

Training counts cover every training text: how often each hashed byte trigram of a word (with its
borders) comes in each language, and how many words each language has in each script.  A word's score
for a language is the mean log share of its trigrams, ``WEIGHT`` times; languages that hardly use the
word's script are left out unless none uses it.  Along a text, the best sequence of languages pays
``SWITCH`` for every change.  All texts of a batch advance together, a word at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from contentflow.llm import tokens

GRAMS = 1 << 16
WEIGHT, SWITCH = 3.0, 6.0
#: Least share of a language's words in a script for the language to be a candidate there.
IN_SCRIPT = 0.002
#: First code point and name of each script range; fixed values of the Unicode blocks.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"),
    (0xAC00, "hangul"), (0xD800, "other"),
]
NAMES = sorted({name for _, name in SCRIPTS})
_FIRST = np.array([at for at, _ in SCRIPTS])
_NAME = np.array([NAMES.index(name) for _, name in SCRIPTS])
BLOCK = 1 << 20


class _Parts:
    """Words of a batch (letter runs) with their trigrams and scripts."""

    def __init__(self, text: pa.Array):
        self.w = w = tokens.words(text, separator=tokens.NOT_LETTER)
        self.n = len(w.start)
        self.script = self._scripts(w)

    @staticmethod
    def _scripts(w: tokens.Words) -> np.ndarray:
        """Script of each word: that of its first code point of two or three bytes outside the Latin range, else Latin."""
        out = np.full(len(w.start), NAMES.index("latin"), np.int64)
        lead = np.flatnonzero((w.data >= 0xCD) & (w.data < 0xF0))
        if len(lead):
            a, b = w.data[lead].astype(np.int64), w.data[np.minimum(lead + 1, len(w.data) - 1)].astype(np.int64)
            c = w.data[np.minimum(lead + 2, len(w.data) - 1)].astype(np.int64)
            point = np.where(a < 0xE0, (a & 31) << 6 | b & 63, (a & 15) << 12 | (b & 63) << 6 | c & 63)
            script = _NAME[np.searchsorted(_FIRST, point, "right") - 1]
            word = np.searchsorted(w.start, lead, "right") - 1
            use = script != NAMES.index("latin")
            out[word[use][::-1]] = script[use][::-1]
        return out

    def grams(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Word (from ``first`` on) and gram of every byte of the words ``first:last``."""
        w = self.w
        lo, hi = w.start[first], w.end[last - 1]
        byte = tokens.LOWER[w.data[lo:hi]] + np.uint64(1)
        start, end = w.start[first:last] - lo, w.end[first:last] - lo
        inside = np.zeros(hi - lo + 1, np.int64)
        inside[start] += 1
        np.subtract.at(inside, end, 1)
        inside = np.cumsum(inside[:-1]).astype(bool)
        padded = np.zeros(hi - lo + 2, np.uint64)
        padded[1:-1] = np.where(inside, byte, np.uint64(0))
        # Two neighbouring words of different texts may touch: borders are set by hand.
        left, right = padded[:-2].copy(), padded[2:].copy()
        left[start], right[end - 1] = 0, 0
        at = np.flatnonzero(inside)
        code = left[at] | (padded[1:-1][at] << np.uint64(9)) | (right[at] << np.uint64(18))
        return np.searchsorted(start, at, "right") - 1, (tokens.mix(code) & np.uint64(GRAMS - 1)).astype(np.int64)

    def blocks(self):
        at = 0
        while at < self.n:
            to = max(at + 1, int(np.searchsorted(self.w.end, self.w.start[at] + BLOCK, "right")))
            yield at, to
            at = to


def _counted(names: list[str]):
    """Batches ``text, lang`` to rows ``kind, cell, lang, n``: kind 0 counts grams, 1 the words of a script."""

    def run(batches):
        for b in tokens.sliced_batches(batches):
            parts = _Parts(b.column("text"))
            lang = np.array([names.index(x) for x in b.column("lang").to_pylist()], np.int64)
            of_word = np.repeat(lang, np.diff(parts.w.at))
            grams = np.zeros(len(names) * GRAMS, np.int64)
            for at, to in parts.blocks():
                word, gram = parts.grams(at, to)
                grams += np.bincount(of_word[at:to][word] * GRAMS + gram, minlength=len(grams))
            scripts = np.bincount(of_word * len(NAMES) + parts.script, minlength=len(names) * len(NAMES))
            for kind, count, width in ((0, grams, GRAMS), (1, scripts, len(NAMES))):
                at = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), kind)), pa.array(at % width), pa.array(at // width), pa.array(count[at])],
                    names=["kind", "cell", "lang", "n"],
                )

    return run


class Model:
    """Language names, log shares of grams (grams x languages) and candidates (scripts x languages)."""

    def __init__(self, names: list[str], share: np.ndarray, candidate: np.ndarray):
        self.names, self.share, self.candidate = names, share.astype(np.float32), candidate

    def word_scores(self, parts: _Parts) -> np.ndarray:
        out = np.zeros((parts.n, len(self.names)), np.float32)
        for at, to in parts.blocks():
            word, gram = parts.grams(at, to)
            first = np.searchsorted(word, np.arange(to - at))
            out[at:to] = np.add.reduceat(self.share[gram], first, axis=0) / np.diff(np.append(first, len(word)))[:, None]
        out *= WEIGHT
        out[~self.candidate[parts.script]] = -1e4
        return out


def fit(labelled: DataFrame) -> Model:
    """The model of rows ``text, lang``; rows with a null in either are left out.

    The model has ``GRAMS`` rows and a column for each language value.  Without rows it has no language.
    """
    known = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    names = sorted(r["lang"] for r in known.select("lang").distinct().collect())  # one row per language
    if not names:
        return Model([], np.zeros((GRAMS, 0)), np.zeros((len(NAMES), 0), bool))
    rows = known.mapInArrow(_counted(names), "kind long, cell long, lang long, n long")
    grams, scripts = np.zeros((GRAMS, len(names))), np.zeros((len(NAMES), len(names)))
    for r in rows.groupBy("kind", "cell", "lang").agg(F.sum("n").alias("n")).toLocalIterator():
        (scripts if r["kind"] else grams)[r["cell"], r["lang"]] = r["n"]
    share = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * GRAMS))
    candidate = scripts >= IN_SCRIPT * np.maximum(scripts.sum(axis=0), 1)
    candidate[~candidate.any(axis=1)] = True
    return Model(names, share, candidate)


def best_path(score: np.ndarray, at: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language of each word: the sequence of the greatest sum of scores less ``switch`` for each change, text by text.

    Ties go to staying, then to the smaller language number.
    """
    n, k = score.shape
    length = np.diff(at)
    order = np.argsort(-length, kind="stable")
    first, sorted_length = at[:-1][order], length[order]
    back = np.zeros((n, k), np.int16)
    total = np.zeros((len(order), k), np.float32)
    steps = int(sorted_length[0]) if len(order) else 0
    alive = np.searchsorted(-sorted_length, -np.arange(steps), "left")
    stay = np.arange(k, dtype=np.int16)
    for t in range(steps):
        m = alive[t]
        here = first[:m] + t
        if t:
            top = total[:m].argmax(axis=1)
            jump = total[np.arange(m), top][:, None] - switch
            moved = jump > total[:m]
            back[here] = np.where(moved, top[:, None].astype(np.int16), stay)
            total[:m] = np.where(moved, jump, total[:m])
        total[:m] += score[here]
    out = np.zeros(n, np.int16)
    state = total.argmax(axis=1).astype(np.int16) if k else np.zeros(len(order), np.int16)
    for t in range(steps - 1, -1, -1):
        m = alive[t]
        here = first[:m] + t
        out[here] = state[:m]
        state[:m] = back[here, state[:m]]
    return out


def labelled_spans(model: Model):
    """Arrow function: text to ``lang_pred, score, spans``.

    ``spans`` are runs of words (letter runs) of one language as ``lang:first:end`` in word numbers;
    ``lang_pred`` has the most bytes of words, ties by name; ``score`` is its share of them times the mean
    chance, against the other languages, of the words given to it.
    """
    fields = [pa.field("lang_pred", pa.string()), pa.field("score", pa.float64()), pa.field("spans", pa.string())]

    def run(text: pa.Array) -> pa.Array:
        parts = _Parts(text)
        w, k, size = parts.w, len(model.names), len(text)
        if not k or not parts.n:
            return pa.StructArray.from_arrays([pa.array(["und"] * size), pa.array([0.0] * size), pa.array([""] * size)], fields=fields)
        score = model.word_scores(parts)
        path = best_path(score, w.at)
        chance = np.exp(score - score.max(axis=1, keepdims=True))
        chance = chance[np.arange(parts.n), path] / chance.sum(axis=1)
        row = np.repeat(np.arange(size), np.diff(w.at))
        cell = row * k + path
        weight = (w.end - w.start).astype(np.float64)
        each = np.bincount(cell, weight, size * k).reshape(size, k)
        sure = np.bincount(cell, weight * chance, size * k).reshape(size, k)
        best = each.argmax(axis=1)
        value = np.clip(sure[np.arange(size), best] / np.maximum(each.sum(axis=1), 1), 0, 1)
        new = np.ones(parts.n, bool)
        new[1:] = (path[1:] != path[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        end = np.append(at[1:], parts.n)
        spans: list[list[str]] = [[] for _ in range(size)]
        for a, b in zip(at.tolist(), end.tolist(), strict=True):
            i = row[a]
            spans[i].append(f"{model.names[path[a]]}:{a - w.at[i]}:{b - w.at[i]}")
        has = np.diff(w.at) > 0
        return pa.StructArray.from_arrays(
            [
                pa.array([model.names[x] if h else "und" for x, h in zip(best.tolist(), has.tolist(), strict=True)]),
                pa.array(np.where(has, value, 0.0)),
                pa.array([",".join(s) for s in spans]),
            ],
            fields=fields,
        )

    return F.arrow_udf(tokens.in_slices(run), "struct<lang_pred:string,score:double,spans:string>")


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``spans``; a text that is null or has no letter is ``und`` with score 0 and no span.

    Rows stand for themselves; columns of these names in ``docs`` are replaced.
    """
    out = docs.drop("lang_pred", "score", "spans").select("*", labelled_spans(model)("text").alias("_found"))
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return out.select(
        *[c for c in out.columns if c != "_found"],
        F.when(lettered, F.col("_found.lang_pred")).otherwise("und").alias("lang_pred"),
        F.when(lettered, F.col("_found.score")).otherwise(0.0).alias("score"),
        F.when(lettered, F.col("_found.spans")).otherwise("").alias("spans"),
    )


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held_out))
    return identified(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "spans")
