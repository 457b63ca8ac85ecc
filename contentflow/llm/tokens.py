"""Words of whole Arrow batches as 64-bit numbers, without a Python object per word.

A word's number is a polynomial in its bytes modulo 2**64, mixed at the end.  Prefix sums give the
polynomial of every word of a block at once, so the cost is a few numpy passes over the bytes.
Blocks end at word borders; memory beside the text is some arrays of ``BLOCK`` items and 8 bytes
per word.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

#: [\x20\x09-\x0D] separates words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything that is not an ASCII letter or part of a longer code point separates words.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[ord("a") : ord("z") + 1] = NOT_LETTER[ord("A") : ord("Z") + 1] = NOT_LETTER[128:] = False
SAME = np.arange(256, dtype=np.uint64) + np.uint64(1)
#: A-Z in lower case, all else as it is.
LOWER = SAME.copy()
LOWER[ord("A") : ord("Z") + 1] += np.uint64(32)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_P, BLOCK + 1)
_INV = _powers(pow(_P, -1, 1 << 64), BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def random_numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers, the same everywhere."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_P) + mix(np.uint64([seed + 1])))


class Words(NamedTuple):
    """``number[at[i]:at[i + 1]]`` are the words of text ``i``; ``start`` and ``end`` index ``data``."""

    number: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    offset: np.ndarray


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the border of each; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, borders, data = column.buffers()
    n = len(column)
    if borders is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(borders, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """The number of each word ``data[start:end]``."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, "right")))
        if end[i] - start[i] > BLOCK:
            out[i] = _long_word(data[start[i] : end[i]], fold)
        else:
            lo = start[i]
            value = fold[data[lo : end[j - 1]]]
            sums = np.zeros(len(value) + 1, np.uint64)
            np.cumsum(value * _POW[: len(value)], out=sums[1:])
            s = start[i:j] - lo
            out[i:j] = (sums[end[i:j] - lo] - sums[s]) * _INV[s]
        i = j
    return mix(out)


def _long_word(word: np.ndarray, fold: np.ndarray) -> np.uint64:
    total = 0
    for at in range(0, len(word), BLOCK):
        part = fold[word[at : at + BLOCK]]
        total += int((part * _POW[: len(part)]).sum(dtype=np.uint64)) * pow(_P, at, 1 << 64)
    return np.uint64(total & _MASK)


def words(column: pa.Array, separator: np.ndarray = SPACE, fold: np.ndarray = LOWER) -> Words:
    """Words of every text of a batch."""
    data, offset = texts(column)
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(offset), np.int64), none, none, data, offset)
    gap = separator[data]
    left = np.empty(n, bool)
    left[0], left[1:] = True, gap[:-1]
    left[offset[offset < n]] = True
    right = np.empty(n, bool)
    right[-1], right[:-1] = True, gap[1:]
    right[offset[offset > 0] - 1] = True
    start = np.flatnonzero(~gap & left)
    end = np.flatnonzero(~gap & right) + 1
    return Words(word_numbers(data, start, end, fold), np.searchsorted(start, offset), start, end, data, offset)


def in_slices(run, size: int = 1 << 22):
    """``run`` on parts of its columns of about ``size`` bytes (whole rows), so that its arrays stay small."""

    def sliced(*columns: pa.Array) -> pa.Array:
        weight = np.cumsum(sum(c.nbytes for c in columns) / max(len(columns[0]), 1) * np.ones(len(columns[0])))
        text = [c for c in columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
        if text:
            weight = np.sum([texts(c)[1][1:] for c in text], axis=0)
        out, at = [], 0
        while at < len(weight):
            done = weight[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(weight, done + size, "right")))
            out.append(run(*[c.slice(at, to - at) for c in columns]))
            at = to
        return pa.concat_arrays(out) if out else run(*columns)

    return sliced


def sliced_batches(batches, column: str = "text", size: int = 1 << 22):
    """The rows of Arrow batches in batches of about ``size`` bytes of ``column``."""
    for b in batches:
        weight, at = texts(b.column(column))[1], 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(weight, weight[at] + size, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def runs(number: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """One number for each run of ``length`` neighbouring items."""
    n = len(number) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = random_numbers(length, seed) | np.uint64(1)
    total = number[:n] * factor[0]
    for i in range(1, length):
        total += number[i : i + n] * factor[i]
    return mix(total)


def shingle_sets(column: pa.Array, length: int) -> list[np.ndarray]:
    """Sorted distinct shingles of ``length`` words of each text.

    A text of fewer words is one shingle; a text without words has none.
    """
    w = words(column)
    whole = runs(w.number, length)
    out = []
    for a, b in zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True):
        if b - a >= length:
            out.append(np.unique(whole[a : b - length + 1]))
        elif b > a:
            out.append(runs(w.number[a:b], b - a, seed=b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
