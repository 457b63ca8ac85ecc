"""Byte-level BPE of whole texts as a tree of halves.

The encoding of a text is a monoid element: ``join`` of the encodings of two neighbouring texts is
the encoding of both together.  A text is halved down to ``LEAF`` code points, leaves are encoded by
tiktoken, and neighbours are joined upwards by encoding a window around the border anew.

Why tokens outside the window cannot change: the splitting pattern has no match that holds a
character other than white space followed by white space.  So a place between the two is a border of
matches in every text that contains it, whatever stands before or after, and merges never cross
matches.  The window therefore grows on either side until such a place (or an end) is inside, and
everything beyond is kept.  A run without such a place is encoded again as a whole.

Decoding goes up the same tree: bytes of neighbours are concatenated.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, functions as F

#: Code points of a leaf, and of the first window on either side of a border.
LEAF, WINDOW = 8192, 64
RANKS = "byte_bpe_50k.tiktoken"
# Python's \s and the pattern's differ on the control characters 1C to 1F; a border with neither is certain.
_BORDER = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \t\n\r])")


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    """The encoding of a rank file; loaded once by each Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _names(path: str) -> list[bytes]:
    return [b"%d" % i for i in range(encoding(path).max_token_value + 1)]


def _last_border(text: str, window: int) -> int:
    """The last certain border of ``text``, 0 if there is none; looks at ever longer ends of it."""
    while True:
        at = max(0, len(text) - window)
        found = 0
        for m in _BORDER.finditer(text, at):
            found = m.start()
        if found or not at:
            return found
        window *= 2


def _first_border(text: str) -> int:
    """The first certain border of ``text``, its length if there is none."""
    m = _BORDER.search(text)
    return m.start() if m else len(text)


def join(enc: tiktoken.Encoding, left: tuple[str, list[int]], right: tuple[str, list[int]], window: int = WINDOW) -> tuple[str, list[int]]:
    """The element of two neighbours."""
    (a, ids_a), (b, ids_b) = left, right
    if not a or not b:
        return (a + b, ids_a or ids_b)
    i, j = _last_border(a, window), _first_border(b)
    tail = len(enc.encode_ordinary(a[i:])) if i else len(ids_a)
    head = len(enc.encode_ordinary(b[:j])) if j < len(b) else len(ids_b)
    return a + b, ids_a[: len(ids_a) - tail] + enc.encode_ordinary(a[i:] + b[:j]) + ids_b[head:]


def encode(enc: tiktoken.Encoding, text: str, leaf: int = LEAF, window: int = WINDOW) -> list[int]:
    """Ids of ``text``, by halves."""
    if len(text) <= leaf:
        return enc.encode_ordinary(text)
    half = len(text) // 2
    a, b = text[:half], text[half:]
    return join(enc, (a, encode(enc, a, leaf, window)), (b, encode(enc, b, leaf, window)), window)[1]


def decode(enc: tiktoken.Encoding, ids: list[int], leaf: int = LEAF) -> bytes:
    """Bytes of ``ids``, by halves."""
    if len(ids) <= leaf:
        return enc.decode_bytes(ids)
    half = len(ids) // 2
    return decode(enc, ids[:half], leaf) + decode(enc, ids[half:], leaf)


def ids_of(path: str, leaf: int = LEAF):
    """Arrow function: text to its ids; a null text is empty."""

    def run(text: pa.Array) -> pa.Array:
        enc = encoding(path)
        return pa.array([encode(enc, t or "", leaf) for t in text.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")


def text_of(path: str, leaf: int = LEAF):
    """Arrow function: ids to their bytes."""

    def run(ids: pa.Array) -> pa.Array:
        enc = encoding(path)
        return pa.array([decode(enc, x or [], leaf) for x in ids.to_pylist()], pa.binary())

    return F.arrow_udf(run, "binary")


def digests(path: str, leaf: int = LEAF):
    """Arrow function: text to ``n_tokens, ids_sha256, decoded_sha256`` without sending the ids to the JVM."""
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]

    def run(text: pa.Array) -> pa.Array:
        enc, names = encoding(path), _names(path)
        n, of_ids, of_bytes = [], [], []
        for t in text:
            ids = encode(enc, t.as_py() or "", leaf)
            n.append(len(ids))
            of_ids.append(hashlib.sha256(b" ".join([names[i] for i in ids])).hexdigest())
            of_bytes.append(hashlib.sha256(decode(enc, ids, leaf)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], fields=fields)

    return F.arrow_udf(run, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")


def encoded(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) with the columns ``n_tokens``, ``ids`` and ``decoded``.

    Columns of these names in ``docs`` are replaced.  Null texts are empty; each row stands for itself.
    """
    path = path or public_tokenizers.path(RANKS)
    out = docs.withColumn("ids", ids_of(path, leaf)("text"))
    return out.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("decoded", text_of(path, leaf)("ids").cast("string"))


def digested(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``docs``."""
    path = path or public_tokenizers.path(RANKS)
    return docs.select("doc_id", digests(path, leaf)("text").alias("d")).select("doc_id", "d.*")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return digested(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
