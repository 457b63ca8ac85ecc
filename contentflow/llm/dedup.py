"""MinHash near-duplicates by a multi-index Hamming join.

A document's word shingles give a signature of ``positions`` MinHash values of ``BITS`` bits.  Two sets
of similarity s differ at each position with probability at most 1 - s, so sets at the threshold
stay within ``distance`` differing positions but for ``MISS`` of them.  The signature is cut into
chunks.  By the pigeonhole principle two signatures within the distance have a chunk with at most
``ERRORS`` differing positions, so with every choice of that many positions left out they share a
key: no pair within the distance is missed, and there is no limit on the size of a key's group.

Equal sets are one node.  Candidates are confirmed on the full sets.  Groups are never expanded
into pairs as they are: first each node is compared with the best connected node it shares a key
with, then only pairs that are still in different components are compared, each once, and only if
``SKETCH`` one-bit MinHash values allow for the threshold (again but for ``MISS`` of such pairs).
"""

from __future__ import annotations

from itertools import combinations
from math import comb, lgamma
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from contentflow.llm import tokens
from contentflow.llm.graph import components
from contentflow.session import stage

BITS = 8
ERRORS = 1
MISS = 2e-5
#: Positions of a chunk by the least similarity: the longer, the more selective.
CHUNK_SIZES = ((0.83, 6), (0.75, 5), (0.6, 4))
#: Bits of the sketch that thins out the last comparisons.
SKETCH = 2048
#: Nodes of a key that are compared with each other in one go.
CELL = 512


class Shape(NamedTuple):
    """Chunks of a signature, positions of a chunk, and the distance that is guaranteed."""

    chunks: int
    size: int

    @property
    def positions(self) -> int:
        return self.chunks * self.size

    @property
    def distance(self) -> int:
        return self.chunks * (ERRORS + 1) - 1

    @property
    def lanes(self) -> list[str]:
        """One 64-bit column for each chunk, a position in each byte."""
        return [f"l{i}" for i in range(self.chunks)]


SKETCHED = [f"b{i}" for i in range(SKETCH // 64)]


def _chances(n: int, q: float) -> np.ndarray:
    """Chance of more than i of ``n`` independent events of chance ``q``, for each i."""
    of = np.array([lgamma(i + 1) for i in range(n + 1)])
    i = np.arange(n + 1)
    each = np.exp(of[n] - of - of[::-1] + i * np.log(q) + (n - i) * np.log1p(-q))
    return np.append(np.cumsum(each[::-1])[::-1][1:], 0.0)


def sketch_distance(percent: int) -> int:
    """Differing bits of the sketch that pairs at the threshold exceed with a chance of at most ``MISS``."""
    return int(np.argmax(_chances(SKETCH, (1 - percent / 100) / 2) <= MISS))


def shape(percent: int) -> Shape:
    """The smallest signature that misses at most ``MISS`` of the pairs at the threshold."""
    s = percent / 100
    size = next((c for least, c in CHUNK_SIZES if s >= least), 3)
    for chunks in range(2, 128 // size + 1):
        sh = Shape(chunks, size)
        if _chances(sh.positions, (1 - s) * (1 - 2**-BITS))[sh.distance] <= MISS:
            return sh
    return Shape(128 // size, size)


def signed(length: int, sh: Shape):
    """Arrow function: text to the size of its shingle set, two hashes of the set and the signature."""
    fields = [pa.field(n, pa.int64()) for n in ("n", "h1", "h2", *sh.lanes)]

    def run(text: pa.Array) -> pa.Array:
        factor, shift = _hashes(sh.positions, 11)
        sets = tokens.shingle_sets(text, length)
        out = np.zeros((len(sets), 3 + sh.chunks), np.uint64)
        for i, x in enumerate(sets):
            if len(x):
                lanes = np.zeros((sh.chunks, 8), np.uint8)
                lanes[:, : sh.size] = (_least(x, factor, shift) >> np.uint64(64 - BITS)).reshape(sh.chunks, sh.size)
                out[i, 0] = len(x)
                out[i, 1] = tokens.mix(x + np.uint64(1)).sum(dtype=np.uint64)
                out[i, 2] = tokens.mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                out[i, 3:] = lanes.view(np.uint64)[:, 0]
        return pa.StructArray.from_arrays([pa.array(c) for c in np.ascontiguousarray(out.view(np.int64).T)], fields=fields)

    kind = "struct<" + ",".join(f"{f.name}:bigint" for f in fields) + ">"
    return F.arrow_udf(tokens.in_slices(run), kind)


def _hashes(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    return (tokens.random_numbers(n, seed) | np.uint64(1))[:, None], tokens.random_numbers(n, seed + 1)[:, None]


def _least(x: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the set, mixed."""
    least = np.full(len(factor), ~np.uint64(0))
    for at in range(0, len(x), 1024):
        np.minimum(least, (x[None, at : at + 1024] * factor + shift).min(axis=1), out=least)
    return tokens.mix(least)


def sketched(length: int):
    """Arrow function: text to the bits of its sketch."""
    fields = [pa.field(n, pa.int64()) for n in SKETCHED]

    def run(text: pa.Array) -> pa.Array:
        factor, shift = _hashes(SKETCH, 31)
        sets = tokens.shingle_sets(text, length)
        bits = np.zeros((len(sets), SKETCH), np.uint8)
        for i, x in enumerate(sets):
            bits[i] = (_least(x, factor, shift) >> np.uint64(63)).astype(np.uint8)
        out = np.packbits(bits, axis=1).view(np.int64)
        return pa.StructArray.from_arrays([pa.array(c) for c in np.ascontiguousarray(out.T)], fields=fields)

    return F.arrow_udf(tokens.in_slices(run), "struct<" + ",".join(f"{n}:bigint" for n in SKETCHED) + ">")


def keys_of(sh: Shape):
    """Arrow batches of nodes (uid and lanes) to rows ``key, uid, part``: one for each chunk and choice of positions left out.

    ``part`` is the chunk's number times the number of choices, plus the choice's.
    """
    choices = list(combinations(range(sh.size), ERRORS))

    def run(batches):
        value = tokens.random_numbers(sh.positions * 256, 21).reshape(sh.chunks, sh.size, 256)
        tag = tokens.random_numbers(sh.chunks * len(choices), 22).reshape(sh.chunks, len(choices))
        place = np.arange(sh.chunks)[None, :, None], np.arange(sh.size)[None, None, :]
        for b in batches:
            if not b.num_rows:
                continue
            lanes = np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in sh.lanes], axis=1)
            sig = np.ascontiguousarray(lanes).view(np.uint8).reshape(len(lanes), sh.chunks, 8)[:, :, : sh.size]
            each = value[*place, sig]
            total = each.sum(axis=2, dtype=np.uint64)
            uid = np.repeat(b.column("uid").to_numpy(), sh.chunks)
            for j, out in enumerate(choices):
                left = total - each[:, :, list(out)].sum(axis=2, dtype=np.uint64)
                key = tokens.mix(left + tag[None, :, j]).view(np.int64)
                part = np.tile(np.arange(sh.chunks, dtype=np.int32) * len(choices) + j, len(sig))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(uid), pa.array(part)], names=["key", "uid", "part"])

    return run


def alike(length: int, percent: int):
    """Arrow function of two texts: whether 100 * shared >= percent * all of their full shingle sets."""

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        out = np.zeros(len(left), bool)
        for i, (x, y) in enumerate(zip(tokens.shingle_sets(left, length), tokens.shingle_sets(right, length), strict=True)):
            shared = len(np.intersect1d(x, y, assume_unique=True))
            out[i] = shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared)
        return pa.array(out)

    return F.arrow_udf(tokens.in_slices(run), "boolean")


def _xor(name: str) -> Column:
    return F.col(f"x.{name}").bitwiseXOR(F.col(f"y.{name}"))


def _errors(lane: str) -> Column:
    """Positions of a chunk at which the sides ``x`` and ``y`` differ: the bytes that are not 0."""
    z = _xor(lane)
    for shift in (4, 2, 1):
        z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
    return F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))


def _sum(columns: list[Column]) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total


def _sizes_fit(percent: int) -> Column:
    return (F.col("x.n") * percent <= F.col("y.n") * 100) & (F.col("y.n") * percent <= F.col("x.n") * 100)


def _compared(sh: Shape, percent: int):
    """Sorted rows of cells (see ``_links``) to pairs ``a, b`` of nodes that may be alike, each pair in one cell of one key only."""
    most, choices = sketch_distance(percent), comb(sh.size, ERRORS)

    def pairs(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        left = np.flatnonzero(rows["mine"] == rows["lo"])
        right = np.flatnonzero(rows["mine"] == rows["hi"])
        inside = rows["lo"][0] == rows["hi"][0]
        uid, root, n, bits = rows["uid"], rows["root"], rows["n"], rows["bits"]
        out = []
        for at in range(0, len(left), 256):
            i = left[at : at + 256]
            ok = root[i][:, None] != root[right][None, :]
            ok &= (n[i][:, None] * percent <= n[right][None, :] * 100) & (n[right][None, :] * percent <= n[i][:, None] * 100)
            if inside:
                ok &= uid[i][:, None] < uid[right][None, :]
            x, y = np.nonzero(ok)
            x, y = i[x], right[y]
            x, y = (z[np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1) <= most] for z in (x, y)) if len(x) else (x, y)
            out.append((x, y))
        x, y = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (left[:0], left[:0])
        if not len(x):
            return x, y
        lanes = (rows["lanes"][x] ^ rows["lanes"][y]).view(np.uint8).reshape(len(x), sh.chunks, 8)
        errors = (lanes != 0).sum(axis=2)
        chunk = rows["part"][x] // choices
        first = (errors <= ERRORS).argmax(axis=1) == chunk
        # Without a differing position all choices of a chunk agree; with one, only the choice that leaves it out.
        first &= (errors[np.arange(len(x)), chunk] > 0) | (rows["part"][x] % choices == 0)
        return uid[x[first]], uid[y[first]]

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rest = batch if rest is None else pa.concat_batches([rest, batch])
            cell = np.stack([rest.column(c).to_numpy() for c in ("key", "lo", "hi")], axis=1)
            cut = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1
            if len(cut):
                yield from found(rest.slice(0, int(cut[-1])), cut[:-1])
                rest = rest.slice(int(cut[-1]))
        if rest is not None:
            yield from found(rest, [])

    def found(batch, cut):
        column = lambda c: batch.column(c).to_numpy()
        rows = {c: column(c) for c in ("uid", "root", "n", "part", "mine", "lo", "hi")}
        rows["lanes"] = np.ascontiguousarray(np.stack([column(c) for c in sh.lanes], axis=1))
        rows["bits"] = np.stack([column(c) for c in SKETCHED], axis=1).view(np.uint64)
        at = [0, *[int(x) for x in cut], batch.num_rows]
        got = [pairs({c: v[i:j] for c, v in rows.items()}) for i, j in zip(at[:-1], at[1:], strict=True)]
        x, y = (np.concatenate(z) for z in zip(*got, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return run


def _confirmed(pairs: DataFrame, nodes: DataFrame, length: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are alike."""
    text = nodes.select("uid", "text")
    left = pairs.join(text.withColumnsRenamed({"uid": "a", "text": "left"}), "a")
    both = left.join(text.withColumnsRenamed({"uid": "b", "text": "right"}), "b")
    return both.where(alike(length, percent)("left", "right")).select("a", "b")


def classes(docs: DataFrame, length: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Rows ``row, uid, n`` of ``docs`` with the size of their shingle set, and ``uid, root`` of those that have words.

    ``root`` is the smallest ``uid`` of the component; rows without words are alone.  Null texts
    count as empty; repeated rows and repeated or null ids are rows of their own.  ``row`` holds all
    columns of ``docs``, whatever their names.
    """
    sh = shape(percent)
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    # Written once: the running numbers have to stay as they are.
    base = docs.select(row, F.monotonically_increasing_id().alias("uid"), signed(length, sh)("text").alias("s"))
    base = stage(base.select("row", "uid", "s.*"), "signed")
    with_words = base.where("n > 0")
    reps = with_words.groupBy("h1", "h2").agg(F.min("uid").alias("rep"))
    member = stage(with_words.select("uid", "h1", "h2").join(reps, ["h1", "h2"]).select("uid", "rep"), "member")
    nodes = base.join(member.where("uid = rep").select("uid"), "uid", "left_semi")
    roots = components(_links(base, nodes.select("uid", *sh.lanes), sh, length, percent))
    placed = member.join(roots.withColumnsRenamed({"node": "rep"}), "rep", "left").select(
        "uid", F.coalesce("root", "rep").alias("root")
    )
    return base.select("row", "uid", "n"), placed


def _links(base: DataFrame, nodes: DataFrame, sh: Shape, length: int, percent: int) -> DataFrame:
    """Links ``a, b`` that have the same components as all confirmed pairs."""
    keys = nodes.mapInArrow(keys_of(sh), "key bigint, uid bigint, part int")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stage(keys.join(sizes, "key"), "keys")
    # Only nodes that share a key are looked at from here on.
    reach = shared.groupBy("uid").agg(F.sum("size").alias("reach"))
    nodes = base.join(reach, "uid")
    nodes = stage(nodes.select("uid", "reach", F.col("row.text").alias("text"), "n", *sh.lanes), "nodes")
    sides = nodes.select("uid", "n", *sh.lanes)

    order = F.struct("reach", F.negative("uid").alias("small")).alias("o")
    lead = shared.join(nodes.select("uid", order), "uid").groupBy("key").agg(F.max("o").alias("o"))
    best = shared.join(lead, "key").groupBy("uid").agg(F.max("o").alias("o"))
    star = best.select(F.negative("o.small").alias("a"), F.col("uid").alias("b")).where("a <> b")
    star = star.join(sides.alias("x"), F.col("a") == F.col("x.uid")).join(sides.alias("y"), F.col("b") == F.col("y.uid"))
    near = _sizes_fit(percent) & (_sum([_errors(n) for n in sh.lanes]) <= sh.distance)
    found = stage(_confirmed(star.where(near).select("a", "b"), nodes, length, percent), "links")

    roots = components(found)
    rest = shared.join(roots, F.col("uid") == F.col("node"), "left").select(
        "key", "uid", "part", F.coalesce("root", "uid").alias("root")
    )
    mixed = rest.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size"))
    mixed = mixed.where("lo < hi").select("key", F.ceil(F.col("size") / CELL).cast("int").alias("blocks"))
    rest = stage(rest.join(mixed, "key"), "mixed")
    bits = nodes.join(rest.select("uid").distinct(), "uid").select("uid", "n", *sh.lanes, sketched(length)("text").alias("s"))
    rest = rest.join(stage(bits.select("uid", "n", *sh.lanes, "s.*"), "sketches"), "uid")
    # The nodes of a key are dealt into blocks of about CELL, and every two blocks meet in a cell of their own.
    mine = F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int").alias("mine")
    rest = rest.select("*", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")})
    cells = rest.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    pairs = cells.mapInArrow(_compared(sh, percent), "a long, b long")
    return found.unionAll(stage(_confirmed(stage(pairs, "pairs"), nodes, length, percent), "links"))


def near_duplicates(docs: DataFrame, length: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of ``docs`` (``doc_id``, ``text``); links at ``percent`` of ``length``-word shingles.

    ``component_id`` is the smallest id of the component (null if all its ids are null), ``kept``
    whether it is the row's own (false for null ids).  Rows that repeat an id keep it in each of them.
    """
    base, placed = classes(docs.select("doc_id", "text"), length, percent)
    placed = base.select(F.col("row.doc_id").alias("id"), "uid", "n").join(placed, "uid", "left")
    placed = stage(placed.select("id", "n", F.coalesce("root", "uid").alias("root")), "placed")
    least = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    out = placed.join(least, "root")
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def one_of_each_group(docs: DataFrame, length: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without all but one of each component: the one with the smallest id (null ids last), then the first row."""
    base, placed = classes(docs, length, percent)
    id_ = F.col("row.doc_id")
    named = base.select(F.struct(id_.isNull().alias("missing"), id_.alias("id"), "uid").alias("o"), "uid").join(placed, "uid", "left")
    keep = named.groupBy(F.coalesce("root", "uid").alias("root")).agg(F.min("o").alias("o")).select("o.uid")
    return base.join(keep, "uid", "left_semi").select("row.*")


#: The shingle length and threshold of the registered query.
LENGTH, PERCENT = 3, 85


def op7_minhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, LENGTH, PERCENT)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[][] WHEN len(w) < 3 THEN [w]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i:i+2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
h AS (SELECT doc_id, hash(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM h a JOIN h b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id,
  d.doc_id = coalesce(c.c, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""
