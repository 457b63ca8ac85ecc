"""N-gram Jaccard join: tiles of like sizes and parts, bitmaps that bound the overlap, then exact intersection.

Equal sets are one node.  Sizes are cut into bands whose borders grow by the threshold, so linked sets lie in one band or in two
neighbouring ones; a band is a scheme for the pairs whose smaller set lies in it.  Such a pair differs in at most
``d`` items, a number that follows from the band.  The scheme parts the hash space into ``d + 1 + SLACK`` ranges, so at
least ``SLACK + 1`` of them hold the same items in both sets.  A tile is the nodes of a band and the next one that have one of the
ranges in common, item for item: every linked pair shares a tile, and a passage that many documents have makes no large tile unless it
is nearly all of them.  (A range may be empty; only nodes with more than ``SLACK`` empty ranges need tiles for them.)

Inside tiles, a bitmap of one bit for each hash value (at least twice as many bits as items) bounds the overlap from above: each bit that
only one side has is an item that the other lacks.  Pairs that the bound allows are intersected as whole sorted arrays.
Tiles are never expanded into pairs as they are: every node is first compared with the busiest node it shares a tile with, and only
nodes that are then in different components are compared further, the larger part of a tile against the rest.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from contentflow.llm import tokens
from contentflow.llm.graph import components
from contentflow.session import stage

#: Ranges that a scheme has beyond those that differing items can spoil.
SLACK = 1
#: Bits of the smallest and the largest bitmap.
NARROW, WIDE = 256, 1 << 16
#: Nodes on each side of a cell.
CELL = 512
#: The shingle length and threshold of the registered query.
LENGTH, PERCENT = 3, 90


@lru_cache
def _borders(percent: int) -> np.ndarray:
    """The largest size of each band."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append((out[-1] + 1) * 100 // percent)
    return np.array(out)


def schemes(size: int, percent: int) -> list[tuple[int, int]]:
    """Band and number of ranges of the schemes that a set takes part in: as the smaller set, and as the larger one."""
    border = _borders(percent)
    band = int(np.searchsorted(border, size))
    out = []
    for b in (band, band - 1):
        differing = int(border[b]) * (100 - percent) // percent if b >= 0 else 0
        # Different sets that may not differ are no pair.
        if differing:
            out.append((b, differing + 1 + SLACK))
    return out


def keys_of(items: np.ndarray, percent: int) -> np.ndarray:
    """The tiles of a sorted set of 64-bit numbers."""
    sums = np.append(np.uint64(0), np.cumsum(tokens.mix(items ^ np.uint64(0x2545F4914F6CDD1D)), dtype=np.uint64))
    out = []
    for band, ranges in schemes(len(items), percent):
        step = np.uint64((1 << 64) // ranges)
        at = np.searchsorted(items, np.arange(1, ranges, dtype=np.uint64) * step)
        at = np.concatenate([[0], at, [len(items)]])
        filled = at[1:] > at[:-1]
        if len(filled) - filled.sum() > SLACK:
            filled[:] = True
        tag = tokens.mix(np.arange(ranges, dtype=np.uint64) + np.uint64(band << 32))
        out.append(tokens.mix((sums[at[1:]] - sums[at[:-1]] + tag)[filled]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bitmap(items: np.ndarray) -> bytes:
    """One bit for each item's hash, in the smallest power of two that is twice the number of items, within limits."""
    width = min(max(NARROW, 1 << (2 * len(items) - 1).bit_length()), WIDE)
    bits = np.zeros(width, np.uint8)
    bits[(items & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all of the width of the smallest."""
    words = min(len(m) for m in maps) // 8
    out = np.empty((len(maps), words), np.uint64)
    for i, m in enumerate(maps):
        np.bitwise_or.reduce(np.frombuffer(m, np.uint64).reshape(-1, words), axis=0, out=out[i])
    return out


def described(length: int, percent: int):
    """Arrow function: text to the size of its shingle set, two hashes of the set and its tiles."""

    def run(text: pa.Array) -> pa.Array:
        sets = tokens.shingle_sets(text, length)
        keys = [keys_of(x, percent).view(np.int64) for x in sets]
        at = np.append(0, np.cumsum([len(k) for k in keys])).astype(np.int32)
        hashes = [
            np.array([f(x).sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
            for f in (lambda x: tokens.mix(x + np.uint64(1)), lambda x: tokens.mix(x ^ np.uint64(0x5851F42D4C957F2D)))
        ]
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        columns = [pa.array([len(x) for x in sets], pa.int64()), *[pa.array(h) for h in hashes], pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]
        return pa.StructArray.from_arrays(columns, names=["n", "h1", "h2", "keys"])

    return F.arrow_udf(tokens.in_slices(run), "struct<n:bigint,h1:bigint,h2:bigint,keys:array<bigint>>")


def items_of(length: int):
    """Arrow function: text to its bitmap and its sorted shingle set."""

    def run(text: pa.Array) -> pa.Array:
        sets = tokens.shingle_sets(text, length)
        at = np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int32)
        flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        columns = [pa.array([bitmap(x) for x in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]
        return pa.StructArray.from_arrays(columns, names=["bits", "items"])

    return F.arrow_udf(tokens.in_slices(run, 1 << 21), "struct<bits:binary,items:array<bigint>>")


def _shared(batches):
    """Rows ``key, uid`` sorted by key to those whose key another row has."""
    last, carried = None, False
    for b in batches:
        if not b.num_rows:
            continue
        b = b if last is None else pa.concat_batches([last, b])
        key = b.column("key").to_numpy()
        same = key[1:] == key[:-1]
        keep = np.append(same, False) | np.append(False, same)
        out = np.flatnonzero(keep)
        # A row carried over may have come out before.
        yield b.take(pa.array(out[out >= int(carried)]))
        last, carried = b.slice(b.num_rows - 1), bool(keep[-1])


def may_link(n1, n2, only1, only2, percent: int):
    """Whether sets of ``n1`` and ``n2`` items, at least ``only1`` and ``only2`` of which the other lacks, may reach the threshold."""
    most = np.minimum(n1 - only1, n2 - only2)
    return (100 + percent) * most >= percent * (n1 + n2)


def linked(percent: int):
    """Arrow function of ``n, bits, items`` of two nodes: whether 100 * shared >= percent * all, after the bitmaps' bound."""

    def run(bits1: pa.Array, items1: pa.Array, bits2: pa.Array, items2: pa.Array) -> pa.Array:
        out = np.zeros(len(bits1), bool)
        sets = [(c.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(pc.list_value_length(c).to_numpy()))) for c in (items1, items2)]
        for i in range(len(out)):
            x, y = (flat[at[i] : at[i + 1]] for flat, at in sets)
            bx, by = folded([bits1[i].as_py(), bits2[i].as_py()])
            if may_link(len(x), len(y), np.bitwise_count(bx & ~by).sum(), np.bitwise_count(by & ~bx).sum(), percent):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                out[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
        return pa.array(out)

    return F.arrow_udf(run, "boolean")


def _cells(percent: int):
    """Sorted rows of cells (see ``_links``) to the pairs ``a, b`` of nodes of different components that the bitmaps allow."""

    def pairs(b: pa.RecordBatch):
        uid, root, n, side = (b.column(c).to_numpy() for c in ("uid", "root", "n", "side"))
        bits = folded(b.column("bits").to_pylist())
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        inside = side[0] == 0
        for i in left.tolist():
            j = right[(root[right] != root[i]) & (100 * n[right] >= percent * n[i]) & (100 * n[i] >= percent * n[right])]
            j = j[uid[j] > uid[i]] if inside else j
            if len(j):
                only1, only2 = (np.bitwise_count(z).sum(axis=1).astype(np.int64) for z in (bits[i] & ~bits[j], bits[j] & ~bits[i]))
                j = j[may_link(n[i], n[j], only1, only2, percent)]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(uid[i], uid[j])), pa.array(np.maximum(uid[i], uid[j]))], names=["a", "b"])

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rest = batch if rest is None else pa.concat_batches([rest, batch])
            cell = np.stack([rest.column(c).to_numpy() for c in ("key", "one", "two")], axis=1)
            cut = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1).tolist()]
            for i, j in zip(cut[:-1], cut[1:]):
                yield from pairs(rest.slice(i, j - i))
            rest = rest.slice(cut[-1])
        if rest is not None:
            yield from pairs(rest)

    return run


def _confirmed(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that the bitmaps allow and whose whole sets are linked."""
    both = pairs
    for c in ("a", "b"):
        both = both.join(nodes.select(F.col("uid").alias(c), F.col("bits").alias(f"bits_{c}"), F.col("items").alias(f"items_{c}")), c)
    return both.where(linked(percent)("bits_a", "items_a", "bits_b", "items_b")).select("a", "b")


def _links(reps: DataFrame, base: DataFrame, length: int, percent: int) -> DataFrame:
    """Links ``a, b`` between nodes with the same components as all links."""
    keys = reps.select(F.explode("keys").alias("key"), "uid").repartition("key").sortWithinPartitions("key")
    shared = stage(keys.mapInArrow(_shared, "key long, uid long"), "shared")
    # Tiles of the same nodes are one.
    tiles = shared.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("uid")).alias("x"), F.sum(F.hash("uid").cast("long")).alias("s")
    )
    tiles = tiles.groupBy("size", "x", "s").agg(F.min("key").alias("key")).select("key", "size")
    shared = stage(shared.join(tiles, "key"), "tiles")
    reach = shared.groupBy("uid").agg(F.sum("size").alias("reach"))
    order = F.struct("reach", F.negative("uid").alias("small")).alias("o")
    lead = shared.join(reach.select("uid", order), "uid").groupBy("key").agg(F.max("o").alias("o"))
    best = shared.join(lead, "key").groupBy("uid").agg(F.negative(F.max("o")["small"]).alias("lead"))
    leads = best.select(F.col("lead").alias("uid")).distinct().withColumn("leads", F.lit(True))
    # Texts are shuffled at any size: the list of nodes grows with the corpus.
    picked = best.join(leads, "uid", "left").hint("merge")
    nodes = base.select("uid", "n", "text").join(picked, "uid").select("uid", "n", "lead", "leads", items_of(length)("text").alias("i"))
    nodes = stage(nodes.select("uid", "n", "lead", "leads", "i.*"), "nodes")

    star = nodes.where("uid <> lead").select("lead", "uid", "bits", "items").join(
        nodes.where("leads").select(F.col("uid").alias("lead"), F.col("bits").alias("lead_bits"), F.col("items").alias("lead_items")), "lead"
    )
    star = star.where(linked(percent)("lead_bits", "lead_items", "bits", "items"))
    found = stage(star.select(F.col("lead").alias("a"), F.col("uid").alias("b")), "links")

    # What is left are tiles with nodes of several components.
    rest = shared.join(components(found), F.col("uid") == F.col("node"), "left").select("key", "uid", F.coalesce("root", "uid").alias("root"))
    roots = rest.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    split = roots.groupBy("key").agg(F.max(F.struct("m", "root")).alias("top"), F.count(F.lit(1)).alias("roots"), F.sum("m").alias("size"))
    split = split.where("roots > 1").select("key", F.col("top.root").alias("main"), F.col("top.m").alias("m"), "size")
    blocks = lambda c: F.ceil(F.expr(c) / CELL).cast("int")
    split = split.select("key", "main", blocks("m").alias("major"), blocks("size - m").alias("minor"))
    rest = rest.join(split, "key")
    # Blocks of the largest component of a tile meet all blocks of the others, and those meet each other.
    mine = F.expr("IF(root = main, -1 - CAST(pmod(xxhash64(uid), major) AS INT), CAST(pmod(xxhash64(uid), minor) AS INT))")
    meets = F.expr("IF(mine < 0, sequence(0, minor - 1), sequence(-major, minor - 1))")
    rest = rest.withColumn("mine", mine).withColumn("other", F.explode(meets))
    rest = rest.select("key", "uid", "root", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"),
        F.expr("CASE WHEN mine = other THEN 0 WHEN mine < other THEN 1 ELSE 2 END").alias("side"))
    rest = rest.join(nodes.select("uid", "n", "bits"), "uid").repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "side")
    pairs = stage(rest.mapInArrow(_cells(percent), "a long, b long").distinct(), "pairs")
    return found.unionAll(stage(_confirmed(pairs, nodes, percent), "links"))


def joined(docs: DataFrame, length: int = LENGTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of ``docs`` (``doc_id``, ``text``): sets of ``length``-word shingles, links at ``percent``.

    ``component_id`` is the smallest id reachable by links (null if all ids of the component are null).  Null texts count
    as empty; rows without words have no shingles and no links, rows of fewer words than ``length`` have their
    words as one shingle.  Repeated rows and repeated or null ids are rows of their own.  Texts of any length are taken whole.  Other
    columns are not read; an empty table gives an empty result.
    """
    # Written once: the running numbers have to stay as they are.
    base = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("uid"), described(length, percent)("text").alias("s"))
    base = stage(base.select("doc_id", "text", "uid", "s.*"), "described")
    with_words = base.where("n > 0").select("uid", "h1", "h2")
    member = stage(with_words.join(with_words.groupBy("h1", "h2").agg(F.min("uid").alias("rep")), ["h1", "h2"]).select("uid", "rep"), "member")
    reps = base.select("uid", "keys").where("size(keys) > 0").join(member.where("uid = rep").select("uid"), "uid", "left_semi")
    roots = components(_links(reps, base, length, percent))
    placed = member.join(roots.withColumnsRenamed({"node": "rep"}), "rep", "left").select("uid", F.coalesce("root", "rep").alias("root"))
    placed = base.select("doc_id", "uid", "n").join(placed, "uid", "left").select("doc_id", "n", F.coalesce("root", "uid").alias("root"))
    placed = stage(placed, "placed")
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op12_jaccard(spark, sf_dir: str) -> DataFrame:
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[][] WHEN len(w) < {LENGTH} THEN [w]
  ELSE list_transform(range(1, len(w) - {LENGTH - 2}), lambda i: w[i:i + {LENGTH - 1}]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
h AS (SELECT doc_id, hash(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM h a JOIN h b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""
