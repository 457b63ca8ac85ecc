"""Source divergence audit: how far the sources of a language lie apart in their words, and which terms set each one off.

Every (language, source) group and every language gives each kept term a smoothed share in billionths, ``p``; two
shares diverge by ``(p - q)**2 // (p + q)``.  All arithmetic is on integers.

*Pairs of sources.*  A sum over all kept terms is split into what holds for terms that neither source has
(one value, times the number of terms), corrections for terms that one source has (by distinct shares) and
corrections for terms that both have; so only occurring (term, source) pairs are touched, and those
of a term are added up inside the task instead of being emitted.

*Terms of a source.*  Within a group the divergence rises with the term's count in the group and falls with its count in the
language.  So a term that is dominated by ``TOP`` others in (higher group count, lower language count, earlier UTF-8) cannot be
among the first ``TOP``.  Every partition keeps its skyband, the terms with fewer dominators; skybands of partitions are
merged into the group's, which alone is ranked exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from contentflow.llm import tokens
from contentflow.session import stage

#: A language keeps terms of so many of its documents.
LEAST_DOCS = 10
#: Ranks of the part `term`.
TOP = 10
SHARE = 1_000_000_000
#: Pairs of a term's sources that are added up at a time, and rows that a skyband takes in at a time.
PAIRS, ROWS = 1 << 20, 1 << 15

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_COUNTED = "lang string, source string, term string, n long, docs long"


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges of ``data``, A-Z in lower case, as strings."""
    size = end - start
    border = np.append(0, np.cumsum(size))
    take = np.arange(border[-1]) + np.repeat(start - border[:-1], size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(border), pa.py_buffer(_LOWER[data[take]])).cast(pa.string())


def term_counts(batches):
    """Arrow batches of ``lang, source, text`` to ``lang, source, term, n, docs`` of each slice of 4 MB of text.

    Terms are told apart by 64-bit numbers within a slice (two of them meet by chance with about 2**-64) and by
    their strings from there on.
    """
    for batch in tokens.sliced_batches(batches):
        w = tokens.words(batch.column("text"), separator=tokens.NOT_LETTER)
        if not len(w.number):
            continue
        langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        groups, group = np.unique(langs.indices.to_numpy() * np.int64(len(sources.dictionary)) + sources.indices.to_numpy(), return_inverse=True)
        _, first, term = np.unique(w.number, return_index=True, return_inverse=True)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(w.at))
        key = np.sort((group[doc] * len(first) + term) * batch.num_rows + doc)
        both = key // batch.num_rows
        start = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        fresh = np.append(True, key[1:] != key[:-1]).astype(np.int64)
        which, both = divmod(both[start], len(first))
        lang, source = divmod(groups[which], len(sources.dictionary))
        yield pa.RecordBatch.from_arrays(
            [
                langs.dictionary.take(pa.array(lang)),
                sources.dictionary.take(pa.array(source)),
                _strings(w.data, w.start[first], w.end[first]).take(pa.array(both)),
                pa.array(np.diff(np.append(start, len(key)))),
                pa.array(np.add.reduceat(fresh, start)),
            ],
            names=["lang", "source", "term", "n", "docs"],
        )


def _share(n: str, total: str, kinds: str) -> Column:
    """``1 + SHARE * (n + 2) // (total + 2 * kinds)``; null where nothing is kept."""
    wide = f"(CAST({SHARE} AS DECIMAL(10,0)) * CAST({n} + 2 AS DECIMAL(20,0))) DIV CAST({total} + 2 * {kinds} AS DECIMAL(20,0))"
    return F.expr(f"CASE WHEN {kinds} > 0 THEN 1 + {wide} END")


def _apart(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) DIV ({p} + {q}))"


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def shared_terms(batches):
    """Arrow batches of ``lang, has`` (a term's sources: place, share, share of an absent term) to sums ``lang, i, j, value``.

    A sum has, for the terms that both sources ``i < j`` have, their divergence less what the two corrections for
    one source and the constant give for it.
    """
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        has = batch.column("has")
        size = np.diff(has.offsets.to_numpy())
        flat = has.flatten()
        s, p, z = (flat.field(i).to_numpy().astype(np.int64) for i in range(3))
        lang = np.repeat(langs.indices.to_numpy().astype(np.int64), size)
        left_over = np.repeat(np.cumsum(size), size) - np.arange(len(s)) - 1
        upto, at = np.cumsum(left_over), 0
        while at < len(s):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            times = left_over[at:to]
            a = np.repeat(np.arange(at, to), times)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
            at = to
            if not len(a):
                continue
            value = _divergence(p[a], p[b]) - _divergence(p[a], z[b]) - _divergence(z[a], p[b]) + _divergence(z[a], z[b])
            cell = np.stack([lang[a], np.minimum(s[a], s[b]), np.maximum(s[a], s[b])])
            order = np.lexsort(cell[::-1])
            cell, value = cell[:, order], value[order]
            start = np.flatnonzero(np.append(True, (cell[:, 1:] != cell[:, :-1]).any(axis=0)))
            l, i, j = cell[:, start]
            out = [langs.dictionary.take(pa.array(l)), pa.array(i), pa.array(j), pa.array(np.add.reduceat(value, start))]
            yield pa.RecordBatch.from_arrays(out, names=["lang", "i", "j", "value"])


def skyband(more: np.ndarray, less: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Which points are dominated by fewer than ``k`` others that have ``more`` not lower, ``less`` not higher and ``rank`` lower.

    In the order of falling ``more``, then rising ``less`` and ``rank``, dominators come first; those inside the band suffice, as
    of a point's first ``k`` dominators in that order each has fewer than ``k`` itself.
    """
    order = np.lexsort((rank, less, -more))
    kept = np.zeros(len(order), bool)
    band_less, band_rank = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(order), 512):
        block = order[at : at + 512]
        before = ((band_less <= less[block][:, None]) & (band_rank < rank[block][:, None])).sum(axis=1)
        block, before = block[before < k], before[before < k]
        new: list[int] = []
        for x, n in zip(block.tolist(), before.tolist()):
            y = np.array(new, int)
            if n + ((less[y] <= less[x]) & (rank[y] < rank[x])).sum() < k:
                new.append(x)
        kept[new] = True
        band_less, band_rank = np.append(band_less, less[new]), np.append(band_rank, rank[new])
    return kept


def skybands(k: int):
    """Arrow batches of terms of groups (``lang, source, term, n, whole`` and more) to those in the ``k``-skyband of their group."""

    def banded(table: pa.Table) -> pa.Table:
        code = [pc.fill_null(table.column(c), "").combine_chunks().dictionary_encode() for c in ("lang", "source")]
        group = code[0].indices.to_numpy().astype(np.int64) * len(code[1].dictionary) + code[1].indices.to_numpy()
        n, whole = (table.column(c).to_numpy() for c in ("n", "whole"))
        rank = np.empty(len(n), np.int64)
        rank[pc.array_sort_indices(table.column("term").combine_chunks()).to_numpy()] = np.arange(len(n))
        order = np.argsort(group, kind="stable")
        keep = [
            part[skyband(n[part], whole[part], rank[part], k)]
            for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1)
        ]
        return table.take(pa.array(np.concatenate(keep))).combine_chunks()

    def run(batches):
        held: list[pa.RecordBatch] = []
        band = 0
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= ROWS + band:
                held = banded(pa.Table.from_batches(held)).to_batches()
                band = sum(x.num_rows for x in held)
        if sum(x.num_rows for x in held):
            yield from banded(pa.Table.from_batches(held)).to_batches()

    return run


def audited(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank`` of ``docs`` (``text, lang, source``).

    Part `pair`: for every group (lang, source) each other source of the language and the divergence summed over all kept terms.
    Part `term`: the first ``TOP`` terms that a group has a larger share of than its language, by divergence from the language.
    Null texts, languages and sources are ''.  Repeated rows count one by one.  A language without kept terms has pairs of
    value 0 and no terms; a language of one source has no pairs; an empty table gives an empty result.  Texts of any length are
    counted whole.  Ties in value go by the item's UTF-8.  Columns of other names are not read.
    """
    text = lambda c: F.coalesce(docs[c], F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text"))
    counted = rows.mapInArrow(term_counts, _COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counted.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("whole"), F.collect_list(F.struct("source", "n")).alias("has")
    )
    kept = stage(terms.where(F.col("docs") >= LEAST_DOCS).drop("docs"), "terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("whole").alias("all"))
    totals = kept.select("lang", F.explode("has").alias("h")).groupBy("lang", "h.source").agg(F.sum("h.n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "kinds", "all"]).withColumn("absent", _share("0", "total", "kinds"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    groups = stage(groups.withColumn("s", place), "groups")

    flat = kept.select("lang", "term", "whole", F.explode("has").alias("h")).select("lang", "term", "whole", "h.*")
    flat = flat.join(groups, ["lang", "source"])
    flat = stage(flat.select("lang", "source", "s", "term", "n", "whole", "absent", _share("n", "total", "kinds").alias("p"), _share("whole", "all", "kinds").alias("q")), "shares")
    return _pairs(flat, groups).unionAll(_terms(flat))


def _ranked(value: DataFrame, part: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return value.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))


def _pairs(flat: DataFrame, groups: DataFrame) -> DataFrame:
    one = groups.select("lang", "s", "absent", "kinds")
    x, y = (one.withColumnsRenamed({"s": s, "absent": z}) for s, z in (("i", "zi"), ("j", "zj")))
    neither = x.join(y.drop("kinds"), "lang").where("i < j").selectExpr("lang", "i", "j", f"coalesce(kinds * {_apart('zi', 'zj')}, 0L) AS value")
    shares = flat.groupBy("lang", "s", "p", "absent").agg(F.count(F.lit(1)).alias("m"))
    other = one.selectExpr("lang", "s AS t", "absent AS z")
    single = shares.join(other, "lang").where("s <> t")
    single = single.selectExpr("lang", "least(s, t) AS i", "greatest(s, t) AS j", f"m * ({_apart('p', 'z')} - {_apart('absent', 'z')}) AS value")
    has = flat.groupBy("lang", "term").agg(F.collect_list(F.struct("s", "p", "absent")).alias("has"))
    both = has.select("lang", "has").mapInArrow(shared_terms, "lang string, i long, j long, value long")
    wide = lambda d: d.selectExpr("lang", "CAST(i AS LONG) AS i", "CAST(j AS LONG) AS j", "value")
    total = wide(neither).unionAll(wide(single)).unionAll(both).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    total = total.unionAll(total.selectExpr("lang", "j", "i", "value"))
    name = groups.select("lang", F.col("s").cast("long").alias("s"), "source")
    total = total.join(name.withColumnsRenamed({"s": "i"}), ["lang", "i"]).join(name.withColumnsRenamed({"s": "j", "source": "item"}), ["lang", "j"])
    return _ranked(total, "pair")


def _terms(flat: DataFrame) -> DataFrame:
    rows = flat.where("p > q").select("lang", "source", "term", "n", "whole", "p", "q")
    kind = "lang string, source string, term string, n long, whole long, p long, q long"
    bands = rows.mapInArrow(skybands(TOP), kind)
    merged = bands.repartition("lang", "source").mapInArrow(skybands(TOP), kind)
    value = merged.selectExpr("lang", "source", "term AS item", f"{_apart('p', 'q')} AS value")
    return _ranked(value, "term").where(F.col("rank") <= TOP)


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    return audited(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST_DOCS}),
l AS (SELECT lang, sum(c) AS n, count(*) AS v FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(c) AS n FROM o GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(o.c, 0) + 2) // (coalesce(n.n, 0) + 2 * l.v) AS p,
    1 + 1000000000::HUGEINT * (k.c + 2) // (l.n + 2 * l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
      WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
  (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM f
QUALIFY part = 'pair' OR rank <= {TOP}
"""
