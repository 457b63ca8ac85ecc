"""Quality rules whose limits come from the data: quantile sketches per language and source.

Each document gets some integer measures.  A measure's sketch is a histogram on a scale of 32 steps for
each doubling, so it is exact to 1/32 of a value, has at most about 1,900 cells and merges by adding
counts: partial sketches of tasks give those of (language, source) pairs, these give those of
languages, and those the one of the corpus.  The order of merging cannot change a result.

A limit is the quartile and ``REACH`` times the distance of the quartiles, or ``LEAST`` of it.  A pair's
quartiles are averaged with its language's, and these with the corpus', weighted by the number of
documents against ``PRIOR``: a small source leans on its language at any size, without a switch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from contentflow.llm import tokens
from contentflow.session import stage

#: Least distance of the quartiles that a limit uses, by measure; only word length has a limit below.
LEAST = {"symbols": 300, "length": 250, "dup_lines": 1500, "repeats": 1200}
REACH = 3
PRIOR = 50
#: Base rule: at least so many words, at most this share (in percent) of repeated ones.
MIN_WORDS, MAX_REPEATED = 50, 50
_COUNTS = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines".split()

_NEWLINE = np.zeros(256, bool)
_NEWLINE[ord("\n")] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def counts():
    """Arrow function: text to its counts; a null text has none."""
    fields = [pa.field(n, pa.int64()) for n in _COUNTS]

    def before(flag: np.ndarray) -> np.ndarray:
        out = np.zeros(len(flag) + 1, np.int64)
        np.cumsum(flag, out=out[1:])
        return out

    def run(text: pa.Array) -> pa.Array:
        w = tokens.words(text, fold=tokens.SAME)
        solid = ~tokens.SPACE[w.data]
        chars = before(solid & ((w.data & 0xC0) != 0x80))
        symbols, filled = before(_SYMBOL[w.data]), before(solid)
        lines = tokens.words(text, separator=_NEWLINE, fold=tokens.SAME)
        windows = tokens.runs(w.number, 3)
        out = np.zeros((len(_COUNTS), len(text)), np.int64)
        out[0] = np.diff(w.at)
        out[1] = np.diff(chars[w.offset])
        out[2] = np.diff(symbols[w.offset])
        for i in range(len(text)):
            a, b = lines.at[i], lines.at[i + 1]
            has = filled[lines.end[a:b]] > filled[lines.start[a:b]]
            number = lines.number[a:b][has]
            out[5, i] = len(number)
            out[3, i] = len(number) - len(np.unique(number))
            a, b = w.at[i], w.at[i + 1]
            if b - a > 3:
                _, which, times = np.unique(windows[a : b - 2], return_inverse=True, return_counts=True)
                twice = times[which] > 1
                part = np.zeros(b - a, bool)
                for k in range(3):
                    part[k : k + len(twice)] |= twice
                out[4, i] = part.sum()
        return pa.StructArray.from_arrays([pa.array(c) for c in out], fields=fields)

    return F.arrow_udf(tokens.in_slices(run), "struct<" + ",".join(f"{n}:bigint" for n in _COUNTS) + ">")


def _measures(c: str) -> dict[str, Column]:
    """The integer measures of the counts in struct column ``c``."""
    words = f"greatest({c}.n_words, 1)"
    return {
        "symbols": F.expr(f"10000 * {c}.n_symbols DIV {words}"),
        "length": F.expr(f"1000 * {c}.word_chars DIV {words}"),
        "dup_lines": F.expr(f"10000 * {c}.n_dup_lines DIV greatest({c}.n_lines, 1)"),
        "repeats": F.expr(f"10000 * {c}.n_repeat_words DIV {words}"),
    }


def _quartiles(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, measure, n, q1, q3`` from the cells of sketches."""
    merged = cells.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"))
    rising = W.partitionBy(*keys, "measure").orderBy("cell")
    upto = merged.withColumn("upto", F.sum("n").over(rising)).withColumn("all", F.sum("n").over(W.partitionBy(*keys, "measure")))
    return upto.groupBy(*keys, "measure").agg(
        F.max("all").alias("n"),
        F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("cell"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("cell"))).alias("q3"),
    )


def limits(counted: DataFrame) -> DataFrame:
    """Limits ``lang, source, <measure>_high, length_low`` from rows ``lang, source, c``; rows without words don't count."""
    measure = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("x")) for k, v in _measures("c").items()]))
    rows = counted.where("c.n_words > 0").select("lang", "source", measure.alias("m")).select("lang", "source", "m.*")
    step = F.greatest(F.length(F.bin("x")) - 6, F.lit(0))
    cell = F.expr("shiftleft(shiftright(x, step), step)")
    cells = rows.withColumn("step", step).groupBy("lang", "source", "measure", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    cells = stage(cells, "cells")

    def blended(fine: str, coarse: str) -> Column:
        return F.expr(f"(n * {fine} + {PRIOR} * {coarse}) DIV (n + {PRIOR})")

    corpus = _quartiles(cells, []).selectExpr("measure AS m0", "q1 AS a0", "q3 AS b0")
    lang = _quartiles(cells, ["lang"]).join(corpus, F.col("measure") == F.col("m0"))
    lang = lang.select(
        F.col("lang").alias("l1"), F.col("measure").alias("m1"), blended("q1", "a0").alias("a1"), blended("q3", "b0").alias("b1")
    )
    pair = _quartiles(cells, ["lang", "source"]).join(lang, F.expr("lang <=> l1 AND measure = m1"))
    pair = pair.select("lang", "source", "measure", blended("q1", "a1").alias("q1"), blended("q3", "b1").alias("q3"))
    reach = F.lit(REACH) * F.greatest(F.expr("q3 - q1"), F.create_map(*[F.lit(x) for kv in LEAST.items() for x in kv])[F.col("measure")])
    pair = pair.withColumn("high", F.col("q3") + reach).withColumn("low", F.col("q1") - reach)
    of = lambda m, v: F.max(F.when(F.col("measure") == m, F.col(v)))
    return pair.groupBy("lang", "source").agg(*[of(m, "high").alias(f"{m}_high") for m in LEAST], of("length", "low").alias("length_low"))


def judged(docs: DataFrame) -> DataFrame:
    """Rows ``row, c, base_failed, kept`` for rows ``row`` of ``docs`` (``text``, ``lang``, ``source``).

    Null languages and sources are groups of their own.  A document without words fails the base
    rule.  Repeated rows are judged and counted one by one; columns of any other name are kept in
    ``row``.  An empty table gives an empty result.
    """
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    counted = docs.select(row, F.col("lang"), F.col("source"), counts()("text").alias("c"))
    known = stage(limits(counted.drop("row")), "limits").withColumnsRenamed({"lang": "_lang", "source": "_source"})
    m = _measures("c")
    inside = (m["length"] >= F.col("length_low")) & (m["length"] <= F.col("length_high"))
    for k in ("symbols", "dup_lines", "repeats"):
        inside = inside & (m[k] <= F.col(f"{k}_high"))
    failed = (F.col("c.n_words") < MIN_WORDS) | (100 * F.col("c.n_repeat_words") > MAX_REPEATED * F.col("c.n_words"))
    return (
        counted.join(known, F.expr("lang <=> _lang AND source <=> _source"), "left")
        .select("row", "c", failed.alias("base_failed"), F.coalesce(~failed & inside, F.lit(False)).alias("kept"))
    )


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    return judged(docs).where("kept").select("row.*")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return judged(docs.select("doc_id", "text", "lang", "source")).select(
        "row.doc_id", *[f"c.{n}" for n in _COUNTS[:5]], "base_failed", "kept"
    )


SQL = rf"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, i, w[i:i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
c AS (SELECT doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(p.n, 0) AS n_repeat_words, len(l) AS n_lines
  FROM w LEFT JOIN p USING (doc_id)),
m AS (SELECT *, 10000 * n_symbols // greatest(n_words, 1) AS symbols, 1000 * word_chars // greatest(n_words, 1) AS length,
    10000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines, 10000 * n_repeat_words // greatest(n_words, 1) AS repeats FROM c),
u AS (UNPIVOT (SELECT lang, source, symbols::BIGINT AS symbols, length::BIGINT AS length, dup_lines::BIGINT AS dup_lines,
    repeats::BIGINT AS repeats FROM m WHERE n_words > 0) ON symbols, length, dup_lines, repeats INTO NAME measure VALUE x),
b AS (SELECT lang, source, measure, (x >> greatest(length(bin(x)) - 6, 0)) << greatest(length(bin(x)) - 6, 0) AS x FROM u),
q0 AS (SELECT measure, quantile_disc(x, 0.25) AS q1, quantile_disc(x, 0.75) AS q3 FROM b GROUP BY ALL),
q1 AS (SELECT lang, measure, count(*) AS n, quantile_disc(x, 0.25) AS q1, quantile_disc(x, 0.75) AS q3 FROM b GROUP BY ALL),
l1 AS (SELECT lang, measure, (n * q1.q1 + {PRIOR} * q0.q1) // (n + {PRIOR}) AS q1, (n * q1.q3 + {PRIOR} * q0.q3) // (n + {PRIOR}) AS q3
  FROM q1 JOIN q0 USING (measure)),
q2 AS (SELECT lang, source, measure, count(*) AS n, quantile_disc(x, 0.25) AS q1, quantile_disc(x, 0.75) AS q3 FROM b GROUP BY ALL),
l2 AS (SELECT q2.lang, source, q2.measure, (n * q2.q1 + {PRIOR} * l1.q1) // (n + {PRIOR}) AS q1, (n * q2.q3 + {PRIOR} * l1.q3) // (n + {PRIOR}) AS q3
  FROM q2 JOIN l1 ON q2.measure = l1.measure AND q2.lang IS NOT DISTINCT FROM l1.lang),
f AS (SELECT *, {REACH} * greatest(q3 - q1, CASE measure {" ".join(f"WHEN '{k}' THEN {v}" for k, v in LEAST.items())} END) AS d FROM l2),
t AS (SELECT lang, source, {", ".join(f"max(q3 + d) FILTER (measure = '{k}') AS {k}_high" for k in LEAST)},
    max(q1 - d) FILTER (measure = 'length') AS length_low FROM f GROUP BY ALL),
j AS (SELECT m.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
    length BETWEEN length_low AND length_high AND symbols <= symbols_high AND dup_lines <= dup_lines_high AND repeats <= repeats_high AS ok
  FROM m LEFT JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, coalesce(NOT base_failed AND ok, false) AS kept FROM j
"""
