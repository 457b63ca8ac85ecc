"""Bind a value once inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated a single time.

    An expression that names a costly sub-expression several times evaluates it several times once
    it sits in a branch or a lambda.  A one-element array carries the value instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Items of one inner fold of ``scan``; an array that a fold builds grows by copying.
_RUN = 64


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], out: Callable[[Column], Column], kind: str) -> Column:
    """``out(state)`` behind each item, where ``state = step(state, item)`` begins with ``start``.

    A fold in two levels: results are collected in runs of ``_RUN`` items, so the copying grows with the number of
    runs and not with the square of the number of items.  ``kind`` is the type of ``out``.
    """

    def one(acc: Column, item: Column) -> Column:
        return let(
            step(acc["state"], item),
            lambda s: F.struct(s.alias("state"), F.concat(acc["outs"], F.array(out(s))).alias("outs")),
        )

    def run(acc: Column, k: Column) -> Column:
        begin = F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("outs"))
        return let(
            F.aggregate(F.slice(items, k * _RUN + 1, F.lit(_RUN)), begin, one),
            lambda d: F.struct(d["state"].alias("state"), F.concat(acc["runs"], F.array(d["outs"])).alias("runs")),
        )

    nothing = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("runs"))
    runs = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _RUN).cast("int"))
    folded = F.flatten(F.aggregate(runs, nothing, run)["runs"])
    return F.when(F.size(items) > 0, folded).otherwise(F.array().cast(f"array<{kind}>"))
