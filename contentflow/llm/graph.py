"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from contentflow.session import stage


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (two long columns ``a, b``); ``root`` is the smallest node reachable.

    Alternates two steps until nothing changes: every node hangs its larger neighbours, then its
    smaller ones, onto the smallest node it knows.  The number of rounds grows with the logarithm
    of a path's length.  The minimum is taken before the shuffle and the joins have one row per
    edge, so a node with very many neighbours costs no task more than its share.  Each round is
    written to the shared folder.  Empty input gives an empty result.
    """
    current = stage(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        state = current.agg(
            F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"), F.sum(F.hash("a", "b").cast("long")).alias("s")
        ).first()
        if state == before or not state["n"]:
            break
        before = state
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        hung = both.where("b > a").join(least, "a").selectExpr("b AS a", "m AS b")
        hung = stage(hung.where("a <> b").distinct(), "edges")
        least = hung.groupBy("a").agg(F.min("b").alias("m"))
        small = hung.join(least, "a")
        current = stage(
            small.selectExpr("b AS a", "m AS b").unionAll(least.selectExpr("a", "m AS b")).where("a <> b").distinct(),
            "edges",
        )
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = current.selectExpr("a AS node", "b AS root")
    return roots.unionAll(current.selectExpr("b AS node", "b AS root").distinct())
