"""Multi-party chats from the point of view of every participant.

For each participant of a conversation all turns are rendered, that speaker's as the assistant's and
the others' as named users', with the part to be trained on.  The result has one row for each turn
and point of view, in the order ``seq``; the rendered dialogue is their concatenation, and ``start``
and ``end`` are places in it.  So a conversation of any length is never gathered in one task: turns
are dealt into ranges of (conversation, turn), and offsets are sums inside a range plus the sums of
the ranges before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from contentflow.session import stage

OWN, OTHER, CLOSE, ENDING = "<|assistant|>\n", "<|user name=", "|>\n", "<|end|>\n"
#: The name of turns without a role.
NOBODY = "unknown"


def _plain(c: Column) -> Column:
    """Text that cannot be taken for one of the marks."""
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def rotated(turns: DataFrame) -> DataFrame:
    """Rows ``conv_id, perspective, seq, turn, speaker, rendered, trained, start, end, mask_start, mask_end``.

    ``turns`` has ``conv_id, turn, role, text``; other columns are ignored.  Turns are in order of
    ``turn`` (nulls first), then of role and of the text's MD5; equal rows follow each other.  A null role
    is ``unknown``, a null text empty; rows without a conversation make up one of their own.  The mask
    spans the text and end mark of the own turns and is null for the others.
    """
    speaker = F.coalesce("role", F.lit(NOBODY))
    text = F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", speaker.alias("speaker"), text.alias("text"), F.md5(text).alias("md5"))
    order = ["turn", "speaker", "md5", "uid"]
    rows = rows.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange("conv_id", *order)
    rows = stage(rows.withColumn("part", F.spark_partition_id()), "turns")
    people = rows.select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    views = rows.join(people, F.col("conv_id").eqNullSafe(F.col("c")))
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit(OWN)).otherwise(F.concat(F.lit(OTHER), _plain(F.col("speaker")), F.lit(CLOSE)))
    views = views.withColumn("head", F.length(head)).withColumn("rendered", F.concat(head, _plain(F.col("text")), F.lit(ENDING)))
    views = views.withColumn("size", F.length("rendered").cast("long")).withColumn("own", own)

    keys = ["conv_id", "perspective"]
    before = (W.unboundedPreceding, -1)
    totals = views.groupBy(*keys, "part").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    ranges = W.partitionBy(*keys).orderBy("part").rowsBetween(*before)
    totals = totals.select(
        F.col("conv_id").alias("tc"), F.col("perspective").alias("tp"), F.col("part").alias("tt"),
        F.coalesce(F.sum("s").over(ranges), F.lit(0)).alias("s"), F.coalesce(F.sum("n").over(ranges), F.lit(0)).alias("n"),
    )
    inside = W.partitionBy(*keys, "part").orderBy(*order)
    views = views.withColumn("seq", F.row_number().over(inside)).withColumn(
        "start", F.coalesce(F.sum("size").over(inside.rowsBetween(*before)), F.lit(0))
    )
    out = views.join(totals, F.expr("conv_id <=> tc AND perspective = tp AND part = tt"))
    start = F.col("start") + F.col("s")
    end = start + F.col("size")
    return out.select(
        "conv_id", "perspective", (F.col("seq") + F.col("n")).alias("seq"), "turn", "speaker", "rendered",
        F.col("own").alias("trained"), start.alias("start"), end.alias("end"),
        F.when(F.col("own"), start + F.col("head")).alias("mask_start"), F.when(F.col("own"), end).alias("mask_end"),
    )


def op6_chat(spark, sf_dir: str) -> DataFrame:
    return rotated(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _quoted(text: str) -> str:
    return "'" + text.replace("\n", "' || chr(10) || '") + "'"


SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '{NOBODY}') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t),
v AS (SELECT *, speaker = perspective AS trained, CASE WHEN speaker = perspective THEN {_quoted(OWN)}
    ELSE {_quoted(OTHER)} || replace(speaker, '<|', '< |') || {_quoted(CLOSE)} END AS head
  FROM t JOIN p ON conv_id IS NOT DISTINCT FROM c),
r AS (SELECT *, head || replace(text, '<|', '< |') || {_quoted(ENDING)} AS rendered FROM v),
s AS (SELECT *, row_number() OVER o AS seq, sum(length(rendered)) OVER o AS e FROM r
  WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, md5(text) ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, seq, turn, speaker, rendered, trained, (e - length(rendered))::BIGINT AS start, e::BIGINT AS "end",
  CASE WHEN trained THEN (e - length(rendered) + length(head))::BIGINT END AS mask_start, CASE WHEN trained THEN e::BIGINT END AS mask_end
FROM s
"""
