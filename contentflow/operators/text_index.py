"""Posting lists of a text column, so that searches read terms and never texts.

A posting says how often a document has a term.  Documents are dealt into blocks by length, in which the largest count of a term
differs most between blocks; ``bounds`` has that count for each term and block.  A search adds up the bounds of its terms: a block whose sum
is below the score of the last row of the page holds nothing for it and is not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from contentflow.operators.catalog import TERM
from contentflow.operators.ordering import with_bucket

BLOCKS, PARTS = 64, 32


def terms_of(spark: SparkSession, query: str) -> list[str]:
    """The different terms of a query, cut as texts are."""
    cut = F.array_distinct(F.regexp_extract_all(F.lower(F.lit(query)), F.lit(TERM), F.lit(0)))
    return spark.range(1).select(cut.alias("t")).first()["t"]


def build(table: DataFrame, key: str, text: str, path: str, blocks: int = BLOCKS) -> None:
    """Write ``postings`` (part, term, block, key, n), sorted by term and block, and ``bounds`` (term, block, most, docs) to ``path``."""
    dealt = with_bucket(table.select(key, F.col(text).alias("_text")).withColumn("_length", F.length("_text")), "_length", blocks, "block")
    # Texts are dealt out, not postings: all rows of a key and block come together, are counted, sorted and written there.
    here = dealt.drop("_length").repartition("block", key)
    cut = here.select(key, "block", F.explode(F.regexp_extract_all(F.lower("_text"), F.lit(TERM), F.lit(0))).alias("term"))
    postings = cut.groupBy("term", "block", key).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int"))
    postings.sortWithinPartitions("part", "term", "block").write.partitionBy("part").parquet(f"{path}/postings")
    spark = table.sparkSession
    read = spark.read.parquet(f"{path}/postings")
    bounds = read.groupBy("part", "term", "block").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("docs"))
    bounds.repartition("part").sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{path}/bounds")


def _of(spark: SparkSession, path: str, name: str, terms: list[str]) -> DataFrame:
    """The rows of some terms: their parts are pruned, their row groups found by the term."""
    held = F.array(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(PARTS)) for t in terms])
    parts = spark.range(1).select(F.array_distinct(held).alias("p")).first()["p"]
    return spark.read.parquet(f"{path}/{name}").where(F.col("part").isin(parts) & F.col("term").isin(terms))


def search(spark: SparkSession, path: str, table: DataFrame, key: str, query: str, offset: int = 0, limit: int = 100, fields: list[str] | None = None) -> DataFrame:
    """The page that ``catalog.search`` gives, from posting lists; ``table`` only adds the fields of the page's rows."""
    terms = terms_of(spark, query)
    wanted = fields or [key]
    if not terms:
        return table.where("false").select(*wanted, F.lit(0).alias("score"))
    scored = lambda rows: rows.groupBy(key).agg(F.sum("n").cast("int").alias("score"))
    postings = _of(spark, path, "postings", terms)
    # One row per block.
    blocks = _of(spark, path, "bounds", terms).groupBy("block").agg(F.sum("most").alias("most"), F.max("docs").alias("docs")).collect()
    blocks = sorted(blocks, key=lambda r: (-r["most"], r["block"]))
    first, held = [], 0
    for r in blocks:
        if held >= offset + limit:
            break
        first.append(r["block"])
        held += r["docs"]
    page = offset + limit
    best = scored(postings.where(F.col("block").isin(first))).orderBy(F.desc("score"), key).limit(page).agg(F.min("score"), F.count(F.lit(1))).first()
    # A block that can only reach the last score may still hold a row with a smaller key.
    last = best[0] if best[1] == page else 0
    left = [r["block"] for r in blocks if r["most"] >= last]
    hits = scored(postings.where(F.col("block").isin(left))).orderBy(F.desc("score"), key).offset(offset).limit(limit)
    found = table.select(F.col(key).alias("_key"), *[F.col(c) for c in wanted])
    return hits.withColumnRenamed(key, "_hit").join(found, F.col("_hit") == F.col("_key")).select(*wanted, "score")


def having_all(spark: SparkSession, path: str, key: str, query: str, token=None) -> DataFrame:
    """Keys after ``token`` of the documents that have all terms of the query."""
    terms = terms_of(spark, query)
    rows = _of(spark, path, "postings", terms)
    rows = rows if token is None else rows.where(F.col(key) > F.lit(token))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(terms)).select(key)
