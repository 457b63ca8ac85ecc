"""The registered queries of this subpackage: ``QUERIES`` and, where SQL can express one, its ``SQL``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from contentflow.llm import bpe, centroids, chat, dedup, divergence, hmm, jaccard, language, leaks, passages, personal, quality, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": leaks.op1_decontaminate,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_pii": personal.op3_pii,
    "op4_language": language.op4_language,
    "op5_bpe": bpe.op5_bpe,
    "op6_chat": chat.op6_chat,
    "op7_minhash": dedup.op7_minhash,
    "op8_quality": quality.op8_quality,
    "op9_hmm": hmm.op9_hmm,
    "op10_passages": passages.op10_passages,
    "op11_divergence": divergence.op11_divergence,
    "op12_jaccard": jaccard.op12_jaccard,
    "op13_centroids": centroids.op13_centroids,
}

SQL: dict[str, str] = {
    "op6_chat": chat.SQL,
    "op7_minhash": dedup.SQL,
    "op8_quality": quality.SQL,
    "op11_divergence": divergence.SQL,
    "op12_jaccard": jaccard.SQL,
    "op13_centroids": centroids.SQL,
}
