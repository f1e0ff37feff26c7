"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hornbeam.llm import bpe, chat, credentials, jaccard, langid, mixing, mtree, quality, substring, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": chat.op1_chat_format,
        "op2_substring_dedup": substring.op2_substring_dedup,
        "op3_byte_bpe": bpe.op3_byte_bpe,
        "op4_ngram_jaccard": jaccard.op4_ngram_jaccard,
        "op5_source_mixing": mixing.op5_source_mixing,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_exact_top_k": mtree.op7_exact_top_k,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_secret_scan": credentials.op9_secret_scan,
        "op10_language_id": langid.op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": chat.OP1_SQL,
        "op4_ngram_jaccard": jaccard.OP4_SQL,
        "op7_exact_top_k": mtree.OP7_SQL,
        "op8_quality_rules": quality.OP8_SQL,
        "op9_secret_scan": credentials.OP9_SQL,
    }
