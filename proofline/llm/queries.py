"""The numbered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from proofline.llm import alignment, bpe, chat, decontaminate, license, ngram_join, passages, quality, records, repeats, simhash, toxicity, vector_codes

MODULES = [quality, chat, license, vector_codes]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": bpe.op1_byte_bpe,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_token_records": records.op4_token_records,
        "op5_repeats": repeats.op5_repeats,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_substring_dedup": passages.op7_substring_dedup,
        "op8_ngram_join": ngram_join.op8_ngram_join,
        "op9_chat_format": chat.op9_chat_format,
        "op10_license_scan": license.op10_license_scan,
        "op11_simhash": simhash.op11_simhash,
        "op12_alignment": alignment.op12_alignment,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.sql().items()}
