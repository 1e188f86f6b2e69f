"""The queries of this subpackage and their SQL twins, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waybill.llm import (
    op1_pii,
    op2_language,
    op3_near_duplicates,
    op4_html_text,
    op5_quality,
    op6_vector_duplicates,
    op7_mix,
    op8_language_model,
    op9_decontaminate,
    op10_tokens,
    op11_whitening,
    op12_neighbours,
    op13_conversations,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_personal_data": op1_pii.query,
    "op2_languages": op2_language.query,
    "op3_near_duplicates": op3_near_duplicates.query,
    "op4_html_text": op4_html_text.query,
    "op5_quality": op5_quality.query,
    "op6_vector_duplicates": op6_vector_duplicates.query,
    "op7_mix_sources": op7_mix.query,
    "op8_language_scores": op8_language_model.query,
    "op9_contamination": op9_decontaminate.query,
    "benchmark_proximity": op9_decontaminate.near_query,
    "op10_token_counts": op10_tokens.query,
    "op11_whitening": op11_whitening.query,
    "op12_neighbours": op12_neighbours.query,
    "op13_conversation_repair": op13_conversations.query,
}

ORACLE: dict[str, str] = {
    "op3_near_duplicates": op3_near_duplicates.ORACLE_SQL,
    "op6_vector_duplicates": op6_vector_duplicates.ORACLE_SQL,
    "op7_mix_sources": op7_mix.ORACLE_SQL,
    "op9_contamination": op9_decontaminate.ORACLE_SQL,
    "op13_conversation_repair": op13_conversations.ORACLE_SQL,
}
