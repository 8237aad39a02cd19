"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import chat_formatting, decontamination, jaccard_join, language_id, line_dedup, lm_scoring, mixing, nearest_neighbours, oracle, pii, sharding, token_alignment, url_filters, whitening

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_chat_prefix_tree": chat_formatting.op2_chat_prefix_tree,
    "op3_benchmark_decontamination": decontamination.op3_benchmark_decontamination,
    "op4_sampled_splitter_sharding": sharding.op4_sampled_splitter_sharding,
    "op5_vantage_point_search": nearest_neighbours.op5_vantage_point_search,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_pii_spans": pii.op7_pii_spans,
    "op8_url_language_model": url_filters.op8_url_language_model,
    "op9_line_winnowing": line_dedup.op9_line_winnowing,
    "op10_ngram_jaccard_join": jaccard_join.op10_ngram_jaccard_join,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_log_frequency_filter": lm_scoring.op12_log_frequency_filter,
    "op13_segment_alignment": token_alignment.op13_segment_alignment,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = dict(oracle.ORACLE_SQL)
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
