"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from leafmill.llm import centroid_clustering, chat_format, decontaminate, divergence_audit, language_id, line_dedup, lm_score, mixing, ngram_join, quality_rules, substring_dedup, token_ids, url_filter

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_language_id": language_id.op8_language_id,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_centroid_clustering": centroid_clustering.op11_centroid_clustering,
    "op12_divergence_audit": divergence_audit.op12_divergence_audit,
    "op13_token_ids": token_ids.op13_token_ids,
}

ORACLES = {
    "op2_decontaminate": decontaminate.ORACLE,
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op5_ngram_join": ngram_join.ORACLE,
    "op6_mix_sources": mixing.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
    "op11_centroid_clustering": centroid_clustering.ORACLE,
    "op12_divergence_audit": divergence_audit.ORACLE,
}
