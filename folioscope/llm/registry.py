"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from folioscope.llm import importance, jaccard, language, line_dedup, media, merkle, mixing, ngram_model, packing, pii, quality_model, quality_rules, token_order

QUERIES = {
    "op1_temperature_mix": mixing.op1_temperature_mix,
    "op2_jaccard_join": jaccard.op2_jaccard_join,
    "op3_pattern_packing": packing.op3_pattern_packing,
    "op4_quality_attention": quality_model.op4_quality_attention,
    "op5_media": media.op5_media,
    "op6_line_rules": quality_rules.op6_line_rules,
    "op7_training_order": token_order.op7_training_order,
    "op8_ngram_trie": ngram_model.op8_ngram_trie,
    "op9_language_id": language.op9_language_id,
    "op10_contextual_pii": pii.op10_contextual_pii,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_importance_resampling": importance.op13_importance_resampling,
}

ORACLE_SQL = {
    "op1_temperature_mix": mixing.ORACLE,
    "op2_jaccard_join": jaccard.ORACLE,
    "op6_line_rules": quality_rules.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_line_dedup": line_dedup.ORACLE,
    "op13_importance_resampling": importance.ORACLE,
}
