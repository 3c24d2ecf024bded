"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, fuzzy_passages, html_extract, importance, near_dedup, piece_codec, quality, sharding, simhash, substring_dedup, topk, toxicity, vector_codes

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_sentencepiece": piece_codec.op2_sentencepiece,
    "op3_fuzzy_passages": fuzzy_passages.op3_fuzzy_passages,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_topk": topk.op5_topk,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_sharding": sharding.op7_sharding,
    "op8_html_extraction": html_extract.op8_html_extraction,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_quality": quality.op10_quality,
    "op11_importance": importance.op11_importance,
    "op12_simhash": simhash.op12_simhash,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
ORACLES = {
    "op4_near_dedup": near_dedup.OP4_SQL,
    "op5_topk": topk.OP5_SQL,
    "op6_substring_dedup": substring_dedup.OP6_SQL,
    "op7_sharding": sharding.OP7_SQL,
    "op9_decontamination": decontaminate.OP9_SQL,
    "op11_importance": importance.OP11_SQL,
    "op12_simhash": simhash.OP12_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
