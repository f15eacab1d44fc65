"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

from . import chat, decontaminate, language, mixing, near_dedup, pii, quality, sharding, substrings, topk

QUERIES = {
    "op1_weighted_minhash": near_dedup.query,
    "op2_exact_top_k": topk.query,
    "op3_suffix_automaton": decontaminate.query,
    "op4_bayes_quality": quality.query,
    "op5_induced_sorting": substrings.query,
    "op6_curriculum_mix": mixing.query,
    "op7_kernel_language": language.query,
    "op8_chat_assembly": chat.query,
    "op9_extendible_shards": sharding.query,
    "op10_lstm_crf_pii": pii.query,
}

ORACLES = {
    "op1_weighted_minhash": near_dedup.SQL,
    "op2_exact_top_k": topk.SQL,
    "op3_suffix_automaton": decontaminate.SQL,
    "op5_induced_sorting": substrings.SQL,
    "op6_curriculum_mix": mixing.SQL,
    "op8_chat_assembly": chat.SQL,
    "op9_extendible_shards": sharding.SQL,
}
