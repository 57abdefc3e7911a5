"""The queries of this subpackage and their DuckDB SQL, for the entry module."""

from __future__ import annotations

from tabulon.llm import bpe, language_id, main_text, mixing, neighbours, perplexity, pii, quality_rules, simhash, toxicity

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_language_mixture": language_id.query,
    "op3_byte_bpe": bpe.query,
    "op4_host_rules": quality_rules.query,
    "op5_toxicity": toxicity.query,
    "op6_simhash_groups": simhash.query,
    "op7_main_text": main_text.query,
    "op8_personal_data": pii.query,
    "op9_perplexity": perplexity.query,
    "op10_nearest": neighbours.query,
}

ORACLES: dict[str, str] = {
    "op1_mix_sources": mixing.ORACLE,
    "op4_host_rules": quality_rules.ORACLE,
}
