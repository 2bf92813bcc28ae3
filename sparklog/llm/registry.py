"""The queries of this subpackage, by name, and their SQL where there is one."""

from __future__ import annotations

from sparklog.llm import chat, decontam, line_dedup, ngram_join, packing, pii, quality, secret_scan, sharding, substring_dedup

QUERIES = {
    "op1_simhash_decontamination": decontam.op1_simhash_decontamination,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_weighted_hash_tree": sharding.op3_weighted_hash_tree,
    "op4_weak_supervision_pii": pii.op4_weak_supervision_pii,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_structural_secrets": secret_scan.op6_structural_secrets,
    "op7_suffix_automata": substring_dedup.op7_suffix_automata,
    "op8_dominance_packing": packing.op8_dominance_packing,
    "op9_ngram_jaccard": ngram_join.op9_ngram_jaccard,
    "op10_token_level_chat": chat.op10_token_level_chat,
}

#: The others are tested against brute-force versions: SQL has no CRC, tokenizer or decoder.
ORACLE_SQL = {
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op7_suffix_automata": substring_dedup.OP7_SQL,
    "op9_ngram_jaccard": ngram_join.OP9_SQL,
    "op10_token_level_chat": chat.OP10_SQL,
}
