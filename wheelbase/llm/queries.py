"""The registered queries of this subpackage, over whole tables with production parameters, and their SQL where it exists."""

from wheelbase.llm import (
    byte_repeats, conversation_trie, decontaminate, katz, language, license_scan, line_dedup, merkle, near_dedup, nearest, packing, toxicity,
    unit_dedup,
)

QUERIES = {
    "op1_substring_dedup": unit_dedup.op1,
    "op2_best_fit_packing": packing.op2,
    "op3_toxicity": toxicity.op3,
    "op4_decontamination": decontaminate.op4,
    "op5_lm_scoring": katz.op5,
    "op6_minhash_near_dedup": near_dedup.op6,
    "op7_language_id": language.op7,
    "op8_suffix_array_dedup": byte_repeats.op8,
    "op9_nearest_neighbours": nearest.op9,
    "op10_line_dedup": line_dedup.op10,
    "op11_merkle_manifest": merkle.op11,
    "op12_license_scan": license_scan.op12,
    "op13_conversation_trie": conversation_trie.op13,
}

SQL = {
    "op9_nearest_neighbours": nearest.OP9_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op12_license_scan": license_scan.OP12_SQL,
    "op13_conversation_trie": conversation_trie.OP13_SQL,
}
