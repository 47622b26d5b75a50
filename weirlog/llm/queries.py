"""The registered queries of this subpackage and the SQL that they are compared with, where SQL can express them."""

from __future__ import annotations

from weirlog.llm import alignment, chat, decontaminate, html, jaccard, line_dedup, minhash, mixing, prefix_trie, quality_rules, sharding, token_counts, weak_labels

QUERIES = {
    "op1_html_extraction": html.op1_html_extraction,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_mixing": mixing.op4_mixing,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_sharding": sharding.op7_sharding,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_quality_classifier": weak_labels.op10_quality_classifier,
    "op11_minhash": minhash.op11_minhash,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLE_SQL = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op6_chat_formatting": chat.ORACLE,
    "op8_decontamination": decontaminate.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
