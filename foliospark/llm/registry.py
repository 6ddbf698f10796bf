"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontamination, divergence, jaccard, licenses, lines, mixing, packing, quality, sharding, tokens, toxicity, trie

QUERIES = {
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_best_fit": packing.op11_best_fit,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_prefix_trie": trie.op13_prefix_trie,
    "op1_ngram_jaccard": jaccard.op1_ngram_jaccard,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_quality": quality.op5_quality,
    "op6_chat": chat.op6_chat,
    "op7_mixing": mixing.op7_mixing,
    "op8_token_planes": tokens.op8_token_planes,
    "op9_sharding": sharding.op9_sharding,
}
ORACLES: dict[str, str] = {
    "op12_source_divergence": divergence.OP12_SQL,
    "op13_prefix_trie": trie.OP13_SQL,
    "op1_ngram_jaccard": jaccard.OP1_SQL,
    "op5_quality": quality.OP5_SQL,
    "op6_chat": chat.OP6_SQL,
}
