"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import gated_toxicity, host_rules, jaccard_join, lm_trie, media_docs, mixing, periodic_runs, piece_codec, rule_ensemble, substring_dedup, token_counts, zip_warc

QUERIES = {
    "op1_zip_warc": zip_warc.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_mix_sources": mixing.query,
    "op4_token_counts": token_counts.query,
    "op5_jaccard_join": jaccard_join.query,
    "op6_piece_codec": piece_codec.query,
    "op7_lm_trie": lm_trie.query,
    "op8_media_docs": media_docs.query,
    "op9_rule_ensemble": rule_ensemble.query,
    "op10_host_rules": host_rules.query,
    "op11_periodic_runs": periodic_runs.query,
    "op12_gated_toxicity": gated_toxicity.query,
}

ORACLES = {
    "op1_zip_warc": zip_warc.SQL,
    "op3_mix_sources": mixing.SQL,
    "op5_jaccard_join": jaccard_join.SQL,
    "op10_host_rules": host_rules.SQL,
    "op11_periodic_runs": periodic_runs.SQL,
}
