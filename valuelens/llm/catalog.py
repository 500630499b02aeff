"""The registered queries of this package and their DuckDB SQL (where SQL can express them)."""

from __future__ import annotations

from . import (chat_format, decontaminate, exact_dedup, lm_trie, merkle, mix_sources, near_dup, period_runs, personal_data,
               shard_table, site_quality, token_counts, toxicity)

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_personal_data": personal_data.query,
    "op3_site_quality": site_quality.query,
    "op4_ngram_jaccard": near_dup.query,
    "op5_shard_table": shard_table.query,
    "op6_toxicity": toxicity.query,
    "op7_mix_sources": mix_sources.query,
    "op8_token_counts": token_counts.query,
    "op9_chat_format": chat_format.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_period_runs": period_runs.query,
    "op12_lm_trie": lm_trie.query,
    "op13_merkle": merkle.query,
}

ORACLE = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op5_shard_table": shard_table.ORACLE,
    "op7_mix_sources": mix_sources.ORACLE,
    "op9_chat_format": chat_format.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op13_merkle": merkle.ORACLE,
}
