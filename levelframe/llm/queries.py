"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from levelframe.llm import decontaminate, hard_negatives, language_id, lm_scoring, mixing, near_dedup, packing, pii, prefix_trie, quality_rules, sharding, suffix_dedup, url_filter


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_lm_scoring": lm_scoring.op4_lm_scoring,
        "op5_near_dedup": near_dedup.op5_near_dedup,
        "op6_pii": pii.op6_pii,
        "op7_language_id": language_id.op7_language_id,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_mixing": mixing.op10_mixing,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_packing": packing.op13_packing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": url_filter.OP2_SQL,
        "op5_near_dedup": near_dedup.OP5_SQL,
        "op8_decontaminate": decontaminate.OP8_SQL,
        "op11_hard_negatives": hard_negatives.OP11_SQL,
        "op12_prefix_trie": prefix_trie.OP12_SQL,
    }
