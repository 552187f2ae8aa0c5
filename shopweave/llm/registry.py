"""The corpus queries by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from shopweave.llm import align, chat_tools, decontaminate, html_blocks, merkle, ngram_join, packing, quality_model, quality_rules, secrets_scan, sharding, token_files, url_filter


def queries() -> dict:
    return {
        "op1_rule_ensemble": quality_model.op1_rule_ensemble,
        "op2_token_files": token_files.op2_token_files,
        "op3_bloom_cascade": url_filter.op3_bloom_cascade,
        "op4_tool_links": chat_tools.op4_tool_links,
        "op5_wu_manber": decontaminate.op5_wu_manber,
        "op6_block_tree": html_blocks.op6_block_tree,
        "op7_blob_ledger": secrets_scan.op7_blob_ledger,
        "op8_robust_outliers": quality_rules.op8_robust_outliers,
        "op9_sum_of_squares": packing.op9_sum_of_squares,
        "op10_ngram_jaccard": ngram_join.op10_ngram_jaccard,
        "op11_bitmap_merkle": merkle.op11_bitmap_merkle,
        "op12_halved_alignment": align.op12_halved_alignment,
        "op13_prefix_shards": sharding.op13_prefix_shards,
    }


def oracle_sql() -> dict:
    return {
        "op3_bloom_cascade": url_filter.ORACLE,
        "op4_tool_links": chat_tools.ORACLE,
        "op11_bitmap_merkle": merkle.ORACLE,
        "op13_prefix_shards": sharding.ORACLE,
    }
