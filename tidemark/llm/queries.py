"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from . import chat, decontamination, exact_dedup, html_text, language, mixing, quality, sharding, simhash, token_ids

QUERIES = {
    "op1_token_ids": token_ids.op1_token_ids,
    "op2_html_extraction": html_text.op2_html_extraction,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_shard": sharding.op6_shard,
    "op7_chat_format": chat.op7_chat_format,
    "op8_benchmark_decontamination": decontamination.op8_benchmark_decontamination,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_language_id": language.op10_language_id,
}

ORACLE_SQL = {
    "op4_mix_sources": mixing.OP4_SQL,
    "op7_chat_format": chat.OP7_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
}
