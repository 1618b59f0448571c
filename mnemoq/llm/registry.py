"""The queries of this subpackage, by name, and their DuckDB twins."""

from __future__ import annotations

from . import chat, decontaminate, exact_dedup, huffman_files, line_dedup, lm_score, near_dedup, packing, periodic_runs, pii, quality, url_filter, whitening

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_pii_pseudonyms": pii.op4_pii_pseudonyms,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_huffman_files": huffman_files.op6_huffman_files,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_chat_format": chat.op8_chat_format,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_pattern_packing": packing.op10_pattern_packing,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_whitening": whitening.op12_whitening,
    "op13_exact_dedup": exact_dedup.op13_exact_dedup,
}

ORACLES = {
    "op2_decontaminate": decontaminate.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op8_chat_format": chat.ORACLE,
    "op9_url_filter": url_filter.ORACLE,
    "op13_exact_dedup": exact_dedup.ORACLE,
}
