"""Queries of the training-data operators and the SQL that some of them are compared with."""

from __future__ import annotations

from .bpe import op5_byte_level_bpe
from .chat import op3_chat_formatting
from .line_dedup import ORACLE_SQL as LINE_DEDUP_SQL
from .line_dedup import op4_line_dedup
from .near_dedup import op2_near_dedup
from .packing import op1_best_fit_packing
from .quality import op9_quality_rules
from .secrets import op8_secret_scans
from .substrings import ORACLE_SQL as SUBSTRINGS_SQL
from .substrings import op10_suffix_dedup
from .topk import ORACLE_SQL as TOP_K_SQL
from .topk import op7_exact_top_k
from .toxicity import op6_toxicity


def queries() -> dict:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_near_dedup": op2_near_dedup,
        "op3_chat_formatting": op3_chat_formatting,
        "op4_line_dedup": op4_line_dedup,
        "op5_byte_level_bpe": op5_byte_level_bpe,
        "op6_toxicity": op6_toxicity,
        "op7_exact_top_k": op7_exact_top_k,
        "op8_secret_scans": op8_secret_scans,
        "op9_quality_rules": op9_quality_rules,
        "op10_suffix_dedup": op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_line_dedup": LINE_DEDUP_SQL,
        "op7_exact_top_k": TOP_K_SQL,
        "op10_suffix_dedup": SUBSTRINGS_SQL,
    }
