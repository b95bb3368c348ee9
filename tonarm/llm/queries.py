"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tonarm import shipped

from . import bpe, chat, exact_dedup, language_id, lexical_search, line_dedup, mixing, nearest, periodic_runs, sharding, simhash, substring_dedup, token_counts

MODULES = {
    "op1_substring_dedup": (substring_dedup, substring_dedup.op1_substring_dedup),
    "op2_line_dedup": (line_dedup, line_dedup.op2_line_dedup),
    "op3_simhash": (simhash, simhash.op3_simhash),
    "op4_bpe": (bpe, bpe.op4_bpe),
    "op5_mixing": (mixing, mixing.op5_mixing),
    "op6_exact_dedup": (exact_dedup, exact_dedup.op6_exact_dedup),
    "op7_chat": (chat, chat.op7_chat),
    "op8_sharding": (sharding, sharding.op8_sharding),
    "op9_nearest": (nearest, nearest.op9_nearest),
    "op10_language": (language_id, language_id.op10_language),
    "op11_lexical_search": (lexical_search, lexical_search.op11_lexical_search),
    "op12_periodic_runs": (periodic_runs, periodic_runs.op12_periodic_runs),
    "op13_token_counts": (token_counts, token_counts.op13_token_counts),
}


def queries():
    return {name: shipped(f) for name, (_, f) in MODULES.items()}


def oracle_sql():
    return {name: m.SQL for name, (m, _) in MODULES.items() if m.SQL}
