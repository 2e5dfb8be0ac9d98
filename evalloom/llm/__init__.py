"""Operations of a training-data pipeline. Nothing else in the package imports this subpackage."""

from __future__ import annotations

from evalloom.llm import chat, fill_middle, gam, langid, licenses, line_dedup, line_rules, mixing, sentencepiece_viterbi, simhash, substring_dedup, token_align, topk

_QUERIES = {
    "op1_mix_sources": mixing,
    "op2_language_id": langid,
    "op3_topk_voronoi": topk,
    "op4_line_rules": line_rules,
    "op5_simhash_dedup": simhash,
    "op6_sentencepiece": sentencepiece_viterbi,
    "op7_license_scan": licenses,
    "op8_chat_format": chat,
    "op9_quality_gam": gam,
    "op10_line_dedup": line_dedup,
    "op11_substring_dedup": substring_dedup,
    "op12_token_align": token_align,
    "op13_fill_middle": fill_middle,
}


def queries() -> dict:
    return {name: module.query for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL expresses over whole tables."""
    return {name: module.ORACLE for name, module in _QUERIES.items() if hasattr(module, "ORACLE")}
