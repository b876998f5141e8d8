"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lapforge.llm import best_fit_packing, chat_format, decontaminate, embedding_whitening, exact_dedup, filter_audit, language_id, mixing, ngram_join, pii, suffix_dedup, token_count, toxicity

MODULES = {
    "op1_suffix_dedup": suffix_dedup,
    "op2_decontaminate": decontaminate,
    "op3_language_id": language_id,
    "op4_ngram_jaccard": ngram_join,
    "op5_source_mixing": mixing,
    "op6_token_count": token_count,
    "op7_pii": pii,
    "op8_toxicity": toxicity,
    "op9_exact_dedup": exact_dedup,
    "op10_chat_format": chat_format,
    "op11_filter_audit": filter_audit,
    "op12_embedding_whitening": embedding_whitening,
    "op13_best_fit_packing": best_fit_packing,
}


def queries() -> dict:
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict:
    return {name: module.ORACLE for name, module in MODULES.items() if module.ORACLE}
