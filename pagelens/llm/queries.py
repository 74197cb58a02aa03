"""Queries of this folder, by name, and their SQL where DuckDB can express them."""

from __future__ import annotations

from . import best_fit, decontaminate, embedding_dedup, langid, lm_score, ngram_join, pii, sql, substring_dedup, token_output, url_filter

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1,
    "op2_pii_pseudonyms": pii.op2,
    "op3_url_filter": url_filter.op3,
    "op4_lm_score": lm_score.op4,
    "op5_decontaminate": decontaminate.op5,
    "op6_token_output": token_output.op6,
    "op7_language_id": langid.op7,
    "op8_substring_dedup": substring_dedup.op8,
    "op9_best_fit_packing": best_fit.op9,
    "op10_embedding_near_dedup": embedding_dedup.op10,
}

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard_join": sql.OP1,
    "op3_url_filter": url_filter.OP3_SQL,
    "op5_decontaminate": sql.OP5,
    "op8_substring_dedup": sql.OP8,
    "op10_embedding_near_dedup": sql.OP10,
}
