"""The queries of this subpackage, and their SQL where there is some."""

from __future__ import annotations

from . import bpe, decontamination, exact_dedup, language_id, line_dedup, ngram_join, substring_dedup, suffix_array_dedup, token_records, toxicity

QUERIES = {
    "op1_language_id": language_id.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_benchmark_decontamination": decontamination.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_ngram_jaccard_join": ngram_join.query,
    "op6_suffix_array_dedup": suffix_array_dedup.query,
    "op7_token_records": token_records.query,
    "op8_bpe": bpe.query,
    "op9_toxicity": toxicity.query,
    "op10_line_dedup": line_dedup.query,
}

ORACLE_SQL = {
    "op2_substring_dedup": substring_dedup.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op6_suffix_array_dedup": suffix_array_dedup.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
}
