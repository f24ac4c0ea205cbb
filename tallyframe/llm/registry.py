"""Queries of this subpackage by name, and the SQL of those that SQL can express."""
from __future__ import annotations

from . import (filter_audit, fingerprint, html_extract, mixing, packing, simhash_dedup, substring_dedup, suffix_dedup, token_counts,
               topk_search, toxicity, url_filter, vector_codes)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_fingerprints": fingerprint.op2_fingerprints,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_topk_search": topk_search.op4_topk_search,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_url_filters": url_filter.op6_url_filters,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_simhash_dedup": simhash_dedup.op10_simhash_dedup,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_html_extract": html_extract.op12_html_extract,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

SQL = {
    "op1_substring_dedup": substring_dedup.ORACLE_SQL,
    "op4_topk_search": topk_search.ORACLE_SQL,
    "op6_url_filters": url_filter.ORACLE_SQL,
    "op7_mix_sources": mixing.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
    "op13_vector_codes": vector_codes.ORACLE_SQL,
}
