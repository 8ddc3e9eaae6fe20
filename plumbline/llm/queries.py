"""The numbered queries, each its operator over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from plumbline.llm import decontaminate, divergence, html_text, licenses, line_dedup, ngram_join, packing, quality, quality_rules, suffix_dedup, toxicity, url_filter, vector_codes

QUERIES = {
    "op1_license_scan": licenses.query,
    "op2_url_filter": url_filter.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_quality": quality.query,
    "op5_pack": packing.query,
    "op6_quality_rules": quality_rules.query,
    "op7_toxicity": toxicity.query,
    "op8_ngram_join": ngram_join.query,
    "op9_line_dedup": line_dedup.query,
    "op10_decontaminate": decontaminate.query,
    "op11_html_text": html_text.query,
    "op12_divergence_audit": divergence.query,
    "op13_vector_codes": vector_codes.query,
}

ORACLES: dict[str, str] = {
    "op2_url_filter": url_filter.ORACLE,
    "op12_divergence_audit": divergence.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
