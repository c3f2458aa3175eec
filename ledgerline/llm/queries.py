"""Queries of the subpackage by name, with SQL where it can express them."""

from __future__ import annotations

from . import bpe, chat_format, decontamination, html_text, jaccard_join, licenses, merkle, periodic, ppm, substring_dedup, token_counts, topk, toxicity

QUERIES = {
    "op1_benchmark_decontamination": decontamination.query,
    "op2_threshold_topk": topk.query,
    "op3_bpe": bpe.query,
    "op4_ppm_scores": ppm.query,
    "op5_token_counts": token_counts.query,
    "op6_toxicity": toxicity.query,
    "op7_substring_dedup": substring_dedup.query,
    "op8_html_text": html_text.query,
    "op9_chat_format": chat_format.query,
    "op10_ngram_jaccard_join": jaccard_join.query,
    "op11_license_scan": licenses.query,
    "op12_merkle_manifest": merkle.query,
    "op13_periodic_runs": periodic.query,
}

ORACLE_SQL: dict[str, str] = {"op2_threshold_topk": topk.SQL, "op12_merkle_manifest": merkle.SQL}
