"""The operators' queries, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from . import exact_dedup, hard_negatives, html_text, packing, pii, segmentation, simhash, source_audit, substring_dedup, token_files, toxicity, vector_graph, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_sentencepiece": segmentation.op3_sentencepiece,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_html_extraction": html_text.op5_html_extraction,
    "op6_token_files": token_files.op6_token_files,
    "op7_warc": warc.op7_warc,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_vector_graph": vector_graph.op10_vector_graph,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_source_audit": source_audit.op12_source_audit,
    "op13_substring_dedup": substring_dedup.op13_substring_dedup,
}
ORACLE = {"op4_exact_dedup": exact_dedup.SQL, "op11_hard_negatives": hard_negatives.SQL, "op12_source_audit": source_audit.SQL}
