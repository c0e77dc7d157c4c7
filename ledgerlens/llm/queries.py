"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from ledgerlens.llm import decontamination, hard_negatives, hash_search, katz, mixing, near_dedup, oracle, packing, quality, quotations, suffix_dedup, surrogates, term_pipeline, url_filter

QUERIES = {
    "op1_minhash_tensored": near_dedup.query,
    "op2_packing_order_preserving": packing.query,
    "op3_multi_index_hashing": hash_search.query,
    "op4_mixing_weights": mixing.query,
    "op5_quotation_linking": quotations.query,
    "op6_url_model_ratio": url_filter.query,
    "op7_line_frequency": quality.query,
    "op8_katz_backoff": katz.query,
    "op9_surrogates": surrogates.query,
    "op10_bwt_merge_dedup": suffix_dedup.query,
    "op11_hard_negatives": hard_negatives.query,
    "op12_decontamination": decontamination.query,
    "op13_term_pipeline": term_pipeline.query,
}
SQL = {
    "op1_minhash_tensored": oracle.NEAR_DUPLICATES,
    "op5_quotation_linking": oracle.QUOTATIONS,
    "op11_hard_negatives": oracle.HARD_NEGATIVES,
    "op12_decontamination": oracle.DECONTAMINATION,
    "op13_term_pipeline": oracle.RANKED_SEARCH,
}
