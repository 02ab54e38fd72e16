"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from lipika.llm import chroma, exact_dedup, line_dedup, mixing, ngram_join, packing, quality, suffix_dedup, toxicity, url_filters

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_ngram_jaccard": ngram_join.op2_ngram_jaccard,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_url_filters": url_filters.op4_url_filters,
    "url_redirect_verdicts": url_filters.url_redirect_verdicts,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_chroma_fingerprints": chroma.op6_chroma_fingerprints,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op2_ngram_jaccard": ngram_join.SQL,
    "op4_url_filters": url_filters.SQL,
    "url_redirect_verdicts": url_filters.REDIRECT_SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op9_mix_sources": mixing.SQL,
}
