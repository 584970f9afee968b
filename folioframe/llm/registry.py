"""The corpus queries, their SQL, and where they come from."""

from __future__ import annotations

from . import decontaminate, exact_dedup, jaccard_join, license_scan, packing, phrases, pii, quality, spelling, substring_dedup, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_pii": pii.op3_pii,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_ngram_jaccard_join": jaccard_join.op7_ngram_jaccard_join,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_suffix_array_dedup": suffix_dedup.op9_suffix_array_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_quality": quality.op11_quality,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_phrases": phrases.op13_phrases,
}

ORACLE_SQL = {
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op5_url_filter": url_filter.ORACLE,
    "op6_license_scan": license_scan.ORACLE,
    "op8_decontamination": decontaminate.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
    "op13_phrases": phrases.ORACLE,
}
