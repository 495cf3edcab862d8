"""The queries of this package and their SQL."""

from __future__ import annotations

from loomstone.llm import alignment, attention_quality, decontamination, license_scan, line_dedup, near_duplicates, packing, pii, quality_rules, secrets, suffix_dedup, token_files

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_ngram_jaccard": near_duplicates.op2_ngram_jaccard,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_packing": packing.op7_packing,
    "op8_pii": pii.op8_pii,
    "op9_token_files": token_files.op9_token_files,
    "op10_secrets": secrets.op10_secrets,
    "op11_quality_classifier": attention_quality.op11_quality_classifier,
    "op12_token_alignment": alignment.op12_token_alignment,
}
ORACLES = {
    "op1_license_scan": license_scan.SQL,
    "op4_line_dedup": line_dedup.SQL,
    "op5_quality_rules": quality_rules.SQL,
}
