"""Registered queries of the training-data operators, and their SQL."""

from . import decontamination, lm_scoring, near_dedup, packing, pii, quality_classifier, quality_rules, token_counts, token_output, url_filter

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_token_output": token_output.op2_token_output,
    "op3_personal_data": pii.op3_personal_data,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    "op10_decontamination": decontamination.op10_decontamination,
}
ORACLE_SQL = {
    "op5_url_filter": url_filter.ORACLE,
    "op8_quality_rules": quality_rules.ORACLE,
}
