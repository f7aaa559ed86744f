"""Registered queries of the training-data operators and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from sourceassay.llm import (alignment, bpe, decontamination, exact_dedup, filter_audit, fingerprints, html_text, licenses, near_dedup,
                              personal_data, quality, sharding, toxicity)

QUERIES = {
    "op1_benchmark_decontamination": decontamination.op1,
    "op2_toxicity": toxicity.op2,
    "op3_quality": quality.op3,
    "op4_license_scan": licenses.op4,
    "op5_byte_bpe": bpe.op5,
    "op6_near_dedup": near_dedup.op6,
    "op7_exact_dedup": exact_dedup.op7,
    "op8_personal_data": personal_data.op8,
    "op9_html_text": html_text.op9,
    "op10_sharding": sharding.op10,
    "op11_filter_audit": filter_audit.op11,
    "op12_tokenizer_alignment": alignment.op12,
    "op13_fingerprints": fingerprints.op13,
}

ORACLE_SQL = {
    "op1_benchmark_decontamination": decontamination.OP1_SQL,
    "op6_near_dedup": near_dedup.OP6_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
}
