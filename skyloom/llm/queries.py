"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import decontam, filter_audit, html_text, licenses, line_dedup, near_dup, packing, quality, rule_ensemble, secrets, sharding, spelling, token_output

QUERIES = {
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op2_decontamination": decontam.op2_decontamination,
    "op1_main_text": html_text.op1_main_text,
    "op10_minhash_near_dup": near_dup.op10_minhash_near_dup,
    "op8_license_scan": licenses.op8_license_scan,
    "op7_retrieval_packing": packing.op7_retrieval_packing,
    "op3_token_output": token_output.op3_token_output,
    "op4_maglev_sharding": sharding.op4_maglev_sharding,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op9_quality_rules": quality.op9_quality_rules,
    "op11_rule_ensemble": rule_ensemble.op11_rule_ensemble,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
ORACLES = {
    "op12_spelling_variants": spelling.OP12_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
    "op10_minhash_near_dup": near_dup.OP10_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op4_maglev_sharding": sharding.OP4_SQL,
    "op9_quality_rules": quality.OP9_SQL,
}
