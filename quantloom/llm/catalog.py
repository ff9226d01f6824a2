"""The corpus queries and their SQL."""

from __future__ import annotations

from . import ann, decontaminate, hard_negatives, language_model, merkle, minhash, mixing, quality, quality_rules, secrets, suffix_dedup, token_output, warc


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_language_model": language_model.op3_language_model,
        "op4_near_duplicates": minhash.op4_near_duplicates,
        "op5_secrets": secrets.op5_secrets,
        "op6_quality": quality.op6_quality,
        "op7_token_ids": token_output.op7_token_ids,
        "op8_nearest": ann.op8_nearest,
        "op9_warc": warc.op9_warc,
        "op10_mix_sources": mixing.op10_mix_sources,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_quality_rules": quality_rules.op13_quality_rules,
    }


def oracle_sql() -> dict:
    return {
        "op1_decontaminate": decontaminate.OP1_SQL,
        "op2_suffix_dedup": suffix_dedup.OP2_SQL,
        "op4_near_duplicates": minhash.OP4_SQL,
        "op9_warc": warc.OP9_SQL,
        "op11_hard_negatives": hard_negatives.OP11_SQL,
        "op12_merkle_manifest": merkle.OP12_SQL,
        "op13_quality_rules": quality_rules.OP13_SQL,
    }
