"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat_format, checks, exact_dedup, line_dedup, merkle, mixing, near_dedup, quality_classifier, quality_rules, sharding, token_counts, warc, whitening

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_mixing": mixing.op2_mixing,
    "op3_bpe": bpe.op3_bpe,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_sharding": sharding.op8_sharding,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_merkle": merkle.op11_merkle,
    "op12_whitening": whitening.op12_whitening,
    "op13_warc": warc.op13_warc,
    **checks.QUERIES,
}

SQL = {
    "op1_chat_format": chat_format.SQL,
    "op2_mixing": mixing.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op11_merkle": merkle.SQL,
    "op13_warc": warc.SQL,
    **checks.SQL,
}
