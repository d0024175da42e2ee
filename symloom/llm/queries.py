"""Queries over the training-data operators, and their SQL."""

from __future__ import annotations

from symloom.llm import line_dedup, licenses, minhash_dedup, mixing, warc
from symloom.llm.bpe import op2_bpe
from symloom.llm.fingerprints import op9_fingerprints
from symloom.llm.quality_classifier import op6_quality_classifier
from symloom.llm.quality_rules import op7_quality_rules
from symloom.llm.suffix_dedup import op10_suffix_dedup


def queries() -> dict:
    return {
        "op1_minhash": minhash_dedup.op1_minhash,
        "op2_bpe": op2_bpe,
        "op3_license_scan": licenses.op3_license_scan,
        "op4_warc": warc.op4_warc,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_quality_rules": op7_quality_rules,
        "op8_mixing": mixing.op8_mixing,
        "op9_fingerprints": op9_fingerprints,
        "op10_suffix_dedup": op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash": minhash_dedup.ORACLE,
        "op3_license_scan": licenses.oracle(),
        "op4_warc": warc.ORACLE,
        "op5_line_dedup": line_dedup.ORACLE,
        "op8_mixing": mixing.ORACLE,
    }
