"""Registered queries on texts. SQL cannot express these operators; the tests compare with brute force."""

from __future__ import annotations

from kasane.llm import encoding, leakage, mixing, residue
from kasane.runtime import table


def _p5_found(spark, d):
    return encoding.garbled_rows(table(spark, d, "source_record"))


def _p5_restored(spark, d):
    return encoding.restored_values(table(spark, d, "source_record"))


def _p7_found(spark, d):
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_item"))


def _p8_mixture(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))


def _p8_report(spark, d):
    return mixing.mix_report(table(spark, d, "documents"), table(spark, d, "mix_target"))


def _p9_found(spark, d):
    return residue.residue_documents(table(spark, d, "documents"))


QUERIES = {
    "p8_mixture": _p8_mixture,
    "p8_report": _p8_report,
    "p9_found": _p9_found,
    "p5_found": _p5_found,
    "p5_restored": _p5_restored,
    "p7_found": _p7_found,
}

SQL: dict[str, str] = {}
