"""The registered queries of this subpackage and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackweave.llm import byte_bpe, decontamination, licenses, lm_scoring, minhash, pii, quality_rules, runs, spelling, token_counts, token_store, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": lm_scoring.query,
    "op2_quality_rules": quality_rules.query,
    "op3_near_dedup": minhash.query,
    "op4_licenses": licenses.query,
    "op5_decontamination": decontamination.query,
    "op6_toxicity": toxicity.query,
    "op7_pii": pii.query,
    "op8_token_counts": token_counts.query,
    "op9_token_store": token_store.query,
    "op10_byte_bpe": byte_bpe.query,
    "op11_warc": warc.query,
    "op12_periodic_runs": runs.query,
    "op13_spelling_variants": spelling.query,
}

ORACLES: dict[str, str] = {
    "op2_quality_rules": quality_rules.oracle(),
    "op3_near_dedup": minhash.ORACLE,
    "op4_licenses": licenses.oracle(),
    "op11_warc": warc.ORACLE,
}
