"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from pathweave.llm import exact_dedup, lm_score, mixing, near_dedup, packing, pii, quality, secret_scan, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_pii": pii.op2_pii,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_lm_scoring": lm_score.op4_lm_scoring,
        "op5_secret_scan": secret_scan.op5_secret_scan,
        "op6_minhash_near_dedup": near_dedup.op6_minhash_near_dedup,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_url_filter": url_filter.op8_url_filter,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_mixing_sources": mixing.op10_mixing_sources,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    found = {
        "op6_minhash_near_dedup": near_dedup.OP6_SQL,
        "op8_url_filter": url_filter.OP8_SQL,
        "op9_exact_dedup": exact_dedup.OP9_SQL,
        "op10_mixing_sources": mixing.OP10_SQL,
        "pipeline": corpus_pipeline.ORACLE_SQL,
    }
    return {name: sql for name, sql in found.items() if sql}
