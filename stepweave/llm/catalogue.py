"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stepweave.llm import decontaminate, html, lsm, packing, quality, sharding, simhash, substring, token_counts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        toxicity.op1_toxicity,
        substring.op2_substring_dedup,
        quality.op3_quality,
        sharding.op4_sharding,
        simhash.op5_simhash_near_dedup,
        token_counts.op6_token_counts,
        lsm.op7_exact_dedup,
        html.op8_html_extraction,
        decontaminate.op9_decontamination,
        packing.op10_packing,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": substring.OP2_SQL, "op4_sharding": sharding.OP4_SQL, "op7_exact_dedup": lsm.OP7_SQL, "op9_decontamination": decontaminate.OP9_SQL}
