"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chains, classifier, edit_counts, exact, host_rules, mixing, near, packing, token_output, tool_calls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (token_output.op1_token_output, mixing.op2_mixing, near.op3_minhash_near_dedup, chains.op4_substring_dedup, host_rules.op5_quality_rules, edit_counts.op6_token_counts, packing.op7_best_fit_packing, tool_calls.op8_chat_formatting, exact.op9_exact_dedup, classifier.op10_quality_classifier)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.OP2_SQL, "op9_exact_dedup": exact.OP9_SQL}
