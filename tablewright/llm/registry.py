"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import decontaminate, exact_dedup, line_dedup, mixing, near_dedup, ngram_lm, passage_dedup, pii, quality, token_counts, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_benchmark_leaks": decontaminate.op2_benchmark_leaks,
        "op3_personal_data": pii.op3_personal_data,
        "op4_quality_scores": quality.op4_quality_scores,
        "op5_near_duplicates": near_dedup.op5_near_duplicates,
        "op6_ngram_scores": ngram_lm.op6_ngram_scores,
        "op7_source_mix": mixing.op7_source_mix,
        "op8_substring_dedup": passage_dedup.op8_substring_dedup,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_token_counts": token_counts.op10_token_counts,
    }


def further_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries beside the one of each operator: whole lines as units."""
    return {"long_line_dedup": line_dedup.long_line_dedup, "every_line_dedup": line_dedup.every_line_dedup}


def further_sql() -> dict[str, str]:
    return {"long_line_dedup": line_dedup.LONG_LINE_SQL, "every_line_dedup": line_dedup.EVERY_LINE_SQL}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.OP1_SQL,
        "op5_near_duplicates": near_dedup.OP5_SQL,
        "op7_source_mix": mixing.OP7_SQL,
        "op8_substring_dedup": passage_dedup.OP8_SQL,
        "op9_url_filter": url_filter.OP9_SQL,
    }
