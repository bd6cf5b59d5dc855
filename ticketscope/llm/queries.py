"""The queries of the operators, by name, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ticketscope.llm import (
    audit,
    bpe,
    decontaminate,
    html_text,
    language,
    pii,
    pivots,
    secrets,
    simhash,
    token_counts,
    token_files,
    toxicity,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_html_text": html_text.op2_html_text,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_language": language.op5_language,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_token_files": token_files.op7_token_files,
        "op8_secrets": secrets.op8_secrets,
        "op9_top_k": pivots.op9_top_k,
        "op10_bpe": bpe.op10_bpe,
        "op11_filter_audit": audit.op11_filter_audit,
        "op12_pii": pii.op12_pii,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontaminate": decontaminate.ORACLE_SQL,
        "op9_top_k": pivots.ORACLE_SQL,
        "op11_filter_audit": audit.ORACLE_SQL,
    }
