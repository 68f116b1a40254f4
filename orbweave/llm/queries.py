"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import decon, exact, htmltext, langid, near, pieces, pii, repeats, secrets, tokenbin


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": lambda s, d: pii.pii_spans(_docs(s, d)),
        "op2_suffix_dedup": lambda s, d: repeats.repeated_passages(_docs(s, d)),
        "op3_token_binary": lambda s, d: tokenbin.write_tokens(_docs(s, d)),
        "op4_exact_dedup": lambda s, d: exact.exact_copies(_docs(s, d)),
        "op5_secret_scan": lambda s, d: secrets.scan(_docs(s, d)),
        "op6_html_extraction": lambda s, d: htmltext.extract_pages(s.read.parquet(f"{d}/pages.parquet")),
        "op7_sentencepiece": lambda s, d: pieces.encode_documents(_docs(s, d)),
        "op8_near_dedup": lambda s, d: near.near_copies(_docs(s, d)),
        "op9_language_id": lambda s, d: langid.identify(_docs(s, d)),
        "op10_decontamination": lambda s, d: decon.contaminated(_docs(s, d), s.read.parquet(f"{d}/benchmark.parquet")),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": repeats.ORACLE, "op4_exact_dedup": exact.ORACLE}
