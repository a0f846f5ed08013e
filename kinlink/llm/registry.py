"""Queries of this subpackage, by name, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinlink.llm.cdc import op9_content_chunks
from kinlink.llm.decontaminate import op10_decontaminate
from kinlink.llm.html_text import op1_html_main_text
from kinlink.llm.langid import op4_language_id
from kinlink.llm.licenses import op6_license_scan, scan_sql
from kinlink.llm.mixing import mix_sql, op7_mix_sources
from kinlink.llm.neardup import op8_minhash_neardup
from kinlink.llm.sharding import op2_uniform_shards
from kinlink.llm.suffixes import op3_suffix_array_dedup
from kinlink.llm.topk import op5_bm25_top_k


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_html_main_text, op2_uniform_shards, op3_suffix_array_dedup, op4_language_id, op5_bm25_top_k,
        op6_license_scan, op7_mix_sources, op8_minhash_neardup, op9_content_chunks, op10_decontaminate,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op6_license_scan": scan_sql(), "op7_mix_sources": mix_sql()}
