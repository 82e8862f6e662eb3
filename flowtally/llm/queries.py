"""Queries of this subpackage for __spark_entry__.py, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, fill_in_middle, html_text, mixing, ngram_join, pii, quality, spotsigs, substring_dedup, token_counts, topk_search, url_filter, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": ngram_join.op1_ngram_jaccard,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_html_text": html_text.op4_html_text,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_spotsigs": spotsigs.op7_spotsigs,
    "op8_pii": pii.op8_pii,
    "op9_quality": quality.op9_quality,
    "op10_decontaminate": decontamination.op10_decontaminate,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_topk_search": topk_search.op12_topk_search,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE_SQL = {"op5_mix_sources": mixing.OP5_SQL, "op6_url_filter": url_filter.OP6_SQL, "op11_fill_in_middle": fill_in_middle.OP11_SQL, "op12_topk_search": topk_search.OP12_SQL}
