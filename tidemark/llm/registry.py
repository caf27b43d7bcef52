"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import centroids, chat_format, decontamination, fingerprint, language_id, lattice_lm, quality, ranked_search, secret_scan, segmentation, simhash, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": chat_format.query,
    "op2_simhash": simhash.query,
    "op3_decontamination": decontamination.query,
    "op4_segmentation": segmentation.query,
    "op5_toxicity": toxicity.query,
    "op6_language_id": language_id.query,
    "op7_lattice_lm": lattice_lm.query,
    "op8_fingerprint": fingerprint.query,
    "op9_warc": warc.query,
    "op10_secret_scan": secret_scan.query,
    "op11_quality": quality.query,
    "op12_ranked_search": ranked_search.query,
    "op13_centroids": centroids.query,
}
ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": decontamination.SQL,
    "op9_warc": warc.SQL,
    "op12_ranked_search": ranked_search.SQL,
    "op13_centroids": centroids.SQL,
}
