"""Registered queries of the library, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.plans import queries_documents, queries_evaluation, queries_grounding, queries_lifecycle, queries_retrieval, queries_streams, queries_text, queries_versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**queries_retrieval.QUERIES, **queries_text.QUERIES, **queries_grounding.QUERIES, **queries_lifecycle.QUERIES, **queries_documents.QUERIES, **queries_evaluation.QUERIES, **queries_streams.QUERIES, **queries_versions.QUERIES}
ORACLE_SQL: dict[str, str] = {**queries_retrieval.ORACLE_SQL, **queries_text.ORACLE_SQL, **queries_grounding.ORACLE_SQL, **queries_lifecycle.ORACLE_SQL, **queries_documents.ORACLE_SQL, **queries_evaluation.ORACLE_SQL, **queries_streams.ORACLE_SQL, **queries_versions.ORACLE_SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search of every benchmark item over all documents."""
    return QUERIES["hybrid_search"](spark, sf_dir)
