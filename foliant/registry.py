"""The registered queries of the document engine and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.plans import queries_documents, queries_functions, queries_ir, queries_nested, queries_streams, queries_tables  # noqa: F401 - registers its queries
from foliant.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query that entry() runs: documents to docx packages, read back and summed up."""
    return QUERIES["docx_roundtrip"](spark, sf_dir)
