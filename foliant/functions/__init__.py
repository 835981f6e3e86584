"""Scalar functions: Catalyst expressions, and their registration for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """SQL functions whose bodies are SQL, so that Catalyst sees through them."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION xml_safe(t STRING) RETURNS STRING RETURN regexp_replace(t, '[\\\\x00-\\\\x08\\\\x0B\\\\x0C\\\\x0E-\\\\x1F\\\\uFFFE\\\\uFFFF]', '')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION safe_href(h STRING) RETURNS BOOLEAN RETURN coalesce(h RLIKE '(?i)^(https?:|mailto:)|^#b[0-9]+$', false)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION colorref_hex(c BIGINT) RETURNS STRING RETURN concat('#', lpad(hex(c & 255), 2, '0'), lpad(hex(shiftright(c, 8) & 255), 2, '0'), lpad(hex(shiftright(c, 16) & 255), 2, '0'))")
