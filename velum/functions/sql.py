"""Functions for SQL users: ``privacy_redact(text)``, ``privacy_scan(text)`` and the table function ``scan_secrets``.

They are SQL functions over the expression that ``secrets.redact`` is, which Spark puts in their place: nothing leaves
the JVM, and there is one catalogue.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from velum.functions.events import EVENTS
from velum.operators.secrets import SECRETS, redaction


def register(spark: SparkSession) -> None:
    """Null gives null, and no row of ``scan_secrets``."""
    done = f"({redaction(SECRETS)})"
    create = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(f"{create} privacy_redact(t STRING) RETURNS STRING RETURN {done}.text")
    spark.sql(f"{create} privacy_scan(t STRING) RETURNS {EVENTS} RETURN CASE WHEN t IS NOT NULL THEN {done}.events END")
    columns = "pattern STRING, original STRING, replaced STRING"
    spark.sql(f"{create} scan_secrets(t STRING) RETURNS TABLE({columns}) RETURN SELECT e.pattern, e.original, e.replaced FROM (SELECT explode({done}.events) AS e)")


__all__ = ["register"]
