"""SQL over registered views (the reference hands SQL text to a database;
here Spark parses, optimises and runs it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def run_sql(spark: SparkSession, text: str, args: dict | None = None) -> DataFrame:
    """Run one statement. Queries return their rows; ``CREATE VIEW`` and
    ``INSERT INTO`` run eagerly and return an empty frame (no affected count)."""
    if not text or not text.strip():
        raise ValueError("SQL query cannot be empty.")
    return spark.sql(text, args=args) if args else spark.sql(text)
