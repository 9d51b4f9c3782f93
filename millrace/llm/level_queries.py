"""Problem 10: reading levels of English documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.levels import reading_levels
from millrace.session import table


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(table(spark, d, "documents"), table(spark, d, "level_samples"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_levels(spark, d).select("doc_id", "band").distinct()


QUERIES = {"p10_found": p10_found, "p10_levels": p10_levels}
ORACLES: dict[str, str] = {}
