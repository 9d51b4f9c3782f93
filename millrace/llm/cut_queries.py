"""Problem 5: texts that were stored incomplete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.truncation import truncated, truncation_rates
from millrace.session import table


def _scored(spark: SparkSession, d: str) -> DataFrame:
    role, suffix = F.lower(F.trim("role")), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    return truncated([(table(spark, d, "messages"), "msg_id", "content", "content", role), (table(spark, d, "file_versions"), "fv_id", "pre", "pre", suffix)])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("cut").select("record_id", "field")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation_rates(_scored(spark, d))


QUERIES = {"p5_found": p5_found, "p5_rates": p5_rates}
ORACLES: dict[str, str] = {}
