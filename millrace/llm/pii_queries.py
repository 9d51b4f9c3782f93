"""Problem 4: personal data in messages of all three forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.pii import find_personal_data
from millrace.session import table


def _found(spark: SparkSession, d: str, with_text: bool = False) -> DataFrame:
    return find_personal_data(table(spark, d, "messages"), table(spark, d, "sessions"), table(spark, d, "chat_records"), with_text=with_text)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _found(spark, d).select("record_kind", "record_id", "msg_pos", F.explode("pii_types").alias("pii_type"))
    return rows.distinct()


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every message that holds personal data, with typed placeholders in its text."""
    return _found(spark, d, True).dropDuplicates(["record_kind", "record_id", "msg_pos"])


QUERIES = {"p4_found": p4_found, "p4_redacted": p4_redacted}
ORACLES: dict[str, str] = {}
