"""Problem 7: whole chats in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.conversations import rebuild, sender_clocks
from millrace.session import table


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return rebuild(table(spark, d, "messages"), table(spark, d, "chat_records")).select("request_id", "turn_no", "msg_id")


def p7_clocks(spark: SparkSession, d: str) -> DataFrame:
    """The estimated clock offset of every client and speaker, with its error; only the sure ones move turns."""
    return sender_clocks(table(spark, d, "messages"))


QUERIES = {"p7_found": p7_found, "p7_clocks": p7_clocks}
ORACLES: dict[str, str] = {}
