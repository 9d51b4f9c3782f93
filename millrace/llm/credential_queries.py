"""Problem 2: credentials in edit pairs and case files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.credentials import find_credentials
from millrace.session import table


def _found(spark: SparkSession, d: str, with_text: bool = False) -> DataFrame:
    files, blobs = table(spark, d, "file_versions"), table(spark, d, "file_blobs")
    return find_credentials([(files, "fv_id", {"pre": "pre", "post": "post"}), (blobs, "blob_id", {"content": "content"})], with_text=with_text)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select("record_id", "field", F.explode("line_nos").alias("line_no")).distinct()


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every file that holds a credential, with the credentials' characters replaced."""
    return _found(spark, d, True).dropDuplicates(["record_id", "field"])


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted}
ORACLES: dict[str, str] = {}
