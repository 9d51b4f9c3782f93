"""Problems 8 and 9: token ids and filled containers of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.packing import fill_report, pack
from millrace.llm.tokenize import encode_ids, encode_offsets, token_counts
from millrace.session import table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_ids(table(spark, d, "documents"), "doc_id", "text")


def p8_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Ids with the byte at which each token begins, for decoding any slice."""
    return encode_offsets(table(spark, d, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(token_counts(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "tokens")


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p9_containers(spark, d))


QUERIES = {"p8_ids": p8_ids, "p8_offsets": p8_offsets, "p9_containers": p9_containers, "p9_fill": p9_fill}
ORACLES: dict[str, str] = {}
