"""Problems 3 and 6: overlap of splits, near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import cross_split, overlap
from millrace.session import table


def _p3_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "cases"), table(spark, d, "file_blobs"), table(spark, d, "validity_reports")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return cross_split.cross_split_pairs(*_p3_tables(spark, d))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return cross_split.overlap_counts(table(spark, d, "cases"), p3_found(spark, d))


def p3_containment(spark: SparkSession, d: str) -> DataFrame:
    return cross_split.containment(table(spark, d, "cases"), table(spark, d, "file_blobs"))


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    """The records behind each id of ``p3_containment``."""
    return cross_split.containment_members(table(spark, d, "cases"), table(spark, d, "file_blobs"))


def _p6_groups(spark: SparkSession, d: str) -> DataFrame:
    files, cases = table(spark, d, "file_versions"), table(spark, d, "cases")
    return overlap.near_duplicates([(files, "fv_id", {"pre": "pre", "post": "post"}), (cases, "case_id", {"prompt": "prompt"})])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.group_pairs(_p6_groups(spark, d))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per grouped record with the group's least record as its name."""
    groups = _p6_groups(spark, d)
    named = groups.groupBy("field", "group").agg(F.min("id").alias("representative"))
    return groups.join(named, ["field", "group"]).select("field", "id", "representative", "members")


QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts, "p3_containment": p3_containment, "p3_members": p3_members, "p6_found": p6_found, "p6_groups": p6_groups}
ORACLES: dict[str, str] = {}
