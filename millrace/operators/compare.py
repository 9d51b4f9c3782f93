"""Comparison of runs case by case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.stats import fisher, mcnemar
from millrace.operators.outcomes import last_wins

_OK = "not coalesce(infra_error, false)"


def paired_outcomes(results: DataFrame, baseline: str) -> DataFrame:
    """Every other run against the baseline on the cases both measured, with the exact McNemar p-value.

    Rows lost to infrastructure go first; the last row wins per (run, case); an empty pairing has a null p-value.
    """
    rows = last_wins(results.where(_OK).select("run_id", "case_id", "attempt", F.coalesce("passed", F.lit(False)).alias("passed")), ["run_id", "case_id"], ["attempt"])
    base = rows.where(F.col("run_id") == baseline).select("case_id", F.col("passed").alias("a"))
    pairs = rows.where(F.col("run_id") != baseline).join(base, "case_id")
    b, a = F.col("passed"), F.col("a")
    counts = pairs.groupBy(F.col("run_id").alias("candidate")).agg(
        F.count_if(a & b).alias("both_passed"), F.count_if(a & ~b).alias("only_baseline"), F.count_if(~a & b).alias("only_candidate"), F.count_if(~a & ~b).alias("neither"),
    )
    runs = results.where(F.col("run_id") != baseline).select(F.col("run_id").alias("candidate")).distinct()
    out = runs.join(counts, "candidate", "left").na.fill(0)
    n = F.col("both_passed") + F.col("only_baseline") + F.col("only_candidate") + F.col("neither")
    p = F.when(n > 0, mcnemar(F.col("only_baseline"), F.col("only_candidate")))
    return out.withColumn("discordant", F.col("only_baseline") + F.col("only_candidate")).withColumn("p_value", p)


def pooled_discordance(pairs: DataFrame) -> DataFrame:
    """One row: discordant over all pairs of all comparisons; null if there are none."""
    total = F.sum(F.col("both_passed") + F.col("only_baseline") + F.col("only_candidate") + F.col("neither"))
    return pairs.agg(F.sum("discordant").alias("discordant"), total.alias("pairs"), F.try_divide(F.sum("discordant"), total).alias("discordance"))


def against_baseline(summary: DataFrame, baseline: str) -> DataFrame:
    """Lift and token multiple of every run against the baseline's row; null where either is unmeasured."""
    base = summary.where(F.col("run_id") == baseline).select(F.col("success_rate").alias("r0"), F.col("total_tokens").alias("t0")).limit(1)
    return summary.join(F.broadcast(base), how="left").select(  # one row
        "run_id", "success_rate", (F.col("success_rate") - F.col("r0")).alias("lift"), F.try_divide("total_tokens", F.nullif(F.col("t0"), F.lit(0))).alias("token_multiple"))


def axis_differences(configs: DataFrame, key: str, axes: list[str], baseline: str) -> DataFrame:
    """``(key, differs)``: names of the axes on which a row differs from the baseline's, null-safe."""
    base = configs.where(F.col(key) == baseline).select(F.struct(*axes).alias("b")).limit(1)
    differs = F.array_compact(F.array(*[F.when(~F.col(a).eqNullSafe(F.col(f"b.{a}")), a) for a in axes]))
    return configs.join(F.broadcast(base), how="left").where(F.col(key) != baseline).select(key, differs.alias("differs"))  # one row


def majority_groups(results: DataFrame) -> DataFrame:
    """``(case_id, model, passes, n, majority, unanimous, flips)`` per model, runs being its repeats."""
    ok = results.where(_OK).withColumn("won", F.coalesce("passed", F.lit(False)).cast("int"))
    out = ok.groupBy("case_id", F.col("anchor").alias("model")).agg(F.sum("won").alias("passes"), F.count("*").alias("n"))
    return out.select("*", (2 * F.col("passes") > F.col("n")).alias("majority"), ((F.col("passes") == 0) | (F.col("passes") == F.col("n"))).alias("unanimous"), F.least("passes", F.col("n") - F.col("passes")).alias("flips"))


def enrichment(groups: DataFrame, group: str, hit: str) -> DataFrame:
    """One row: the 2x2 table of two booleans and its Fisher p-value."""
    g, h = F.col(group), F.col(hit)
    t = groups.agg(F.count_if(g & h).alias("a"), F.count_if(g & ~h).alias("b"), F.count_if(~g & h).alias("c"), F.count_if(~g & ~h).alias("d"))
    return t.withColumn("p_value", fisher(F.col("a"), F.col("b"), F.col("c"), F.col("d")))


def table_difference(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, change)``: added, removed or changed keys between two states, null-safe."""
    b = before.select(F.col(key), F.col(value).alias("v0"), F.lit(True).alias("in0"))
    a = after.select(F.col(key), F.col(value).alias("v1"), F.lit(True).alias("in1"))
    change = F.when(F.col("in0").isNull(), "added").when(F.col("in1").isNull(), "removed").when(~F.col("v0").eqNullSafe(F.col("v1")), "changed")
    return b.join(a, key, "full").select(key, change.alias("change")).where("change is not null")
