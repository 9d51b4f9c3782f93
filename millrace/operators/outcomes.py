"""Attempts to outcomes: folding, run summaries, strata, cost curves, failures.

Input rows are attempts ``(run_id, case_id, attempt, passed, infra_error, total_tokens, wall_time_s, ...)``. An attempt
lost to infrastructure is no failure: it leaves rates, curves and strata, but its cost still counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.stats import wilson
from millrace.session import materialize

_OK = "not coalesce(infra_error, false)"
#: Budgets of one cost curve; more are refused, none are dropped.
MAX_RUNGS = 1000


def label(c: Column, missing: str = "unknown") -> Column:
    """A stratum label: null and empty become ``missing``."""
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(missing))


def fold_attempts(attempts: DataFrame, strategy: str = "first-submit") -> DataFrame:
    """One row per run and case. ``first-submit`` submits the first usable attempt, ``best-of-k`` the first that passed.

    pass@k and pass^k are false, pass@1 null, where no attempt was usable; costs are summed over all attempts.
    """
    if strategy not in ("first-submit", "best-of-k"):
        raise ValueError(f"unknown strategy {strategy!r}")
    usable = F.expr(_OK)
    passed = F.coalesce("passed", F.lit(False))
    rank = F.when(~usable, 2).when(passed | F.lit(strategy == "first-submit"), 0).otherwise(1)
    out = attempts.groupBy("run_id", "case_id").agg(
        F.count("*").alias("attempt_count"),
        F.count_if(usable).alias("usable_attempt_count"),
        F.min_by(passed, F.struct(rank, F.col("attempt"))).alias("submitted_passed"),
        F.avg(F.when(usable, passed.cast("double"))).alias("pass_at_1"),
        F.coalesce(F.bool_or(F.when(usable, passed)), F.lit(False)).alias("pass_at_k"),
        F.coalesce(F.bool_and(F.when(usable, passed)), F.lit(False)).alias("pass_pow_k"),
        (F.count_if(usable) == 0).alias("infra_error"),
        F.sum(F.coalesce("total_tokens", F.lit(0))).alias("total_tokens"),
        F.sum(F.coalesce("wall_time_s", F.lit(0.0))).alias("wall_time_s"),
    )
    hit = F.when(F.col("pass_at_k"), F.col("submitted_passed"))
    return out.withColumn("selection_hit", hit).withColumnRenamed("submitted_passed", "passed")


def stratify(results: DataFrame, axes: list[str]) -> DataFrame:
    """``(axis, label, n, successes, success_rate, ci_low, ci_high)`` for every axis in one pass of grouping sets."""
    rows = results.where(_OK).select(*[label(F.col(a)).alias(a) for a in axes], F.coalesce("passed", F.lit(False)).cast("int").alias("passed"))
    one = rows.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("label")) for a in axes])).alias("s"), "passed")
    out = one.groupBy("s.axis", "s.label").agg(F.count("*").alias("n"), F.sum("passed").alias("successes"))
    low, high = wilson(F.col("successes"), F.col("n"))
    return out.select("axis", "label", "n", "successes", (F.col("successes") / F.col("n")).alias("success_rate"), low.alias("ci_low"), high.alias("ci_high"))


def run_summary(results: DataFrame) -> DataFrame:
    """One row per run. Rates are over usable rows; tokens and time over all rows."""
    usable = F.expr(_OK)
    won = usable & F.coalesce("passed", F.lit(False))
    out = results.groupBy("run_id").agg(
        F.count("*").alias("case_count"), F.count_if(usable).alias("effective"), F.count_if(won).alias("successes"),
        F.sum(F.coalesce("total_tokens", F.lit(0))).alias("total_tokens"), F.sum(F.coalesce("wall_time_s", F.lit(0.0))).alias("wall_time_s"),
    )
    n, tokens = F.col("effective"), F.col("total_tokens")
    low, high = wilson(F.col("successes"), n)
    return out.select(
        "*", F.try_divide("successes", n).alias("success_rate"), low.alias("ci_low"), high.alias("ci_high"), ((F.col("case_count") - n) / F.col("case_count")).alias("infra_error_rate"),
        F.coalesce(F.try_divide(tokens, n), F.lit(0.0)).alias("tokens_per_case"), F.try_divide(tokens, "successes").alias("tokens_per_success"), (n < 0.8 * F.col("case_count")).alias("infra_dominated"),
    )


def scaling(folded: DataFrame) -> DataFrame:
    """Per run, over cases with a usable attempt: mean attempts, pass@1, pass@k and pass^k shares, selection hit rate."""
    return folded.where(_OK).groupBy("run_id").agg(
        F.avg("attempt_count").alias("mean_attempts"), F.avg("pass_at_1").alias("pass_at_1"), F.avg(F.col("pass_at_k").cast("int")).alias("pass_at_k"),
        F.avg(F.col("pass_pow_k").cast("int")).alias("pass_pow_k"), F.avg(F.col("selection_hit").cast("int")).alias("selection_hit_rate"),
    )


def budget_rungs(results: DataFrame, fractions: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 1.0)) -> DataFrame:
    """Distinct nearest-rank token quantiles of the usable rows, ascending, numbered from 0.

    Rows are counted by token number first; ranks are running sums over a range sort of the distinct numbers, with
    the offsets of the ranges added, so no buffer holds all rows.
    """
    tokens = F.coalesce("total_tokens", F.lit(0)).cast("long")
    counts = results.where(_OK).groupBy(tokens.alias("t")).agg(F.count("*").alias("n"))
    ranged = materialize(counts.repartitionByRange("t").withColumn("part", F.spark_partition_id()), "rungs")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.sum("n").alias("m")).select("part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"), F.sum("m").over(Window.partitionBy()).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("t"))
    rows = ranged.withColumn("upto", upto).join(F.broadcast(starts), "part")  # a row per range
    least = [F.min(F.when(F.col("start") + F.col("upto") >= F.greatest(F.ceil(F.lit(f) * F.col("total")), F.lit(1)), F.col("t"))) for f in fractions]
    rungs = rows.agg(F.array_sort(F.array_distinct(F.array_compact(F.array(*least)))).alias("r"))
    return rungs.select(F.posexplode("r").alias("rung", "budget"))


def cost_curve(results: DataFrame, rungs: DataFrame) -> DataFrame:
    """``(run_id, budget, solved, n, share)``: share of usable rows passed within each budget; rungs are a handful of rows."""
    rows = results.where(_OK).select("run_id", F.coalesce("passed", F.lit(False)).alias("passed"), F.coalesce("total_tokens", F.lit(0)).alias("tokens"))
    budgets = [r.budget for r in rungs.select("budget").distinct().orderBy("budget").limit(MAX_RUNGS + 1).collect()]
    if len(budgets) > MAX_RUNGS:
        raise ValueError(f"a cost curve has at most {MAX_RUNGS} budgets")
    if not budgets:
        return rows.select("run_id", F.lit(0).cast("long").alias("budget"), F.lit(0).cast("long").alias("solved"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("share")).limit(0)
    wide = rows.groupBy("run_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("passed") & (F.col("tokens") <= b)).alias(f"b{i}") for i, b in enumerate(budgets)])
    point = F.explode(F.array(*[F.struct(F.lit(b).cast("long").alias("budget"), F.col(f"b{i}").alias("solved")) for i, b in enumerate(budgets)])).alias("p")
    return wide.select("run_id", "n", point).select("run_id", "p.budget", "p.solved", "n", (F.col("p.solved") / F.col("n")).alias("share"))


def failure_top(rows: DataFrame, category: str, detail: str, top: int = 15) -> DataFrame:
    """The ``top`` most frequent (category, first line of detail) of failed rows, ties by name: a report."""
    line = F.regexp_replace(F.lower(F.substring_index(F.coalesce(F.col(detail), F.lit("")), "\n", 1)), r"[0-9]+", "#")
    return rows.groupBy(label(F.col(category)).alias("category"), line.alias("line")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category", "line").limit(top)


def cost_rollup(rows: DataFrame, group: list[str], measures: dict[str, str]) -> DataFrame:
    """Sums by the groups' rollup; a subtotal's label is ``ALL``."""
    out = rows.rollup(*group).agg(F.count("*").alias("rows"), *[F.sum(c).alias(a) for a, c in measures.items()], *[F.grouping(g).alias(f"_{g}") for g in group])
    return out.select(*[F.when(F.col(f"_{g}") == 1, "ALL").otherwise(F.col(g)).alias(g) for g in group], "rows", *measures)


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key under a total order."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key under a total order; combined in the mappers, so a hot key moves one row per mapper."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*").select(*rows.columns)
