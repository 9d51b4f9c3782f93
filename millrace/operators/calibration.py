"""Item statistics of a case set over anchor runs, verdicts, bands and quota selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.stats import pearson, wilson

# The selection policy and the difficulty bands.
P_MAX, P_MIN, MIN_R = 0.9, 0.05, 0.15
BANDS = ("hard", "mid", "easy")
_OK = "not coalesce(infra_error, false)"


def difficulty_band(p: Column) -> Column:
    """hard below 0.2, easy above 0.8, mid between (both ends), unmeasured for null."""
    return F.when(p.isNull(), "unmeasured").when(p < 0.2, "hard").when(p > 0.8, "easy").otherwise("mid")


def verdict_reasons(p: Column, r: Column, measured: Column, expected: Column) -> Column:
    """Why an item is not kept, in order; an incomplete panel comes alone, a null correlation passes."""
    inside = (p <= P_MAX) & (p >= P_MIN)
    rest = F.array_compact(F.array(F.when(p > P_MAX, "too_easy"), F.when(p < P_MIN, "unsolved"), F.when(inside & (r < MIN_R), "no_discrimination")))
    return F.when(measured < expected, F.array(F.lit("incomplete_panel"))).otherwise(rest)


def item_statistics(rows: DataFrame) -> DataFrame:
    """Per case over attempts ``(case_id, anchor, run_id, passed, infra_error)``.

    p_hat pools attempts; spread is the range of anchor rates; flaky means an anchor neither always nor never passed;
    the item-rest correlation is over the runs that measured the case, against the run's rate without the case. A
    case of which every attempt was lost stays, with zero attempts and null statistics.
    """
    seen = rows.select("case_id").distinct()
    ok = rows.where(_OK).withColumn("won", F.coalesce("passed", F.lit(False)).cast("int"))
    by_anchor = ok.groupBy("case_id", "anchor").agg(F.count("*").alias("n"), F.sum("won").alias("s"))
    anchors = by_anchor.agg(F.count_distinct("anchor").alias("expected"))
    rate = F.col("s") / F.col("n")
    pooled = by_anchor.groupBy("case_id").agg(
        F.sum("n").alias("attempts"), F.sum("s").alias("passes"), (F.max(rate) - F.min(rate)).alias("spread"), F.bool_or((rate > 0) & (rate < 1)).alias("flaky"), F.count("*").alias("measured"),
    )
    cell = ok.groupBy("case_id", "run_id").agg(F.avg("won").alias("item"), F.sum("won").alias("w"))
    runs = cell.groupBy("run_id").agg(F.sum("w").alias("run_passes"), F.count("*").alias("run_measured"))
    both = cell.join(runs, "run_id")
    rest = (F.col("run_passes") - F.col("item")) / F.when(F.col("run_measured") > 1, F.col("run_measured") - 1)
    corr = both.withColumn("rest", rest).groupBy("case_id").agg(F.when(F.min("run_measured") > 1, pearson(F.col("item"), F.col("rest"))).alias("point_biserial"))
    out = seen.join(pooled, "case_id", "left").join(corr, "case_id", "left").crossJoin(F.broadcast(anchors))  # one row
    p = F.col("passes") / F.col("attempts")
    low, high = wilson(F.col("passes"), F.col("attempts"))
    out = out.withColumn("p_hat", p).withColumn("ci_low", low).withColumn("ci_high", high)
    reasons = verdict_reasons(F.col("p_hat"), F.col("point_biserial"), F.coalesce("measured", F.lit(0)), F.col("expected"))
    out = out.withColumn("reasons", reasons).withColumn("keep", F.size("reasons") == 0).withColumn("band", difficulty_band(F.col("p_hat")))
    return out.select("case_id", F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("passes", F.lit(0)).alias("passes"), "p_hat", "ci_low", "ci_high", "spread", "flaky", "point_biserial", "band", "keep", "reasons")


def rank_order() -> list[Column]:
    """Best first: spread, then correlation (null as 0), then id."""
    return [F.coalesce("spread", F.lit(0.0)).desc(), F.coalesce("point_biserial", F.lit(0.0)).desc(), F.col("case_id").asc()]


def largest_remainder(shares: dict[str, float], total: int, rotate: int = 0) -> dict[str, int]:
    """Whole parts summing to ``total``; leftovers by largest fraction, ties by name rotated by ``rotate``."""
    if total < 0 or any(not 0 <= s <= 1 for s in shares.values()) or abs(sum(shares.values()) - 1) > 0.01:
        raise ValueError("shares lie in 0..1 and sum to 1")
    names = sorted(shares)
    turned = names[rotate % len(names) :] + names[: rotate % len(names)]
    parts = {k: int(shares[k] * total + 1e-9) for k in names}
    left = total - sum(parts.values())
    for k in sorted(turned, key=lambda k: (-(round(shares[k] * total - parts[k], 9)), turned.index(k)))[: max(left, 0)]:
        parts[k] += 1
    return parts


def quota_select(items: DataFrame, column: str, shares: dict[str, float], total: int) -> DataFrame:
    """The best ``quota`` items of every class of ``column``; a class too small is not filled up from others."""
    want = largest_remainder(shares, total)
    return top_per_class(items.where(F.col(column).isin(*want)), column, want)


def quota_shortfall(selected: DataFrame, column: str, shares: dict[str, float], total: int) -> DataFrame:
    """``(class, want, got, shortfall)``."""
    want = selected.sparkSession.createDataFrame(sorted(largest_remainder(shares, total).items()), f"`{column}` string, want long")
    got = selected.groupBy(column).agg(F.count("*").alias("got"))
    return want.join(got, column, "left").select(column, "want", F.coalesce("got", F.lit(0)).alias("got"), (F.col("want") - F.coalesce("got", F.lit(0))).alias("shortfall"))


def p_buckets(items: DataFrame) -> DataFrame:
    """Counts of p_hat in [0, .2) [.2, .5) [.5, .8) [.8, 1], zeros kept; a null counts as 0."""
    p = F.coalesce("p_hat", F.lit(0.0))
    names = ["0.0-0.2", "0.2-0.5", "0.5-0.8", "0.8-1.0"]
    at = F.when(p < 0.2, 0).when(p < 0.5, 1).when(p < 0.8, 2).otherwise(3)
    wide = items.agg(*[F.count_if(at == i).alias(f"b{i}") for i in range(4)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("bucket"), F.col(f"b{i}").alias("n")) for i, n in enumerate(names)])).alias("b")).select("b.*")


def reuse_plan(current: DataFrame, previous: DataFrame, *, panel: str | None = None, scheme: str = "", never: DataFrame | None = None) -> DataFrame:
    """``(case_id, fingerprint, reusable)``: whether the case was measured before with this fingerprint.

    With ``panel`` only rows of ``previous`` of that panel count; fingerprints must begin with ``scheme``; cases listed in
    ``never`` are measured anew.
    """
    old = previous if panel is None else previous.where(F.col("panel") == panel)
    old = old.where(F.col("fingerprint").startswith(scheme)).select("case_id", "fingerprint").distinct().withColumn("_old", F.lit(True))
    if never is not None:
        old = old.join(never.select("case_id").distinct(), "case_id", "left_anti")
    return current.join(old, ["case_id", "fingerprint"], "left").select("case_id", "fingerprint", F.coalesce("_old", F.lit(False)).alias("reusable"))


def fill_quota(items: DataFrame, column: str, shares: dict[str, float], total: int) -> DataFrame:
    """The best of every class up to its rounded share, topped up by rank from the rest, ranked over all and cut at ``total``.

    Shares are rounded half to even. At most ``total`` rows of each class and of all are ranked, so the windows stay small.
    """
    want = {k: round(v * total) for k, v in shares.items()}
    best = top_per_class(items, column, {**{k: max(v, total) for k, v in want.items()}}, other=total)
    limit = F.coalesce(F.create_map(*[x for k, v in want.items() for x in (F.lit(k), F.lit(v))])[F.col(column)], F.lit(0)) if want else F.lit(0)
    first = F.when(F.col("rank") <= limit, 0).otherwise(1)
    chosen = best.orderBy(first, *rank_order()).limit(total)
    return chosen.drop("rank").withColumn("rank", F.row_number().over(Window.orderBy(*rank_order())))  # at most ``total`` rows


def top_per_class(items: DataFrame, column: str, limits: dict[str, int], other: int = 0) -> DataFrame:
    """The best rows of each class with their rank; classes without a limit keep ``other`` rows.

    Every class is cut by its own literal limit before the window ranks it, in the mappers first.
    """
    label = F.coalesce(F.col(column).cast("string"), F.lit(""))
    parts = [items.where(label == k).orderBy(*rank_order()).limit(n) for k, n in limits.items() if n > 0]
    if other > 0:
        most = max(other, 1)
        rest = items.where(~label.isin(*limits)) if limits else items
        parts.append(rest.withColumn("_r", F.row_number().over(Window.partitionBy(column).orderBy(*rank_order()))).where(F.col("_r") <= most).drop("_r"))
    if not parts:
        return items.limit(0).withColumn("rank", F.lit(0))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(column).orderBy(*rank_order())))


def nested_quota(items: DataFrame, shares: dict[str, float], total: int, tier_shares: dict[str, float]) -> DataFrame:
    """Band quotas (`hard`, `mid`, `easy`) with tier quotas inside each band, topped up by rank within the band only."""
    bands = largest_remainder(shares, total)
    order = list(BANDS)
    out = []
    for band, want in bands.items():
        if want:
            turn = order.index(band) if band in order else 0
            tiers = largest_remainder(tier_shares, want, turn)
            rows = top_per_class(items.where(F.col("band") == band), "tier", {k: want for k in tiers}, other=want)
            limit = F.coalesce(F.create_map(*[x for k, v in tiers.items() for x in (F.lit(k), F.lit(v))])[F.col("tier")], F.lit(0))
            out.append(rows.orderBy(F.when(F.col("rank") <= limit, 0).otherwise(1), *rank_order()).limit(want).drop("rank"))
    return reduce(DataFrame.unionByName, out) if out else items.limit(0)


def merge_reused(new: DataFrame, reused: DataFrame, expected: int) -> DataFrame:
    """New and reused item rows, new ones first per case, with verdicts and bands judged again; rows without attempts are not counted as measured."""
    rows = new.withColumn("_new", F.lit(True)).unionByName(reused.withColumn("_new", F.lit(False)), allowMissingColumns=True)
    others = [c for c in rows.columns if c not in ("case_id", "_new", "reasons", "keep", "band")]
    one = rows.groupBy("case_id").agg(F.max_by(F.struct(*others), F.col("_new")).alias("r")).select("case_id", "r.*")
    measured = F.coalesce(F.size(F.map_keys("by_anchor")), F.lit(0)) if "by_anchor" in one.columns else F.coalesce("measured", F.lit(0))
    reasons = verdict_reasons(F.col("p_hat"), F.col("point_biserial"), measured, F.lit(expected))
    return one.withColumn("reasons", reasons).withColumn("keep", F.size("reasons") == 0).withColumn("band", difficulty_band(F.col("p_hat")))


def select_cases(items: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept items joined to their source cases, and the kept ids that the source lacks."""
    keep = items.where("keep").dropDuplicates(["case_id"])
    return source.join(keep, "case_id"), keep.select("case_id").join(source.select("case_id"), "case_id", "left_anti")


def unfit_anchors(anchors: DataFrame, tiers: DataFrame) -> DataFrame:
    """``(anchor, tier, missing)``: axes a tier requires that the anchor declares not to move; undeclared anchors (null) are left out.

    ``anchors(anchor, axes)`` and ``tiers(tier, required)`` are panels of a few rows.
    """
    both = anchors.where("axes is not null").crossJoin(F.broadcast(tiers))  # five rows
    return both.select("anchor", "tier", F.array_sort(F.array_except("required", "axes")).alias("missing")).where("size(missing) > 0")


def missing_anchors(configured: DataFrame, runs: DataFrame) -> DataFrame:
    """Configured anchors of which no row was measured or reused."""
    return configured.select("anchor").distinct().join(runs.select("anchor").distinct(), "anchor", "left_anti")


def parse_shares(text: str) -> dict[str, float]:
    """``"T2=0.3, T3=0.7"`` as shares between 0 and 1 that sum to 1, within a hundredth."""
    pairs = [p.split("=", 1) for p in text.split(",") if p.strip()]
    if any(len(p) != 2 for p in pairs):
        raise ValueError("a share reads name=number")
    shares = {k.strip(): float(v) for k, v in pairs}
    largest_remainder(shares, 0)
    return shares


