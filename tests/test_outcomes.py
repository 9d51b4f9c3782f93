import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import stats
from millrace.operators import calibration, compare, outcomes

ATT = "run_id string, case_id string, attempt int, passed boolean, infra_error boolean, total_tokens long, wall_time_s double"


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_kernels(spark):
    p = lambda b, c: one(spark, stats.mcnemar(F.lit(b), F.lit(c)).alias("p")).p
    assert p(6, 0) == pytest.approx(0.03125) and p(13, 6) == pytest.approx(0.1671, abs=1e-4) and p(7, 2) == pytest.approx(0.1797, abs=1e-4)
    assert p(0, 0) == 1 and p(15, 0) == pytest.approx(6.10e-05, rel=1e-3) and p(900, 700) == pytest.approx(6.4e-7, rel=0.2)
    lo, hi = one(spark, *stats.wilson(F.lit(26), F.lit(31)))
    assert (lo, hi) == (pytest.approx(0.6737, abs=1e-3), pytest.approx(0.9291, abs=1e-3))
    assert list(one(spark, *stats.wilson(F.lit(0), F.lit(0)))) == [None, None]
    assert one(spark, stats.normal_quantile(F.lit(0.975)).alias("z")).z == pytest.approx(1.959964, abs=1e-5)
    assert one(spark, stats.normal_quantile(F.lit(1.0)).alias("z")).z is None
    assert one(spark, stats.binomial_tail(F.lit(8), F.lit(10)).alias("t")).t == pytest.approx(56 / 1024)
    assert one(spark, stats.fisher(F.lit(3), F.lit(1), F.lit(1), F.lit(3)).alias("p")).p == pytest.approx(0.485714, abs=1e-5)
    assert one(spark, stats.fisher(F.lit(0), F.lit(0), F.lit(2), F.lit(3)).alias("p")).p == 1
    n = one(spark, stats.mcnemar_sample_size(F.lit(0.1), F.lit(0.2)).alias("n"), stats.mcnemar_sample_size(F.lit(0.3), F.lit(0.2)).alias("m"))
    z = (1.959964 * math.sqrt(0.2) + 0.841621 * math.sqrt(0.19)) ** 2 / 0.01
    assert n.n == math.ceil(z) and n.m is None


def test_fold_strategies(spark):
    rows = spark.createDataFrame([
        ("r", "a", 1, False, True, 5, 1.0), ("r", "a", 2, False, False, 7, 1.0), ("r", "a", 3, True, False, 1, None),
        ("r", "b", 1, True, True, 3, 1.0), ("r", "c", 1, None, None, None, 1.0),
    ], ATT)
    first = {r.case_id: r for r in outcomes.fold_attempts(rows).collect()}
    best = {r.case_id: r for r in outcomes.fold_attempts(rows, "best-of-k").collect()}
    assert first["a"].passed is False and best["a"].passed is True
    assert first["a"].pass_at_1 == 0.5 and first["a"].pass_at_k and not first["a"].pass_pow_k and first["a"].total_tokens == 13
    assert first["b"].infra_error and first["b"].pass_at_1 is None and not first["b"].pass_at_k and first["b"].selection_hit is None
    assert first["c"].passed is False and not first["c"].infra_error
    with pytest.raises(ValueError):
        outcomes.fold_attempts(rows, "luck")


def test_summary_with_only_lost_rows_and_empty(spark):
    rows = spark.createDataFrame([("r", "a", 1, True, True, 5, 1.0), ("s", "a", 1, True, False, 5, 1.0), ("s", "b", 1, False, False, 7, 1.0), ("s", "c", 1, False, True, 8, 1.0)], ATT)
    out = {r.run_id: r for r in outcomes.run_summary(rows).collect()}
    assert out["r"].success_rate is None and out["r"].ci_low is None and out["r"].total_tokens == 5 and out["r"].tokens_per_case == 0
    assert out["s"].success_rate == 0.5 and out["s"].total_tokens == 20 and out["s"].tokens_per_success == 20 and out["s"].infra_dominated
    assert outcomes.run_summary(rows.limit(0)).count() == 0
    rungs = outcomes.budget_rungs(rows)
    assert [r.budget for r in rungs.collect()] == [5, 7]
    assert {(r.run_id, r.budget): r.share for r in outcomes.cost_curve(rows, rungs).collect()} == {("s", 5): 0.5, ("s", 7): 0.5}
    assert outcomes.cost_curve(rows, outcomes.budget_rungs(rows.limit(0))).count() == 0


def test_strata_labels(spark):
    rows = spark.createDataFrame([("", True, False), (None, False, False), ("x", True, True)], "lang string, passed boolean, infra_error boolean")
    out = outcomes.stratify(rows, ["lang"]).collect()
    assert [(r.label, r.n, r.successes) for r in out] == [("unknown", 2, 1)]


def test_item_statistics(spark):
    rows = []
    for run, wins in {"r1": "abc", "r2": "ab", "r3": "a", "r4": ""}.items():
        rows += [(c, run[1], run, c in wins, False) for c in "abcd"]
    rows += [("lost", "1", "r1", False, True)]
    df = spark.createDataFrame(rows, "case_id string, anchor string, run_id string, passed boolean, infra_error boolean")
    out = {r.case_id: r for r in calibration.item_statistics(df).collect()}
    assert out["lost"].attempts == 0 and out["lost"].p_hat is None and out["lost"].band == "unmeasured" and not out["lost"].keep
    assert out["d"].point_biserial is None and out["d"].reasons == ["unsolved"] and out["d"].band == "hard"
    rest = [(2 / 3, 1), (1 / 3, 1), (1 / 3, 0), (0, 0)]
    mx, my = sum(x for x, _ in rest) / 4, 0.5
    r = sum((x - mx) * (y - my) for x, y in rest) / math.sqrt(sum((x - mx) ** 2 for x, _ in rest) * sum((y - my) ** 2 for _, y in rest))
    assert out["b"].point_biserial == pytest.approx(r) and out["b"].keep and out["b"].band == "mid"
    assert calibration.item_statistics(df.limit(0)).count() == 0


def test_largest_remainder_and_quota(spark):
    assert calibration.largest_remainder({"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, 10) == {"a": 4, "b": 3, "c": 3}
    assert calibration.largest_remainder({"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, 10, rotate=1) == {"a": 3, "b": 4, "c": 3}
    with pytest.raises(ValueError):
        calibration.largest_remainder({"a": 0.5}, 3)
    items = spark.createDataFrame([("c1", "x", 0.1, None), ("c2", "x", 0.9, 0.2), ("c3", "y", None, None)], "case_id string, band string, spread double, point_biserial double")
    got = calibration.quota_select(items, "band", {"x": 0.5, "y": 0.5}, 2)
    assert sorted(r.case_id for r in got.collect()) == ["c2", "c3"]
    assert {r.band: r.shortfall for r in calibration.quota_shortfall(got, "band", {"x": 0.5, "y": 0.5}, 6).collect()} == {"x": 2, "y": 2}


def test_pairs(spark):
    rows = [("base", c, 1, c in "ab", False, 1, 1.0) for c in "abcd"] + [("new", c, 1, c in "ac", c == "d", 1, 1.0) for c in "abcd"] + [("new", "a", 2, False, False, 1, 1.0), ("alone", "z", 1, True, False, 1, 1.0)]
    out = {r.candidate: r for r in compare.paired_outcomes(spark.createDataFrame(rows, ATT), "base").collect()}
    assert (out["new"].both_passed, out["new"].only_baseline, out["new"].only_candidate, out["new"].neither) == (0, 2, 1, 0)
    assert out["alone"].p_value is None and out["new"].p_value == 1
    t = compare.table_difference(spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string"), spark.createDataFrame([(2, None), (3, "d"), (4, "e")], "k int, v string"), "k", "v")
    assert sorted(map(tuple, t.collect())) == [(1, "removed"), (3, "changed"), (4, "added")]
