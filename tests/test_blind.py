import numpy as np

from millrace.operators import blind


def test_threshold_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(50):
        v, y = rng.integers(0, 5, 9).astype(float), rng.random(9) < 0.5
        if y.all() or not y.any():
            continue
        acc = lambda pred: ((pred & y).sum() / y.sum() + (~pred & ~y).sum() / (~y).sum()) / 2
        want = max(max(acc(v > c), acc(~(v > c))) for c in [-1, *v])
        cut, above, got = blind.best_threshold(v, y)
        assert abs(got - want) < 1e-12 and abs(acc((v > cut) == above) - got) < 1e-12


def test_features(spark):
    rows = [("size", str(i), float(i % 2) * 10 + i / 100, bool(i % 2)) for i in range(40)] + [("noise", str(i // 2), float((i * 7919) % 13), bool(i % 2)) for i in range(40)] + [("size", None, None, True), ("one", "a", 1.0, True)]
    got = {r.feature: r for r in blind.blind_features(spark.createDataFrame(rows, "feature string, pair string, value double, label boolean"), 60).collect()}
    assert got["size"].accuracy == 1 and got["size"].loo_accuracy == 1 and got["size"].p_value < 0.05 and got["size"].n == 40
    assert got["noise"].p_value > 0.05 and got["one"].p_value == 1
    assert blind.blind_features(spark.createDataFrame([], "feature string, pair string, value double, label boolean")).count() == 0
