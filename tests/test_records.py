from pyspark.sql import functions as F

from millrace.operators import records


def test_normalized_messages(spark):
    rows = [("a", '[{"role": "user", "content": [{"text": "x"}]}, 3, {"content": null}, {"role": "ai", "content": "\\u00e9"}]'), ("b", "[{cut"), ("c", None), ("d", ""), ("e", "{}"), ("f", "[]")]
    got = sorted((r.request_id, r.pos, r.role, r.content, r.tool_calls) for r in records.normalized_messages(spark.createDataFrame(rows, "request_id string, full_history string")).collect())
    assert got == [("a", 0, "user", "x", "[]"), ("a", 2, "unknown", "", "[]"), ("a", 3, "ai", "é", "[]")]


def test_columns(spark):
    df = spark.createDataFrame([("a/b\\Test_x.PY",), ("src/m.spec.ts",), ("tests/u.rs",), (".env",), (None,)], "p string")
    got = [tuple(r) for r in df.select(records.language_of(F.col("p")), records.is_test_path(F.col("p"))).collect()]
    assert got == [("python", True), ("typescript", True), ("other", True), ("other", False), ("other", None)]
    ids = spark.createDataFrame([("a-1",), ("..",), ("a b",), ("",), (None,), ("x" * 129,)], "i string")
    assert [r[0] for r in ids.select(records.is_safe_id(F.col("i"))).collect()] == [True, False, False, False, False, False]
    out = spark.createDataFrame([("3 passed, 1 failed, 12 passed",), ("",), (None,)], "o string")
    assert [tuple(r) for r in out.select(*records.runner_counts(F.col("o"))).collect()] == [(12, 1), (0, 0), (0, 0)]


def test_nearest_by_size_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.choice("xyz"), f"k{i:03}", "a" * rng.randint(0, 12)) for i in range(60)] + [("alone", "q", "a"), ("x", "nul", None)]
    got = {r.k: (r.nearest, r.difference) for r in records.nearest_by_size(spark.createDataFrame(rows + rows[:3], "g string, k string, t string"), "g", "k", "t").collect()}
    want = {}
    for g, k, t in rows:
        others = [(abs(len(u) - len(t)), j) for h, j, u in rows if h == g and j != k and t is not None and u is not None]
        if others:
            want[k] = (min(others)[1], min(others)[0])
    assert got == want
