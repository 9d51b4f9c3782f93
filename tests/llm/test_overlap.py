import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import dartminhash, shingles
from millrace.llm import cross_split, overlap
from millrace.llm.components import connected_components

WORD = re.compile("[a-z0-9_]+")


def triples(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}, len(w)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abcXYZ09_ .,\n\tÄß中🙂K", max_size=80)), max_size=8))
def test_shingles_equal_brute_force(texts):
    got = list(shingles.ngrams(pa.array(texts, pa.string())))
    assert [r for r, _, _ in got] == list(range(len(texts)))
    for (_, n, grams), t in zip(got, texts):
        want, words = triples(t)
        assert n == words and len(grams) == len(want)


def test_shingles_of_very_long_text_and_slices():
    long = "word " * 400_000
    a = pa.array(["x", long, "", None, "a b c d"], pa.string())
    assert [n for _, n, _ in shingles.ngrams(a)] == [1, 400_000, 0, 0, 4]
    assert [n for _, n, _ in shingles.ngrams(a.slice(3))] == [0, 4]


def test_dartminhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    a, b = base[:200], base[100:]
    sig = dartminhash.signatures(np.concatenate([a, b, a]), np.array([200, 200, 200]), 512)
    assert (sig[0] == sig[2]).all() and (sig != 0).all()
    assert abs((sig[0] == sig[1]).mean() - 100 / 300) < 0.08
    w = np.concatenate([np.full(200, 2.5), np.full(200, 1.0)])
    sig = dartminhash.signatures(np.concatenate([a, a]), np.array([200, 200]), 512, w)
    assert abs((sig[0] == sig[1]).mean() - 1 / 2.5) < 0.08
    assert dartminhash.signatures(np.zeros(0, np.uint64), np.array([0, 0]), 8).tolist() == [[0] * 8] * 2


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def _corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.randint(20, 90))] for _ in range(n // 3)]
    header = [f"licence{i}" for i in range(30)]
    out = []
    for k in range(n):
        t = list(rng.choice(texts))
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        out.append(" ".join(header * (k % 2) + t))
    return out


def brute_groups(records, threshold=0.6):
    items = [(i, *triples(t)) for i, t in records]
    items = [(i, s) for i, s, n in items if n >= 25]
    parent = {i: i for i, _ in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(items):
        for j, b in items[:k]:
            if len(a & b) >= threshold * len(a | b):
                parent[find(i)] = find(j)
    groups = {}
    for i, _ in items:
        groups.setdefault(find(i), set()).add(i)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("hot", [64, 2])
def test_near_duplicates_equal_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(overlap, "HOT_BUCKET", hot)
    texts = _corpus(3)
    rows = [(f"r{i:03}", t, i) for i, t in enumerate(texts)] + [("r000", texts[0], 0), ("nul", None, 1), ("emp", "", 1), ("sho", "one two three", 1), (None, texts[1], 1)]
    df = spark.createDataFrame(rows, "rid string, body string, `group` int")
    got = {}
    for r in overlap.near_duplicates([(df, "rid", {"body": "body"})]).collect():
        got.setdefault(r["group"], set()).add(r["id"])
    want = brute_groups([(i, t) for i, t, _ in dict.fromkeys(rows)])
    assert {frozenset(x) for x in got.values()} == want


def test_prefix_links_equal_brute_force(spark):
    texts = _corpus(9)
    df = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(texts)], "rid string, body string")
    sets = overlap.nodes(df, "rid", {"f": "body"}).cache()
    _, comps = overlap.bucket_links(overlap.prefix_buckets(sets), sets)
    got = {}
    for r in overlap.alike_groups(sets, comps).collect():
        got.setdefault(r["group"], set()).add(r["id"])
    assert {frozenset(x) for x in got.values()} == brute_groups([(f"r{i}", t) for i, t in enumerate(texts)])


def test_pairs_and_empty_table(spark):
    df = spark.createDataFrame([("a", "x " * 30), ("b", "x " * 30), ("c", "x " * 30)], "rid string, body string")
    pairs = overlap.group_pairs(overlap.near_duplicates([(df, "rid", {"t": "body"})]))
    assert sorted(map(tuple, pairs.collect())) == [("t", "a", "b"), ("t", "a", "c"), ("t", "b", "c")]
    assert overlap.near_duplicates([(df.limit(0), "rid", {"t": "body"})]).count() == 0


def test_cross_split_pairs(spark):
    long = " ".join(f"p{i}" for i in range(40))
    near = long.replace("p7 ", "q7 ")
    cases = spark.createDataFrame([("a", long, " Train ", "s"), ("a", long, " Train ", "s"), ("b", near, "DEV", "s"), ("c", long, None, "s"), ("d", "short", "test", None), ("e", None, "holdout", "s"), ("f", "other " * 3, "train", "s")], "case_id string, prompt string, split string, source string")
    code = " ".join(f"c{i}" for i in range(50))
    blobs = spark.createDataFrame([("1", "d", code, "impl"), ("2", "f", code, "impl"), ("3", "a", code, "test"), ("4", "e", None, "impl")], "blob_id string, case_id string, content string, role string")
    reports = spark.createDataFrame([("e", "v3:1"), ("a", "v3:1"), ("b", "v2:9"), ("f", "v2:9"), ("d", ""), ("f", None)], "case_id string, fingerprint string")
    pairs = cross_split.cross_split_pairs(cases, blobs, reports)
    assert sorted(map(tuple, pairs.collect())) == [("a", "b"), ("a", "e"), ("d", "f")]
    counts = {(r.split, r.source): (r.cases, r.overlapping, r.pairs) for r in cross_split.overlap_counts(cases, pairs).collect()}
    assert counts[("train", "s")] == (2, 2, 3) and counts[("test", "none")] == (1, 1, 1)
    best = {(r.eval_id, r.train_id): r.containment for r in cross_split.containment(cases).collect()}
    assert set(best) == {("b", "a")} and 0.8 < best["b", "a"] < 1
    empty = cross_split.cross_split_pairs(cases.limit(0), blobs.limit(0), reports.limit(0))
    assert empty.count() == 0


@pytest.mark.parametrize("block", [256, 2])
def test_containment_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(cross_split, "BLOCK", block)
    texts = _corpus(11, 90)
    rows = [(f"r{i:03}", t, ["train", "dev", "Train ", None, "holdout"][i % 5]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "case_id string, prompt string, split string")
    got = {(r.eval_id, r.train_id): r.containment for r in cross_split.containment(df).collect()}
    side = lambda x: {"train": "train", "dev": "eval", "holdout": "eval"}.get((x or "").strip().lower())
    least = {}
    for i, t, s in rows:
        grams, words = triples(t)
        if side(s) and words >= 25:
            least.setdefault((side(s), frozenset(grams)), i)
    want = {(i, j): len(a & b) / len(a) for (s, a), i in least.items() for (x, b), j in least.items() if (s, x) == ("eval", "train") and len(a & b) >= 0.6 * len(a | b)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_containment_of_files_and_members(spark):
    words = [f"c{i}" for i in range(50)]
    code, near = " ".join(words), " ".join([*words[:20], "new", *words[21:]])
    cases = spark.createDataFrame([("a", code, "train"), ("b", "short", "dev"), ("c", None, "test"), ("d", code, None), ("e", code, "Train")], "case_id string, prompt string, split string")
    blobs = spark.createDataFrame([("1", "a", code, "impl"), ("2", "e", code, "impl"), ("3", "b", near, "impl"), ("4", "c", near, "impl"), ("5", "c", code, "test"), ("6", "d", code, "impl"), ("7", "c", None, "impl"), ("8", "c", code, "impl")], "blob_id string, case_id string, content string, role string")
    got = {(r.field, r.eval_id, r.train_id): r.containment for r in cross_split.containment(cases, blobs).collect()}
    a, b = triples(near)[0], triples(code)[0]
    assert got == {("content", "3", "1"): pytest.approx(len(a & b) / len(a)), ("content", "8", "1"): 1}
    members = sorted(map(tuple, cross_split.containment_members(cases, blobs).collect()))
    assert members == [("content", "eval", "3", "3", "b"), ("content", "eval", "3", "4", "c"), ("content", "eval", "8", "8", "c"), ("content", "train", "1", "1", "a"), ("content", "train", "1", "2", "e"), ("prompt", "train", "a", "a", "a"), ("prompt", "train", "a", "e", "e")]
    assert cross_split.containment(cases.limit(0), blobs.limit(0)).count() == 0


def test_blocks_pair_what_one_bucket_pairs(spark):
    rows = [(b, 10 * b + 1000 * k, k % 4, n) for b, n in ((1, 700), (2, 3), (3, 257)) for k in range(n)]
    df = spark.createDataFrame(rows, "bucket long, fp long, c long, rows long")
    got = {(r.u, r.v) for r in overlap._apart(df).collect()}
    want = {(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[2] != y[2] and x[1] < y[1]}
    assert got == want
