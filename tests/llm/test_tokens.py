import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import packing, tokenize

JSON = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def both():
    ref = Tokenizer.from_file(JSON)
    ref.encode_special_tokens = True
    with open(tokenize.DEFAULT_TOKENIZER, "rb") as f:
        return tokenize.Encoder(f.read()), ref


def check(both, texts):
    enc, ref = both
    ids, off = enc.encode(texts)
    want = [r.ids for r in ref.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = [ids[off[i] : off[i + 1]].tolist() for i in range(len(texts))]
    assert got == want
    assert [enc.decode(g) for g in got] == [t or "" for t in texts]


def test_fixed_texts(both):
    check(both, ["it's I'll  'store\t\n x'", None, "", " ", "  a", "\n\n b", "'s's", "a'LL 'll", "x<|endoftext|>y", "a" * 3000 + "ß" * 500 + " " * 400, "don’t 12ab ١٢ ²½　x\u200bz\x1c \xa0q", "🙂" * 300 + " '", "'", "\"'s\"", "\ufeffx", "e\u0301"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab's'tlvre \n\t09²ßé中🙂.,!-_\xa0\u2003\x0b")), max_size=60), min_size=1, max_size=6))
def test_random_texts(both, texts):
    check(both, texts)


def test_column(spark, both):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "hello world", "x")], "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids) for r in tokenize.encode_ids(df, "doc_id", "text").collect()]
    hello = both[1].encode("hello world", add_special_tokens=False).ids
    assert sorted(got) == sorted([(1, hello), (1, hello), (2, []), (3, [])])
    assert tokenize.encode_ids(df.limit(0), "doc_id", "text").count() == 0
    assert sorted(r.tokens for r in tokenize.token_counts(df, "doc_id", "text").collect()) == [0, 0, 2, 2]


def test_vocabulary_is_not_in_the_repository():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert not [f for _, _, fs in os.walk(root) for f in fs if f.endswith(".tiktoken")]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=200))
def test_best_fit_never_overfills(sizes):
    import numpy as np

    counts = np.bincount(sizes, minlength=31) if sizes else np.zeros(31, int)
    ranges, used = packing.best_fit(counts, 30)
    load, seen = {}, {}
    for size, rank, container, n in ranges:
        for k in range(max(n, 0)):
            load[container + k] = load.get(container + k, 0) + size
            assert (size, rank + k) not in seen
            seen[size, rank + k] = True
    assert max(load.values(), default=0) <= 30 and len(seen) == sum(1 for s in sizes if s)
    total = sum(sizes)
    assert used <= max(1.3 * total / 30 + 2, bool(sizes))


def test_pack_table(spark):
    rows = [(i, s) for i, s in enumerate([5, 5, 5, 5, 25, 7, 3, 0, None, 10, 10])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, n long, container string")
    out = packing.pack(df, "doc_id", "n", 10).collect()
    by = {}
    for r in out:
        by.setdefault(r.container, []).append(r.tokens)
    assert all(sum(v) <= 10 for v in by.values()) and len(by) == 8
    pieces = {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r.tokens)
    assert sorted(pieces[4]) == [5, 10, 10] and all(len(v) == 1 for k, v in pieces.items() if k != 4) and pieces[8] == [0]
    report = packing.fill_report(packing.pack(df, "doc_id", "n", 10), 10).first()
    assert (report.containers, report.tokens, report.least_containers) == (8, 75, 8)
    assert packing.pack(df.limit(0), "doc_id", "n", 10).count() == 0


def test_offsets_decode_every_slice(spark):
    from millrace.llm.tokenize import encode_offsets

    texts = [None, "", "Hello  world\n\tx = 1", "naïve 漢字 🙂 café", " " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in encode_offsets(df, "doc_id", "text").collect()}
    ids = {r.doc_id: r.ids for r in tokenize.encode_ids(df, "doc_id", "text").collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert got[i].ids == ids[i] and len(got[i].starts) == len(ids[i])
        pieces = [raw[a:b] for a, b in zip(got[i].starts, [*got[i].starts[1:], len(raw)])]
        assert b"".join(pieces) == raw and all(pieces)
