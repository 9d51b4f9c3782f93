"""Texts cut at a fixed length or in transfer.

1. Length hazards. Per source, field and unit (code points, bytes) windows over the length histogram give the
   hazard of every length (texts of that length over texts at least as long) and that of its neighbours. A Poisson
   test against the neighbours and Benjamini-Hochberg control over all lengths of a field leave significant lengths.
2. Endings. A logistic model of how texts end, fitted on a bounded sample of the corpus itself: the texts as they
   stand against the same texts cut at random places. The texts as they stand hold some cuts, which are set aside in
   rounds. Features are computed from whole texts in the workers, for fitting and for scoring alike.
   Every text is judged by a model that did not learn it.
3. A text counts as cut if the odds of its ending, times the odds that a text of its group is cut, exceed one. The
   groups are the significant lengths of a source, and all its other texts; their rates are estimated from the endings,
   beginning at the excess share of the hazard, and at ``TRANSFER_RATE`` where no length stands out.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialize

#: Texts per field on which the ending model is fitted, on average: the rows with the least hashes, whole texts.
SAMPLE = 30_000
#: Neighbouring lengths on each side, the false-discovery rate, and the share of cut texts from which estimation starts.
NEIGHBOURS, FDR, TRANSFER_RATE = 25, 1e-3, 0.02
#: Texts as many as which the starting share of a group counts, and the least share of cut texts a group is taken to have.
START_WEIGHT, LEAST_RATE = 10, 2e-3
#: Passes of a fit, and rounds of setting cut texts aside.
EPOCHS, ROUNDS = 8, 3
#: Resolution and end of the p-value scale on which false discoveries are counted.
P_STEPS, P_END = 20, 300
#: Features seen less often in the examples are not used.
LEAST_SEEN = 3
_TAIL = 600

_MARK = re.compile(r"(?:\s*(?:\[(?:truncated|cut|clipped|\.\.\.|…)[^\]\n]{0,30}\]|<truncated>|\((?:truncated|cut off)\))|…)\s*$", re.I)
_GUTTER = re.compile(r"^\s*\d+\s*[|:\t]")
_WORD = re.compile(r"\S+")
_PAIRS = {")": "(", "]": "[", "}": "{"}


def _shape(w: str, vocab: frozenset[str]) -> str:
    if w in vocab or not any(c.isalnum() for c in w):
        return w[:12]
    out = []
    for c in w:
        k = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else "字" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)[:16]


def _open(line: str) -> str:
    depth: list[str] = []
    for c in line:
        if c in "([{":
            depth.append(c)
        elif c in _PAIRS and depth and depth[-1] == _PAIRS[c]:
            depth.pop()
    return "".join(depth)[-2:]


def features(text: str, vocab: frozenset[str], prefixes: frozenset[str], context: str = "") -> list[str]:
    """Names of the features of a text's ending; ``context`` is the kind of text (a suffix, a role)."""
    mark = bool(_MARK.search(text[-60:]))
    body = _MARK.sub("", text) if mark else text
    tail = body[-_TAIL:]
    nl = len(tail) - len(tail.rstrip("\r\n"))
    tail = tail.rstrip()
    cut = tail.rfind("\n")
    line, above = tail[cut + 1 :], tail[tail.rfind("\n", 0, max(cut, 0)) + 1 : max(cut, 0)].rstrip()
    gutter = bool(_GUTTER.match(line))
    bullet = line.lstrip()[:2] in ("- ", "* ")
    code = _GUTTER.sub("", line, count=1) if gutter else line
    words = [_shape(w, vocab) for w in _WORD.findall(code[-160:])][-4:]
    last = code.split()[-1] if code.split() else ""
    kind = "g" if gutter else "b" if bullet else "p"
    end = tail[-1:] or "∅"
    endk = end if not end.isalnum() else "9" if end.isdigit() else "a" if end.islower() else "A" if end.isupper() else "字"
    seg = re.split(r"[.!?。！？]\s|\n", tail)[-1]
    ends = nl > 0
    fence = body.count("```") % 2
    depth = sum(body.count(c) for c in "([{") - sum(body.count(c) for c in ")]}")
    balance = f"{min(max(depth, -2), 3)}{'{' if body.count('{') > body.count('}') else ''}"
    indent = len(code) - len(code.lstrip())
    head = code.split()[:2]
    f = [
        f"e={endk}",
        f"en={endk}|{kind}|{ends}",
        f"ce={context}|{endk}|{ends}|{kind}",
        f"w1={kind}{words[-1:]}|{ends}",
        f"w2={kind}{words[-2:]}|{ends}",
        f"w3={kind}{words[-3:]}",
        f"w4={words[-4:]}",
        f"l1={head}|{endk}|{cut < 0}",
        f"l2={head[:1]}|{endk}|{words[-1:]}",
        f"up={above[-1:]}|{above.split()[:1] if len(above) < 60 else ''}|{endk}|{ends}",
        f"ind={min(indent, 13)}|{endk}|{ends}|{kind}",
        f"open={_open(line)}|{ends}",
        f"bal={balance}|{context}|{endk}|{ends}",
        f"bn={balance}|{context}",
        f"tick={line.replace('```', '').count('`') % 2}{line.count(chr(34)) % 2}|{ends}",
        f"sys={body.count('<system-reminder>') > body.count('</system-reminder>')}",
        f"fence={fence}",
        f"fe={fence}|{endk}|{line.startswith('```')}",
        f"nw={min(len(seg.split()), 12)}|{endk}",
        f"len={min(len(body).bit_length(), 9)}|{endk}",
    ]
    if endk in "aA9字":
        known = last in vocab
        token = re.search(r"\w+$", last)
        token = token.group() if token else ""
        # Elsewhere in the text: the last token as it stands, or only longer ones that begin with it.
        again = body.find(token, 0, max(0, len(body.rstrip()) - len(token))) if len(token) >= 3 else -1
        stands = "-" if again < 0 else "whole" if re.search(rf"(?<!\w){re.escape(token)}(?!\w)", body[: len(body.rstrip()) - len(token)]) else "part"
        f += [f"known={known}|{last in prefixes}|{kind}", f"n={min(len(last), 12)}|{known}", f"again={stands}|{known}", f"shape={_shape(last, vocab)}|{context}|{ends}"]
    if seg and len(seg) < 50:
        f.append("seg=" + re.sub(r"\d+", "9", seg))
    if mark:
        f.append("mark")
    return f


def _slots(names: list[str]) -> list[int]:
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) - (1 << 31) for n in names]


def _matrix(rows: list[list[int]], kept: np.ndarray) -> np.ndarray:
    """Places of the rows' features among the sorted slots ``kept``; others, and the filling, are at ``len(kept)``."""
    width = max((len(r) for r in rows), default=1)
    out = np.full((len(rows), width), len(kept), np.int32)
    if not rows or not len(kept):
        return out
    n = np.array([len(r) for r in rows])
    flat = np.fromiter((v for r in rows for v in r), np.int64, int(n.sum()))
    at = np.minimum(np.searchsorted(kept, flat), len(kept) - 1)
    out[np.repeat(np.arange(len(rows)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = np.where(kept[at] == flat, at, len(kept))
    return out


def _fit(x: np.ndarray, y: np.ndarray, share: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Weights of a logistic model by AdaGrad; ``share`` weighs rows, and both classes count the same in all."""
    weights, grad2 = np.zeros(size + 1), np.full(size + 1, 1e-2)
    pull = share * np.where(y == 1, 0.5 / max(share[y == 1].sum(), 1e-9), 0.5 / max(share[y == 0].sum(), 1e-9)) * len(y)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(order), 128):
            batch = order[i : i + 128]
            at = x[batch]
            z = weights[at].sum(1)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) * pull[batch]
            hit, where = np.unique(at, return_inverse=True)
            g = np.bincount(where.ravel(), weights=np.repeat(err, at.shape[1])) + 1e-2 * weights[hit]
            g[hit == size] = 0
            grad2[hit] += g * g
            weights[hit] -= 0.1 * g / np.sqrt(grad2[hit])
    return weights


def group_rate(z: np.ndarray, n: np.ndarray, start: float, rounds: int = 25) -> float:
    """The share of cut texts of a group by expectation maximisation over the log odds ``z`` of ``n`` texts each.

    The share it starts from counts as much as ``START_WEIGHT`` texts.
    """
    rate = start = min(max(start, LEAST_RATE), 0.999)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(z + math.log(rate / (1 - rate)), -40, 40)))
        rate = min(max(float((q * n).sum() + START_WEIGHT * start) / float(n.sum() + START_WEIGHT), LEAST_RATE), 0.999)
    return rate


def calibrate(seen: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and their log odds of a cut against a whole text, rising; for interpolation.

    From the histograms of the scores of observed and of cut texts, none of them learned by the model that scored it. The
    observed are whole texts and a share of cut ones: no more than their tail allows, against the tail of the cut texts.
    Observed texts beyond the score that nineteen in twenty cut texts exceed are not counted as whole.
    """
    if not len(seen) or not len(cut):
        return np.array([0.0]), np.array([-9.0])
    rate = min(float((seen > t).mean()) / float((cut > t).mean()) for t in np.quantile(cut, (0.03, 0.05, 0.1)) - 1e-9)
    edges = np.r_[-np.inf, np.arange(-11, 12), np.inf]
    o, c = np.histogram(seen[seen <= np.quantile(cut, 0.05)], edges)[0] / len(seen), np.histogram(cut, edges)[0] / len(cut)
    whole = np.maximum(o - rate * c, 0.5 / len(seen))
    blocks: list[list[float]] = []  # pooled neighbours, until the odds rise
    for a, b in zip(c + 0.5 / len(cut), whole):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a1, b1, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a1, blocks[-1][1] + b1, blocks[-1][2] + k]
    odds = np.concatenate([[math.log(a / b)] * int(k) for a, b, k in blocks])
    # Where no whole text is left to count, the odds go on rising as the model's own.
    at = np.arange(-11.5, 12)
    least = whole <= 0.5 / len(seen)
    if least[-1]:
        first = len(least) - int(np.argmin(least[::-1])) if not least.all() else 0
        odds[first:] = np.maximum(odds[first:], odds[first] + at[first:] - at[first])
    return at, odds


def fit_endings(whole: list[list[int]], cut: list[list[int]], half_of: list[int], seed: int = 7) -> tuple[np.ndarray, list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Slots, two weight vectors and the calibration of the ending model, from the features of texts as they stand and of texts cut at random.

    ``half_of`` tells the half (0 or 1) of every text, the observed ones first; weights ``k`` were fitted on the other half, and are
    for texts of half ``k``, so that no text is judged by a model that learned it. The texts as they stand hold cuts: those
    that a model of the other half finds as cut as nineteen in twenty of the random cuts are no examples of whole ones, nor
    are random cuts that fell on an ending examples of cut ones.
    """
    rng = np.random.default_rng(seed)
    slots, count = np.unique(np.fromiter((v for r in whole + cut for v in r), np.int64), return_counts=True)
    kept = slots[count >= LEAST_SEEN]
    x = _matrix(whole + cut, kept)
    y = np.r_[np.zeros(len(whole)), np.ones(len(cut))]
    half, share, seen = np.array(half_of), np.ones(len(y)), y == 0
    models = [np.zeros(len(kept) + 1)] * 2
    for k in range(ROUNDS):
        z = np.zeros(len(y))
        for h in (0, 1):
            other = half != h
            models[h] = _fit(x[other], y[other], share[other], len(kept), rng)
            z[~other] = models[h][x[~other]].sum(1)
        share[seen] = (z[seen] <= (np.quantile(z[~seen], 0.05) if len(cut) else 0.0)).astype(float)
        share[~seen] = np.where(z[~seen] < -4, 0.0, 1.0)
    return kept, models, calibrate(z[seen], z[~seen])


def _vocabulary(sample: DataFrame) -> frozenset[str]:
    """Words of the sampled texts' ends that at least one text in 400, and five texts, hold; counted in the workers."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        for batch in it:
            for t in batch.column(0).to_pylist():
                df.update({w for w in _WORD.findall((t or "")[-2000:]) if len(w) <= 16})
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], names=["w", "n"])

    n = sample.count()
    words = sample.select("t").mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= max(5, n // 400))
    return frozenset(r.w for r in words.select("w").collect())


def _examples(sample: DataFrame, vocab: frozenset[str]) -> tuple[list[list[int]], list[list[int]], list[int]]:
    """Feature slots of the sampled texts as they stand, and cut at a place drawn from their hash; and the halves of both."""
    prefixes = frozenset(w[:i] for w in vocab for i in range(1, len(w)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            whole, cut = [], []
            for t, h, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rng = np.random.default_rng(h & (1 << 63) - 1)
                whole.append(_slots(features(t, vocab, prefixes, c or "")))
                cut.append([])
                if len(t) >= 60:
                    part = t[: int(len(t) * rng.uniform(0.2, 0.98))]
                    if rng.random() < 0.15:
                        part += ("…", " [truncated]")[int(rng.integers(2))]
                    cut[-1] = _slots(features(part, vocab, prefixes, c or ""))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(whole, ints), pa.array(cut, ints)], names=["h", "whole", "cut"])

    got = sample.select("t", "h", "context").mapInArrow(run, "h long, whole array<int>, cut array<int>").orderBy("h").toArrow()
    half, cuts = [_half(h) for h in got["h"].to_pylist()], got["cut"].to_pylist()
    return got["whole"].to_pylist(), [r for r in cuts if r], half + [h for h, r in zip(half, cuts) if r]


def _half(h: int) -> int:
    """The half to which a text of hash ``h`` belongs."""
    return h >> 40 & 1


def _scored(df: DataFrame, field: str, model) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, kept, weights, scale = model.value
        prefixes = frozenset(w[:i] for w in vocab for i in range(1, len(w)))
        for batch in it:
            ids, clients, contexts, texts, hashes = (batch.column(i).to_pylist() for i in range(5))
            rows = _matrix([_slots(features(t, vocab, prefixes, c or "")) for t, c in zip(texts, contexts)], kept)
            half = np.array([_half(h) for h in hashes], bool)
            z = np.where(half, weights[1][rows].sum(1), weights[0][rows].sum(1)) if len(texts) else np.zeros(0)
            z = np.interp(z, *scale)
            cols = [
                pa.array(ids, pa.string()),
                pa.array([field] * len(ids), pa.string()),
                pa.array(clients, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                pa.array(z, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["record_id", "field", "client", "chars", "bytes", "z"])

    return df.select("id", "client", "context", "t", "h").mapInArrow(run, "record_id string, field string, client string, chars long, bytes long, z double")


def _poisson_tail(n: int, mean: float) -> float:
    """P(X >= n) of a Poisson variable."""
    if n <= 0:
        return 1.0
    if n > mean + 1 and mean > 0:
        first = -mean + n * math.log(mean) - math.lgamma(n + 1)
        ratio, term, k = 1.0, 1.0, n
        while term > 1e-12 and k < n + 10_000:
            k += 1
            term *= mean / k
            ratio += term
        return min(1.0, math.exp(max(first, -700)) * ratio)
    return 1.0


def length_hazards(texts: DataFrame, neighbours: int = NEIGHBOURS, fdr: float = FDR) -> DataFrame:
    """``(field, client, unit, length, n, at_risk, hazard, near, p, significant, excess)`` of every length that occurs.

    ``texts(field, client, chars, bytes, mark)``; equal texts of a source count once. ``near`` is the mean hazard of
    lengths within ``neighbours`` on either side, at least half a text; ``excess`` the share of texts of that
    length beyond it.
    """
    units = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")])).alias("u")
    hist = texts.select("field", "client", "mark", units).select("field", "client", "u.unit", "u.length", "mark").distinct()
    hist = hist.groupBy("field", "client", "unit", "length").agg(F.count("*").alias("n"))
    w = Window.partitionBy("field", "client", "unit").orderBy("length")
    at_risk = F.sum("n").over(w.orderBy(F.col("length").desc()).rangeBetween(Window.unboundedPreceding, 0))
    hist = hist.withColumn("at_risk", at_risk).withColumn("hazard", F.col("n") / F.col("at_risk"))
    around = w.rangeBetween(-neighbours, neighbours)
    others = F.sum("n").over(around) - F.col("n")
    exposed = F.sum("at_risk").over(around) - F.col("at_risk")
    # Lengths of the window at which no text ends are exposed too; they are counted at this length's exposure.
    empty = (2 * neighbours + 1 - F.count("*").over(around)) * F.col("at_risk")
    hist = hist.withColumn("near", (others + 0.5) / F.greatest(exposed + empty, F.lit(1)))

    @F.pandas_udf("double")
    def tail(n: pd.Series, mean: pd.Series) -> pd.Series:
        return pd.Series([_poisson_tail(int(a), float(b)) for a, b in zip(n, mean)])

    hist = hist.withColumn("p", tail("n", F.col("near") * F.col("at_risk")))
    # Benjamini-Hochberg over the steps of a fixed p-value scale, whose number does not grow with the data: the
    # largest step of which the share of lengths at or below it, times the rate, is no less than its upper end.
    step = F.least(F.floor(-F.log10(F.greatest("p", F.lit(10.0**-P_END))) * P_STEPS), F.lit(P_STEPS * P_END)).cast("int")
    hist = hist.withColumn("step", step)
    steps = hist.groupBy("field", "unit", "step").agg(F.count("*").alias("k"))
    by = Window.partitionBy("field", "unit")
    below = F.sum("k").over(by.orderBy(F.col("step").desc()))
    steps = steps.select("field", "unit", "step", (F.pow(F.lit(10.0), -F.col("step") / P_STEPS) <= fdr * below / F.sum("k").over(by)).alias("ok"))
    least = steps.where("ok").groupBy("field", "unit").agg(F.min("step").alias("least"))
    hist = hist.join(F.broadcast(least), ["field", "unit"], "left")  # a row per field and unit
    excess = 1 - F.col("near") * F.col("at_risk") / F.col("n")
    return hist.select("field", "client", "unit", "length", "n", "at_risk", "hazard", "near", "p", F.coalesce(F.col("step") >= F.col("least"), F.lit(False)).alias("significant"), excess.alias("excess"))


def _rates(rows: DataFrame, start: float) -> DataFrame:
    """``(field, client, spike, rate)``: the share of cut texts of each group, from a histogram of its log odds."""
    bins = rows.groupBy("field", "client", "spike", F.floor(F.col("z") * 4).alias("b")).agg(F.count("*").alias("n"), F.first("excess").alias("excess"))
    groups = bins.groupBy("field", "client", "spike").agg(F.collect_list(F.struct("b", "n")).alias("h"), F.first("excess").alias("excess"))

    @F.pandas_udf("double")
    def rate(h: pd.Series, excess: pd.Series) -> pd.Series:
        out = []
        for row, e in zip(h, excess):
            row = sorted((r["b"], r["n"]) for r in row)
            z, n = (np.array([r[0] for r in row], float) + 0.5) / 4, np.array([r[1] for r in row], float)
            out.append(group_rate(z, n, start if e is None or e != e else e))
        return pd.Series(out)

    return groups.select("field", "client", "spike", rate("h", "excess").alias("rate"))


def truncated(sources: list[tuple[DataFrame, str, str, str] | tuple[DataFrame, str, str, str, Column]], *, sample: int = SAMPLE, fdr: float = FDR, transfer_rate: float = TRANSFER_RATE) -> DataFrame:
    """``(record_id, field, client, chars, z, prior, cut)`` of every non-empty text of ``(table, id, text, field[, context])`` sources.

    ``context`` is a column that tells kinds of text apart (a role, a suffix). Null and empty texts are left out; a null client is a source
    of its own, named ''; repeated rows count once.
    """
    narrow, sizes = [], None
    for df, id_col, text_col, field, *kind in sources:
        context = kind[0] if kind else F.lit("")
        t = F.col(text_col).cast("string")
        one = df.where(t != "").select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col("client").cast("string"), F.lit("")).alias("client"), context.cast("string").alias("context"), t.alias("t"), F.xxhash64(F.col(id_col).cast("string"), t).alias("h"))
        narrow.append((one, field))
        t = F.col("t")
        size = one.select(F.lit(field).alias("field"), "client", F.char_length(t).cast("long").alias("chars"), F.octet_length(t).cast("long").alias("bytes"), F.xxhash64(t).alias("mark"))
        sizes = size if sizes is None else sizes.unionByName(size)
    spikes = materialize(length_hazards(sizes, fdr=fdr).where("significant and excess > 0.5").select("field", "client", "unit", "length", "excess"), "spikes")
    chars = spikes.where("unit = 'chars'").select("field", "client", F.col("length").alias("chars"), F.col("excess").alias("xc"))
    size = spikes.where("unit = 'bytes'").select("field", "client", F.col("length").alias("bytes"), F.col("excess").alias("xb"))
    parts = None
    for one, field in narrow:
        limits = spikes.where((F.col("field") == field) & (F.col("length") > 100)).select("client", "unit", "length").distinct()
        rows = one.count()
        some = one.where(F.pmod("h", F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample / max(rows, 1)))))
        for unit, measure in (("chars", F.char_length("t")), ("bytes", F.octet_length("t"))):
            some = some.withColumn("length", measure.cast("long")).join(limits.where(F.col("unit") == unit).select("client", "length"), ["client", "length"], "left_anti")
        # The sample is small and its features are not cheap: spread over all cores, however few files the table has.
        some = materialize(some.select("t", "h", "context").repartition(max(one.sparkSession.sparkContext.defaultParallelism, 2)), "sample")
        vocab = _vocabulary(some)
        scored = _scored(one, field, one.sparkSession.sparkContext.broadcast((vocab, *fit_endings(*_examples(some, vocab)))))
        parts = scored if parts is None else parts.unionByName(scored)
    rows = parts.distinct().join(chars, ["field", "client", "chars"], "left").join(size, ["field", "client", "bytes"], "left")
    by_bytes = F.coalesce("xb", F.lit(0.0)) > F.coalesce("xc", F.lit(0.0))
    spike = F.when(by_bytes, F.concat(F.lit("bytes "), F.col("bytes"))).when(F.col("xc").isNotNull(), F.concat(F.lit("chars "), F.col("chars"))).otherwise("")
    rows = materialize(rows.select("record_id", "field", "client", "chars", "z", spike.alias("spike"), F.greatest("xc", "xb").alias("excess")), "endings")
    rows = rows.join(_rates(rows, transfer_rate), ["field", "client", "spike"]).withColumnRenamed("rate", "prior")
    odds = F.col("z") + F.log(F.col("prior") / (1 - F.col("prior")))
    return rows.withColumn("cut", odds > 0).select("record_id", "field", "client", "chars", "z", "prior", "cut")


def truncation_rates(scored: DataFrame) -> DataFrame:
    """Texts, cut texts and their share per client and field."""
    return scored.groupBy("client", "field").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut"), (F.count_if("cut") / F.count("*")).alias("rate"))
