"""Reading level by harmonic propagation over the document-word graph."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import shingles
from millrace.session import materialize

BANDS = ("basic", "intermediate", "advanced")
#: Word nodes. Words are hashed to this many nodes, so a round sends a vector of fixed length whatever the vocabulary.
NODES = 1 << 15
#: Iteration ends when no word's score (0 to 2) moves further than this, after so many rounds at most.
SETTLED, ROUNDS = 0.003, 30
MIN_WORDS = 80
#: Graded examples read to the driver at most.
MAX_SAMPLES = 100_000
#: Weight of the overall mean in every word's score; keeps words seen once or twice from echoing their own document.
PRIOR = 5.0

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and a to in is it that for with as was on are be this have not but which at from by or an so its will can if when then no you we after before without either what all each",
    "de": "der die das und nicht ist ein eine zu von mit sich des auf dem den im dass weil bitte nur alle werden wird oder auch bis bevor nach aus bei als wenn wir",
    "es": "el la los las de que y en un una por con para del se no al lo como más pero sus le ya o este porque cuando sin sobre hasta según",
    "fr": "le la les de des et un une est que qui dans pour pas sur avec ce il elle nous vous sont aux du ne se",
    "pt": "o a os as de que e do da em um uma para com não por dos das se na no mais ao",
    "it": "il lo la gli le di che e un una per con non del della in sono si da nel alla",
    "nl": "de het een en van ik niet in op te dat die is voor met zijn aan er om ook als bij",
}

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)", re.M | re.S)
_LINES = re.compile(r"^(?:[ \t]{0,3}#{1,6}(?:[ \t][^\n]*)?|[ \t]*\|[^\n]*|(?: {4}|\t)[^\n]*|[^\n]+\n[ \t]*(?:={3,}|-{3,})[ \t]*)$", re.M)
_LINK = re.compile(r"!?\[[^\]\n]*\]\([^)\n]*\)|<?\b(?:https?|ftp)://\S+|\bwww\.\S+")


def prose(text: str) -> str:
    """The text without fenced or indented code, tables, headings and links."""
    return _LINK.sub(" ", _LINES.sub("", _FENCE.sub("\n", text.replace("\r\n", "\n"))))


def _hashes(words: str) -> np.ndarray:
    return np.array([h for _, hs, _ in shingles.words(pa.array(words.split())) for h in hs], np.uint64)


_LANGS: list[np.ndarray] = []


def _languages() -> list[np.ndarray]:
    if not _LANGS:
        _LANGS.extend(np.sort(_hashes(re.sub(r"[^\x00-\x7f]\S*|\S*[^\x00-\x7f]\S*", "", w))) for w in FUNCTION_WORDS.values())
    return _LANGS


def _nodes(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (row, words, function-word shares by language, distinct word nodes) of prose texts."""
    langs = _languages()
    for first, hashes, owner in shingles.words(pa.array(texts, pa.string())):
        if not len(owner):
            continue
        n = int(owner[-1]) + 1
        count = np.bincount(owner, minlength=n)
        shares = np.stack([np.bincount(owner, weights=np.isin(hashes, l), minlength=n) / np.maximum(count, 1) for l in langs], 1)
        node = (hashes >> np.uint64(20)) % np.uint64(NODES)
        key = np.unique(owner.astype(np.int64) * NODES + node.astype(np.int64))
        row = key // NODES
        cut = np.searchsorted(row, np.arange(n + 1))
        for i in range(n):
            if count[i]:
                yield first + i, int(count[i]), shares[i], (key[cut[i] : cut[i + 1]] % NODES).astype(np.int32)


_NON_LATIN = re.compile("[Ͱ-\U0010ffff]+")


def _is_english(text: str, shares: np.ndarray) -> bool:
    if shares[0] < 0.03 or shares[0] <= 1.5 * shares[1:].max():
        return False
    return sum(map(len, _NON_LATIN.findall(text))) < 0.2 * len(text)


def english_prose(df: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """``(id_col, words, nodes)`` of the texts that are English prose of at least ``min_words`` words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [prose(t) if t else "" for t in batch.column(1).to_pylist()]
            at, words, nodes = [], [], []
            for row, n, shares, own in _nodes(texts):
                if n >= min_words and _is_english(texts[row], shares):
                    at.append(row)
                    words.append(n)
                    nodes.append(own)
            off = np.r_[0, np.cumsum([len(x) for x in nodes])]
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(nodes) if nodes else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(words, pa.int32()), lists], names=[id_col, "words", "nodes"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, words int, nodes array<int>")


def _scores(batch: pa.RecordBatch, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column(batch.num_columns - 1)
    flat, off = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    off = off - off[0]
    size = np.diff(off)
    own = np.add.reduceat(np.r_[score[flat], 0.0], off[:-1]) / np.maximum(size, 1) if len(size) else np.zeros(0)
    return own, flat, size


def reading_levels(documents: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, min_words: int = MIN_WORDS) -> DataFrame:
    """``(id_col, level, band)``: continuous difficulty from 0 to 2 and its band.

    Documents and graded samples are joined to the words they hold. Samples keep their grade; in every round each
    document takes the mean of its words and each word the mean of its documents and samples, a distributed harmonic
    iteration whose only traffic is a vector of ``NODES`` numbers. Bands are cut halfway between the mean levels that
    the samples' own words give. Null, empty, short and non-English texts have no row; repeated rows of an id repeat.
    """
    graded = [(t, BANDS.index(b)) for t, b in samples.select("text", "band").where(F.col("band").isin(*BANDS)).limit(MAX_SAMPLES + 1).collect() if t]
    if len(graded) > MAX_SAMPLES:
        raise ValueError("too many graded samples for one driver")
    grade, owned = [], []
    for row, _, _, own in _nodes([prose(t) for t, _ in graded]):
        grade.append(float(graded[row][1]))
        owned.append(own)
    docs = materialize(english_prose(documents, id_col, text_col, min_words), "levels")
    if not owned:
        return docs.select(id_col, F.lit(None).cast("double").alias("level"), F.lit(None).cast("string").alias("band")).limit(0)
    grades = np.array(grade)
    flat, size = np.concatenate(owned), np.array([len(x) for x in owned])
    base_n = np.bincount(flat, minlength=NODES).astype(float)
    base_s = np.bincount(flat, weights=np.repeat(grades, size), minlength=NODES)
    mean = float(grades.mean())
    score = (base_s + PRIOR * mean) / (base_n + PRIOR)
    sc = docs.sparkSession.sparkContext

    for _ in range(rounds):
        before = score
        now = sc.broadcast(score)

        def partial(it):
            n, s = np.zeros(NODES), np.zeros(NODES)
            for batch in it:
                own, words, sizes = _scores(batch, now.value)
                n += np.bincount(words, minlength=NODES)
                s += np.bincount(words, weights=np.repeat(own, sizes), minlength=NODES)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(s[at])], names=["node", "n", "s"])

        got = docs.select("nodes").mapInArrow(partial, "node int, n double, s double").groupBy("node").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toPandas()
        n, s = base_n.copy(), base_s.copy()
        n[got["node"].to_numpy()] += got["n"].to_numpy()
        s[got["node"].to_numpy()] += got["s"].to_numpy()
        # A document's mean lies nearer the middle than its grade does; documents count by the samples' spread.
        score = (s + PRIOR * mean) / (n + PRIOR)
        level = np.array([score[x].mean() for x in owned])
        spread, centre = np.polyfit(level, grades, 1) if np.ptp(level) > 1e-9 else (1.0, 0.0)
        score = score * spread + centre
        now.unpersist()
        # The words that documents hold have settled: no level can move further than its words do.
        if float(np.abs(score - before)[n > 0].max(initial=0.0)) < SETTLED:
            break
    level = np.array([score[x].mean() for x in owned])
    centres = [float(level[grades == b].mean()) if (grades == b).any() else float(b) for b in range(3)]
    cuts = [(centres[0] + centres[1]) / 2, (centres[1] + centres[2]) / 2]
    last = sc.broadcast(score)

    def final(it):
        for batch in it:
            own, _, _ = _scores(batch, last.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own)], names=[id_col, "level"])

    kind = documents.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, "nodes").mapInArrow(final, f"`{id_col}` {kind}, level double")
    return out.withColumn("band", F.when(F.col("level") < cuts[0], BANDS[0]).when(F.col("level") < cuts[1], BANDS[1]).otherwise(BANDS[2]))
