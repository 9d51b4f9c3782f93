"""Byte-level BPE encoding of whole columns.

Pre-tokens are found without a regular expression: code points become class symbols by table lookup, every
symbol is a transition function over a few states, and a blocked associative scan (functions of blocks are
composed, then each block runs from its entry state) gives the state before every code point of a whole
batch at once. The slices go through a cache of merged pre-tokens.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Merged pre-tokens kept per worker; a full cache is emptied, results do not depend on it.
CACHE = 400_000
#: Code points scanned at once.
_CHUNK = 1 << 19
_BLOCK = 256

_LETTER, _NUMBER, _OTHER, _SPACE = 0, 1, 2, 3
# The white space of the pre-token rule.
_WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# States before a code point, and symbols.
START, IN_L, IN_N, IN_O, IN_S, GLUED, C1, C2 = range(8)
SYM_L, SYM_N, SYM_O, SYM_Q1, SYM_Q2, SYM_W, SYM_LASTW, SYM_GLUE = range(8)


@lru_cache(1)
def _classes() -> np.ndarray:
    kind = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kind[c] = _LETTER
        elif k == "N":
            kind[c] = _NUMBER
    kind[_WHITE] = _SPACE
    return kind


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """``step[symbol, state]`` and ``begins[symbol, state]``; symbols from 8 on are at the start of a text."""
    step, begins = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    for sym, run in ((SYM_L, IN_L), (SYM_N, IN_N), (SYM_O, IN_O)):
        step[sym] = run
        begins[sym, [run, GLUED]] = False
    step[SYM_L, C2], step[SYM_L, C1] = C1, START
    begins[SYM_L, [C1, C2]] = False
    for sym, rest in ((SYM_Q1, C1), (SYM_Q2, C2)):
        step[sym] = rest
        step[sym, [IN_O, GLUED]] = IN_O
        begins[sym, [IN_O, GLUED]] = False
    step[SYM_W] = IN_S
    begins[SYM_W, IN_S] = False
    step[SYM_LASTW], step[SYM_GLUE] = START, GLUED
    step[8:] = step[:8, START][:, None]
    return step, begins


_STEP, _BEGINS = _transitions()


def scan(symbols: np.ndarray) -> np.ndarray:
    """The state before every symbol, from START, by composing transition functions block by block."""
    n = len(symbols)
    blocks = -(-n // _BLOCK)
    padded = np.zeros(blocks * _BLOCK, np.uint8)
    padded[:n] = symbols
    grid = np.ascontiguousarray(padded.reshape(blocks, _BLOCK).T)
    fn = np.broadcast_to(np.arange(8, dtype=np.uint8), (blocks, 8)).copy()
    flat = _STEP.reshape(-1)
    for t in range(_BLOCK):
        fn = flat[grid[t][:, None].astype(np.int64) * 8 + fn]
    entry = np.empty(blocks, np.uint8)
    state = START
    for b, f in enumerate(fn.tolist()):
        entry[b] = state
        state = f[state]
    out = np.empty((_BLOCK, blocks), np.uint8)
    state_now = entry
    for t in range(_BLOCK):
        out[t] = state_now
        state_now = flat[grid[t].astype(np.int64) * 8 + state_now]
    return out.T.reshape(-1)[:n]


def boundaries(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """First code point of every pre-token of texts laid end to end; ``starts`` are the texts' first places."""
    kind = _classes()[points]
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[starts] = True
    first[n] = True
    follows = np.r_[kind[1:], _SPACE]
    ends_text = first[1:]
    sym = kind.copy()  # letters, numbers and others keep their class number
    white = kind == _SPACE
    last = white & (follows != _SPACE) & ~ends_text
    sym[white] = SYM_W
    sym[last] = SYM_LASTW
    sym[last & (points == 0x20)] = SYM_GLUE
    at = np.flatnonzero((points == 0x27) & ~ends_text)
    if len(at):
        one = points[at + 1]
        inside = (at + 2 < n) & ~first[np.minimum(at + 2, n)]
        two = np.where(inside, points[np.minimum(at + 2, n - 1)], 0)
        q1 = np.isin(one, [ord(c) for c in "sdmt"])
        q2 = ((one == ord("l")) & (two == ord("l"))) | (((one == ord("v")) | (one == ord("r"))) & (two == ord("e")))
        sym[at[q1]] = SYM_Q1
        sym[at[q2]] = SYM_Q2
    sym[starts] += 8
    return np.flatnonzero(_BEGINS[sym, scan(sym)])


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its id on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token: the lowest-ranked neighbouring pair, leftmost first, is merged until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    n = len(piece)
    if n > 200:
        return _merge_long(piece, ranks)
    part = [piece[i : i + 1] for i in range(n)]
    pair = [ranks.get(part[i] + part[i + 1], 1 << 30) for i in range(n - 1)]
    while pair and (low := min(pair)) < 1 << 30:
        i = pair.index(low)
        part[i : i + 2] = [part[i] + part[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(part[i] + part[i + 1], 1 << 30)
        if i:
            pair[i - 1] = ranks.get(part[i - 1] + part[i], 1 << 30)
    return tuple(ranks[p] for p in part)


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same by a heap over a linked list, for very long runs."""
    import heapq

    n = len(piece)
    end, left, right = [i + 1 for i in range(n)], [i - 1 for i in range(n)], [i + 1 for i in range(n)]
    alive = bytearray(b"\1" * n)

    def rank(i: int) -> int | None:
        j = right[i]
        return None if j >= n else ranks.get(piece[i : end[j]])

    heap = [(r, i, end[i + 1]) for i in range(n - 1) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        if not alive[i] or right[i] >= n or end[right[i]] != to or (rank(i) != _):
            continue
        j = right[i]
        alive[j] = 0
        end[i], right[i] = end[j], right[j]
        if right[i] < n:
            left[right[i]] = i
        for k in (i, left[i]):
            if k >= 0 and (r := rank(k)) is not None:
                heapq.heappush(heap, (r, k, end[right[k]]))
    return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])


class Encoder:
    """Encodes lists of texts with one vocabulary."""

    def __init__(self, data: bytes):
        self.ranks = load_ranks(data)
        self.cache: dict[str, tuple[int, ...]] = {}

    def _ids(self, piece: str) -> tuple[int, ...]:
        if len(self.cache) >= CACHE:
            self.cache.clear()
        ids = self.cache[piece] = merge(piece.encode("utf-8", "surrogatepass"), self.ranks)
        return ids

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        text = "".join(texts)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.cumsum(size) - size
        cut = boundaries(points, at[size > 0])
        ends = np.r_[cut[1:], len(points)]
        get, make = self.cache.get, self._ids
        pieces = [text[a:b] for a, b in zip(cut.tolist(), ends.tolist())]
        found = [get(p) or make(p) for p in pieces]
        width = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(width.sum()))
        of_text = np.searchsorted(cut, at, side="left")
        run = np.r_[0, np.cumsum(width)]
        return ids, run[np.r_[of_text, len(cut)]], cut, run

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and their offsets; null and empty texts have none."""
        parts, offsets, base = [], [np.zeros(1, np.int64)], 0
        group: list[str] = []
        size = 0
        for i, t in enumerate(texts):
            group.append(t or "")
            size += len(group[-1])
            if size >= _CHUNK or i == len(texts) - 1:
                if size:
                    ids, off, *_ = self._chunk(group)
                else:
                    ids, off = np.zeros(0, np.int32), np.zeros(len(group) + 1, np.int64)
                parts.append(ids)
                offsets.append(off[1:] + base)
                base += len(ids)
                group, size = [], 0
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), np.concatenate(offsets)

    def widths(self) -> np.ndarray:
        """Bytes of every token by its id."""
        out = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for token, rank in self.ranks.items():
            out[rank] = len(token)
        return out

    def decode(self, ids: list[int]) -> str:
        back = self.__dict__.setdefault("back", {v: k for k, v in self.ranks.items()})
        return b"".join(back[i] for i in ids).decode("utf-8", "surrogatepass")


_ENCODERS: dict[int, Encoder] = {}


def _encoder(data: bytes) -> Encoder:
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(data)
    return _ENCODERS[key]


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file (under 2 MB) as a broadcast."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 16 << 20:
        raise ValueError("a vocabulary file of more than 16 MB is not broadcast")
    return spark.sparkContext.broadcast(data)


def encode_ids(df: DataFrame, id_col: str, text_col: str, path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``(id_col, ids)``: token ids of every text, without special tokens.

    Null and empty texts give an empty list; blank texts are encoded as they stand; repeated rows give
    repeated rows; no shuffle is needed. Other columns are dropped.
    """
    data = vocabulary(df.sparkSession, path)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(data.value)
        for batch in it:
            ids, offsets = enc.encode(batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, df[text_col].cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def encode_offsets(df: DataFrame, id_col: str, text_col: str, path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``(id_col, ids, starts)``: token ids of every text, and the byte of its UTF-8 form at which each begins.

    A token ends where the next begins, the last at the text's end, so any slice can be decoded by itself. Null and empty texts
    give empty lists.
    """
    data = vocabulary(df.sparkSession, path)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(data.value)
        width = enc.widths()
        for batch in it:
            ids, offsets = enc.encode(batch.column(1).to_pylist())
            ids, offsets = np.asarray(ids, np.int64), np.asarray(offsets)
            ends = np.r_[0, np.cumsum(width[ids])]
            starts = ends[:-1] - np.repeat(ends[offsets[:-1]], np.diff(offsets))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (ids, starts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=[id_col, "ids", "starts"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, df[text_col].cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, starts array<int>")


def token_counts(df: DataFrame, id_col: str, text_col: str, path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``(id_col, tokens)``: the number of ids of every text; the lists never leave the worker."""
    data = vocabulary(df.sparkSession, path)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(data.value)
        for batch in it:
            _, offsets = enc.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets))], names=[id_col, "tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, df[text_col].cast("string")).mapInArrow(run, f"`{id_col}` {kind}, tokens long")
