"""Word n-gram hashing over Arrow string columns, without a Python string per row.

Words are maximal runs of ``[a-z0-9_]`` in the lower-cased text. Everything works on the UTF-8 buffer of
an Arrow array: a class table marks word bytes, ``reduceat`` folds each word into a 64-bit hash, and n
neighbouring word hashes of one text are mixed into an n-gram hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), ord("_")]] = True
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Bytes hashed at once; bounds the working arrays whatever the batch size.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _P, dtype=np.uint64))


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, word hashes, row of each word counted from the first row); nulls have none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.utf8_lower(pc.fill_null(column, "")).cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    for i, j in _chunks(offsets):
        lo, hi = offsets[i], offsets[j]
        raw = data[lo:hi]
        if not len(raw):
            yield i, np.zeros(0, np.uint64), np.zeros(0, np.int64)
            continue
        at = offsets[i : j + 1] - lo
        word = _WORD[raw]
        first = word.copy()
        first[1:] &= ~word[:-1]
        cuts = at[:-1][at[:-1] < len(raw)]
        first[cuts] = word[cuts]
        starts = np.flatnonzero(first)
        if not len(starts):
            yield i, np.zeros(0, np.uint64), np.zeros(0, np.int64)
            continue
        place = np.flatnonzero(word)
        owner = np.cumsum(first)[place] - 1
        depth = place - starts[owner]
        power = _powers(int(depth.max()) + 1)
        with np.errstate(over="ignore"):
            terms = (raw[place].astype(np.uint64) + np.uint64(1)) * power[depth]
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            hashes = mix(np.add.reduceat(terms, heads))
        yield i, hashes, np.searchsorted(at, starts, side="right") - 1


def ngrams(column: pa.Array | pa.ChunkedArray, n: int = 3) -> Iterator[tuple[int, int, np.ndarray]]:
    """Yields (row, number of words, sorted distinct n-gram hashes) of every row in order."""
    rows = len(column)
    done = 0
    for i, hashes, owner in words(column):
        count = np.bincount(owner, minlength=1) if len(owner) else np.zeros(1, np.int64)
        if len(hashes) >= n:
            with np.errstate(over="ignore"):
                grams = hashes[: len(hashes) - n + 1].copy()
                for k in range(1, n):
                    grams = mix(grams * np.uint64(0xD6E8FEB86659FD93) + hashes[k : len(hashes) - n + 1 + k])
            same = owner[: len(owner) - n + 1] == owner[n - 1 :]
            grams, where = grams[same], owner[: len(owner) - n + 1][same]
        else:
            grams, where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        bounds = np.searchsorted(where, np.arange(len(count) + 1))
        for k in range(len(count)):
            while done < i + k:
                yield done, 0, np.zeros(0, np.uint64)
                done += 1
            yield i + k, int(count[k]), np.unique(grams[bounds[k] : bounds[k + 1]])
            done = i + k + 1
    while done < rows:
        yield done, 0, np.zeros(0, np.uint64)
        done += 1


def set_fingerprint(grams: np.ndarray) -> int:
    """An order-free 64-bit fingerprint of a set of n-gram hashes, as a signed integer."""
    with np.errstate(over="ignore"):
        a = mix(grams).sum(dtype=np.uint64)
        b = (mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * np.uint64(3)).sum(dtype=np.uint64)
        return int(mix(np.array([a * np.uint64(0x9FB21C651E98DF25) + b + np.uint64(len(grams))]))[0].view(np.int64))
