"""DartMinHash signatures of weighted sets, vectorised over a batch of sets.

Every element owns a half-line of unit cells in rank and, for weights above one, in weight. Hashing decides
how many darts (Poisson, mean one) fall into a cell and where. A dart counts if it lands under the
element's weight. Each dart is hashed to one of ``k`` coordinates; a coordinate keeps its dart of least
rank. Two sets agree in a coordinate with probability equal to their weighted Jaccard similarity. Only
darts of rank below ``t / total weight`` are thrown, about ``t = k (ln k + 3)`` for each set whatever its
size; a set left with an empty coordinate is thrown again with the limit doubled, which cannot change
the coordinates already filled.
"""

from __future__ import annotations

import math

import numpy as np

from millrace.llm.shingles import mix

_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
_U = np.uint64


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> _U(11)).astype(np.float64) / float(1 << 53)


def _throw(elements: np.ndarray, owner: np.ndarray, weight: np.ndarray, limit: np.ndarray, k: int, sets: int) -> np.ndarray:
    """Signatures (sets x k), zero where a coordinate stayed empty. ``limit`` is the rank limit by set."""
    tall, wide = np.ceil(limit[owner]).astype(np.int64), np.ceil(weight).astype(np.int64)
    cells = tall * wide
    at = np.repeat(np.arange(len(elements)), cells)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
    rank0, weight0 = nth % tall[at], nth // tall[at]
    with np.errstate(over="ignore"):
        cell = mix(elements[at] + rank0.astype(_U) * _U(0x9E3779B97F4A7C15) + weight0.astype(_U) * _U(0xC2B2AE3D27D4EB4F))
        darts = np.searchsorted(_POISSON, _unit(cell))
        pick = np.repeat(np.arange(len(cell)), darts)
        order = np.arange(len(pick)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(cell[pick] + (order.astype(_U) + _U(1)) * _U(0xD6E8FEB86659FD93))
        rank = rank0[pick] + _unit(mix(dart ^ _U(0x5851F42D4C957F2D)))
        place = weight0[pick] + _unit(mix(dart ^ _U(0x14057B7EF767814F)))
    source = at[pick]
    keep = (rank < limit[owner[source]]) & (place < weight[source])
    dart, rank, row = dart[keep], rank[keep], owner[source[keep]]
    slot = row * k + (mix(dart ^ _U(0x2545F4914F6CDD1D)) % _U(k)).astype(np.int64)
    best = np.lexsort((rank, slot))
    slot, dart = slot[best], dart[best]
    first = np.r_[True, slot[1:] != slot[:-1]] if len(slot) else np.zeros(0, bool)
    out = np.zeros(sets * k, _U)
    out[slot[first]] = dart[first] | _U(1)
    return out.reshape(sets, k)


def signatures(elements: np.ndarray, sizes: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """``elements`` of all sets one after the other, ``sizes`` elements each; returns (sets, k) of uint64.

    An empty set, or one of zero weight, has a row of zeros.
    """
    sets = len(sizes)
    owner = np.repeat(np.arange(sets), sizes)
    weight = np.ones(len(elements)) if weights is None else np.asarray(weights, float)
    total = np.bincount(owner, weights=weight, minlength=sets) if sets else np.zeros(0)
    out = np.zeros((sets, k), _U)
    todo, t = np.flatnonzero(total > 0), k * (math.log(k) + 3)
    while len(todo):
        mine = np.isin(owner, todo)
        place = np.zeros(sets, np.int64)
        place[todo] = np.arange(len(todo))
        out[todo] = _throw(elements[mine], place[owner[mine]], weight[mine], t / total[todo], k, len(todo))
        todo, t = todo[(out[todo] == 0).any(axis=1)], 2 * t
    return out


def bands(signature: np.ndarray, rows: int, salt: int = 0) -> np.ndarray:
    """(sets, k) signatures to (sets, k // rows) signed band hashes."""
    sets, k = signature.shape
    n = k // rows
    part = signature[:, : n * rows].reshape(sets, n, rows)
    h = np.broadcast_to(mix(np.arange(1, n + 1, dtype=_U) + _U(salt % (1 << 63))), (sets, n)).copy()
    with np.errstate(over="ignore"):
        for r in range(rows):
            h = mix(h * _U(0xD6E8FEB86659FD93) + part[:, :, r])
    return h.view(np.int64)
