"""Conditional random fields over hashed features: fitting, Viterbi spans and skip-chain message passing."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np

DIM = 1 << 15


def slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % DIM


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class ChainCRF:
    """A linear chain over BIO labels. ``W[feature, label]`` scores tokens, ``A[from, to]`` neighbours."""

    def __init__(self, types: Sequence[str]):
        self.labels = ["O"] + [f"{p}-{t}" for t in types for p in "BI"]
        n = len(self.labels)
        self.W = np.zeros((DIM, n))
        self.A = np.zeros((n, n))
        self.allowed = np.zeros((n, n))
        for j, to in enumerate(self.labels):
            if to[0] == "I":
                for i, frm in enumerate(self.labels):
                    if frm[2:] != to[2:]:
                        self.allowed[i, j] = -1e4
        self.skip = 1.0
        self.start = np.array([-1e4 if x[0] == "I" else 0.0 for x in self.labels])

    def emissions(self, feats: Sequence[Sequence[int]]) -> np.ndarray:
        n = np.array([len(f) for f in feats])
        flat = np.concatenate([np.asarray(f) for f in feats])
        e = np.add.reduceat(self.W[flat], np.r_[0, np.cumsum(n)[:-1]], axis=0)
        e[0] += self.start
        return e

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Log beliefs of every token, forward scores and the log partition function."""
        a = self.A + self.allowed
        t = len(e)
        f, b = np.empty_like(e), np.zeros_like(e)
        f[0] = e[0]
        for i in range(1, t):
            f[i] = e[i] + _lse(f[i - 1][:, None] + a, 0)
        for i in range(t - 2, -1, -1):
            b[i] = _lse(a + (e[i + 1] + b[i + 1])[None, :], 1)
        z = float(_lse(f[-1], 0))
        return f + b - z, f, z

    def viterbi(self, e: np.ndarray) -> list[int]:
        a = self.A + self.allowed
        t = len(e)
        back = np.zeros(e.shape, int)
        score = e[0]
        for i in range(1, t):
            m = score[:, None] + a
            back[i] = m.argmax(0)
            score = m.max(0) + e[i]
        y = [int(score.argmax())]
        for i in range(t - 1, 0, -1):
            y.append(int(back[i][y[-1]]))
        return y[::-1]

    def fit(self, data: list[tuple[list[list[int]], list[int]]], epochs: int = 4, rate: float = 0.4, l2: float = 1e-5, seed: int = 3) -> ChainCRF:
        """Maximises the conditional likelihood by AdaGrad, one sequence at a time."""
        rng = np.random.default_rng(seed)
        gw, ga = np.full(self.W.shape, 1e-2), np.full(self.A.shape, 1e-2)
        order = np.arange(len(data))
        for _ in range(epochs):
            rng.shuffle(order)
            for k in order:
                feats, y = data[k]
                e = self.emissions(feats)
                log_p, f, z = self.marginals(e)
                d = np.exp(log_p)
                d[np.arange(len(y)), y] -= 1
                flat = np.concatenate([np.asarray(x) for x in feats])
                rows = np.repeat(d, [len(x) for x in feats], axis=0)
                hit, where = np.unique(flat, return_inverse=True)
                g = np.zeros((len(hit), d.shape[1]))
                np.add.at(g, where, rows)
                g += l2 * self.W[hit]
                gw[hit] += g * g
                self.W[hit] -= rate * g / np.sqrt(gw[hit])
                if len(y) > 1:
                    b = log_p + z - f
                    pair = f[:-1, :, None] + (self.A + self.allowed)[None] + (e[1:] + b[1:])[:, None, :] - z
                    g = np.exp(pair).sum(0)
                    np.add.at(g, (y[:-1], y[1:]), -1)
                    ga += g * g
                    self.A -= rate * g / np.sqrt(ga)
        return self

    def spans(self, y: Sequence[int]) -> list[tuple[int, int, str]]:
        """``(first, end, type)`` of the labelled spans."""
        out: list[tuple[int, int, str]] = []
        for i, k in enumerate(y):
            name = self.labels[k]
            if name[0] == "B":
                out.append((i, i + 1, name[2:]))
            elif name[0] == "I" and out and out[-1][1] == i:
                out[-1] = (out[-1][0], i + 1, out[-1][2])
        return out

    def skip_decode(self, chains: list[np.ndarray], edges: list[tuple[tuple[int, int], tuple[int, int]]], strength: float, rounds: int = 3) -> list[list[int]]:
        """Viterbi labels of several chains whose tokens are tied by skip edges, by loopy message passing.

        ``edges`` join (chain, token) places. The factor of an edge rewards equal entity types by ``strength``; its
        messages pass beliefs of one end, less what came from the other, for a fixed number of rounds.
        """
        kinds = np.array([x[2:] or "O" for x in self.labels])
        factor = np.where((kinds[:, None] == kinds[None, :]) & (kinds != "O")[None, :], strength, 0.0)
        n = len(self.labels)
        into: dict[tuple[int, int], np.ndarray] = {}
        sent = {(k, s): np.zeros(n) for k in range(len(edges)) for s in (0, 1)}
        for _ in range(rounds):
            belief = []
            for c, e in enumerate(chains):
                e = e.copy()
                for (cc, t), m in into.items():
                    if cc == c:
                        e[t] += m
                belief.append(self.marginals(e)[0])
            new = {}
            for k, ends in enumerate(edges):
                for s in (0, 1):
                    c, t = ends[s]
                    m = _lse((belief[c][t] - sent[k, 1 - s])[:, None] + factor, 0)
                    new[k, s] = m - m.max()
            sent = new
            into = {}
            for k, ends in enumerate(edges):
                for s in (0, 1):
                    at = ends[1 - s]
                    into[at] = into.get(at, np.zeros(n)) + sent[k, s]
        out = []
        for c, e in enumerate(chains):
            e = e.copy()
            for (cc, t), m in into.items():
                if cc == c:
                    e[t] += m
            out.append(self.viterbi(e))
        return out
