"""Hashed n-gram features and logistic models in numpy.

Features are computed for many texts at once: n-grams of bytes by a rolling polynomial over the joined texts, n-grams of
words by mixing neighbouring word hashes. Every text's features of a family are scaled to unit length, so long and short
texts weigh alike. Model sizes are fixed by DIMENSIONS, whatever the data.
"""

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import xxhash

DIMENSIONS = 1 << 18
_MASK = np.uint32(DIMENSIONS - 1)


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = h ^ np.uint32((salt * 0x9E3779B1) & 0xFFFFFFFF)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))) & _MASK


class _WordHash(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[w] = xxhash.xxh32_intdigest(w)
        return h


_words = _WordHash()


@dataclass
class Rows:
    """Sparse rows: row and index of each feature with its value, and dense columns beside."""

    n: int
    row: np.ndarray
    index: np.ndarray
    value: np.ndarray
    dense: np.ndarray
    #: Number of features of the last family.
    last: int = 0

    def with_dense(self, more: np.ndarray) -> "Rows":
        return Rows(self.n, self.row, self.index, self.value, np.hstack([self.dense, more]))

    def take(self, keep: np.ndarray) -> "Rows":
        """The rows at which the mask is true."""
        new = np.cumsum(keep) - 1
        own = keep[self.row]
        return Rows(int(keep.sum()), new[self.row[own]].astype(np.int32), self.index[own], self.value[own], self.dense[keep])


def char_grams(texts: Sequence[str], orders: Sequence[int], salt: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of the n-grams of UTF-8 bytes, with a mark at either end of a text."""
    coded = [b"\x02" + t.encode("utf-8", "replace") + b"\x03" for t in texts]
    size = np.fromiter(map(len, coded), np.int64, len(coded))
    data = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(coded), dtype=np.int32), size)
    rows, found = [], []
    for n in orders:
        if len(data) < n:
            continue
        h = np.zeros(len(data) - n + 1, np.uint32)
        for k in range(n):
            h = h * np.uint32(16777619) + data[k : len(data) - n + 1 + k]
        inside = owner[: len(h)] == owner[n - 1 :]
        rows.append(owner[: len(h)][inside])
        found.append(_mix(h[inside], salt * 16 + n))
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int32), np.zeros(0, np.uint32))


def word_grams(texts: Sequence[Sequence[str]], orders: Sequence[int], salt: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of the n-grams of words."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.fromiter((_words[w] for t in texts for w in t), np.uint32, int(size.sum()))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    rows, found = [], []
    for n in orders:
        if len(flat) < n:
            continue
        h = np.zeros(len(flat) - n + 1, np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) + flat[k : len(flat) - n + 1 + k]
        inside = owner[: len(h)] == owner[n - 1 :]
        rows.append(owner[: len(h)][inside])
        found.append(_mix(h[inside], salt * 16 + n))
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int32), np.zeros(0, np.uint32))


#: Distances of two classes, in words, that are told apart.
_NEAR = (1, 2, 4, 8)


def class_grams(rows: Sequence[Sequence[int]], kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of word classes (0 for none, else below `kinds`): alone, in ordered pairs up to eight words apart, three in a row."""
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.fromiter((k for ks in rows for k in ks), np.uint32, int(size.sum()))
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), size)
    at = np.flatnonzero(flat)
    k, own, n = flat[at], owner[at], np.uint32(kinds)
    out_row, out = [own], [k]
    for step in (1, 2, 3):
        if len(at) <= step:
            break
        gap = at[step:] - at[:-step]
        near = (own[step:] == own[:-step]) & (gap <= _NEAR[-1])
        pair = k[:-step] * n + k[step:]
        out_row += [own[step:][near]] * 2
        out += [n + pair[near], (n + n * n) * (np.searchsorted(_NEAR, gap[near]).astype(np.uint32) + np.uint32(1)) + n + pair[near]]
    if len(at) > 2:
        three = own[2:] == own[:-2]
        out_row.append(own[2:][three])
        out.append(np.uint32(1 << 20) + ((k[:-2] * n + k[1:-1]) * n + k[2:])[three])
    return np.concatenate(out_row), _mix(np.concatenate(out), 77)


def assemble(n: int, families: Sequence[tuple[np.ndarray, np.ndarray]], dense: np.ndarray | None = None) -> Rows:
    """Rows of several families, each scaled to unit length per text."""
    rows, index, value = [], [], []
    for r, i in families:
        count = np.bincount(r, minlength=n)
        rows.append(r)
        index.append(i)
        value.append((1 / np.sqrt(np.maximum(count, 1)))[r].astype(np.float32))
    none = np.zeros(0)
    return Rows(
        n, np.concatenate(rows) if rows else none.astype(np.int32), np.concatenate(index) if rows else none.astype(np.uint32), np.concatenate(value) if rows else none.astype(np.float32),
        np.zeros((n, 0), np.float32) if dense is None else dense.astype(np.float32), len(rows[-1]) if rows else 0,
    )


@dataclass
class Linear:
    """A logistic model: hashed weights, dense weights and a constant."""

    weight: np.ndarray
    dense: np.ndarray
    constant: float

    def logit(self, x: Rows) -> np.ndarray:
        z = np.bincount(x.row, self.weight[x.index] * x.value, minlength=x.n) + self.constant
        return z + x.dense @ self.dense if x.dense.shape[1] else z

    def probability(self, x: Rows) -> np.ndarray:
        return sigmoid(self.logit(x))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: Rows, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 120, rate: float = 0.25, penalty: float = 1e-6) -> Linear:
    """Weighted logistic regression by full-batch Adam with a decaying rate; the same data give the same model."""
    y = y.astype(np.float64)
    w = np.ones(x.n) if weight is None else weight.astype(np.float64)
    w = w / max(w.sum(), 1e-12)
    used, index = np.unique(x.index, return_inverse=True)
    k, d = len(used), x.dense.shape[1]
    theta = np.zeros(k + d + 1)
    p = np.clip((w * y).sum(), 1e-4, 1 - 1e-4)
    theta[-1] = np.log(p / (1 - p))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    value = x.value.astype(np.float64)
    dense = x.dense.astype(np.float64)
    for t in range(1, steps + 1):
        z = np.bincount(x.row, theta[index] * value, minlength=x.n) + dense @ theta[k : k + d] + theta[-1]
        g = w * (sigmoid(z) - y)
        grad = np.concatenate([np.bincount(index, g[x.row] * value, minlength=k), dense.T @ g, [g.sum()]])
        grad[:-1] += penalty * theta[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        theta -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    full = np.zeros(DIMENSIONS, np.float32)
    full[used] = theta[:k]
    return Linear(full, theta[k : k + d].astype(np.float32), float(theta[-1]))


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, low: float = 0.2, high: float = 0.95) -> float:
    """The threshold in [low, high] of the best (weighted) F1; the middle of the best range on ties."""
    grid = np.linspace(low, high, 76)
    w = np.ones(len(p)) if weight is None else weight
    good = (w * y).sum()
    score = np.array([2 * (w * (y * (p >= t))).sum() / max(1e-12, good + (w * (p >= t)).sum()) for t in grid])
    best = np.flatnonzero(score >= score.max() - 1e-12)
    return float(grid[best[len(best) // 2]])
