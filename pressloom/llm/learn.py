"""Small learners in NumPy: softmax regression over hashed n-grams, gradient-boosted trees on histograms."""

from __future__ import annotations

import re

import numpy as np

from pressloom.llm.linewise import DIM

TOKEN = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)?|\d+|[^\w\s]|_")


def tokens(line: str) -> list[str]:
    """Lower-case words with names masked (capitalised words after the first: X), digits as 0, runs of X as one."""
    out: list[str] = []
    for k, t in enumerate(TOKEN.findall(line)):
        if k and t[0].isupper() and not (len(t) > 1 and t.isupper()):
            if not out or out[-1] != "X":
                out.append("X")
        else:
            out.append("0" if t[0].isdigit() else t.lower())
    return out


def softmax_regression(flat: np.ndarray, starts: np.ndarray, y: np.ndarray, classes: int, l2: float = 1e-5, rounds: int = 45) -> np.ndarray:
    """L2-regularised, fitted by full-batch Adam with class-balanced weights. (DIM + 1, classes); the last row is the bias."""
    n = len(y)
    w = np.zeros((DIM + 1, classes), np.float32)
    sizes = np.diff(np.r_[starts, len(flat)])
    count = np.bincount(y, minlength=classes).astype(float)
    weight = (np.sqrt(n / np.maximum(count, 1)) / np.sqrt(classes))[y]
    weight = weight / weight.sum()
    used = np.unique(flat)
    where = np.searchsorted(used, flat)
    m, v = np.zeros((len(used) + 1, classes)), np.zeros((len(used) + 1, classes))
    onehot = np.eye(classes)[y]
    u = np.zeros((len(used) + 1, classes))
    for t in range(1, rounds + 1):
        z = np.add.reduceat(u[where], starts, axis=0) + u[-1]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        r = (p - onehot) * weight[:, None]
        each = np.repeat(np.arange(n), sizes)
        g = np.stack([np.bincount(where, r[each, c], len(used) + 1) for c in range(classes)], axis=1)
        g[-1] = r.sum(axis=0)
        g += l2 * u
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        u -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    w[used], w[-1] = u[:-1], u[-1]
    return w


class Boosted:
    """Gradient-boosted trees for two classes: histograms of up to BINS bins, trees grown level by level."""

    BINS = 32

    def __init__(self, trees: int = 50, depth: int = 4, rate: float = 0.2, least: float = 8.0):
        self.trees, self.depth, self.rate, self.least = trees, depth, rate, least

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.BINS + 1)[1:-1])) for f in range(x.shape[1])]
        b, (n, f) = self._bin(x), x.shape
        base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(base / (1 - base)))
        z = np.full(n, self.base)
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        offset = np.arange(f) * self.BINS
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            feature, split = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, self.BINS, np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                key = ((node - first)[:, None] * (f * self.BINS) + offset + b).ravel()
                size = width * f * self.BINS
                sg = np.bincount(key, np.repeat(g, f), size).reshape(width, f, self.BINS).cumsum(axis=2)
                sh = np.bincount(key, np.repeat(h, f), size).reshape(width, f, self.BINS).cumsum(axis=2)
                tg, th = sg[:, :, -1:], sh[:, :, -1:]
                gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                gain[(sh < self.least) | (th - sh < self.least)] = 0
                best = gain.reshape(width, -1).argmax(axis=1)
                ok = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
                feature[first : first + width] = best // self.BINS
                split[first : first + width] = np.where(ok, best % self.BINS, self.BINS)
                node = 2 * node + 1 + (b[np.arange(n), feature[node]] > split[node])
            leaf = node - (2**self.depth - 1)
            value = -self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + 1)
            z += value[leaf]
            self.model.append((feature, split, value))
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        b, n = self._bin(x), len(x)
        z, at = np.full(n, self.base), np.arange(n)
        for feature, split, value in self.model:
            node = np.zeros(n, np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[at, feature[node]] > split[node])
            z += value[node - (2**self.depth - 1)]
        return z
