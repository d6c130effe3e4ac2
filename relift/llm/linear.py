"""Naive Bayes support vectors over hashed indicator features.

Each feature's indicator is scaled by the log ratio of its class counts; a linear hinge-loss model
(squared norm, classes weighted to balance) is then fitted by dual coordinate descent.  The margin is
turned into 0 to 1 by a logistic curve fitted on the same rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

from .common import logistic, platt

#: Buckets that features are hashed into; the model is one float32 a bucket.
BUCKETS = 1 << 18


class Hashes(dict):
    """Word to 32-bit hash, remembered; ``trim`` keeps it within a bound."""

    def __missing__(self, word: str) -> int:
        self[word] = value = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return value

    def trim(self, most: int = 150_000) -> None:
        if len(self) > most:
            self.clear()


def bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    """Buckets of 64-bit hashes, apart for each kind of feature."""
    mixed = (hashes + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(46)).astype(np.int32)  # 18 bits


@dataclass
class Model:
    weight: np.ndarray  # by bucket: ratio times the fitted weight
    ratio: np.ndarray  # by bucket: for the norm
    bias: float
    a: float
    b: float

    def margin(self, rows: list[np.ndarray]) -> np.ndarray:
        """Of rows given as distinct buckets."""
        out = np.full(len(rows), self.bias)
        sizes = np.array([len(x) for x in rows])
        if sizes.sum():
            every = np.concatenate(rows)
            owner = np.repeat(np.arange(len(rows)), sizes)
            norm = np.sqrt(np.bincount(owner, self.ratio[every].astype(float) ** 2, len(rows)))
            out += np.bincount(owner, self.weight[every], len(rows)) / np.maximum(norm, 1e-9)
        return out

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return logistic(self.a * self.margin(rows) + self.b)


def fit(rows: list[np.ndarray], labels: list[int], c: float = 1.0, rounds: int = 30, smooth: float = 1.0) -> Model:
    """From distinct buckets and a 0/1 label a row; without rows, or with one class, a constant model."""
    y = np.array(labels, int)
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 2)  # without labels, rather 0
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0, 1.0, float(np.log(p / (1 - p))))
    count = [np.bincount(np.concatenate([r for r, k in zip(rows, y, strict=True) if k == at] or [np.zeros(0, int)]), minlength=BUCKETS) + smooth for at in (0, 1)]
    ratio = np.log(count[1] / (len(y[y == 1]) + 2 * smooth)) - np.log(count[0] / (len(y[y == 0]) + 2 * smooth))
    ratio[(count[0] + count[1]) <= 2 * smooth] = 0
    scaled = []
    for row in rows:
        x = ratio[row]
        n = np.sqrt(x @ x)
        scaled.append(x / n if n else x)
    top = np.where(y == 1, c * len(y) / (2 * (y == 1).sum()), c * len(y) / (2 * (y == 0).sum()))
    sign = np.where(y == 1, 1.0, -1.0)
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(y))
    norm = np.array([x @ x for x in scaled]) + 1.0  # 1: the bias feature
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            x, row = scaled[i], rows[i]
            g = sign[i] * (w[row] @ x + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), top[i])
            if d := new - alpha[i]:
                alpha[i] = new
                w[row] += d * sign[i] * x
                bias += d * sign[i]
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    model = Model((w * ratio).astype(np.float32), ratio.astype(np.float32), float(bias), 1.0, 0.0)
    model.a, model.b = platt(model.margin(rows), y)
    return model
