"""Small logistic models fitted on the driver from bounded samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Sparse:
    """Rows of few entries, with some full columns at the end: what fitting needs of a matrix."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int, full: np.ndarray):
        self.starts, self.columns, self.values, self.width, self.full = starts, columns, values, width, full
        self.owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        self.shape = (len(starts) - 1, width + full.shape[1])

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]], width: int) -> Sparse:
        """From (columns, values) of each row."""
        starts = np.cumsum([0, *(len(c) for c, _ in rows)])
        columns = np.concatenate([np.zeros(0, np.int64), *(c for c, _ in rows)]).astype(np.int64)
        return cls(starts, columns, np.concatenate([np.zeros(0), *(v for _, v in rows)]), width, np.zeros((len(rows), 0)))

    def part(self, rows: np.ndarray, place: np.ndarray) -> Sparse:
        """The rows of a mask; ``place`` has the new number of each column, or -1 for those that go."""
        kept = rows[self.owner] & (place[self.columns] >= 0)
        sizes = np.bincount(self.owner[kept], minlength=self.shape[0])[rows]
        return Sparse(np.concatenate([[0], np.cumsum(sizes)]), place[self.columns[kept]], self.values[kept], int(place.max(initial=-1)) + 1, self.full[rows])

    def with_column(self, column: np.ndarray) -> Sparse:
        return Sparse(self.starts, self.columns, self.values, self.width, np.column_stack([self.full, column]))

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, self.values * w[self.columns], minlength=self.shape[0]) + self.full @ w[self.width :]

    @property
    def T(self) -> Turned:  # noqa: N802
        return Turned(self)


@dataclass
class Turned:
    """The transpose of :class:`Sparse`."""

    of: Sparse

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        own = np.bincount(self.of.columns, self.of.values * v[self.of.owner], minlength=self.of.width)
        return np.concatenate([own, self.of.full.T @ v])


@dataclass
class Linear:
    """Weights over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def fit_logistic(x: np.ndarray | Sparse, y: np.ndarray, sample_weight: np.ndarray | None = None, l2: float = 1.0, steps: int = 120, standardise: bool = True) -> Linear:
    """L2 logistic regression by limited-memory BFGS.

    With one class only, or no rows, the model is the constant share (0.5
    without rows). A sparse matrix is not standardised.
    """
    n, d = x.shape
    zero = Linear(np.zeros(d), np.ones(d), np.zeros(d), 0.0)
    if n == 0:
        return zero
    weight = np.ones(n) if sample_weight is None else sample_weight.astype(float)
    share = float((weight * y).sum() / weight.sum())
    if share <= 0.0 or share >= 1.0:
        zero.bias = float(logit(np.array([share]))[0])
        return zero
    mean = x.mean(axis=0) if standardise else np.zeros(d)
    scale = x.std(axis=0) if standardise else np.ones(d)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - mean) / scale if standardise else x
    w = np.zeros(d + 1)
    w[d] = logit(np.array([share]))[0]

    def value_and_slope(w: np.ndarray) -> tuple[float, np.ndarray]:
        margin = z @ w[:d] + w[d]
        loss = float((weight * (np.logaddexp(0, margin) - y * margin)).sum()) + 0.5 * l2 * float(w[:d] @ w[:d])
        error = weight * (sigmoid(margin) - y)
        slope = np.empty(d + 1)
        slope[:d] = z.T @ error + l2 * w[:d]
        slope[d] = error.sum()
        return loss, slope

    loss, slope = value_and_slope(w)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction = slope.copy()
        kept = []
        for s, g in reversed(moves):
            a = (s @ direction) / (s @ g)
            kept.append(a)
            direction -= a * g
        if moves:
            s, g = moves[-1]
            direction *= (s @ g) / (g @ g)
        else:
            direction /= max(1.0, np.linalg.norm(slope))
        for (s, g), a in zip(moves, reversed(kept), strict=True):
            direction += (a - (g @ direction) / (s @ g)) * s
        length, downhill = 1.0, float(slope @ direction)
        while True:
            tried, tried_slope = value_and_slope(w - length * direction)
            if tried <= loss - 1e-4 * length * downhill or length < 1e-8:
                break
            length /= 2
        s, g = -length * direction, tried_slope - slope
        if s @ g > 1e-10:
            moves = [*moves[-9:], (s, g)]
        done = loss - tried < 1e-7 * max(1.0, abs(loss))
        w, loss, slope = w + s, tried, tried_slope
        if done:
            break
    return Linear(mean, scale, w[:d], float(w[d]))


def folds_of(n: int, k: int = 5) -> np.ndarray:
    """A fold for each row: rows come in hashed order, so their number will do."""
    return np.arange(n) % k


def out_of_fold(x: np.ndarray, y: np.ndarray, k: int = 5, **options) -> np.ndarray:
    """Probabilities of each row by a model that has not seen it."""
    fold, out = folds_of(len(y), k), np.full(len(y), 0.5)
    for i in range(k):
        test = fold == i
        if test.any() and (~test).any():
            out[test] = fit_logistic(x[~test], y[~test], **options)(x[test])
    return out
