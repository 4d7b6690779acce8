"""Which rows of two blocks of points are within a Manhattan distance of each other, without a table of the pairs.

Coordinates are laid on a grid of integers so fine that the distance of two rows
is known up to what their own rounding amounts to. Integers settle nearly every
pair; the few that lie as close to ``eps`` as that are settled by the distance
itself, added up in order of the dimensions. So every answer is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

ROWS, COLUMNS = 64, 2048  # of a tile; its integers stay in a core's cache
LEVELS, NARROW = 30_000, 4_000  # of the distance in 16 bits, and the dimensions up to which they do


class Block:
    """Rows in the order of their positions: ``at``, ``x`` and, where asked for, a number more for each."""

    def __init__(self, at: np.ndarray, x: np.ndarray, value: np.ndarray):
        order = np.argsort(at)
        self.at, self.x, self.value = at[order], x[order], value[order]
        with np.errstate(over="ignore", invalid="ignore"):  # what is no number there is not left out
            self.plane = np.stack([self.x.sum(axis=1), self.x[:, ::2].sum(axis=1) - self.x[:, 1::2].sum(axis=1)])


class Meeting:
    """Two blocks, perhaps the same one, under one ``eps``."""

    def __init__(self, a: Block, b: Block, eps: float):
        self.a, self.b, self.eps = a, b, eps
        low, high = np.minimum(a.x.min(axis=0), b.x.min(axis=0)), np.maximum(a.x.max(axis=0), b.x.max(axis=0))
        kind = np.int16 if len(low) <= NARROW else np.int32
        self.slack = 1e-11 * float(np.maximum(np.abs(low), np.abs(high)).sum() + abs(eps))
        spread = float((high - low).sum())
        self.step = spread / LEVELS if 0 < spread < np.inf else 1.0
        self.exact = not spread < np.inf  # too wide for a grid
        grid = lambda x: np.zeros(x.shape, kind) if self.exact else np.rint((x - low) / self.step).astype(kind)
        rounding = lambda x, q: np.abs(x - (low + q * self.step)).sum(axis=1) + self.slack
        self.qa = grid(a.x)
        qb = self.qa if b is a else grid(b.x)
        self.ra, self.rb = rounding(a.x, self.qa), rounding(b.x, qb)
        self.qb = np.ascontiguousarray(qb.T)

    def chunks(self, rows: np.ndarray, columns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``rows`` of a, a few at a time, with those ``columns`` (rows of b) that the plane of two sums leaves."""
        for first in range(0, len(rows), ROWS):
            some, left = rows[first : first + ROWS], np.ones(len(columns), bool)
            for mine, theirs in zip(self.a.plane, self.b.plane, strict=True):
                reach, other = self.eps + self.slack, theirs[columns]
                left &= ~(other < mine[some].min() - reach) & ~(other > mine[some].max() + reach)
            if left.any():
                yield some, columns[left]

    def links(self, rows: np.ndarray, columns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of a and rows of b that are within ``eps``, a tile at a time."""
        for first in range(0, len(columns) if len(rows) else 0, COLUMNS):
            some = columns[first : first + COLUMNS]
            if self.exact:
                r, c = (i.ravel() for i in np.indices((len(rows), len(some))))
                good = self.apart(rows[r], some[c]) <= self.eps
                yield rows[r[good]], some[c[good]]
                continue
            other = self.qb[:, some]
            total = np.zeros((len(rows), len(some)), other.dtype)
            term = np.empty_like(total)
            for mine, theirs in zip(self.qa[rows].T, other, strict=True):
                np.subtract(mine[:, None], theirs, out=term)
                np.abs(term, out=term)
                np.add(total, term, out=total)
            spare = float(self.ra[rows].max() + self.rb[some].max())
            most = np.iinfo(total.dtype).max
            sure, open_ = (int(np.clip(np.floor((self.eps + s) / self.step), -1, most)) for s in (-spare, spare))
            r, c = np.nonzero(total <= min(open_ + 1, most))
            doubtful = total[r, c] > sure - 1
            good = ~doubtful
            good[doubtful] = self.apart(rows[r[doubtful]], some[c[doubtful]]) <= self.eps
            yield rows[r[good]], some[c[good]]

    def apart(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """The distances of pairs, a term a dimension in order."""
        total = np.zeros(len(rows))
        for mine, theirs in zip(self.a.x.T, self.b.x.T, strict=True):
            total += np.abs(mine[rows] - theirs[columns])
        return total

    def both(self) -> Iterator[Meeting]:
        """This and, if the blocks are two, the same with the sides exchanged."""
        yield self
        if self.b is not self.a:
            yield Meeting(self.b, self.a, self.eps)


def degrees(met: Meeting) -> tuple[np.ndarray, np.ndarray]:
    """at of rows that are still to be counted (``value`` over 0) and the sum of the counts (of either sign) within ``eps`` on the other side."""
    ats, sums = [], []
    for way in met.both():
        open_, own, counts = np.flatnonzero(way.a.value > 0), np.zeros(len(way.a.at)), np.abs(way.b.value)
        for some, columns in way.chunks(open_, np.arange(len(way.b.at))):
            for r, c in way.links(some, columns):
                own += np.bincount(r, counts[c], len(own))
        ats.append(way.a.at[open_])
        sums.append(own[open_])
    return np.concatenate(ats), np.concatenate(sums)


def unite(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Labels (the least index of a component) after links between u and v."""
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        after = np.arange(len(label))
        np.minimum.at(after, np.maximum(a, b), np.minimum(a, b))
        while (further := after[after]).tobytes() != after.tobytes():
            after = further
        label[:] = after[label]


def forest(met: Meeting) -> tuple[np.ndarray, np.ndarray]:
    """Two components (``value``) at a time that links within the two blocks join, as a star for each that results.

    Rows that are in one component already do not meet again.
    """
    shift = 0 if met.b is met.a else len(met.a.at)
    value = met.a.value if met.b is met.a else np.concatenate([met.a.value, met.b.value])
    names, first, place = np.unique(value, return_index=True, return_inverse=True)
    label = first[place]
    for some, columns in met.chunks(np.arange(len(met.a.at)), np.arange(len(met.b.at))):
        most = lambda: np.bincount(label[some]).argmax()  # noqa: B023, E731
        one = most()
        for r, c in met.links(some[label[some] == one], columns[label[columns + shift] != one]):
            unite(label, r, c + shift)
        for r, c in met.links(some[label[some] != most()], columns):
            unite(label, r, c + shift)
    joined = label[first] != first
    return names[joined].astype(np.int64), value[label[first[joined]]]


def borders(met: Meeting) -> tuple[np.ndarray, np.ndarray]:
    """at of rows without a cluster (``value`` under 0) and the least cluster within ``eps`` on the other side."""
    ats, least = [np.zeros(0, np.int64)], [np.zeros(0)]
    for way in met.both():
        best = np.full(len(way.a.at), np.inf)
        for some, columns in way.chunks(np.flatnonzero(way.a.value < 0), np.flatnonzero(way.b.value >= 0)):
            for r, c in way.links(some, columns):
                np.minimum.at(best, r, way.b.value[c])
        ats.append(way.a.at[best < np.inf])
        least.append(best[best < np.inf])
    return np.concatenate(ats), np.concatenate(least)


def meetings(work: Callable[[Meeting], tuple[np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows (alone, eps, at, x, value), a block a row: one that is ``alone`` meets itself, others the next row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Block | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                alone, eps = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                at, x, value = (batch.column(j)[i].values.to_numpy(zero_copy_only=False) for j in (2, 3, 4))
                block = Block(at, x.reshape(len(at), -1), value)
                if not alone and held is None:
                    held = block
                    continue
                found, numbers = work(Meeting(block if alone else held, block, eps))
                held = None
                for first in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(found[first : first + 10_000], pa.int64()), pa.array(numbers[first : first + 10_000].astype(np.float64))], ["at", "value"])

    return run
