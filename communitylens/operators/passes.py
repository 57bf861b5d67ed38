"""Passes over stored sparse vectors: principal axes and cluster curves.

A pass multiplies the vectors with a thin matrix. Every task adds up its share in one array of the
result's size and sends that array's filled rows once; they are summed by row, so what is exchanged and
what reaches the driver depends on the number of features and columns, never on the number of vectors.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communitylens import constants as K

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

#: Entries (non-zero values) that are multiplied at once.
CHUNK = 1 << 18
#: Vectors that starting centres are chosen from, by a hash of their content.
SEED_VECTORS = 2000


@dataclass
class Entries:
    """Vectors as (row, index, value) triples, in row order."""

    n: int
    rows: np.ndarray
    index: np.ndarray
    values: np.ndarray

    def times(self, thin: np.ndarray) -> np.ndarray:
        """The product of the vectors with a matrix of few columns."""
        return np.stack([np.bincount(self.rows, self.values * column[self.index], self.n) for column in thin.T], axis=1)

    def squares(self) -> np.ndarray:
        return np.bincount(self.rows, self.values * self.values, self.n)


def entries(column: pa.StructArray) -> Iterator[Entries]:
    """The vectors of an Arrow column of unwrapped vectors, in chunks of whole rows."""
    kind, _, places, values = column.flatten()
    counts = pc.list_value_length(values).to_numpy()
    ends = np.cumsum(counts)
    values = values.flatten().to_numpy()
    index = np.arange(len(values)) - np.repeat(ends - counts, counts)
    sparse = np.repeat(kind.to_numpy() == 0, counts)
    index[sparse] = places.flatten().to_numpy()
    first = 0
    while first < len(counts):
        start = ends[first] - counts[first]
        last = max(first + 1, int(np.searchsorted(ends, start + CHUNK, side="right")))
        part = slice(start, ends[last - 1])
        yield Entries(last - first, np.repeat(np.arange(last - first), counts[first:last]), index[part], values[part])
        first = last


def summed(vectors: DataFrame, column: str, shape: tuple[int, int], add: Callable[[np.ndarray, Entries], None]) -> np.ndarray:
    """The sum over all vectors of what ``add`` puts into an array of ``shape``; one scan."""
    names = [f"v{k}" for k in range(shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for part in entries(batch.column(0)):
                add(total, part)
        held = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(held), *[pa.array(c) for c in total[held].T]], ["place", *names])

    rows = vectors.select(F.unwrap_udt(column).alias("vector")).where("vector is not null").mapInArrow(
        run, ", ".join(["place bigint", *[f"{n} double" for n in names]]))
    table = rows.groupBy("place").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros(shape)
    for k, name in enumerate(names):
        out[table.column("place").to_numpy(), k] = table.column(name).to_numpy()
    return out


def _size(vectors: DataFrame, column: str) -> int:
    """Features per vector."""
    vector = F.unwrap_udt(column)
    row = vectors.where(F.col(column).isNotNull()).select(F.coalesce(vector["size"], F.size(vector["values"]))).first()
    return row[0] if row else 0


# --------------------------------------------------------------- principal axes
@dataclass(frozen=True)
class Axes:
    """Principal axes (one per column), the variances along them, the variance of all features, and how far the axes are
    from being exact: the largest part of the covariance times an axis that is not along it, relative to the first variance."""

    axes: np.ndarray
    variance: np.ndarray
    total: float
    residual: float
    scans: int


def principal_axes(vectors: DataFrame, k: int = 2, column: str = "features", oversample: int = 8, tolerance: float = 1e-7,
                   most_scans: int = 100, seed: int = K.SEED) -> Axes:
    """The first ``k`` principal axes by randomised subspace iteration.

    Each scan multiplies the covariance with ``k + oversample`` columns, without making it: the centred vectors times the
    columns, and the vectors' transpose times that. A thin QR on the driver keeps the columns apart. Scans end once
    the residual is below ``tolerance`` or after ``most_scans``; the result tells which. Axes point to where their
    largest entry is positive. A table without two vectors has no axes of any variance.
    """
    size = _size(vectors, column)

    def moments(total: np.ndarray, part: Entries) -> None:
        total[:size, 0] += np.bincount(part.index, part.values, size)
        total[:size, 1] += np.bincount(part.index, part.values * part.values, size)
        total[size, 0] += part.n

    sums = summed(vectors, column, (size + 1, 2), moments)
    n, width = sums[size, 0], min(k + oversample, size)
    if n < 2 or not size:
        return Axes(np.zeros((size, min(k, size))), np.zeros(min(k, size)), 0.0, 0.0, 1)
    mean = sums[:size, 0] / n
    total = float((sums[:size, 1] - n * mean * mean).sum() / (n - 1))
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    scans = 1
    while True:
        def products(out: np.ndarray, part: Entries, basis: np.ndarray = basis) -> None:
            seen = part.times(basis)
            for c in range(width):
                out[:, c] += np.bincount(part.index, part.values * seen[part.rows, c], size)

        moved = (summed(vectors, column, (size, width), products) - n * np.outer(mean, mean @ basis)) / (n - 1)
        scans += 1
        inner = basis.T @ moved
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
        axes = basis @ turn
        off = np.linalg.norm(moved @ turn - axes * values, axis=0).max()
        residual = float(off / values[0]) if values[0] > 0 else 0.0
        if residual <= tolerance or scans >= most_scans:
            signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
            return Axes(axes * np.where(signs == 0, 1, signs), np.maximum(values, 0), total, residual, scans)
        basis = np.linalg.qr(moved)[0]


def projected(vectors: DataFrame, axes: np.ndarray, column: str = "features", alias: str = "pca_features") -> DataFrame:
    """Adds the vectors' places along the axes; the axes go to every task (features times few columns)."""
    shared = vectors.sparkSession.sparkContext.broadcast(axes)

    @F.arrow_udf("array<double>")
    def place(column: pa.Array) -> pa.Array:
        axes = shared.value
        parts = [part.times(axes) for part in entries(column)]
        flat = np.concatenate(parts).reshape(-1) if parts else np.zeros(0)
        return pa.ListArray.from_arrays(np.arange(len(column) + 1, dtype=np.int32) * axes.shape[1], flat)

    return vectors.withColumn(alias, array_to_vector(place(F.unwrap_udt(column))))


# ----------------------------------------------------------------- cluster curve
@dataclass(frozen=True)
class Curve:
    """Centres (a row each) and within-cluster sum of squares by number of clusters."""

    centres: dict[int, np.ndarray]
    costs: dict[int, float]
    scans: int


def _seeds(vectors: DataFrame, column: str, count: int, size: int, seed: int) -> np.ndarray:
    """Up to ``count`` starting centres far from each other (k-means++), from a bounded choice of vectors by hash."""
    vector = F.unwrap_udt(column)
    chosen = vectors.select(vector.alias("vector")).where("vector is not null").orderBy(F.xxhash64("vector.indices", "vector.values")).limit(SEED_VECTORS)
    table = chosen.toArrow().column(0).combine_chunks()
    parts = list(entries(table))
    pick, out, gap = np.random.default_rng(seed), [], None
    n = sum(part.n for part in parts)
    norms = np.concatenate([part.squares() for part in parts]) if parts else np.zeros(0)
    while n and len(out) < count:
        at = int(pick.integers(n)) if gap is None else int(pick.choice(n, p=gap / gap.sum()))
        dense = np.zeros(size)
        place = at
        for part in parts:
            if place < part.n:
                mine = part.rows == place
                dense[part.index[mine]] = part.values[mine]
                break
            place -= part.n
        out.append(dense)
        here = np.concatenate([part.times(dense[:, None])[:, 0] for part in parts])
        new = np.maximum(norms - 2 * here + dense @ dense, 0)
        new[new < 1e-9 * (1 + norms)] = 0
        gap = new if gap is None else np.minimum(gap, new)
        if not gap.sum():
            break
    return np.array(out).reshape(len(out), size)


def _round(vectors: DataFrame, column: str, size: int, centres: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, float, float]]:
    """For every number of clusters: moved centres, the largest squared move, and the cost before it. One scan for all."""
    ks = list(centres)
    counts = [len(centres[k]) for k in ks]
    starts = np.cumsum([0, *counts])
    thin = np.concatenate([centres[k] for k in ks]).T
    lengths = (thin * thin).sum(axis=0)

    def assign(total: np.ndarray, part: Entries) -> None:
        gaps, own = lengths - 2 * part.times(thin), part.squares()
        for start, count in zip(starts[:-1], counts, strict=True):
            mine = gaps[:, start:start + count]
            best = mine.argmin(axis=1)
            near = mine[np.arange(part.n), best] + own
            total[:size, start:start + count] += np.bincount(part.index * count + best[part.rows], part.values, size * count).reshape(size, count)
            total[size, start:start + count] += np.bincount(best, minlength=count)
            total[size + 1, start] += np.maximum(near, 0).sum()

    sums = summed(vectors, column, (size + 2, int(starts[-1])), assign)
    out = {}
    for k, start, count in zip(ks, starts[:-1], counts, strict=True):
        rows = sums[size, start:start + count]
        moved = np.where(rows[:, None] > 0, sums[:size, start:start + count].T / np.maximum(rows, 1)[:, None], centres[k])
        out[k] = (moved, float(((moved - centres[k]) ** 2).sum(axis=1).max()), float(sums[size + 1, start]))
    return out


def cluster_curve(vectors: DataFrame, ks: Iterable[int], column: str = "features", iterations: int = 20, tolerance: float = 1e-4,
                  seed: int = K.SEED) -> Curve:
    """Lloyd's k-means for every k of ``ks``, all of them moving in the same scans.

    The starting centres are chosen once: k clusters start from the first k of them. A k leaves the scans when no centre
    moved by more than ``tolerance`` or after ``iterations``; one more scan gives every cost around the centres
    returned. Where a larger k ended in a worse optimum, it starts again from the smaller one's centres and one seed
    more, so costs never rise with k. With fewer different vectors than k there are fewer clusters.
    """
    ks = sorted(set(ks))
    size = _size(vectors, column)
    seeds = _seeds(vectors, column, ks[-1], size, seed)
    if not len(seeds):
        return Curve({k: np.zeros((0, size)) for k in ks}, {k: 0.0 for k in ks}, 1)
    centres = {k: seeds[:k] for k in ks}
    costs: dict[int, float] = {}
    moving, scans = dict.fromkeys(ks, iterations), 0
    while True:
        while moving:
            for k, (moved, step, cost) in _round(vectors, column, size, {k: centres[k] for k in moving}).items():
                if moving[k] == 0 or step <= tolerance ** 2:  # costs are around the centres that stay
                    costs[k] = cost
                    del moving[k]
                else:
                    centres[k], moving[k] = moved, moving[k] - 1
            scans += 1
        worse = next((b for a, b in zip(ks[:-1], ks[1:], strict=True) if costs[b] > costs[a] * (1 + 1e-12)), None)
        if worse is None:
            return Curve(centres, {k: costs[k] for k in ks}, scans)
        below = ks[ks.index(worse) - 1]
        centres[worse] = np.concatenate([centres[below], seeds[len(centres[below]):worse]])
        moving = {worse: iterations}
