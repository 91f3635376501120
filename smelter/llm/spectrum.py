"""Whitening of vectors on the leading eigenvectors of their covariance, found by spectrum slicing.

Sums and products are counted on Spark in whole numbers, so the covariance is exact up to its last
division. Its leading eigenvalues are then told apart by slicing: the factors LDLᵀ of the
covariance minus a shift have as many positive pivots as there are eigenvalues above the shift, so
halving intervals by these counts isolates the k-th eigenvalue. Rayleigh quotient iteration from
there converges cubically, and counts on both sides of the value it ends at certify its number.

Centring comes before multiplying: products are those of ``x`` minus the rounded mean, corrected
by the rest. Only sums (dimension squared numbers) come to the driver, never vectors.

Defined results: rows with a null vector or a null or non-finite entry are left out, a null id is
carried along, equal rows are rows of their own, other columns are not read. A shorter
vector counts as ending in zeros. Components without variance (constant dimensions, fewer
different rows than components, one row) can't be whitened and are left out; an empty table
gives no rows. Equal eigenvalues share a space: any orthonormal basis of it is right, and all
rows get the same one. A sum beyond 64 bits stops the job with an error, as an integer overflow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smelter.llm.anchor_bounds import EXACT, dense
from smelter.llm.common import written

#: Relative rounding error of a double.
EPS = np.finfo(float).eps

LONG = 2**63 - 1

_SUM = "i int, j int, value decimal(38, 0)"
_FLOAT_SUM = "i int, j int, value double"
_PROJECTED = "id long, deviation long, whitened array<double>"
RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def whiten(vectors: DataFrame, components: int = 32, id: str = "vec_id", x: str = "x") -> DataFrame:
    """Every vector of whole numbers on the leading components, scaled to variance 1.

    Returns a row for each vector and component, with the share of the variance that the
    component explains and the largest error of the whitened covariance.
    """
    spark = vectors.sparkSession
    rows = written(vectors.select(F.col(id).cast("long").alias("id"), F.col(x).alias("x")), "whole")
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    sums = _column_sums(rows, width)
    middle = np.array([round(s / n) if n else 0 for s in sums], dtype=object)
    covariance = _covariance(_products(rows, width, middle), [s - n * m for s, m in zip(sums, middle)], n)
    values, axes = leading(covariance, min(components, width))
    if not len(values):
        return spark.createDataFrame([], RESULT)
    projected = written(_project(rows, width, n, sums, axes / np.sqrt(values)), "projected")
    shares = F.array(*[F.lit(float(v / np.trace(covariance))) for v in values])
    error = _identity_error(projected, len(values), n)
    return projected.select(
        F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("_k", "whitened")
    ).select(
        "vec_id", (F.col("_k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("_k")).alias("explained"), F.lit(error).alias("identity_error"),
    )


# Sums


def whole(vectors: pa.Array, width: int) -> np.ndarray:
    """A list array of whole numbers as a matrix of them."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(vectors) * width and (np.diff(vectors.offsets.to_numpy()) == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors.to_pylist()):
        out[i, : len(v)] = v
    return out


def _task_sums(batches, width: int, term: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The sums of one task over its batches, in whole numbers of any size; a row an entry."""
    total = 0
    for batch in batches:
        total = total + term(whole(batch.column("x"), width)).astype(object)
    if isinstance(total, np.ndarray):
        # A row of sums, or one half of a symmetric matrix.
        i, j = np.triu_indices(len(total), m=total.shape[1])
        values = pa.array([int(v) for v in total[i, j]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), values], ["i", "j", "value"])


def _entries(sums: DataFrame) -> dict[tuple[int, int], int | float]:
    """Sums over all tasks: at most a number for each pair of dimensions."""
    return {(r["i"], r["j"]): r["value"] for r in sums.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()}


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``aᵀ b`` in whole numbers: by floating point where that is exact, else number by number."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(len(a), 1)
    if bound < EXACT:
        return (a.astype(float).T @ b.astype(float)).astype(np.int64)
    return a.astype(object).T @ b.astype(object)


def _column_sums(rows: DataFrame, width: int) -> list[int]:
    def run(batches):
        yield from _task_sums(batches, width, lambda x: exact_products(np.ones((len(x), 1), dtype=np.int64), x))

    found = _entries(rows.select("x").mapInArrow(run, _SUM))
    return [int(found.get((0, j), 0)) for j in range(width)]


def _products(rows: DataFrame, width: int, middle: np.ndarray) -> np.ndarray:
    def run(batches):
        def term(x):
            centred = x - middle if np.abs(x).max(initial=0) > LONG // 4 else x - middle.astype(np.int64)
            return exact_products(centred, centred)

        yield from _task_sums(batches, width, term)

    out = np.zeros((width, width), dtype=object)
    found = _entries(rows.select("x").mapInArrow(run, _SUM))
    for (i, j), value in found.items():
        out[i, j] = out[j, i] = int(value)
    return out


def _covariance(products: np.ndarray, rest: list[int], n: int) -> np.ndarray:
    """Of whole numbers, so each entry is rounded once, by the division."""
    width = len(rest)
    return np.array(
        [[(n * products[i, j] - rest[i] * rest[j]) / (n * n) if n else 0.0 for j in range(width)] for i in range(width)],
        dtype=float,
    ).reshape(width, width)


# Slicing


def above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues above the shift: the positive pivots of LDLᵀ, pivots of one or two rows."""
    a = matrix - shift * np.eye(len(matrix))
    n, k, count = len(a), 0, 0
    enough = (1 + 17**0.5) / 8  # keeps the growth of entries least (Bunch and Kaufman)
    while k < n:
        column = np.abs(a[k + 1 :, k])
        largest = column.max(initial=0)
        if abs(a[k, k]) >= enough * largest:
            width = 1
        else:
            r = k + 1 + int(column.argmax())
            others = np.abs(a[r, k:])
            others[r - k] = 0
            across = others.max()
            if abs(a[k, k]) * across >= enough * largest**2:
                width = 1
            else:
                width = 1 if abs(a[r, r]) >= enough * across else 2
                _swap(a, k + width - 1, r)
        pivot, below = a[k : k + width, k : k + width], a[k + width :, k : k + width]
        if width == 2:
            count += 1  # one of two signs each: its determinant is negative
            a[k + 2 :, k + 2 :] -= below @ np.linalg.solve(pivot, below.T)
        elif pivot[0, 0]:
            count += pivot[0, 0] > 0
            a[k + 1 :, k + 1 :] -= np.outer(below, below) / pivot[0, 0]
        k += width
    return int(count)


def _swap(a: np.ndarray, i: int, j: int) -> None:
    a[[i, j]] = a[[j, i]]
    a[:, [i, j]] = a[:, [j, i]]


class Slices:
    """Intervals of the spectrum, halved by counts that are kept."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.top = float(np.abs(matrix).sum(axis=1).max(initial=0)) * (1 + 4 * EPS)
        self.counts: dict[float, int] = {self.top: 0}

    def count(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = above(self.matrix, shift)
        return self.counts[shift]

    def around(self, k: int, floor: float) -> tuple[float, float] | None:
        """An interval with the k-th largest eigenvalue, if that lies above the floor."""
        if self.count(floor) < k:
            return None
        return (
            max(s for s, c in self.counts.items() if c >= k), min(s for s, c in self.counts.items() if c < k),
        )

    def halve(self, low: float, high: float, k: int) -> tuple[float, float]:
        middle = (low + high) / 2
        return (middle, high) if self.count(middle) >= k else (low, middle)


def leading(matrix: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues above rounding error, falling, and their unit eigenvectors as columns."""
    size = len(matrix)
    slices = Slices(matrix)
    floor = slices.top * size * EPS
    least = slices.top * 8 * EPS
    values, axes = [], np.empty((size, 0))
    for k in range(1, components + 1):
        interval = slices.around(k, floor) if slices.top else None
        if interval is None:
            break
        low, high = interval
        while True:
            alone = slices.count(low) == k and slices.count(high) == k - 1
            if alone or high - low <= least:
                value, axis = _iterate(matrix, low, high, axes)
                if low - least <= value <= high + least and _certified(slices, value, k, least):
                    break
            if high - low <= least:
                raise ArithmeticError(f"eigenvalue {k} can't be told from its neighbours")
            low, high = slices.halve(low, high, k)
        values.append(value)
        axes = np.column_stack([axes, axis])
    return np.array(values), axes


def _certified(slices: Slices, value: float, k: int, least: float) -> bool:
    """Fewer than k eigenvalues above the value, at least k above what lies below it."""
    room = max(least, slices.top * len(slices.matrix) * EPS)
    return slices.count(value + room) < k <= slices.count(value - room)


def _iterate(matrix: np.ndarray, low: float, high: float, found: np.ndarray) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration, started by two steps of inverse iteration at the middle."""
    size = len(matrix)
    v = _apart(np.cos(np.arange(1, size + 1) * (1 + found.shape[1])) + 2, found)
    shift, best = (low + high) / 2, (np.inf, 0.0, v)
    for step in range(20):
        v = _apart(_solved(matrix, shift, v), found)
        image = matrix @ v
        value = float(v @ image)
        left = float(np.linalg.norm(image - value * v))
        if left >= best[0] and step > 3:
            break
        if left < best[0]:
            best = (left, value, v)
        if step and low <= value <= high:
            shift = value
    return best[1], best[2]


def _solved(matrix: np.ndarray, shift: float, v: np.ndarray) -> np.ndarray:
    size, scale = len(matrix), float(np.abs(matrix).max())
    for nudge in (0, 1, 2, 4):
        try:
            # A hit on the eigenvalue itself leaves nothing to solve: stand off by a rounding error.
            out = np.linalg.solve(matrix - (shift + nudge * EPS * scale) * np.eye(size), v)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(out).all():
            return out
    return v


def _apart(v: np.ndarray, found: np.ndarray) -> np.ndarray:
    """A unit vector at right angles to those found; twice, so that rounding leaves nothing."""
    for _ in range(2):
        v = v - found @ (found.T @ v)
        v = v / np.linalg.norm(v)
    return v


# Projection


def _project(rows: DataFrame, width: int, n: int, sums: list[int], scaled_axes: np.ndarray) -> DataFrame:
    """Deviation and whitened coordinates of every row."""

    def run(batches):
        for batch in batches:
            x = whole(batch.column("x"), width)
            off = x.astype(object) * n - np.array(sums, dtype=object)
            largest = max((abs(v) for v in off.flat), default=0) if n * float(np.abs(x).max(initial=0)) >= LONG / 4 else None
            if largest is None:
                off = x * n - np.array(sums, dtype=np.int64)
                largest = int(np.abs(off).max(initial=0))
            if largest**2 * width > LONG:
                squares = [sum(int(v) ** 2 for v in row) for row in off]
                if max(squares, default=0) > LONG:
                    raise ArithmeticError("deviation beyond 64 bits")
            else:
                squares = (off.astype(np.int64) ** 2).sum(axis=1)
            white = (off.astype(float) / n) @ scaled_axes
            offsets = np.arange(len(white) + 1, dtype=np.int32) * white.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array(squares, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(white.ravel())),
                ],
                ["id", "deviation", "whitened"],
            )

    return rows.mapInArrow(run, _PROJECTED)


def _identity_error(projected: DataFrame, size: int, n: int) -> float:
    """The largest entry of the whitened covariance minus the identity."""

    def run(batches):
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            white = dense(batch.column("whitened"), size)
            # A column of ones in front carries the sums along.
            white = np.column_stack([np.ones(len(white)), white])
            total += white.T @ white
        i, j = np.triu_indices(size + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "value"]
        )

    found = _entries(projected.select("whitened").mapInArrow(run, _FLOAT_SUM))
    total = np.zeros((size + 1, size + 1))
    for (i, j), value in found.items():
        total[i, j] = total[j, i] = value / n
    covariance = total[1:, 1:] - np.outer(total[0, 1:], total[0, 1:])
    return float(np.abs(covariance - np.eye(size)).max())
