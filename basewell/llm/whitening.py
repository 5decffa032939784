"""Embedding whitening by pivoted Cholesky and one-sided Jacobi.

Entries become integers, x = floor(SCALE * c) + SHIFT, so that sums over all vectors are exact whatever the order of
the partitions: ``fit`` gathers for each dimension the sum, then the scatter of the vectors centred on the whole
number next to the mean, and corrects it for the rest; both as integers. Tasks send one row for each pair of
dimensions, which Spark adds up, so the driver sees (dimensions)^2 / 2 rows, whatever the number of vectors.

On the driver the covariance V is factored as L L^T with the largest pivots first, and Jacobi rotations make the
columns of L orthogonal. Their squared norms are the eigenvalues, the columns divided by their norms the components.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
#: At most so many components.
MOST = 32
#: Entries beyond this are taken for it, so that they fit a long.
LARGEST = 1 << 62
LIMB, LIMBS = 30, 6
_MASK = (1 << LIMB) - 1
_LIMB_NAMES = [f"l{k}" for k in range(LIMBS)]


class Whitening(NamedTuple):
    n: int
    sums: tuple[int, ...]  # of x, by dimension
    components: np.ndarray  # dimensions x components, by falling eigenvalue
    eigenvalues: np.ndarray
    explained: np.ndarray  # share of the trace


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L (lower triangular up to the order of rows) and pivots with v[pivots][:, pivots] = L L^T; it stops at the rank."""
    rest, n = v.copy(), len(v)
    pivots, factor = np.arange(n), np.zeros((n, n))
    least = np.finfo(float).eps * n * max(np.diag(v).max(initial=0.0), 0.0)
    for k in range(n):
        best = k + int(np.argmax(np.diag(rest)[k:]))
        for a in (rest, rest.T, factor):
            a[[k, best]] = a[[best, k]]
        pivots[[k, best]] = pivots[[best, k]]
        if rest[k, k] <= least:
            return factor[:, :k], pivots
        root = math.sqrt(rest[k, k])
        factor[k, k] = root
        factor[k + 1 :, k] = rest[k + 1 :, k] / root
        rest[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, pivots


def one_sided_jacobi(factor: np.ndarray, most_sweeps: int = 60) -> np.ndarray:
    """The factor's columns, rotated in pairs until all are orthogonal to working precision.

    A sweep meets every pair once, in rounds of disjoint pairs (a round-robin), so that a round is one step of numpy.
    """
    a = factor.T.copy()  # rows are the columns
    k = len(a)
    ring = np.arange(k + k % 2)
    for _ in range(most_sweeps if k > 1 else 0):
        rotated = False
        for _ in range(len(ring) - 1):
            i, j = ring[: len(ring) // 2], ring[::-1][: len(ring) // 2]
            real = (i < k) & (j < k)
            i, j = i[real], j[real]
            left, right = a[i], a[j]
            p, q, r = (left * left).sum(1), (right * right).sum(1), (left * right).sum(1)
            turn = np.abs(r) > 1e-15 * np.sqrt(p * q)
            if turn.any():
                rotated = True
                i, j, left, right, p, q, r = (v[turn] for v in (i, j, left, right, p, q, r))
                tau = (q - p) / (2 * r)
                t = np.copysign(1, tau) / (np.abs(tau) + np.hypot(1, tau))
                c = 1 / np.hypot(1, t)
                s = c * t
                a[i], a[j] = c[:, None] * left - s[:, None] * right, s[:, None] * left + c[:, None] * right
            ring = np.r_[ring[0], ring[-1], ring[1:-1]]
        if not rotated:
            break
    return a.T


def principal(v: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Components (as columns) and eigenvalues of a covariance, largest first, none beyond its rank."""
    factor, pivots = pivoted_cholesky(v)
    rotated = one_sided_jacobi(factor)
    norms = np.linalg.norm(rotated, axis=0)
    order = np.argsort(-norms, kind="stable")[:most]
    components = np.zeros((len(v), len(order)))
    components[pivots] = rotated[:, order] / norms[order]
    return components, norms[order] ** 2


def clean(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part: no null vector, no null or non-finite entry."""
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return kept.where(F.col("vector").isNotNull() & finite & (F.size("vector") > 0))


def _whole(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The batch's vectors as integers; all have the same width."""
    at = batch.schema.get_field_index("vector")
    flat = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _add_limbs(limbs: np.ndarray, values: np.ndarray) -> None:
    """Adds integers to sums held as LIMBS longs each, of LIMB bits and more to come; only the last part of an integer is signed."""
    if values.dtype == object:
        values = values.copy()
        for k in range(LIMBS - 1):
            limbs[k] += (values & _MASK).astype(np.int64)
            values >>= LIMB
        limbs[-1] += values.astype(np.int64)
    else:
        for k in range(2):
            limbs[k] += (values >> (LIMB * k)) & _MASK
        limbs[2] += values >> (2 * LIMB)


def _totals(vectors: DataFrame, width: int, size: int, add: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """Exact sums over all vectors of the size integers that add gives for a block of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limbs = np.zeros((LIMBS, size), np.int64)
        for batch in batches:
            if batch.num_rows:
                _add_limbs(limbs, add(_whole(batch, width)))
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int64()), *map(pa.array, limbs)], ["place", *_LIMB_NAMES])

    parts = vectors.select("vector").mapInArrow(run, ", ".join(f"{c} long" for c in ("place", *_LIMB_NAMES)))
    rows = parts.groupBy("place").agg(*[F.sum(c).alias(c) for c in _LIMB_NAMES]).collect()
    found = {r.place: sum(r[f"l{k}"] << (LIMB * k) for k in range(LIMBS)) for r in rows}
    return [found.get(i, 0) for i in range(size)]


def _products(y: np.ndarray) -> np.ndarray:
    """y^T y, exactly."""
    most = int(np.abs(y).max(initial=0))
    if most * most * max(len(y), 1) < 1 << 53:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64)
    return y.astype(object).T @ y.astype(object)


def common_width(vectors: DataFrame) -> int:
    """The most frequent number of dimensions (the larger of equally frequent ones), 0 without vectors."""
    first = vectors.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return first.width if first else 0


def fit(vectors: DataFrame, width: int, most: int = MOST) -> Whitening:
    """Mean, components and eigenvalues of all vectors, which come from clean and have the width."""
    upper = np.triu_indices(width)
    ones = _totals(vectors, width, width + 1, lambda x: np.r_[x.astype(object).sum(0) if np.abs(x).max() > LARGEST // max(len(x), 1) else x.sum(0), len(x)])
    n, sums = ones[-1], ones[:-1]
    if not n:
        return Whitening(0, tuple(sums), np.zeros((width, 0)), np.zeros(0), np.zeros(0))
    middle = np.array([s // n for s in sums], np.int64)

    def scatter(x: np.ndarray) -> np.ndarray:
        y = x - middle if np.abs(x).max() < LARGEST // 2 else x.astype(object) - middle
        return _products(y)[upper]

    products = _totals(vectors, width, len(upper[0]), scatter)
    rest = [s - n * int(m) for s, m in zip(sums, middle, strict=True)]  # sums of the centred entries, below n
    v = np.zeros((width, width))
    for i, j, p in zip(*(u.tolist() for u in upper), products, strict=True):
        v[i, j] = v[j, i] = (n * p - rest[i] * rest[j]) / (n * n)
    components, eigenvalues = principal(v, most)
    trace = float(np.trace(v))
    return Whitening(n, tuple(sums), components, eigenvalues, eigenvalues / trace if trace else eigenvalues)


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    middle = np.array([s // model.n for s in model.sums], np.int64)
    rest = np.array([s % model.n / model.n for s in model.sums])
    return (x - middle).astype(float) - rest


def _deviations(x: np.ndarray, model: Whitening) -> pa.Array:
    """For each row the sum of (n x - S)^2, exactly; null beyond a long."""
    far = max(max(abs(s) for s in model.sums), model.n * int(np.abs(x).max(initial=0)))
    if 2 * far < 1 << 62:
        away = model.n * x - np.array(model.sums, np.int64)
        most = int(np.abs(away).max(initial=0))
        if most * most * x.shape[1] < 1 << 63:
            return pa.array((away * away).sum(1), pa.int64())
    away = x.astype(object) * model.n - np.array(model.sums, object)
    return pa.array([v if v < 1 << 63 else None for v in (away * away).sum(1).tolist()], pa.int64())


def transform(vectors: DataFrame, model: Whitening) -> DataFrame:
    """One row for each vector and component: vec_id, component (from 1), n, deviation, whitened, explained."""
    width, k = model.components.shape
    kind = dict(vectors.dtypes)["vec_id"]
    scaled = model.components / np.sqrt(model.eigenvalues)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = _whole(batch, width)
            many = np.repeat(np.arange(len(x)), k)
            columns = [
                batch.column(0).take(pa.array(many)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(many), model.n)),
                _deviations(x, model).take(pa.array(many)), pa.array((_centred(x, model) @ scaled).ravel()), pa.array(np.tile(model.explained, len(x))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return vectors.select("vec_id", "vector").mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double")


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of all whitened vectors minus the identity, measured on the vectors."""
    width, k = model.components.shape
    if not k:
        return 0.0
    scaled = model.components / np.sqrt(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, pairs = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = _centred(_whole(batch, width), model) @ scaled
                ones += w.sum(0)
                pairs += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k + k * k)), pa.array(np.r_[ones, pairs.ravel()])], ["place", "value"])

    rows = vectors.select("vector").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()
    found = np.array([r.value for r in rows]) / model.n
    mean = found[:k]
    return float(np.abs(found[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MOST) -> DataFrame:
    """Fits on all vectors and whitens them: transform's columns and identity_error, the same in every row.

    Rows whose vector is null, empty, or has a null or non-finite entry are left out, and so are vectors of another
    number of dimensions than most have. Repeated and null ids stay. There are no components beyond the covariance's rank, so
    equal vectors, or a single one, give no row. A deviation that exceeds a long is null.
    """
    found = clean(vectors, id_col, vector_col)
    width = common_width(found)
    found = found.where(F.size("vector") == width)
    model = fit(found, width, most)
    return transform(found, model).withColumn("identity_error", F.lit(identity_error(found, model)))
