"""Embedding whitening by spectrum slicing.

Entries become integers (``floor(64 c) + 1000000``), so counts, sums and covariances are exact. The fit list
holds each distinct integer vector once. Its sums come from one pass, its covariance from a second one, in
which every entry is centred by the whole number nearest to its mean before anything is multiplied; what
is left of the mean is taken off in exact arithmetic. Tasks return sums of the size of the covariance, added in Spark.

The eigenvalues of the covariance V are isolated by slicing: the LDL' factors of V - s I (Bunch-Kaufman pivots) have as
many positive pivots as V has eigenvalues above s, so bisecting s cuts the spectrum into intervals with one eigenvalue each,
from the largest down. In each interval Rayleigh quotient iteration converges cubically to the eigenpair. Its
eigenvalue must lie in the interval, and counts on both sides of it certify the number of the component; else the interval
is cut further. Eigenvalues that no cut parts are one cluster, whose basis comes from subspace iteration at
the cluster's shift. A factorisation costs the cube of the number of dimensions on the driver, which holds nothing larger than
the covariance. Whitened rows are made where the rows are; the covariance of what comes out is measured over the fit list.

Defined cases: a vector that is null or holds null or non-finite entries is dropped. Entries beyond 2^34 in size count
as 2^34. Vectors of different lengths are whitened apart, each length with its own fit list; an empty vector has no
components and no rows. Repeated rows give their rows each and enter the fit list once; a null ``vec_id`` stays null.
Directions without variance (eigenvalues below 10^-12 of the trace) are no components, so there may be fewer than asked,
and none for a single distinct vector. A ``deviation`` beyond a long is null. An empty table gives an
empty table. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
LARGEST = float(1 << 34)
FLAT = 1e-12
ROWS = 2_000


def integers(vector: Column) -> Column:
    """The integer vector of an embedding; null if that is null or holds an entry that is no finite number."""
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    held = F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double"), F.lit(-LARGEST)), F.lit(LARGEST)) * SCALE).cast("long") + OFFSET)
    return F.when(F.coalesce(sound, F.lit(False)), held)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, pd.DataFrame]]:
    """Rows of one length: the length, their vectors as a matrix, and the rows."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.iloc[at : at + ROWS]
            for dim, some in part.groupby(part["x"].map(len), sort=False):
                if dim:
                    yield dim, np.array(some["x"].tolist(), np.int64), some


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``left' right`` of integers, exact: as doubles while every sum is below 2^53, as Python numbers beyond."""
    if len(left) * float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) < 2**53:
        return (left.T.astype(np.float64) @ right.astype(np.float64)).astype(np.int64).astype(object)
    return left.T.astype(object) @ right.astype(object)


def _summed(fit: DataFrame, pick: Callable[[int, np.ndarray], np.ndarray]) -> DataFrame:
    """Rows ``dim, i, j, total``: sums over the fit list of the matrix that ``pick`` makes of a block of vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for dim, x, _ in _blocks(batches):
            found = pick(dim, x)
            totals[dim] = totals[dim] + found if dim in totals else found
        for dim, total in totals.items():
            for i, row in enumerate(total):
                yield pd.DataFrame({"dim": np.int32(dim), "i": np.int32(i), "j": np.arange(len(row), dtype=np.int32), "total": [str(v) for v in row]})

    sums = fit.select("x").mapInPandas(run, "dim int, i int, j int, total string")
    return sums.groupBy("dim", "i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def _matrices(sums: DataFrame) -> dict[int, list[list[int]]]:
    """Summed matrices by length; they have the size of a covariance."""
    out: dict[int, list[list[int]]] = {}
    for r in sums.orderBy("dim", "i", "j").collect():
        rows = out.setdefault(r.dim, [])
        if r.j == 0:
            rows.append([])
        rows[r.i].append(int(r.total))
    return out


def positive(matrix: np.ndarray) -> int:
    """Positive eigenvalues of a symmetric matrix: positive pivots of its LDL' factors, by Bunch and Kaufman's choice of pivots."""
    a = matrix.copy()
    n, k, found, alpha = len(a), 0, 0, (1 + math.sqrt(17)) / 8
    while k < n:
        below = np.abs(a[k + 1 :, k])
        most = below.max(initial=0.0)
        r, pair = k, False
        if most > 0 and abs(a[k, k]) < alpha * most:
            r = k + 1 + int(below.argmax())
            line = np.abs(a[r, k:])
            line[r - k] = 0
            widest = line.max()
            if abs(a[k, k]) * widest >= alpha * most * most:
                r = k
            elif abs(a[r, r]) < alpha * widest:
                pair = True
        to = k + 1 if pair else k
        if r != to:
            a[[r, to], k:] = a[[to, r], k:]
            a[k:, [r, to]] = a[k:, [to, r]]
        if pair:  # two by two with one eigenvalue on each side of zero
            found += 1
            rest = a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= rest @ np.linalg.solve(a[k : k + 2, k : k + 2], rest.T)
            k += 2
            continue
        pivot = a[k, k]
        found += pivot > 0
        if pivot != 0:
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k + 1 :, k] / pivot)
        k += 1
    return int(found)


def _solve(v: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    for nudge in (0.0, 1e-15, 1e-13, 1e-11):
        try:
            found = np.linalg.solve(v - (shift + nudge) * np.eye(len(v)), right)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(found).all():
            return found
    return right


def _pair(v: np.ndarray, low: float, high: float, seed: int) -> tuple[float, np.ndarray]:
    """Inverse iteration at the interval's middle, then Rayleigh quotient iteration."""
    x = np.random.default_rng(seed).normal(size=len(v))
    x /= np.linalg.norm(x)
    for _ in range(4):
        x = _solve(v, (low + high) / 2, x)
        x /= np.linalg.norm(x)
    value = float(x @ v @ x)
    for _ in range(12):
        y = _solve(v, value, x)
        y /= np.linalg.norm(y)
        done = abs(float(y @ v @ y) - value) <= 4e-16 and min(np.abs(y - x).max(), np.abs(y + x).max()) < 1e-14
        x, value = y, float(y @ v @ y)
        if done:
            break
    return value, x


def leading(covariance: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; eigenvalues of about zero are left out."""
    trace = float(np.trace(covariance))
    if trace <= 0:
        return np.zeros(0), np.zeros((len(covariance), 0))
    v = covariance / trace
    unit = np.eye(len(v))

    def above(shift: float) -> int:
        return positive(v - shift * unit)

    count = min(count, above(FLAT))
    values, vectors = [], []
    # intervals (low, high] with the numbers of eigenvalues above their ends; the highest is on top
    open_ = [(FLAT, 1.0 + 1e-9, above(FLAT), 0)]
    finest = 64 * np.finfo(float).eps
    while open_ and len(values) < count:
        low, high, many, few = open_.pop()
        if many == few:
            continue
        if many - few == 1:
            value, vector = _pair(v, low, high, many)
            slack = 8 * np.finfo(float).eps * len(v)
            if low <= value <= high and np.linalg.norm(v @ vector - value * vector) < slack and above(value + slack) <= few and above(value - slack) >= many:
                values.append(value)
                vectors.append(vector)
                continue
        if high - low <= finest:  # a cluster that no cut parts
            basis = np.random.default_rng(many).normal(size=(len(v), many - few))
            for _ in range(6):
                basis = np.linalg.qr(_solve(v, (low + high) / 2 + finest, basis))[0]
            values += [(low + high) / 2] * (many - few)
            vectors += list(basis.T)
            continue
        middle = (low + high) / 2
        between = above(middle)
        open_ += [(low, middle, many, between), (middle, high, between, few)]
    found = np.array(vectors[:count]).T.reshape(len(v), -1)
    for _ in range(2):  # neighbours of a close eigenvalue lose digits of their right angle
        for k in range(found.shape[1]):
            found[:, k] -= found[:, :k] @ (found[:, :k].T @ found[:, k])
            found[:, k] /= np.linalg.norm(found[:, k])
    return np.array(values[:count]) * trace, found


@dataclass
class Whitening:
    """For vectors of one length: their distinct number, sums and whole centre, eigenvalues, trace, and the projection to unit variance."""

    n: int
    sums: list[int]
    centre: np.ndarray
    values: np.ndarray
    trace: float
    projection: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        rest = np.array([float(Fraction(s, self.n) - int(c)) for s, c in zip(self.sums, self.centre, strict=True)])
        return (x - self.centre - rest) @ self.projection

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of squares of n x - S, exact."""
        d = x - self.centre
        rest = [s - self.n * int(c) for s, c in zip(self.sums, self.centre, strict=True)]
        if len(self.sums) * (self.n * (int(np.abs(d).max(initial=0)) + 1)) ** 2 < 2**63:
            return [int(v) for v in ((self.n * d - np.array(rest, np.int64)) ** 2).sum(1)]
        exact = ((self.n * d.astype(object) - np.array(rest, object)) ** 2).sum(1)
        return [int(v) if v < 2**63 else None for v in exact]


def fit(points: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """By length, the whitening fitted on distinct integer vectors (column ``x``)."""
    sums = _matrices(_summed(points, lambda dim, x: np.vstack([x.sum(0).astype(object), np.full(dim, len(x), object)])))
    counts = {dim: rows[1][0] for dim, rows in sums.items()}
    centres = {dim: np.array([round(Fraction(s, counts[dim])) for s in rows[0]], np.int64) for dim, rows in sums.items()}
    shared = points.sparkSession.sparkContext.broadcast(centres)
    squares = _matrices(_summed(points, lambda dim, x: _products(x - shared.value[dim], x - shared.value[dim])))
    out = {}
    for dim, (total, _) in sums.items():
        n, rest = counts[dim], [s - counts[dim] * int(c) for s, c in zip(total, centres[dim], strict=True)]
        exact = [[Fraction(n * squares[dim][i][j] - rest[i] * rest[j], n * n) for j in range(dim)] for i in range(dim)]
        covariance = np.array([[float(v) for v in row] for row in exact])
        values, vectors = leading(covariance, components)
        out[dim] = Whitening(n, total, centres[dim], values, float(sum(exact[i][i] for i in range(dim))), vectors / np.sqrt(values))
    return out


def identity_errors(points: DataFrame, fitted: dict[int, Whitening]) -> dict[int, float]:
    """By length, the largest absolute entry of the whitened fit list's covariance minus the identity.

    Blocks are centred by their own mean before they are multiplied, then joined with the spread of their means, in a task and over tasks.
    """
    shared = points.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for dim, x, _ in _blocks(batches):
            w = shared.value[dim].apply(x)
            n, mean = len(w), w.mean(0)
            inner = (w - mean).T @ (w - mean)
            if dim in held:
                m, other, before = held[dim]
                apart = mean - other
                inner = before + inner + np.outer(apart, apart) * (m * n / (m + n))
                n, mean = m + n, other + apart * (n / (m + n))
            held[dim] = n, mean, inner
        for dim, (n, mean, inner) in held.items():
            for i in range(len(mean)):
                yield pd.DataFrame({"dim": np.int32(dim), "i": np.int32(i), "j": np.arange(len(mean), dtype=np.int32), "n": n, "mi": mean[i], "mj": mean, "inner": inner[i]})

    parts = points.select("x").mapInPandas(run, "dim int, i int, j int, n long, mi double, mj double, inner double")
    n = F.sum("n")
    spread = F.sum(F.col("n") * F.col("mi") * F.col("mj")) - F.sum(F.col("n") * F.col("mi")) * F.sum(F.col("n") * F.col("mj")) / n
    entry = (F.sum("inner") + spread) / n - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)
    worst = parts.groupBy("dim", "i", "j").agg(entry.alias("off")).groupBy("dim").agg(F.max(F.abs("off")).alias("off"))
    return {r.dim: r.off for r in worst.collect()}


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per sound row and component: the projection of unit variance, the row's exact deviation, and what the fit says of itself."""
    # as text, an id passes through pandas unchanged beside nulls
    rows = vectors.select(F.col("vec_id").cast("string").alias("id"), integers(F.col("embedding")).alias("x")).where("x IS NOT NULL")
    points = stored(rows.select("x").distinct(), "whitening-points")
    fitted = fit(points, components)
    errors = identity_errors(points, fitted)
    shared = vectors.sparkSession.sparkContext.broadcast((fitted, errors))
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, off = shared.value
        for dim, x, some in _blocks(batches):
            model = known[dim]
            w, k = model.apply(x), len(model.values)
            if k:
                yield pd.DataFrame({"id": some["id"].repeat(k).reset_index(drop=True), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), "n": model.n,
                                    "deviation": pd.array(model.deviation(x), "Int64").repeat(k), "whitened": w.ravel(), "explained": np.tile(model.values / model.trace, len(x)),
                                    "identity_error": off[dim]})

    out = rows.mapInPandas(run, "id string, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.select(F.col("id").cast(kind).alias("vec_id"), *out.columns[1:])
