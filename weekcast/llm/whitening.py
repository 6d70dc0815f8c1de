"""Embedding whitening: leading components of the covariance by spectrum slicing.

A vector's entries are taken on an integer grid, ``x = floor(SCALE * c) + OFFSET``, so that sums are
exact whatever the order of the tasks. Three passes over the table (sums, covariance about the exact
mean, covariance of the whitened rows) each leave one partial result per task, which Spark adds up;
what reaches the driver has the size of the dimension squared, whatever the number of rows.

The driver slices the spectrum of the covariance V. The pivots' signs of an LDL' factorisation of
V - s*I count the eigenvalues below s (Sylvester's law of inertia), so bisection on the counts gives
every leading eigenvalue an interval of its own; inverse iteration there and Rayleigh quotient
iteration (cubic convergence) then give value and vector, and two more counts, just below and just
above the value, certify its number. Eigenvalues that no interval separates (closer than rounding)
share one and get an orthonormal basis of their common space.

Defined cases: vectors that are null, or hold null or non-finite entries or entries too large for an
exact ``x`` (beyond 2**52), take no part, nor do those of another dimension than the most frequent
one (of equally frequent ones the smaller); a component whose eigenvalue is zero to rounding gives no
rows (so equal vectors, a single one and an empty table give none); rows that repeat an id give their
rows each; a null id is kept; other columns are ignored. ``deviation`` is exact; a value beyond a
long raises an error rather than wrapping.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Entries beyond this have no exact place on the grid.
LARGEST = float(2**52)
#: Vectors that one numpy step takes at a time.
ROWS = 4096

#: An interval is used when it holds one eigenvalue, and no other lies within so many widths of it.
GUARD = 16

_EPS = np.finfo(float).eps
#: Bunch and Parlett's constant: a diagonal pivot at least this share of the largest entry is stable.
_ALPHA = (1 + 17**0.5) / 8


def eigenvalues_below(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``v`` are less than ``shift``: the negative pivots of a
    completely pivoted LDL' of ``v - shift * I`` (a 2 x 2 pivot has one of either sign)."""
    a = v - shift * np.eye(len(v))
    below = 0
    while len(a):
        size = np.abs(a)
        r = int(size.diagonal().argmax())
        i, j = np.unravel_index(int(size.argmax()), a.shape)
        if size[r, r] >= _ALPHA * size[i, j]:
            if a[r, r] == 0:  # nothing but zeros is left: eigenvalues equal to the shift
                return below
            below += bool(a[r, r] < 0)
            rest = np.delete(np.arange(len(a)), r)
            column = a[rest, r]
            a = a[np.ix_(rest, rest)] - np.outer(column, column / a[r, r])
        else:
            below += 1
            rest = np.delete(np.arange(len(a)), [i, j])
            pair = a[np.ix_([i, j], [i, j])]
            columns = a[np.ix_(rest, [i, j])]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(pair, columns.T)
    return below


def _solved(a: np.ndarray, b: np.ndarray, nudge: float) -> np.ndarray:
    """``a``'s solution for ``b``, of a neighbour of ``a`` where it is singular to working precision."""
    try:
        x = np.linalg.solve(a, b)
        if np.isfinite(x).all():
            return x
    except np.linalg.LinAlgError:
        pass
    return np.linalg.solve(a + nudge * np.eye(len(a)), b)


def _basis(v: np.ndarray, lo: float, hi: float, m: int, known: np.ndarray, nudge: float) -> tuple[np.ndarray, np.ndarray]:
    """Values (falling) and orthonormal vectors (columns) of the ``m`` eigenvalues between ``lo`` and ``hi``."""
    space = np.random.default_rng(len(known)).standard_normal((len(v), m))
    middle = (lo + hi) / 2
    for _ in range(4):  # inverse iteration, kept clear of the vectors that are known
        space = _solved(v - middle * np.eye(len(v)), space, nudge)
        space /= np.abs(space).max(axis=0)
        for _ in range(2):
            space -= known.T @ (known @ space)
            space, _ = np.linalg.qr(space)
    if m == 1:
        x = space[:, 0]
        e = x @ v @ x
        best = np.linalg.norm(v @ x - e * x)
        for _ in range(12):  # Rayleigh quotient iteration
            y = _solved(v - e * np.eye(len(v)), x, nudge)
            y /= np.linalg.norm(y)
            rho = y @ v @ y
            left = np.linalg.norm(v @ y - rho * y)
            if not lo - nudge <= rho <= hi + nudge or left >= best:
                break
            x, e, best = y, rho, left
        for _ in range(2):
            x = x - known.T @ (known @ x)
            x /= np.linalg.norm(x)
        return np.array([x @ v @ x]), x[:, None]
    values, turned = np.linalg.eigh(space.T @ v @ space)
    return values[::-1], (space @ turned)[:, ::-1]


def leading_components(v: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of the covariance ``v`` that aren't zero, falling, and their unit vectors (rows)."""
    d = len(v)
    norm = float(np.abs(v).sum(axis=1).max(initial=0.0))
    if not norm:
        return np.empty(0), np.empty((0, d))
    nudge = 4 * d * _EPS * norm
    values, vectors = np.empty(0), np.empty((0, d))
    counts = {norm + nudge: d}

    def below(s: float) -> int:
        if s not in counts:
            counts[s] = eigenvalues_below(v, s)
        return counts[s]

    hi = norm + nudge
    while len(values) < min(count, d):
        k = d - len(values) - 1  # of the eigenvalues in rising order, the one that comes next
        lo = nudge
        if below(lo) > k:
            break  # what is left is zero to rounding
        top = hi
        while True:  # the interval [lo, top) holds number k
            width = top - lo
            if width <= nudge:  # as narrow as rounding allows: neighbours that near are one cluster
                while below(lo - GUARD * nudge) < below(lo):
                    lo -= GUARD * nudge
                break
            if below(top + GUARD * width) - below(lo - GUARD * width) == 1:
                break
            middle = (lo + top) / 2
            if below(middle) <= k:
                lo = middle
            else:
                top = middle
        e, x = _basis(v, lo, top, max(1, below(top) - below(lo)), vectors, nudge)
        values, vectors = np.concatenate((values, e)), np.vstack((vectors, x.T))
        hi = lo
    values, vectors = values[:count], vectors[:count]
    for k, e in enumerate(values):  # certified: at most k eigenvalues above, and more than k from here on
        above, at_least = d - below(e + 4 * nudge), d - below(e - 4 * nudge)
        if above > k or at_least <= k:
            raise ArithmeticError(f"eigenvalue {k + 1} could not be certified: {above} above it, {at_least} from it on")
    return values, vectors


@dataclass
class Whitening:
    """A fitted whitening: exact row count and sums, leading values and vectors, trace of the covariance."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of integer rows."""
        whole, part = np.divmod(self.sums, max(self.n, 1))
        centred = (x - whole) - part / max(self.n, 1)
        return centred @ self.vectors.T / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - sums)**2, exact."""
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * self.n + int(np.abs(self.sums).max(initial=0))
        if most < 2**63:
            apart = x * self.n - self.sums
            largest = max(int(apart.max(initial=0)), -int(apart.min(initial=0)))
            if largest**2 * x.shape[1] < 2**63:
                return (apart * apart).sum(axis=1)
        apart = x.astype(object) * self.n - self.sums.astype(object)
        return (apart * apart).sum(axis=1)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id`` and ``vector`` (doubles) of the rows that take part."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    return rows.where(F.forall("vector", lambda c: F.coalesce(F.abs(c) * SCALE < LARGEST, F.lit(False)) & ~F.isnan(c)))


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for start in range(0, batch.num_rows, ROWS):
        part = batch.slice(start, ROWS)
        flat = part.column("vector").flatten().to_numpy(zero_copy_only=False)
        yield part, np.floor(flat * SCALE).astype(np.int64).reshape(part.num_rows, -1) + OFFSET


def _added(df: DataFrame, keys: list[str]) -> dict:
    """The sums per key; as many rows as entries of one partial result."""
    found = df.groupBy(*keys).agg(F.sum("value").alias("value")).toArrow()
    return {tuple(k): v for *k, v in zip(*(found.column(c).to_pylist() for c in [*keys, "value"]))}


def fit(rows: DataFrame, count: int = COMPONENTS) -> Whitening:
    """The whitening of ``rows`` (see :func:`usable`; all of one dimension)."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            for part, x in _batches(batch):
                n += part.num_rows
                sums = x.sum(axis=0) if sums is None else sums + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(sums))), pa.array(np.concatenate(([n], sums)))], ["i", "value"])

    found = _added(rows.mapInArrow(totals, "i long, value long"), ["i"])
    n = found.get((-1,), 0)
    sums = np.array([found[(i,)] for i in range(len(found) - 1)], np.int64)
    d = len(sums)
    if not n or not d:
        return Whitening(n, sums, np.empty(0), np.empty((0, d)), 0.0)
    whole, part = np.divmod(sums, n)
    rest = part / n

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((d, d))
        for batch in batches:
            for _, x in _batches(batch):
                centred = (x - whole) - rest
                gram += centred.T @ centred
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(gram[i, j])], ["i", "j", "value"])

    cov = np.zeros((d, d))
    for (i, j), value in _added(rows.mapInArrow(products, "i long, j long, value double"), ["i", "j"]).items():
        cov[i, j] = cov[j, i] = value / n
    values, vectors = leading_components(cov, count)
    return Whitening(n, sums, values, vectors, float(np.trace(cov)))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry of |covariance of the whitened rows - identity|, over all rows.

    Every task centres its own whitened rows; the tasks' means then correct for what they differ by.
    """
    k = len(model.values)
    if not k:
        return 0.0

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            for _, x in _batches(batch):
                total += model.whitened(x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(total)], ["i", "value"])

    total = _added(rows.mapInArrow(means, "i long, value double"), ["i"])
    mean = np.array([total[(i,)] for i in range(k)]) / model.n

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((k, k))
        for batch in batches:
            for _, x in _batches(batch):
                w = model.whitened(x) - mean
                gram += w.T @ w
        i, j = np.indices((k, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(gram.ravel())], ["i", "j", "value"])

    found = _added(rows.mapInArrow(products, "i long, j long, value double"), ["i", "j"])
    return max(abs(v / model.n - (i == j)) for (i, j), v in found.items())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """One row per remaining vector and component: ``id_col``, ``component`` (from 1), ``n``, ``deviation``,
    ``whitened``, ``explained`` (share of the variance) and ``identity_error`` (one value)."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    kind = vectors.schema[id_col].dataType
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("vector") == (sizes["d"] if sizes else 0))
    model = fit(rows, count)
    error = identity_error(rows, model)
    schema = f"id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    known, k = spark.sparkContext.broadcast(model), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for batch in batches:
            for part, x in _batches(batch) if k else ():
                m = part.num_rows
                at = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(at),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n, np.int64)),
                        pa.array(np.repeat(model.deviation(x), k), pa.int64()),
                        pa.array(model.whitened(x).ravel()),
                        pa.array(np.tile(model.values / (model.trace or 1.0), m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
