"""Whitening of embeddings by spectral divide and conquer over polar decompositions.

An entry ``c`` counts as the whole number ``floor(scale * c) + offset``, so sums and deviations are exact.  Three passes over the
vectors fit the model: exact sums per dimension, the covariance of the centred vectors, and the covariance of the whitened ones as
a check.  Each task sends one partial result, whose size depends on the number of dimensions alone; Spark adds them up.  The
covariance, at most ``MAX_DIMENSIONS`` squared whatever the number of vectors, is taken apart on the driver:

- the polar factor of the covariance less a shift, by QDWH (dynamically weighted Halley) iterations, is the sign of each eigenvalue
  against the shift; with it, half the sum of that factor and the identity is the projector on the eigenvectors above the shift;
- the projector splits the space in two invariant subspaces, and both go on in the same way, down to single directions.

The eigenvectors of largest eigenvalue, over the roots of their eigenvalues, go to every task with the closure.

Dropped are vectors that are null, empty, hold a null, NaN or infinite entry, or have another length than most vectors (of lengths
that are equally frequent, the greater).  Entries beyond 2**53 in size count as 2**53.  Repeated rows, and rows of equal or null id, count one
by one.  An empty table, or one without a vector that remains, gives no rows.  A component whose eigenvalue is zero (to rounding) has
a null ``whitened``; a deviation beyond 64 bits is null.  Texts play no part, and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What the driver holds is at most this number squared.
MAX_DIMENSIONS = 4096
LARGEST = 2.0**53
EPS = np.finfo(np.float64).eps


# -- the spectral part, on one small symmetric matrix ----------------------------------------------------------------------------

def polar_factor(a: np.ndarray, most: int = 40) -> np.ndarray:
    """The symmetric orthogonal polar factor of a symmetric matrix, by QDWH; eigenvalues become their signs."""
    n = len(a)
    eye = np.eye(n)
    x = a / max(np.abs(a).sum(axis=0).max(), np.finfo(np.float64).tiny)
    try:  # a lower bound of the least singular value; too small a one costs iterations, not digits
        least = 1.0 / np.abs(np.linalg.inv(x)).sum(axis=0).max()
    except np.linalg.LinAlgError:
        least = EPS
    least = min(max(least, EPS), 1.0) if np.isfinite(least) else EPS
    for _ in range(most):
        l2 = least * least
        d = np.cbrt(4.0 * (1.0 - l2) / (l2 * l2))
        root = np.sqrt(1.0 + d)
        wa = root + 0.5 * np.sqrt(8.0 - 4.0 * d + 8.0 * (2.0 - l2) / (l2 * root))
        wb = (wa - 1.0) ** 2 / 4.0
        wc = wa + wb - 1.0
        if wc > 100.0:  # the form that stays accurate while singular values are small
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            low = np.linalg.cholesky(eye + wc * x.T @ x)
            half = np.linalg.solve(low, x.T)
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(low.T, half).T
        new = (new + new.T) / 2.0
        step = np.linalg.norm(new - x)
        x = new
        least = min(1.0, least * (wa + wb * l2) / (1.0 + wc * l2))
        if step <= np.cbrt(5.0 * EPS) and abs(1.0 - least) <= 10.0 * EPS:
            break
    return x


def _shifts(diagonal: np.ndarray) -> Iterator[float]:
    """Places to cut a spectrum at: the median of the diagonal, its mean, which always lies inside, and places next to the mean."""
    yield float(np.median(diagonal))
    mean, wide = float(diagonal.mean()), float(np.ptp(diagonal))
    yield mean
    for k in range(1, 8):
        for side in (1, -1):
            yield mean + side * wide * 0.37**k


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces, the one of greater eigenvalues first; None if all eigenvalues are equal to rounding."""
    n = len(a)
    tight, best = 50.0 * n * EPS * scale, None
    if np.abs(a - np.diag(np.diag(a))).max() <= EPS * scale and np.ptp(np.diag(a)) <= EPS * scale:
        return None
    start = np.random.default_rng(n).standard_normal((n, n))
    for shift in _shifts(np.diag(a)):
        projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2.0
        rank = int(round(float(np.trace(projector))))
        if not 0 < rank < n:
            continue
        basis = projector @ start[:, :rank]
        for _ in range(3):
            q, _ = np.linalg.qr(basis, mode="complete")
            above, below = q[:, :rank], q[:, rank:]
            coupled = np.abs(below.T @ a @ above).max()
            if best is None or coupled < best[0]:
                best = (coupled, above, below)
            if coupled <= tight:
                return above, below
            basis = projector @ above
    return best[1:] if best is not None and best[0] <= 1e4 * tight else None


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and their unit eigenvectors as columns, by divide and conquer."""
    n = len(a)
    a = (a + a.T) / 2.0
    scale = float(np.abs(a).sum(axis=0).max()) if n else 0.0
    open_, done = [np.eye(n)] if n else [], []
    while open_:
        basis = open_.pop()
        block = basis.T @ a @ basis
        block = (block + block.T) / 2.0
        parts = _split(block, scale) if len(block) > 1 and scale > 0.0 else None
        if parts is None:
            done.append(basis)
        else:
            open_ += [basis @ p for p in parts]
    vectors = np.hstack(done) if done else np.zeros((0, 0))
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# -- the passes over the vectors ---------------------------------------------------------------------------------------------------

def _rows(column: pa.Array, scale: float, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the vectors that count: row numbers, lengths, and all their whole numbers one after the other."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    good = lengths > 0
    good[row[~np.isfinite(values)]] = False
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(values[good[row]] * scale), -LARGEST, LARGEST).astype(np.int64) + offset
    at = np.flatnonzero(good)
    return at, lengths[at], whole


def _matrix(column, scale: float, offset: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and whole numbers of the vectors of ``size`` entries."""
    at, lengths, whole = _rows(column, scale, offset)
    fits = lengths == size
    return at[fits], whole[np.repeat(fits, lengths)].reshape(-1, size)


@dataclass(frozen=True)
class Whitening:
    """A fitted model; ``vectors`` has the components as columns."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: float
    offset: int

    def centred(self, whole: np.ndarray) -> np.ndarray:
        """Numbers less their mean; the whole part of the mean goes first, so only one rounding is left."""
        floor = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (whole - floor) - rest

    def deviations(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact sums of squares of ``n * x - sum``, and whether they fit in 64 bits."""
        rough = ((self.centred(whole) * self.n) ** 2).sum(axis=1)
        low = np.array([s % 2**64 for s in self.sums], dtype=np.uint64)
        with np.errstate(over="ignore"):  # right modulo 2**64, so right wherever the sum fits
            off = whole.astype(np.uint64) * np.uint64(self.n % 2**64) - low
            exact = (off * off).sum(axis=1, dtype=np.uint64).astype(np.int64)
        fits = rough < 2.0**63 * (1 - 1e-6)
        for k in np.flatnonzero((rough >= 2.0**63 * (1 - 1e-6)) & (rough < 2.0**63 * (1 + 1e-6))):
            total = sum((self.n * int(x) - s) ** 2 for x, s in zip(whole[k], self.sums))
            if total < 2**63:
                exact[k], fits[k] = total, True
        return exact, fits

    def weights(self, components: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns that whiten, and which of them have an eigenvalue above rounding; the others are zero."""
        k = min(components, len(self.sums))
        live = self.values[:k] > len(self.sums) * EPS * max(self.trace, 0.0)
        roots = np.sqrt(np.where(live, self.values[:k], 1.0))
        return np.where(live, self.vectors[:, :k] / roots, 0.0), live

    def explained(self, components: int) -> list[float | None]:
        return [float(v / self.trace) if self.trace > 0.0 else None for v in self.values[:components]]


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    return df.select(F.col(vector).alias("v"))


def _sums(df: DataFrame, vector: str, scale: float, offset: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums per dimension, over the vectors of the most frequent length."""

    def partial(batches):
        found: dict[int, list] = {}
        for batch in batches:
            _, lengths, whole = _rows(batch.column(0), scale, offset)
            for size in np.unique(lengths).tolist():
                x = whole[np.repeat(lengths == size, lengths)].reshape(-1, size)
                # in two parts, as a sum of large entries can need more than 64 bits
                totals = [(int(h) << 26) + int(lo) for h, lo in zip((x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0))]
                kept = found.setdefault(size, [0, [0] * size])
                kept[0] += len(x)
                kept[1] = [a + b for a, b in zip(kept[1], totals)]
        for size, (n, totals) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()),
                 pa.array([Decimal(t) for t in totals], pa.decimal128(38, 0))], names=["size", "i", "n", "total"])

    parts = _vectors(df, vector).mapInArrow(partial, "size int, i int, n long, total decimal(38,0)")
    added = parts.groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    size = added.filter("i = 0").orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not size:
        return 0, []
    if size[0].size > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {size[0].size} dimensions; at most {MAX_DIMENSIONS} are taken")
    rows = added.filter(F.col("size") == size[0].size).collect()
    return size[0].n, [int(r.total) for r in sorted(rows, key=lambda r: r.i)]


def _added(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of the tasks' partial matrices, which come as rows ``(i, line)``."""
    out = np.zeros((size, size))
    for r in parts.select("i", F.posexplode("line").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        out[r.i, r.j] = r.x
    return out


def _lines(matrix: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(matrix)), pa.int32()), pa.array(matrix.tolist(), pa.list_(pa.float64()))], names=["i", "line"])


def fit(df: DataFrame, vector: str = "embedding", scale: float = 1024.0, offset: int = 100_000) -> Whitening:
    """Means, covariance and components of all vectors."""
    n, sums = _sums(df, vector, scale, offset)
    if not n:
        return Whitening(0, (), np.zeros(0), np.zeros((0, 0)), 0.0, scale, offset)
    size = len(sums)
    model = Whitening(n, tuple(sums), np.zeros(size), np.eye(size), 0.0, scale, offset)

    def partial(batches):
        total = np.zeros((size, size))
        for batch in batches:
            _, whole = _matrix(batch.column(0), scale, offset, size)
            x = model.centred(whole)
            total += x.T @ x
        yield _lines(total)

    covariance = _added(_vectors(df, vector).mapInArrow(partial, "i int, line array<double>"), size) / n
    values, vectors = spectrum(covariance)
    return Whitening(n, tuple(sums), values, vectors, float(np.trace(covariance)), scale, offset)


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding", components: int = 8) -> float | None:
    """The largest entry, in size, of the covariance of all whitened vectors less the identity; null without a component that can be whitened."""
    weights, live = model.weights(components) if model.n else (np.zeros((0, 0)), np.zeros(0, dtype=bool))
    k = int(live.sum())
    if not k:
        return None
    weights, size = weights[:, live], len(model.sums)

    def partial(batches):  # centred on the task's own mean; the means are put together below
        n, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            _, whole = _matrix(batch.column(0), model.scale, model.offset, size)
            if not len(whole):
                continue
            w = model.centred(whole) @ weights
            here, m = w.mean(axis=0), len(w)
            gap = here - mean
            spread += (w - here).T @ (w - here) + np.outer(gap, gap) * (n * m / (n + m))
            mean = mean + gap * (m / (n + m))
            n += m
        # one matrix: spread around the mean, and the mean's own products in a last line and column
        out = np.zeros((k + 1, k + 1))
        out[:k, :k] = spread + n * np.outer(mean, mean)
        out[k, :k] = n * mean
        yield _lines(out)

    total = _added(_vectors(df, vector).mapInArrow(partial, "i int, line array<double>"), k + 1)
    mean = total[k, :k] / model.n
    return float(np.abs(total[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8, scale: float = 1024.0, offset: int = 100_000) -> DataFrame:
    """One row per remaining vector and component: its whitened coordinate, the component's share of the variance and the model's error."""
    model = fit(df, vector, scale, offset)
    error = identity_error(df, model, vector, components)
    kept = df.select(F.col(key).alias("vec_id"), F.col(vector).alias("v"))
    schema = T.StructType([kept.schema["vec_id"], T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
                           T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
                           T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    if not model.n:
        return df.sparkSession.createDataFrame([], schema)
    weights, live = model.weights(components)
    share, size, k = model.explained(weights.shape[1]), len(model.sums), weights.shape[1]

    def rows(batches):
        for batch in batches:
            at, whole = _matrix(batch.column(1), model.scale, model.offset, size)
            if not len(at):
                continue
            exact, fits = model.deviations(whole)
            many, which = len(at) * k, np.tile(np.arange(k), len(at))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(which + 1, pa.int32()), pa.array(np.full(many, model.n), pa.int64()),
                 pa.array(np.repeat(exact, k), pa.int64(), mask=np.repeat(~fits, k)),
                 pa.array((model.centred(whole) @ weights).reshape(-1), pa.float64(), mask=~live[which]),
                 pa.array(share * len(at), pa.float64()), pa.array([error] * many, pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.mapInArrow(rows, schema)
