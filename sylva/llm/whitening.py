"""Embedding whitening (operator 12): leading eigenvectors of the covariance by LOBPCG, then rows projected and scaled.

The covariance V of the centred rows is never formed. Each round multiplies it by a block of directions in one pass: a task adds up
c' (c B) of its centred rows c, cells of all tasks are summed by a shuffle, and the driver gets dimensions times columns numbers. The
block is an orthonormal basis of the present vectors, their residuals and the directions of the round before; Rayleigh-Ritz on it gives the
next vectors. Rounds end when the residuals of all wanted vectors are certified: |V x - e x| <= TOLERANCE times the largest e, or,
where rounding allows no better, when they stop falling below CERTIFIED. More vectors than wanted are kept, so the gap that convergence depends on is wider.

Entries are whole numbers (floor(1024 c) + 100000), so sums, the mean and the trace are exact; a centred entry is x minus the whole part of the
mean, minus the rest of it, whatever the number of rows. Nothing but sums leaves a task; a lost executor costs its tasks of one round.

Defined results: null vectors and vectors with null or non-finite entries take no part; of vectors of several lengths those of the
commonest take part (of equally common ones the longest), others don't; empty vectors have no components and give no rows; entries beyond 2**44
count as that; a null id is kept; repeated rows count as often as they are there; equal eigenvalues have any orthonormal vectors
of their space; a component without variance has whitened null and takes no part in identity_error; a deviation that 38 digits can't hold is null;
an empty table gives no rows; columns other than vec_id and embedding, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components, and vectors iterated beside them.
COMPONENTS, GUARD = 8, 8
#: Residuals as a part of the largest eigenvalue: the aim, and what is certified where rounding stops them above it.
TOLERANCE, CERTIFIED, ROUNDS = 4e-15, 1e-11, 500
#: Entries in whole numbers: scale, shift and the largest size before the shift.
SCALE, SHIFT, LARGEST = 1024.0, 100_000, 1 << 44
SEED = 12


def whole_rows(batch: pa.RecordBatch, d: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and whole numbers of the vectors of d finite entries."""
    ids, vectors = batch.column("vec_id"), batch.column("embedding")
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), d), False)
    ids, vectors = ids.filter(fits), vectors.filter(fits)
    c = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    finite = np.isfinite(c).all(axis=1)
    x = np.clip(np.floor(SCALE * c[finite]), -LARGEST, LARGEST).astype(np.int64) + SHIFT
    return ids.filter(pa.array(finite)), x


@dataclass
class FitList:
    """Rows n of d entries; mean = floor + rest / n in each dimension; trace of the covariance."""

    n: int
    d: int
    floor: np.ndarray
    rest: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum of (n x - S)^2 over the dimensions, exact: with a = x - floor it is n^2 sum(a^2) - 2 n sum(a rest) + sum(rest^2)."""
        a = x - self.floor
        largest = int(np.abs(a).max(initial=0))
        rest = self.rest
        if max(largest, 1) * self.d * max(largest, self.n) >= 1 << 62:
            a, rest = a.astype(object), rest.astype(object)
        squares, products = (a * a).sum(axis=1).tolist(), (a * rest).sum(axis=1).tolist()
        own = sum(int(v) ** 2 for v in self.rest)
        return [self.n * self.n * s - 2 * self.n * p + own for s, p in zip(squares, products, strict=True)]


def _vectors(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "embedding").where("embedding is not null")


def fit_list(df: DataFrame) -> FitList | None:
    """Sums over the vectors that take part; none if there are none."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    common = _vectors(df).where(finite).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not common or not common[0]["d"]:
        return None
    d = common[0]["d"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (d + 2)
        for batch in batches:
            x = whole_rows(batch, d)[1]
            total[d] += len(x)
            for k, s in enumerate(x.sum(axis=0, dtype=object if len(x) > 1 << 16 else np.int64).tolist()):
                total[k] += s
            y = x - SHIFT
            small = np.abs(y).max(initial=0) < 1 << 20
            total[d + 1] += int((y * y).sum() if small else (y.astype(object) ** 2).sum()) + 2 * SHIFT * int(y.sum(dtype=object if not small else None)) + SHIFT * SHIFT * y.size
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 2), pa.int32()), pa.array(total, pa.decimal128(38, 0))], ["cell", "value"])

    rows = _vectors(df).mapInArrow(sums, "cell int, value decimal(38,0)").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    total = {r["cell"]: int(r["value"]) for r in rows}
    n, s = total[d], [total[k] for k in range(d)]
    trace = Fraction(n * total[d + 1] - sum(v * v for v in s), n * n)
    return FitList(n, d, np.array([v // n for v in s], np.int64), np.array([v % n for v in s], np.int64), float(trace))


def covariance_times(df: DataFrame, fit: FitList, block: np.ndarray) -> np.ndarray:
    """V block, from one pass over the rows."""
    d, width = block.shape

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, width))
        for batch in batches:
            c = fit.centred(whole_rows(batch, d)[1])
            total += c.T @ (c @ block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * width), pa.int32()), pa.array(total.ravel(), pa.float64())], ["cell", "value"])

    rows = _vectors(df).mapInArrow(product, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(d * width)
    for r in rows:
        out[r["cell"]] = r["value"]
    return out.reshape(d, width) / fit.n


def _orthonormal(blocks: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of the blocks' columns, those of the first block first; columns that the ones before hold are left out."""
    basis = blocks[0]
    for block in blocks[1:]:
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 0] / size[size > 0]
        for _ in range(3):  # once more is enough against rounding, once more again where columns nearly vanish
            block = block - basis @ (basis.T @ block)
            u, s, _ = np.linalg.svd(block, full_matrices=False)
            block = u[:, s > 1e-8]
        basis = np.hstack([basis, block[:, : basis.shape[0] - basis.shape[1]]])
    return basis


@dataclass
class Components:
    """Eigenvalues falling, unit eigenvectors as columns, the residual of each, and the rounds it took."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    rounds: int


def lobpcg(times, d: int, wanted: int = COMPONENTS, guard: int = GUARD, seed: int = SEED) -> Components:
    """Largest eigenpairs of the symmetric operator times(block) of d dimensions."""
    wanted = min(wanted, d)
    m = min(d, wanted + guard)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, m)))[0]
    first, best, still = m, np.inf, 0
    for done in range(1, ROUNDS + 1):
        image = times(basis)
        small = basis.T @ image
        values, mix = np.linalg.eigh((small + small.T) / 2)
        values, mix = values[::-1][:m], mix[:, ::-1][:, :m]
        x, ax = basis @ mix, image @ mix
        moved = basis[:, first:] @ mix[first:]
        residual = ax - x * values
        sizes = np.linalg.norm(residual, axis=0)
        worst = float(sizes[:wanted].max()) if wanted else 0.0
        scale = max(float(values[0]), 0.0)
        still = 0 if worst < 0.5 * best else still + 1
        best = min(best, worst)
        if worst <= TOLERANCE * scale or (worst <= CERTIFIED * scale and still >= 2) or basis.shape[1] == d and still >= 1:
            return Components(values[:wanted], x[:, :wanted], sizes[:wanted], done)
        x = np.linalg.qr(x)[0]
        first = m
        basis = _orthonormal([x, residual, moved])
    raise ArithmeticError(f"residuals stay at {worst / scale:.1e} of the largest eigenvalue after {ROUNDS} rounds")


def principal_components(df: DataFrame, fit: FitList, wanted: int = COMPONENTS) -> Components:
    return lobpcg(lambda block: covariance_times(df, fit, block), fit.d, wanted)


def whitened_rows(df: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector that takes part and component."""
    kinds = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    df = df.selectExpr("cast(vec_id as long) vec_id", "embedding")
    fit = fit_list(df)
    if fit is None:
        return df.sparkSession.createDataFrame([], kinds)
    found = principal_components(df, fit, wanted)
    spread = found.values > fit.d * np.finfo(float).eps * max(float(found.values[0]), 0.0)
    scaled = found.vectors / np.sqrt(np.where(spread, found.values, 1.0))
    explained = (found.values / fit.trace if fit.trace else np.full(len(found.values), np.nan)).tolist()
    error = identity_error(df, fit, scaled[:, spread]) if spread.any() else None
    names, k = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"], len(found.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = whole_rows(batch, fit.d)
            z = fit.centred(x) @ scaled
            deviations = [v if v < 10**38 else None for v in fit.deviations(x)]
            each = pa.array(np.repeat(np.arange(len(x)), k))
            nothing = np.tile(~spread, len(x))
            yield pa.RecordBatch.from_arrays([
                ids.take(each), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(k * len(x), fit.n), pa.int64()),
                pa.array(deviations, pa.decimal128(38, 0)).take(each), pa.array(z.ravel(), pa.float64(), mask=nothing),
                pa.array([None if v != v else v for v in explained], pa.float64()).take(pa.array(np.tile(np.arange(k), len(x)))), pa.array([error] * (k * len(x)), pa.float64()),
            ], names)

    return _vectors(df).mapInArrow(project, kinds)


def identity_error(df: DataFrame, fit: FitList, scaled: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""
    k = scaled.shape[1]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            z = fit.centred(whole_rows(batch, fit.d)[1]) @ scaled
            total[:k] += z.T @ z
            total[k] += z.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel(), pa.float64())], ["cell", "value"])

    total = np.zeros((k + 1) * k)
    for r in _vectors(df).mapInArrow(moments, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        total[r["cell"]] = r["value"]
    total = total.reshape(k + 1, k) / fit.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())
