"""Whitening of vectors by an incremental eigendecomposition.

1. Each task takes its vectors one after the other as centred rank-one updates of the spectrum
   of their scatter matrix: Q diag(D) Q' + rho v v' is diagonal again once the secular equation
   is solved, entries that the update does not reach and equal eigenvalues being set aside first.
2. Spectra of tasks are combined in groups of FAN until one is left: the eigenpairs of one are
   rank-one updates of the other, and the distance of the means is one more.
3. Rayleigh-Ritz: the covariance is summed anew, over all tasks, in the basis found, and its
   small matrix diagonalised, which removes what rounding added up over many updates.

A task holds one spectrum (dimensions squared); the driver gets the last one only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obscast.llm.shared import Scratch

#: Factor and offset that turn entries into whole numbers, and components returned at most.
FACTOR, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Vectors that a task takes into one spectrum, and spectra that a task combines.
ROWS, FAN = 4096, 16
#: Entries beyond this many whole steps are not exact in double precision.
EXACT = float(1 << 52)
EPS = np.finfo(float).eps
#: Share of the trace below which a direction counts as without variance.
FLAT = 1e-12


class Spectrum:
    """Count, mean and the scatter matrix's eigenvalues (rising) and eigenvectors."""

    def __init__(self, dim: int):
        self.n, self.mean = 0, np.zeros(dim)
        self.values, self.vectors = np.zeros(dim), np.eye(dim)

    def add(self, x: np.ndarray) -> None:
        """A centred rank-one update by one vector."""
        apart = x - self.mean
        self.update(self.n / (self.n + 1), apart)
        self.n += 1
        self.mean = self.mean + apart / self.n

    def merge(self, other: Spectrum) -> None:
        """The other's eigenpairs and the distance of the means, one after the other."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            self.update(value, vector)
        apart = other.mean - self.mean
        both = self.n + other.n
        self.update(self.n * (other.n / both), apart)
        self.mean = self.mean + apart * (other.n / both)
        self.n = both

    def update(self, rho: float, v: np.ndarray) -> None:
        """Eigenpairs of this matrix plus rho times v v', with deflation."""
        z = self.vectors.T @ v
        length = np.sqrt(z @ z)
        rho = rho * length * length
        if not rho > 0:
            return
        z /= length
        small = 8 * EPS * max(self.values[-1], rho)
        self._turn_equals(z, small)
        live = np.flatnonzero(rho * np.abs(z) > small)
        if not len(live):
            return
        d, kept = self.values[live], z[live]
        gap, mu = secular_roots(d, kept, rho)
        self.values = self.values.copy()
        self.values[live] = d[gap] + mu
        # Entries of the update for which the computed roots are exact, so that vectors stay orthogonal.
        far = (d[None, :] - d[gap][:, None]) - mu[:, None]
        turn = update_entries(d, far, rho, kept)[None, :] / far
        turn /= np.sqrt(np.einsum("ij,ij->i", turn, turn))[:, None]
        self.vectors = self.vectors.copy()
        self.vectors[:, live] = self.vectors[:, live] @ turn.T
        order = np.argsort(self.values, kind="stable")
        self.values, self.vectors = self.values[order], self.vectors[:, order]

    def _turn_equals(self, z: np.ndarray, small: float) -> None:
        """Turns the eigenvectors of equal values so that the update reaches only the last of them."""
        near = np.diff(self.values) <= small
        if not near.any():
            return
        self.vectors = self.vectors.copy()
        first, n = 0, len(z)
        while first < n:
            last = first
            while last + 1 < n and self.values[last + 1] - self.values[first] <= small:
                last += 1
            part = slice(first, last + 1)
            length = np.sqrt(z[part] @ z[part])
            if last > first and length > 0:
                mirror = z[part].copy()
                mirror[-1] += length if mirror[-1] >= 0 else -length
                mirror /= np.sqrt(mirror @ mirror)
                turned = -length if z[last] >= 0 else length
                self.vectors[:, part] -= 2 * np.outer(self.vectors[:, part] @ mirror, mirror)
                z[part] = 0
                z[last] = turned
            first = last + 1


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho sum z_j^2 / (d_j - x) = 0 as (index of the nearest pole, distance from it).

    d rises strictly and no z is zero. Each root lies between two poles, the last one beyond
    the last pole. All are refined together by two-pole interpolation inside brackets.
    """
    k = len(d)
    w = rho * z * z
    upper = np.append(d[1:], d[-1] + w.sum())
    width = upper - d
    middle = 1 + (w[None, :] / ((d[None, :] - d[:, None]) - width[:, None] / 2)).sum(axis=1)
    right = middle < 0
    right[-1] = False  # no pole there
    gap = np.arange(k) + right
    lo, hi = np.where(right, -width / 2, 0.0), np.where(right, 0.0, width / 2)
    if middle[-1] < 0:
        lo[-1], hi[-1] = width[-1] / 2, width[-1]
    delta = d[None, :] - d[gap][:, None]
    below = np.arange(k)[None, :] <= np.arange(k)[:, None]
    near, other = delta[np.arange(k), np.arange(k)], np.append(delta[np.arange(k - 1), np.arange(1, k)], np.inf)
    x = (lo + hi) / 2
    for _ in range(80):
        far = delta - x[:, None]
        term = w[None, :] / far
        total = term.sum(axis=1)
        f = 1 + total
        lo, hi = np.where(f < 0, x, lo), np.where(f >= 0, x, hi)
        done = (np.abs(f) <= 4 * EPS * k * (1 + np.abs(term).sum(axis=1))) | (hi - lo <= 2 * EPS * np.maximum(np.abs(lo), np.abs(hi)))
        if done.all():
            break
        # Left sum as p + q / (near - x), right sum as r + s / (other - x), each with its slope.
        slope = term / far
        left, left_slope = np.where(below, term, 0).sum(axis=1), np.where(below, slope, 0).sum(axis=1)
        a, b = near - x, np.where(np.isinf(other), 1.0, other - x)
        right_slope = np.where(np.isinf(other), 0.0, slope.sum(axis=1) - left_slope)
        right_sum = np.where(np.isinf(other), 0.0, total - left)
        q, s = left_slope * a * a, right_slope * b * b
        c = 1 + (left - left_slope * a) + (right_sum - right_slope * b)
        # c + q / (a - t) + s / (b - t) = 0 for the step t.
        two, one, none = c, -(c * (a + b) + q + s), c * a * b + q * b + s * a
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(one * one - 4 * two * none, 0))
            big = -(one + np.where(one >= 0, root, -root)) / 2
            steps = np.stack([big / two, none / big])
            steps = np.where(np.isinf(other), a + q / c, steps)
            tried = x + steps
            inside = np.isfinite(tried) & (tried > lo) & (tried < hi)
        best = np.where(inside[0], tried[0], np.where(inside[1], tried[1], (lo + hi) / 2))
        x = np.where(done, x, best)
    return gap, x


def update_entries(d: np.ndarray, far: np.ndarray, rho: float, z: np.ndarray) -> np.ndarray:
    """The update's entries whose roots are exactly those found; far[i, j] is d_j minus root i."""
    k = len(d)
    i, j = np.arange(k)[:, None], np.arange(k)[None, :]
    poles = np.where(i < j, d[:, None], np.append(d[1:], 0.0)[:, None]) - d[None, :]
    poles[-1, :] = rho
    return np.copysign(np.sqrt(np.abs(np.prod(-far / poles, axis=0))), z)


def whole_numbers(vector: Column) -> Column:
    """floor(64 c) of each entry, OFFSET left out; null for vectors that do not count."""
    fits = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * FACTOR) < EXACT))
    steps = F.transform(vector, lambda c: F.floor(c.cast("double") * FACTOR).cast("long"))
    return F.when(fits & (F.size(vector) > 0), steps)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: [v] for k, v in values.items()})


SPECTRUM = "part long, n long, mean binary, values binary, vectors binary, sums array<string>"
MATRIX = "part long, matrix binary"


def _combined(rows: DataFrame, combine: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str, scratch: Scratch) -> pd.DataFrame:
    """The only row that is left when FAN rows after FAN rows are combined into one."""
    rows = scratch.cut(rows)
    left = rows.count()
    while left > 1:
        rows = scratch.cut(rows.groupBy(F.floor(F.col("part") / FAN).alias("next")).applyInPandas(combine, schema))
        left = rows.count()
    return rows.toPandas()


def _merge_spectra(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    out, sums = None, None
    for r in group.sort_values("part").itertuples():
        found, own = _spectrum(r), [int(s) for s in r.sums]
        if out is None:
            out, sums = found, own
        else:
            out.merge(found)
            sums = [a + b for a, b in zip(sums, own, strict=True)]
    return pd.DataFrame([_spectrum_row(int(key[0]), out, sums)])


def _spectrum(r) -> Spectrum:
    out = Spectrum(0)
    out.n, out.mean, out.values = int(r.n), np.frombuffer(r.mean), np.frombuffer(r.values)
    out.vectors = np.frombuffer(r.vectors).reshape(len(out.mean), -1)
    return out


def _spectrum_row(part: int, s: Spectrum, sums: list[int]) -> dict:
    return {"part": part, "n": s.n, "mean": s.mean.tobytes(), "values": s.values.tobytes(), "vectors": np.ascontiguousarray(s.vectors).tobytes(), "sums": [str(v) for v in sums]}


def _add_matrices(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(m) for m in group.sort_values("part")["matrix"]], axis=0)
    return pd.DataFrame([{"part": int(key[0]), "matrix": total.tobytes()}])


def _spectra(dim: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found, sums = Spectrum(dim), [0] * dim
        for batch in batches:
            y = _matrix(batch.column("y"), dim)
            for x in y.astype(np.float64):
                found.add(x)
            sums = [s + int(t) for s, t in zip(sums, y.astype(object).sum(axis=0) if np.abs(y).max(initial=0) > 1 << 40 else y.sum(axis=0), strict=True)]
        if found.n:
            yield _row(**_spectrum_row(TaskContext.get().partitionId(), found, sums))

    return run


def _products(dim: int, middle: np.ndarray, basis: np.ndarray):
    """Sums of products of the centred vectors in a basis, a matrix for each task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, any_ = np.zeros((basis.shape[1], basis.shape[1])), False
        for batch in batches:
            z = (_matrix(batch.column("y"), dim) - middle) @ basis
            total, any_ = total + z.T @ z, True
        if any_:
            yield _row(part=TaskContext.get().partitionId(), matrix=total.tobytes())

    return run


def _deviations(y: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of (n x - S)^2, exact; the offset falls out of the difference. Null beyond a long."""
    widest = n * int(np.abs(y).max(initial=0)) + max(map(abs, sums))
    if y.shape[1] * widest * widest < 1 << 63:
        off = n * y - np.array(sums)
        return np.einsum("ij,ij->i", off, off).tolist()
    off = n * y.astype(object) - np.array(sums, dtype=object)
    return [v if v < 1 << 63 else None for v in (off * off).sum(axis=1).tolist()]


def whiten(rows: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component.

    Rows whose vector is null, empty or holds null or non-finite entries, or entries of 2 ** 46
    or more, are left out, and so are those of another length than most (the shorter of equally
    frequent lengths counts). Fitted on each different vector once; rows with equal vectors or
    ids each have their results. Directions without variance have a null `whitened` and are no
    part of the identity error; a deviation beyond a long is null. A sign is chosen so that a
    component's largest entry is positive. An empty table gives no rows; other columns are not
    read.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "whitening")
    kind = rows.schema[id_column].dataType.simpleString()
    read = rows.select(F.col(id_column).alias("vec_id"), whole_numbers(F.col(vector)).alias("y")).where("y is not null")
    read = scratch.cut(read.withColumn("dim", F.size("y")))
    lengths = read.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths[0]
    read = read.where(F.col("dim") == dim)
    fit = scratch.cut(read.select("y").distinct())
    n = fit.count()
    fit = fit.repartition(-(-n // ROWS))

    last = next(_combined(fit.mapInArrow(_spectra(dim), SPECTRUM), _merge_spectra, SPECTRUM, scratch).itertuples())
    sums = [int(s) for s in last.sums]
    # The mean of the whole numbers without their offset, whole and remaining part added last.
    middle = np.array([s // n + (s % n) / n for s in sums])
    basis = np.linalg.qr(_spectrum(last).vectors[:, ::-1])[0]
    summed = _combined(fit.mapInArrow(_products(dim, middle, basis), MATRIX), _add_matrices, MATRIX, scratch)
    ritz, turn = np.linalg.eigh(np.frombuffer(summed["matrix"].iloc[0]).reshape(dim, dim) / n)
    trace, most = ritz.sum(), min(components, dim)
    values, vectors = ritz[::-1][:most], (basis @ turn)[:, ::-1][:, :most]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(most)])
    live = int((values > FLAT * trace).sum()) if trace > 0 else 0
    scale = vectors[:, :live] / np.sqrt(values[:live])
    error = 0.0
    if live:
        whole = _combined(fit.mapInArrow(_products(dim, middle, scale), MATRIX), _add_matrices, MATRIX, scratch)
        error = float(np.abs(np.frombuffer(whole["matrix"].iloc[0]).reshape(live, live) / n - np.eye(live)).max())
    shares = [float(max(v, 0.0) / trace) if trace > 0 else 0.0 for v in values]

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, k = _matrix(batch.column("y"), dim), batch.num_rows
            made = np.full((k, most), np.nan)
            made[:, :live] = (y - middle) @ scale
            at = pa.array(np.repeat(np.arange(k), most))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), k)), pa.array(np.full(k * most, n)),
                    pa.array(_deviations(y, n, sums), pa.int64()).take(at), pa.array(made.ravel(), from_pandas=True),
                    pa.array(np.tile(shares, k)), pa.array(np.full(k * most, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return read.select("vec_id", "y").mapInArrow(project, schema)
