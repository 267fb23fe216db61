"""Embedding whitening by incremental eigendecomposition.

1. Each task turns its rows into a spectrum: count, exact integer sums, eigenvalues and
   eigenvectors of the scatter about their mean. Rows come in blocks; a block's centred
   triangular factor and the shift of the mean are added as rank-one updates. Each update solves
   the secular equation of the nondeflated part: eigenvalues that are equal up to rounding are
   first folded into one coordinate by a reflection, coordinates that the update does not
   touch are left alone.
2. Spectra are combined in a tree, a few per task: the eigenpairs of one are successive rank-one
   updates of the other. What remains is one spectrum of d x d numbers.
3. Rayleigh-Ritz refinement: its basis is made orthonormal, the covariance is projected on it by
   one distributed pass over all rows, and the small projected problem gives the components.

Nothing but matrices of the vectors' dimension is ever sent to the driver or broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import rows_in_slices, table
from panelcast.session import cut_lineage

#: Rows that become one triangular factor; spectra that one task combines.
BLOCK, FAN_IN = 4096, 8
EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum_j w_j / (d_j - x) for rising d and positive w.

    Root i lies between d_i and d_{i+1} (the last one below d_k + sum(w)). Returned are the
    distances d_j - root_i as a matrix [i, j], free of cancellation, and the roots.
    """
    k = len(d)
    upper = np.append(d[1:], d[-1] + w.sum())
    gap = upper - d
    at = np.arange(k)
    middle = d[None, :] - d[:, None] - gap[:, None] / 2
    right = 1 + (w / middle).sum(1) < 0
    right[-1] = False  # beyond the last pole there is none to start from
    origin = np.where(right, upper, d)
    poles = d[None, :] - origin[:, None]
    lo = np.where(right, -gap / 2, 0.0)
    hi = np.where(right, 0.0, gap / 2)
    hi[-1] = gap[-1] * (1 + 4 * EPS)
    x = (lo + hi) / 2
    below = at[None, :] <= at[:, None]
    near = poles[at, at]
    far = np.append(poles[at[:-1], at[:-1] + 1], gap[-1])
    for turn in range(100):
        dist = poles - x[:, None]
        part = w / dist
        slope = part / dist
        f = 1 + part.sum(1)
        lo, hi = np.where(f < 0, x, lo), np.where(f < 0, hi, x)
        size = 1 + np.abs(part).sum(1)
        if ((np.abs(f) <= 4 * EPS * size) | (hi - lo <= 2 * EPS * np.maximum(np.abs(lo), np.abs(hi)))).all():
            break
        low, all_of = np.where(below, slope, 0).sum(1), slope.sum(1)
        one, two = near - x, far - x
        c = f - one * low - two * (all_of - low)
        a = (one + two) * f - one * two * all_of
        b = one * two * f
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = x + step
        good = np.isfinite(new) & (new > lo) & (new < hi) & (turn % 8 < 6)  # a bisection now and then bounds the turns
        x = np.where(good, new, (lo + hi) / 2)
    return poles - x[:, None], origin + x


def rank_one(e: np.ndarray, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of q diag(e) q' + v v'."""
    z = q.T @ v
    tol = 8 * EPS * max(np.abs(e).max(initial=0.0), float(z @ z))
    if float(z @ z) <= tol * EPS:
        return e, q
    q = q.copy()
    # eigenvalues equal up to rounding: a reflection turns their part of z into its last coordinate
    first = np.flatnonzero(np.concatenate(([True], np.diff(e) > tol)))
    for lo, hi in zip(first, np.append(first[1:], len(e)), strict=True):
        if hi - lo > 1 and (norm := np.linalg.norm(z[lo:hi])) > 0:
            h = z[lo:hi].copy()
            h[-1] += np.copysign(norm, h[-1])
            h /= np.linalg.norm(h)
            q[:, lo:hi] -= 2 * np.outer(q[:, lo:hi] @ h, h)
            last = -np.copysign(norm, z[hi - 1])
            z[lo:hi] = 0
            z[hi - 1] = last
    live = np.flatnonzero(np.abs(z) * np.linalg.norm(z) > tol)
    if not len(live):
        return e, q
    d, w = e[live], z[live] ** 2
    dist, roots = secular_roots(d, w)
    # the vector for which these roots are exact gives orthogonal eigenvectors
    near = d[None, :] - d[:, None]
    np.fill_diagonal(near, 1.0)
    ratio = -dist / np.where(np.eye(len(d), dtype=bool), 1.0, near.T)
    exact = np.sqrt(np.abs(ratio.prod(0))) * np.sign(z[live])
    u = exact[None, :] / dist
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    e, q[:, live] = e.copy(), q[:, live] @ u.T
    e[live] = roots
    order = np.argsort(e, kind="stable")
    return e[order], q[:, order]


class Spectrum:
    """Count, exact sums, eigenvalues and eigenvectors of the scatter about the mean."""

    def __init__(self, dim: int):
        self.n, self.sums, self.e, self.q = 0, np.zeros(dim, np.int64), np.zeros(dim), np.eye(dim)

    def _take(self, n: int, sums: np.ndarray, factors: np.ndarray) -> None:
        """Add n rows with these sums, whose scatter about their mean is factors' factors."""
        if self.n:
            shift = sums / n - self.sums / self.n
            factors = np.vstack([factors, shift[None, :] * np.sqrt(self.n * (n / (self.n + n)))])
        for v in factors:
            self.e, self.q = rank_one(self.e, self.q, v)
        self.n, self.sums = self.n + n, self.sums + sums

    def add_rows(self, x: np.ndarray) -> None:
        sums = x.sum(0)
        self._take(len(x), sums, np.linalg.qr(x - sums / len(x), mode="r"))

    def add(self, other: Spectrum) -> None:
        if other.n:
            self._take(other.n, other.sums, (other.q * np.sqrt(np.maximum(other.e, 0))).T)

    def pack(self) -> bytes:
        return np.int64(self.n).tobytes() + self.sums.tobytes() + self.e.tobytes() + self.q.tobytes()

    @staticmethod
    def unpack(data: bytes, dim: int) -> Spectrum:
        out = Spectrum(dim)
        out.n = int(np.frombuffer(data, np.int64, 1)[0])
        out.sums = np.frombuffer(data, np.int64, dim, 8).copy()
        numbers = np.frombuffer(data, np.float64, offset=8 + 8 * dim)
        out.e, out.q = numbers[:dim].copy(), numbers[dim:].reshape(dim, dim).copy()
        return out


def grid_numbers(vectors: pa.Array, dim: int, grid: int) -> np.ndarray:
    x = np.floor(np.asarray(vectors.flatten().cast(pa.float64())) * grid)
    if len(x) and np.abs(x).max() >= 2.0 ** 40:
        raise ValueError("a vector's entry is beyond the grid's range (2 ** 40 steps)")
    return x.astype(np.int64).reshape(-1, dim)


def _spectra(dim: int, grid: int):
    def run(batches):
        whole = Spectrum(dim)
        waiting, rows = [], 0
        for part in rows_in_slices(batches, BLOCK):
            waiting.append(grid_numbers(part.column(1), dim, grid))
            rows += part.num_rows
            if rows >= BLOCK:
                whole.add_rows(np.concatenate(waiting))
                waiting, rows = [], 0
        if rows:
            whole.add_rows(np.concatenate(waiting))
        if whole.n:
            yield pa.RecordBatch.from_arrays([pa.array([whole.pack()], pa.binary())], ["_state"])
    return run


def _combined(dim: int):
    def run(group: pa.Table) -> pa.Table:
        whole = Spectrum(dim)
        for state in group.column("_state").to_pylist():  # FAN_IN states
            whole.add(Spectrum.unpack(state, dim))
        return pa.table({"_at": group.column("_next")[:1], "_state": pa.array([whole.pack()], pa.binary())})
    return run


def spectrum(rows: DataFrame, dim: int, grid: int) -> Spectrum:
    """The spectrum of all rows (_id, _vec)."""
    states = rows.mapInArrow(_spectra(dim, grid), "_state binary")
    states = cut_lineage(states.select(F.spark_partition_id().cast("long").alias("_at"), "_state"))
    last = states.agg(F.coalesce(F.max("_at"), F.lit(0))).first()[0]
    while last > 0:
        states = cut_lineage(states.withColumn("_next", F.floor(F.col("_at") / FAN_IN).cast("long"))
                             .groupBy("_next").applyInArrow(_combined(dim), "_at long, _state binary"))
        last //= FAN_IN
    return Spectrum.unpack(bytes(states.first()["_state"]), dim)


def products(rows: DataFrame, dim: int, grid: int, base: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """sum of y y' for y = (row - mean) base: one matrix a task, added up cell by cell."""
    k = base.shape[1]
    at_i, at_j = np.triu_indices(k)

    def run(batches):
        total = np.zeros((k, k))
        for part in rows_in_slices(batches, BLOCK):
            y = ((n * grid_numbers(part.column(1), dim, grid) - sums) / n) @ base
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(at_i.astype(np.int32)), pa.array(at_j.astype(np.int32)),
                                          pa.array(total[at_i, at_j])], ["i", "j", "v"])
    out = np.zeros((k, k))
    for r in rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]  # k * k cells
    return out


def components(rows: DataFrame, dim: int, grid: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(n, sums, falling eigenvalues, eigenvectors as columns) of the rows' covariance."""
    rough = spectrum(rows, dim, grid)
    base, _ = np.linalg.qr(rough.q[:, ::-1])
    projected = products(rows, dim, grid, base, rough.n, rough.sums) / rough.n
    e, u = np.linalg.eigh(projected)
    order = np.argsort(-e, kind="stable")
    return rough.n, rough.sums, e[order], base @ u[:, order]


def _finite(vec: Column) -> Column:
    return F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


OUT = "{id} long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = 32,
           grid: int = 64) -> DataFrame:
    """One row per vector and component: <id_col>, component, n, deviation, whitened, explained, identity_error.

    Vectors are put on a grid, x = floor(grid * c), before anything else; a constant added to all
    entries changes none of the columns. Left out are vectors that are null, empty, hold null or
    non-finite entries, or have another length than most (ties: the longer). Repeated rows and ids, null ids
    too, each count and are returned. Components whose eigenvalue is nought up to rounding (fewer
    independent rows than dimensions) are not returned. Without vectors, or if all are equal,
    the result is empty. Deviations beyond the range of a long and entries beyond 2 ** 40
    steps of the grid raise an error. Other columns, whatever their names, are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_vec"))
    rows = rows.filter(F.col("_vec").isNotNull() & (F.size("_vec") > 0) & _finite(F.col("_vec")))
    lengths = rows.groupBy(F.size("_vec").alias("_dim")).count().orderBy(F.desc("count"), F.desc("_dim")).first()
    schema = OUT.format(id=f"`{id_col}`")
    if lengths is None:
        return rows.limit(0).mapInArrow(lambda batches: iter(()), schema)
    dim = lengths["_dim"]
    rows = rows.filter(F.size("_vec") == dim)
    n, sums, e, q = components(rows, dim, grid)
    used = min(count, int((e > 64 * dim * EPS * max(e[0], 0)).sum()))
    weights = q[:, :used] / np.sqrt(e[:used])
    explained = e[:used] / e.sum() if used else e[:0]
    error = float(np.abs(products(rows, dim, grid, weights, n, sums) / n - np.eye(used)).max()) if used else 0.0

    def run(batches):
        for part in rows_in_slices(batches):
            off = n * grid_numbers(part.column(1), dim, grid) - sums
            if float(np.abs(off).max()) ** 2 * dim < 2.0 ** 62:
                deviation = pa.array((off * off).sum(1))
            else:
                deviation = pa.array([sum(int(v) ** 2 for v in row) for row in off], pa.int64())
            white = (off / n) @ weights
            size = part.num_rows * used
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), used))),
                 pa.array(np.tile(np.arange(1, used + 1, dtype=np.int32), part.num_rows)),
                 pa.array(np.full(size, n, np.int64)),
                 deviation.take(pa.array(np.repeat(np.arange(part.num_rows), used))),
                 pa.array(white.ravel()), pa.array(np.tile(explained, part.num_rows)), pa.array(np.full(size, error))],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
