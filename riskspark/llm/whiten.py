"""Embedding whitening (operator 11): QDWH spectral divide and conquer, then broadcast whitening.

Spark jobs take the exact sums and the centred second moments of all vectors (one small matrix per
task, added up by entry).  The covariance, whose size is the dimension squared and never follows the
rows, is split on the driver: the polar factor U of the shifted covariance V - sI, found by dynamically
weighted Halley steps, gives the spectral projector (U + I) / 2 onto the eigenvalues above s.
Orthonormal bases of its range and null space split V into two smaller covariances, and so on down
to single components.  The components are broadcast and every vector is projected where it lies.

Integers: an entry c becomes x = floor(1024 c) + 100000.  Second moments are taken about an integer
centre within half a unit of the mean, so they are exact whatever the order or partitioning; the rest of
the centring is a rank-one term of at most a quarter per entry.

Defined results: vectors that are null or hold null or non-finite entries are left out, and so are
vectors whose length is not the most frequent one (ties: the longer) or zero; null ids and repeated rows
are rows like any other; entries beyond 2^40 count as 2^40.  A component without variance (within
rounding of 0) has ``whitened`` 0 and no part in ``identity_error``.  ``deviation`` is null where it exceeds a long;
``deviation_exact`` has its digits in any case.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col

SCALE, SHIFT, LARGEST = 1024, 100000, float(1 << 50)
CHUNK = 4096


# ---------------------------------------------------------------- spectral divide and conquer

def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal (here symmetric) polar factor of a symmetric matrix by QDWH iteration."""
    n = len(a)
    norm = np.linalg.norm(a, 2) if n < 3 else np.sqrt(np.linalg.norm(a, 1) * np.linalg.norm(a, np.inf))
    if norm == 0:
        return np.eye(n)
    x = a / norm
    low = max(1.0 / (np.linalg.norm(np.linalg.pinv(x) if n < 2 else _inverse(x), 1) * np.sqrt(n)), 1e-16)
    eye = np.eye(n)
    for _ in range(40):
        l2 = low * low
        dd = np.cbrt(4.0 * (1.0 - l2) / (l2 * l2)) if low < 1 else 0.0
        root = np.sqrt(1.0 + dd)
        wa = root + 0.5 * np.sqrt(max(8.0 - 4.0 * dd + 8.0 * (2.0 - l2) / (l2 * root), 0.0))
        wb = (wa - 1.0) ** 2 / 4.0
        wc = wa + wb - 1.0
        low = min(low * (wa + wb * l2) / (1.0 + wc * l2), 1.0)
        if wc > 100.0:  # by QR: stable for any weights
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            new = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            z = np.linalg.cholesky(eye + wc * (x.T @ x))
            half = np.linalg.solve(z, x.T)
            new = (wb / wc) * x + (wa - wb / wc) * np.linalg.solve(z.T, half).T
        new = (new + new.T) / 2.0
        moved, x = np.linalg.norm(new - x), new
        if moved < 1e-13 * np.sqrt(n) and abs(1.0 - low) < 1e-12:
            break
    return x


def _inverse(x: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.inv(x)
    except np.linalg.LinAlgError:
        return np.eye(len(x)) * 1e16


def _range_basis(p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the range (k columns) and null space of a projector: column-pivoted QR."""
    order, left = [], p.copy()
    for _ in range(k):  # pivots: the columns that stand out most from those chosen
        j = int(np.argmax((left * left).sum(0)))
        v = left[:, j] / np.linalg.norm(left[:, j])
        left = left - np.outer(v, v @ left)
        order.append(j)
    q, _ = np.linalg.qr(p @ p[:, order], mode="complete")
    return q[:, :k], q[:, k:]


def spectral_components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix by recursive spectral division."""
    n = len(v)
    scale = np.linalg.norm(v)
    values, vectors = [], []
    todo = [(np.eye(n), (v + v.T) / 2.0)]
    while todo:
        basis, a = todo.pop()
        m = len(a)
        off = a - np.diag(np.diag(a))
        if m == 1 or np.linalg.norm(off) <= 1e-15 * scale * m:
            values += list(np.diag(a))
            vectors += list(basis.T)
            continue
        diag = np.sort(np.diag(a))
        spread = np.linalg.norm(a - np.eye(m) * diag.mean())
        for shift in [float(np.median(diag)), float(diag.mean()), *(diag.mean() + spread / np.sqrt(m) * t for t in (0.01, -0.01, 0.3, -0.3, 1, -1, 0.1, -0.1))]:
            u = polar_factor(a - shift * np.eye(m))
            p = (u + np.eye(m)) / 2.0
            k = int(round(np.trace(p)))
            if not 0 < k < m:
                continue
            q1, q2 = _range_basis(p, k)
            if np.linalg.norm(q1.T @ a @ q2) <= 1e-12 * scale:
                todo += [(basis @ q, (lambda s: (s + s.T) / 2.0)(q.T @ a @ q)) for q in (q1, q2)]
                break
        else:  # eigenvalues closer than rounding tells apart: a rotation of each pair of axes ends it
            a, q = _rotate(a)
            values += list(np.diag(a))
            vectors += list((basis @ q).T)
    order = np.argsort(np.array(values), kind="stable")[::-1]
    w = np.array(vectors)[order].T
    values = np.array(values)[order]
    return values, w / np.linalg.norm(w, axis=0)


def _rotate(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jacobi rotations until the off-diagonal part is rounding."""
    n, q = len(a), np.eye(len(a))
    for _ in range(30):
        if np.linalg.norm(a - np.diag(np.diag(a))) <= 1e-16 * max(np.linalg.norm(a), 1e-300) * n:
            break
        for i in range(n - 1):
            for j in range(i + 1, n):
                if a[i, j] != 0:
                    t = 0.5 * np.arctan2(2 * a[i, j], a[i, i] - a[j, j])
                    r = np.eye(n)
                    r[i, i] = r[j, j] = np.cos(t)
                    r[i, j], r[j, i] = -np.sin(t), np.sin(t)
                    a, q = r.T @ a @ r, q @ r
    return a, q


# ---------------------------------------------------------------- Spark jobs

def _matrices(batch: pa.RecordBatch, index: int, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, x as float64 integers) of the usable vectors of a batch, a chunk at a time."""
    arr = batch.column(index)
    for at in range(0, batch.num_rows, CHUNK):
        part = arr.slice(at, CHUNK)
        flat = part.flatten()
        sizes = np.asarray(pc.fill_null(pc.list_value_length(part), 0), dtype=np.int64)
        values = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=np.float64)
        ends = np.cumsum(sizes)
        rows = np.flatnonzero(sizes == dim)
        if not len(rows):
            continue
        c = values[(ends[rows] - dim)[:, None] + np.arange(dim)]
        ok = np.isfinite(c).all(1)
        x = np.floor(SCALE * np.clip(c[ok], -LARGEST / SCALE, LARGEST / SCALE)) + SHIFT
        yield at + rows[ok], x


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b of integer-valued matrices, exact: in doubles while they hold all integers that occur, else in Python's."""
    if a.size and np.abs(a).max() * np.abs(b).max() * len(a) >= 2.0 ** 53:
        whole = lambda m: np.array([[int(v) for v in r] for r in m], dtype=object).reshape(m.shape)
        return whole(a).T.dot(whole(b))
    return (a.T @ b).astype(np.int64).astype(object)


def usable_dimension(rows: DataFrame) -> int:
    """The most frequent length of usable vectors (ties: the longer), 0 without any."""
    good = rows.where(F.col("v").isNotNull() & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    found = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("d > 0").orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return found[0]["d"] if found else 0


def moments(rows: DataFrame, dim: int, centre: list[int] | None) -> dict[tuple[int, int], int]:
    """Exact sums over all usable vectors: {(-1, -1): n, (i, -1): sum of x_i} without a centre, with one
    {(i, j): sum of (x_i - centre_i) (x_j - centre_j)}.  Each task gives one entry per pair, whatever its rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        n, sums, gram = 0, np.zeros(dim, dtype=object), np.zeros((dim, dim), dtype=object)
        for batch in batches:
            for _, x in _matrices(batch, 0, dim):
                if centre is None:
                    n += len(x)
                    sums = sums + _product(x, np.ones((len(x), 1)))[:, 0]
                else:
                    z = x - np.array(centre, dtype=np.float64)
                    gram = gram + _product(z, z)
        if centre is None:
            total = {(-1, -1): n, **{(i, -1): int(s) for i, s in enumerate(sums)}}
        else:
            total = {(i, j): int(gram[i, j]) for i in range(dim) for j in range(i + 1)}
        i, j = zip(*total) if total else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                          pa.array([str(v) for v in total.values()], pa.string())], names=["i", "j", "s"])

    found = (rows.select("v").mapInArrow(task, "i int, j int, s string").groupBy("i", "j")
             .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())  # (dimension + 1)^2 rows at most
    return {(r["i"], r["j"]): int(r["s"]) for r in found}


class Whitening:
    """Fitted components: n, exact sums, eigenvalues, unit eigenvectors, trace."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace
        self.live = values > max(trace, 0.0) * 1e-13

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of integer rows."""
        centre = np.array([s // self.n for s in self.sums], dtype=np.float64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        scale = np.where(self.live, 1.0 / np.sqrt(np.where(self.live, self.values, 1.0)), 0.0)
        return ((x - centre) - rest) @ (self.vectors * scale)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Exact sum over dimensions of (n x - S)^2 per row."""
        big = float(self.n) * np.abs(x).max(initial=0.0)
        if big < 2.0 ** 52:
            y = self.n * x.astype(np.int64) - np.array(self.sums, dtype=np.int64)
            if float(np.abs(y).max(initial=0)) ** 2 * x.shape[1] < 2.0 ** 62:
                return (y * y).sum(1).tolist()
        return [sum((self.n * int(v) - s) ** 2 for v, s in zip(r, self.sums)) for r in x]


def fit(rows: DataFrame, dim: int, components: int) -> Whitening | None:
    """Components of all usable vectors (column ``v``) of length ``dim``."""
    first = moments(rows, dim, None)
    n = first.get((-1, -1), 0)
    if not n:
        return None
    sums = [first[(i, -1)] for i in range(dim)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    second = moments(rows, dim, centre)
    delta = np.array([(s - c * n) / n for s, c in zip(sums, centre)])
    v = np.empty((dim, dim))
    for i in range(dim):
        for j in range(i + 1):
            v[i, j] = v[j, i] = second[(i, j)] / n - delta[i] * delta[j]
    values, vectors = spectral_components(v)
    return Whitening(n, sums, values[:components], vectors[:, :components], float(np.trace(v)))


def identity_error(rows: DataFrame, dim: int, model: Whitening) -> float:
    """Largest absolute entry of (covariance of the whitened rows - identity), measured over all rows."""
    k = int(model.live.sum())
    if not k:
        return 0.0

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, gram = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, x in _matrices(batch, 0, dim):
                w = model.apply(x)[:, model.live]
                mean += w.sum(0)
                gram += w.T @ w
        both = np.vstack([mean, gram])
        i, j = np.indices(both.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(both.ravel())], names=["i", "j", "s"])

    got = np.zeros((k + 1, k))
    for r in rows.select("v").mapInArrow(task, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        got[r["i"], r["j"]] = r["s"] / model.n
    # the rows are centred before they are whitened; what rounding leaves of the mean is taken off here
    return float(np.abs(got[1:] - np.outer(got[0], got[0]) - np.eye(k)).max())


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error, deviation_exact) per usable vector and component."""
    id_type = embeddings.schema[id_col].dataType.simpleString()
    schema = (f"vec_id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, "
              "deviation_exact string")
    rows = embeddings.select(col(vector_col).cast("array<double>").alias("v"), col(id_col).alias("vec_id"))
    dim = usable_dimension(rows)
    model = fit(rows, dim, components) if dim else None
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema).withColumnRenamed("vec_id", id_col)
    error = identity_error(rows, dim, model)
    k = len(model.values)
    explained = np.maximum(model.values, 0.0) / model.trace if model.trace > 0 else np.zeros(k)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _matrices(batch, 0, dim):
                m = len(at)
                exact = model.deviation(x)
                dev = pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(pa.array(at)).take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                     pa.array(np.full(m * k, model.n), pa.int64()), dev.take(each), pa.array(model.apply(x).ravel()),
                     pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                     pa.array([str(d) for d in exact], pa.string()).take(each)],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return rows.mapInArrow(task, schema).withColumnRenamed("vec_id", id_col)
