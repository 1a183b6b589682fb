"""Whitening of embeddings by a bidiagonal qd solver.

1. Rows whose vector is null, or holds a null or a non-finite entry, go; so
   do rows whose vector has another length than most (ties: the smaller
   length), which no covariance can take.  Entry c becomes the long
   ``x = floor(64 * c) + 1000000``, with ``floor(64 * c)`` held within 2^40
   either way.
2. The fit list is each distinct x vector once: n vectors with per-dimension
   sums S, both exact.
3. *Blockwise QR*: every task reduces its centred rows to one upper triangle,
   block by block, and triangles are stacked and reduced again, ``FAN`` at a
   time, until one d x d triangle R is left.  Rows are centred as
   ``(n * x - S) / n`` with an exact numerator, before any product.
4. *Householder bidiagonalisation* of R, on the driver (d x d numbers, however
   many rows): R = U B Z'.
5. *dqds* on B: singular values to high relative accuracy; the covariance's
   eigenvalue is their square over n.
6. *Twisted factorisations* of B'B - s^2 I: the eigenvector of each singular
   value; B is cut first where its superdiagonal vanishes, so equal values in
   different parts stay orthogonal, and vectors of close values of one part
   are made orthogonal among each other.  Z turns them into components.

Then every row is centred exactly, projected and scaled.

Defined results: components with an eigenvalue of zero (below the rounding of
the largest) do not exist, so a constant dimension, a single distinct vector
or an empty table give fewer rows or none; repeated rows and null ids each
keep their own rows; ``deviation`` is null where it doesn't fit a long; extra
columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

TOP = 16
FAN = 16
BLOCK = 4096  # rows reduced at a time within a task
SCALE, SHIFT, BOUND = 64, 1_000_000, float(1 << 40)
EPS = np.finfo(float).eps


# --- the d x d solver (numpy, no Spark) --------------------------------------


def reduce_rows(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """Triangle of ``r`` stacked on ``rows`` (d x d, zero rows where short)."""
    stack = rows if r is None else np.vstack([r, rows])
    out = np.linalg.qr(stack, mode="r")
    d = rows.shape[1]
    return out if len(out) == d else np.vstack([out, np.zeros((d - len(out), d))])


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(v, beta): (I - beta v v') x has only a first entry, -sign(x0) |x|."""
    big = np.abs(x).max(initial=0.0)
    if big == 0.0 or len(x) == 1:
        return np.zeros_like(x), 0.0
    v = x / big
    v[0] += math.copysign(float(np.sqrt(v @ v)), v[0])
    return v, 2.0 / float(v @ v)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, e, z): R = U B z' with B upper bidiagonal, diagonal q >= 0 and
    superdiagonal e >= 0; U isn't kept."""
    a, d = r.astype(float).copy(), len(r)
    z = np.eye(d)
    for k in range(d):
        v, beta = _reflector(a[k:, k].copy())
        if beta:
            a[k:, k:] -= beta * np.outer(v, v @ a[k:, k:])
        if k + 2 < d:
            v, beta = _reflector(a[k, k + 1 :].copy())
            if beta:
                a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ v, v)
                z[:, k + 1 :] -= beta * np.outer(z[:, k + 1 :] @ v, v)
    q, e = np.diag(a).copy(), np.diag(a, 1).copy()
    # signs: rows of B are free (they turn U), columns are turned in z
    turn = np.ones(d)
    for k in range(d - 1):
        row = turn[k] * (math.copysign(1.0, q[k]) if q[k] else 1.0)
        if e[k]:
            turn[k + 1] = row * math.copysign(1.0, e[k])
    return np.abs(q), np.abs(e), z * turn


def _dqds_step(q: np.ndarray, e: np.ndarray, s: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """One differential qd transform with shift ``s``; None where it would
    lose positivity.  The third value is the smallest intermediate d."""
    n = len(q)
    q2, e2 = np.empty(n), np.empty(n - 1)
    d = low = q[0] - s
    if d < 0:
        return None
    for k in range(n - 1):
        q2[k] = d + e[k]
        t = q[k + 1] / q2[k] if q2[k] > 0 else 0.0
        e2[k] = e[k] * t
        d = d * t - s
        if not d >= 0:
            return None
        low = min(low, d)
    q2[n - 1] = d
    return q2, e2, low


def _tridiagonal_low(q: np.ndarray, e: np.ndarray) -> float:
    """A lower bound of the least eigenvalue of L U in the last rows (Gershgorin)."""
    n = len(q)
    lows = []
    for k in range(max(0, n - 2), n):
        mid = q[k] + (e[k] if k < n - 1 else 0.0)
        off = (math.sqrt(q[k] * e[k - 1]) if k else 0.0) + (math.sqrt(q[k + 1] * e[k]) if k < n - 1 else 0.0)
        lows.append(mid - off)
    return max(0.0, min(lows))


def dqds(diagonal: np.ndarray, above: np.ndarray, max_sweeps: int = 200) -> np.ndarray:
    """Singular values of an upper bidiagonal matrix, largest first.

    Works on squares; every transform is free of subtractions but for the
    shift, whose sum is added back to each value that splits off at the end.
    """
    found: list[float] = []
    parts = [(diagonal.astype(float) ** 2, above.astype(float) ** 2, 0.0)]
    while parts:
        q, e, shift = parts.pop()
        sweeps = 0
        while len(q) > 1:
            n = len(q)
            cut = np.flatnonzero(e <= EPS * EPS * (np.minimum(q[:-1], q[1:]) + shift))
            if len(cut):
                k = int(cut[-1]) + 1
                parts.append((q[:k].copy(), e[: k - 1].copy(), shift))
                q, e = q[k:], e[k:]
                continue
            if sweeps > max_sweeps * n:
                raise ArithmeticError("singular values did not converge")
            sweeps += 1
            # the last diagonal entry bounds the least value from above; its
            # two-by-two end estimates it
            a, b, c = q[n - 2], e[n - 2], q[n - 1]
            tr, det = a + b + c, a * c
            least = det / (0.5 * (tr + math.sqrt(max(0.0, tr * tr - 4 * det)))) if tr > 0 else 0.0
            step = None
            for s in (0.99 * least * (1 - math.sqrt(min(1.0, b / (a + b))) if a + b > 0 else 0.0), _tridiagonal_low(q, e), 0.0):
                if s >= 0 and (step := _dqds_step(q, e, s)) is not None:
                    break
            q, e = step[0], step[1]
            shift += s
        found.append(float(q[0]) + shift)
    return np.sqrt(np.sort(np.array(found))[::-1])


@dataclass
class Twisted:
    """B'B - lam I = N D N', N unit lower bidiagonal above row ``r`` and unit
    upper bidiagonal below it."""

    r: int
    lower: np.ndarray
    upper: np.ndarray
    pivots: np.ndarray

    def vector(self) -> np.ndarray:
        """Unit solution of N' z = unit vector of row r: products alone."""
        z = np.zeros(len(self.pivots))
        z[self.r] = 1.0
        return self._back(z)

    def solve(self, b: np.ndarray) -> np.ndarray:
        """Unit vector along the solution of (B'B - lam I) z = b."""
        w, n, r = b.copy(), len(b), self.r
        for k in range(r):
            w[k + 1] -= self.lower[k] * w[k]
        for k in range(n - 2, r - 1, -1):
            w[k] -= self.upper[k] * w[k + 1]
        w /= self.pivots
        return self._back(w / np.abs(w).max())

    def _back(self, z: np.ndarray) -> np.ndarray:
        for k in range(self.r - 1, -1, -1):
            z[k] -= self.lower[k] * z[k + 1]
        for k in range(self.r, len(z) - 1):
            z[k + 1] -= self.upper[k] * z[k]
        return z / np.linalg.norm(z)


def twisted(q: np.ndarray, e: np.ndarray, lam: float) -> Twisted:
    """B'B - lam I is factored from the top (stationary qd) and from the
    bottom (progressive qd); the two meet at the twist of the smallest pivot."""
    n = len(q)
    off = q[:-1] * e
    tiny = EPS * EPS * max(float((q * q).max()), float((e * e).max(initial=0.0)), 1e-300)

    def safe(x: float) -> float:
        return x if abs(x) > tiny else math.copysign(tiny, x if x else 1.0)

    down, lower, tops = np.empty(n), np.empty(n - 1), np.empty(n)
    tops[0] = -lam  # what a pivot has beyond its q^2
    for k in range(n - 1):
        down[k] = safe(tops[k] + q[k] * q[k])
        lower[k] = off[k] / down[k]
        tops[k + 1] = tops[k] * (e[k] * e[k]) / down[k] - lam
    up, upper, tails = np.empty(n), np.empty(n - 1), np.empty(n)
    tails[n - 1] = q[n - 1] * q[n - 1] - lam
    for k in range(n - 2, -1, -1):
        up[k + 1] = safe(tails[k + 1] + e[k] * e[k])
        upper[k] = off[k] / up[k + 1]
        tails[k] = tails[k + 1] * (q[k] * q[k]) / up[k + 1] - lam
    gamma = tops + tails + lam
    r = int(np.argmin(np.abs(gamma)))
    return Twisted(r, lower, upper, np.concatenate([down[:r], [safe(float(gamma[r]))], up[r + 1 :]]))


def _apart(v: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, float]:
    """``v`` less its part along ``others`` (columns), as a unit vector, and
    what was left of it."""
    v = v - others @ (others.T @ v)
    left = float(np.linalg.norm(v))
    return (v / left if left else v), left


def bidiagonal_vectors(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors as columns), largest first."""
    d = len(q)
    scale = float(max(q.max(initial=0.0), e.max(initial=0.0)))
    values, vectors = [], []
    first = 0
    for last in range(d):
        if last < d - 1 and e[last] > EPS * scale:
            continue
        part, size = slice(first, last + 1), last + 1 - first
        pq, pe = q[part], e[first:last]
        sigma = dqds(pq, pe)
        own = np.zeros((size, size))
        for k, s in enumerate(sigma):
            factors = twisted(pq, pe, float(s) ** 2)
            v = factors.vector()
            # close values of one part: orthogonal to the vectors before; where nothing
            # new is left of it, inverse iteration from another direction
            near = own[:, [j for j in range(k) if sigma[j] ** 2 - s**2 <= 1e-3 * max(sigma[0] ** 2, 1e-300)]]
            v, left = _apart(v, near)
            for turn in range(8):
                if left >= 0.1:
                    break
                v, _ = _apart(np.cos(np.arange(1, size + 1) * (k + turn + 1.0)), near)
                for _ in range(3):
                    v, left = _apart(factors.solve(v), near)
            v, _ = _apart(v, near)
            own[:, k] = v
            values.append(float(s))
            whole = np.zeros(d)
            whole[part] = v
            vectors.append(whole)
        first = last + 1
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.array(vectors).T[:, order]


def right_singular(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of a triangle."""
    scale = float(np.abs(r).max(initial=0.0))
    if scale == 0.0:
        return np.zeros(len(r)), np.eye(len(r))
    q, e, z = bidiagonalise(r / scale)
    values, v = bidiagonal_vectors(q, e)
    return values * scale, z @ v


# --- the fit on Spark -----------------------------------------------------------


@dataclass
class Whitening:
    """n, S, the components (columns) with their eigenvalues, trace of V."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def integer_rows(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that take part; ``x`` is array<long>."""
    c = F.col("embedding")
    broken = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long"), c).filter(
        c.isNotNull() & ~F.coalesce(broken, F.lit(False)) & (F.size(c) > 0)
    )
    held = lambda v: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.floor(v.cast("double") * SCALE).cast("double")))
    return rows.select("vec_id", F.transform(c, lambda v: held(v).cast("long") + SHIFT).alias("x"))


def _width(rows: DataFrame) -> int:
    """Length of most vectors (one row per length reaches the driver: one)."""
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return 0 if most is None else most.d


def _matrix(column, width: int, dtype) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, width)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: in longs where they surely hold it, else in integers
    of any size."""
    if float(np.abs(x).max(initial=0)) * n + float(np.abs(sums.astype(float)).max(initial=0)) < 2.0**62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _fit_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    def run(batches):
        for b in batches:
            x = _matrix(b.column("x"), width, np.int64)
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(x)], pa.int64()), "s": pa.array([x.sum(axis=0).tolist()])})

    part = fit.mapInArrow(run, "n long, s array<long>")
    each = part.select("n", F.posexplode("s").alias("i", "s"))
    sums = each.groupBy("i").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    rows = sums.orderBy("i").collect()  # a row per dimension
    return (int(rows[0].n), [int(r.s) for r in rows]) if rows else (0, [])


def triangle(fit: DataFrame, width: int, n: int, sums: list[int], fan: int = FAN) -> np.ndarray:
    """R of the centred fit list: one triangle a task, then reduced ``fan`` at
    a time, each round a job that writes its triangles."""
    held = np.array(sums, dtype=object)

    def rows_of(batches):
        r = None
        for b in batches:
            x = _matrix(b.column("x"), width, np.int64)
            for at in range(0, len(x), BLOCK):
                r = reduce_rows(r, _centred(x[at : at + BLOCK], n, held).astype(float) / n)
        if r is not None:
            yield pa.RecordBatch.from_pydict({"r": pa.array([r.ravel().tolist()], pa.list_(pa.float64()))})

    def stacked(batches):
        r = None
        for b in batches:
            for t in _matrix(b.column("r"), width * width, float):
                r = reduce_rows(r, t.reshape(width, width))
        if r is not None:
            yield pa.RecordBatch.from_pydict({"r": pa.array([r.ravel().tolist()], pa.list_(pa.float64()))})

    now = written(fit.mapInArrow(rows_of, "r array<double>"), "triangles")
    left = now.count()
    while left > 1:
        now = written(now.repartition(-(-left // fan)).mapInArrow(stacked, "r array<double>"), "triangles")
        left, before = now.count(), left
        if left >= before:
            raise ArithmeticError("triangles did not reduce")
    return np.array(now.first().r).reshape(width, width)


def fit_whitening(fit: DataFrame, width: int) -> Whitening | None:
    """Whitening of a written fit list (x array<long>); None if it is empty."""
    n, sums = _fit_sums(fit, width)
    if not n:
        return None
    sigma, v = right_singular(triangle(fit, width, n, sums))
    e = sigma**2 / n
    real = sigma > width * EPS * max(float(sigma[0]), 1e-300) * 8
    return Whitening(n, sums, v[:, real], e[real], float(e.sum()))


def _identity_error(fit: DataFrame, width: int, w: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the
    identity; the sums are k x k numbers a task."""
    k = w.components.shape[1]
    project = w.components / np.sqrt(w.eigenvalues)
    held, n = np.array(w.sums, dtype=object), w.n

    def run(batches):
        total = np.zeros((k, k))
        for b in batches:
            y = (_centred(_matrix(b.column("x"), width, np.int64), n, held).astype(float) / n) @ project
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({"s": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})

    each = fit.mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "s"))
    rows = each.groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()  # k x k rows
    cov = np.array([r.s for r in rows]).reshape(k, k) / n
    return float(np.abs(cov - np.eye(k)).max())


def whiten(embeddings: DataFrame, top: int = TOP) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error)
    for every row that takes part and each of its ``top`` components."""
    spark = embeddings.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integer_rows(embeddings)
    width = _width(rows)
    if not width:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("x") == width)
    fit = written(rows.select("x").distinct(), "fit-list")
    w = fit_whitening(fit, width)
    k = min(top, w.components.shape[1])
    if not k:
        return spark.createDataFrame([], schema)
    w = Whitening(w.n, w.sums, w.components[:, :k], w.eigenvalues[:k], w.trace)
    error = _identity_error(fit, width, w)
    project, explained = w.components / np.sqrt(w.eigenvalues), w.eigenvalues / w.trace
    held, n = np.array(w.sums, dtype=object), w.n

    def run(batches):
        for b in batches:
            z = _centred(_matrix(b.column("x"), width, np.int64), n, held)
            y = (z.astype(float) / n) @ project
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(b.column("vec_id").to_pandas().astype("Int64"), k), pa.int64()),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(z))),
                    pa.array(np.full(len(z) * k, n, dtype=np.int64)),
                    pa.array([v for v in _deviations(z) for _ in range(k)], pa.int64()),
                    pa.array(y.ravel()),
                    pa.array(np.tile(explained, len(z))),
                    pa.array(np.full(len(z) * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)


def _deviations(z: np.ndarray) -> list[int | None]:
    """Exact sums of squares; null beyond a long."""
    if z.dtype != object and float(np.abs(z).max(initial=0)) < 2.0**31 / math.sqrt(max(1, z.shape[1])):
        return (z * z).sum(axis=1).tolist()
    sums = [sum(int(v) * int(v) for v in row) for row in z]
    return [s if s < 2**63 else None for s in sums]


def digest(embeddings: DataFrame) -> DataFrame:
    """The contract's columns."""
    return whiten(embeddings)
