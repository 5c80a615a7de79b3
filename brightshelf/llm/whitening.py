"""Whitening of integer vectors on their leading principal components.

Vectors become integers (256ths, rounded down). Tasks add up centred outer products of the distinct
vectors, one matrix each, and the matrices are added row by row in a shuffle. The driver holds one
d x d covariance: Householder reflections make it tridiagonal, Sturm counts and bisection give the leading
eigenvalues, inverse iteration gives their vectors, made orthogonal within clusters. All rows are
then projected with the broadcast components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brightshelf.session import materialise

SCALE, COMPONENTS = 256, 4


# --- eigenvectors of one symmetric matrix on the driver -------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and Q with matrix = Q T Q', by Householder reflections."""
    a = matrix.astype(float).copy()
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0 or np.linalg.norm(x[1:]) == 0:
            continue
        v = x.copy()
        v[0] += np.copysign(size, x[0])
        v /= np.linalg.norm(v)
        w = a[k + 1 :, k + 1 :] @ v
        w -= (v @ w) * v
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0.0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(size, x[0])
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def sturm_count(d: np.ndarray, e: np.ndarray, x: float) -> int:
    """How many eigenvalues of the tridiagonal matrix lie below x."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    count, p = 0, 1.0
    for i in range(len(d)):
        p = d[i] - x - (e[i - 1] ** 2 / p if i else 0.0)
        if abs(p) < tiny:
            p = -tiny
        count += p < 0
    return count


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, bisected to the last bits."""
    radius = np.abs(np.r_[0.0, e]) + np.abs(np.r_[e, 0.0])
    low, high = float((d - radius).min()), float((d + radius).max())
    out = []
    for m in range(k):
        a, b = low, high if not out else out[-1]
        b += abs(b) * 1e-15 + np.finfo(float).tiny
        while True:
            mid = (a + b) / 2
            if mid <= a or mid >= b:
                break
            if sturm_count(d, e, mid) <= len(d) - 1 - m:  # at least m + 1 eigenvalues are not below
                a = mid
            else:
                b = mid
        out.append((a + b) / 2)
    return np.array(out)


def solve_shifted(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges; a vanishing pivot becomes tiny."""
    n = len(d)
    main, up, upper, x = d - shift, np.r_[e, 0.0], np.zeros(n), b.copy()
    main, up, below = main.copy(), up.copy(), e.copy()
    tiny = np.finfo(float).eps * (max(np.abs(d).max(), np.abs(e).max() if len(e) else 0.0) or 1.0)
    for i in range(n - 1):
        if abs(below[i]) > abs(main[i]):
            main[i], below[i] = below[i], main[i]
            up[i], main[i + 1] = main[i + 1], up[i]
            upper[i], up[i + 1] = up[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(main[i]) < tiny:
            main[i] = tiny
        f = below[i] / main[i]
        main[i + 1] -= f * up[i]
        up[i + 1] -= f * upper[i]
        x[i + 1] -= f * x[i]
    if abs(main[-1]) < tiny:
        main[-1] = tiny
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            x[i] -= up[i] * x[i + 1]
        if i + 2 < n:
            x[i] -= upper[i] * x[i + 2]
        x[i] /= main[i]
    return x


def leading_eigenvectors(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows.

    The largest entry of a vector is positive. Equal eigenvalues get orthogonal vectors.
    """
    d, e, q = tridiagonal(matrix)
    values = leading_eigenvalues(d, e, k)
    spread = max(float(np.abs(d).max()), float(np.abs(e).max()) if len(e) else 0.0)
    rng = np.random.default_rng(12)
    vectors: list[np.ndarray] = []
    for m, value in enumerate(values):
        cluster = [vectors[j] for j in range(m) if values[j] - value <= 1e-3 * spread]

        def apart(x: np.ndarray) -> np.ndarray:
            for _ in range(2):
                for v in cluster:
                    x = x - (v @ x) * v
            return x / np.linalg.norm(x)

        x = apart(rng.normal(size=len(d)))
        for _ in range(5):
            x = apart(solve_shifted(d, e, value, x))
        vectors.append(x)
    rows = np.array(vectors).reshape(k, len(d)) @ q.T
    return values, rows * np.sign(rows[np.arange(k), np.abs(rows).argmax(axis=1)])[:, None]


# --- distributed sums -----------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _added(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray | None:
    """Sum over all batches of the matrix `kernel` makes of a batch of `x`; None without rows.

    A task hands on one matrix; the rows of equal number of all tasks are added in a shuffle.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = kernel(_matrix(batch.column("x")))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total))], names=["i", "v"])

    def add(table: pa.Table) -> pa.Table:
        v = _matrix(table.column("v").combine_chunks())
        return pa.table({"i": table.column("i").slice(0, 1), "v": pa.array([v.sum(axis=0)])})

    schema = f"i int, v array<{kind}>"
    rows = df.select("x").mapInArrow(partial, schema).groupBy("i").applyInArrow(add, schema).orderBy("i").toArrow()
    return _matrix(rows.column("v").combine_chunks()) if rows.num_rows else None


def integer_vectors(df: DataFrame, keep: list[str], vector: str = "embedding") -> DataFrame:
    """`keep` and x, the vector's entries in 256ths rounded down; unusable vectors are left out.

    Left out are null and empty vectors, those with a null or non-finite entry, and those whose
    length is not the commonest one (the larger of equally common lengths).
    """
    if "x" in keep:
        raise ValueError("column x is named like a result; rename it first")
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    usable = df.where((F.size(v) > 0) & finite).select(*keep, F.transform(v, lambda c: F.floor(c * SCALE) + 0).alias("x"))
    usable = materialise(usable, "vectors")
    length = usable.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c")).agg(F.max_by("d", F.struct("c", "d"))).first()[0]
    return usable.where(F.size("x") == F.lit(length))


@dataclass
class Whitening:
    n: int  # distinct vectors
    sums: np.ndarray  # of each dimension, exact
    components: np.ndarray  # unit rows
    eigenvalues: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n if self.n else self.sums.astype(float)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.components / np.sqrt(self.eigenvalues)[:, None]).T

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - sums)^2, exact; an OverflowError where 64 bits do not hold it."""
        bound = self.n * (int(np.abs(x).max()) if x.size else 0) + int(np.abs(self.sums).max()) if len(self.sums) else 0
        if bound * bound * max(x.shape[1], 1) < 1 << 63:
            return ((self.n * x - self.sums) ** 2).sum(axis=1)
        exact = [sum((self.n * int(c) - int(s)) ** 2 for c, s in zip(row, self.sums)) for row in x]
        return np.array(exact, np.int64)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Whitening of the distinct `x` of `integer_vectors`, each counted once.

    Components whose eigenvalue is nothing but rounding error are left out, so there may be fewer
    than asked for: none at all without rows or with one distinct vector.
    """
    distinct = materialise(vectors.select("x").distinct(), "distinct-vectors")

    def sums(x: np.ndarray) -> np.ndarray:
        if int(np.abs(x).max()) * len(x) >= 1 << 62:
            raise OverflowError("sums of vectors do not fit into 64 bits")
        return np.r_[x.sum(axis=0), len(x)][None, :]

    counted = _added(distinct, sums, "bigint")
    if counted is None:
        return Whitening(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    s, n = counted[0, :-1], int(counted[0, -1])
    mean = s / n

    def scatter(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    covariance = _added(distinct, scatter, "double") / n
    values, rows = leading_eigenvectors(covariance, min(components, len(s)))
    trace = float(np.trace(covariance))
    real = values > trace * len(s) * np.finfo(float).eps
    model = Whitening(n, s, rows[real], values[real], trace, 0.0)
    if real.any():

        def moments(x: np.ndarray) -> np.ndarray:
            w = model.project(x)
            return np.vstack([w.T @ w, w.sum(axis=0)])

        m = _added(distinct, moments, "double") / n
        of_whitened = m[:-1] - np.outer(m[-1], m[-1])
        model.identity_error = float(np.abs(of_whitened - np.eye(len(of_whitened))).max())
    return model


def transform(vectors: DataFrame, keep: list[str], model: Whitening) -> DataFrame:
    """One row per row of `vectors`: the `keep` columns, deviation, whitened (one value per component)."""
    clash = set(keep) & {"deviation", "whitened"}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are named like results; rename them first")
    source = vectors.select(*keep, "x")
    broadcast = source.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            if not len(x):
                continue
            whitened = broadcast.value.project(x)
            k = whitened.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(whitened.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(broadcast.value.deviation(x)), lists], names=[*keep, "deviation", "whitened"])

    fields = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"{fields}{', ' if keep else ''}deviation bigint, whitened array<double>")


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row of `df` and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Null ids and repeated rows stay; repeated vectors are fitted once. `explained` is the
    component's share of the whole variance. Extra columns are not read.
    """
    vectors = integer_vectors(df.select(F.col(vec_id).alias("id"), F.col(vector).alias("v")), ["id"], "v")
    model = fit(vectors, components)
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.eigenvalues]).cast("array<double>")
    found = transform(vectors, ["id"], model).select("id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return found.select(
        F.col("id").alias(vec_id),
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("place")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
