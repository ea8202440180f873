"""Operator 11, embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

The vectors stay in Spark. Three passes over them are worked out in Arrow blocks: the exact integer sums of every
dimension; the scatter of the centred vectors, block by block, each task adding up its own; and the projections. What reaches the
driver is a matrix of the dimension's square, whatever the number of rows.

There the scatter is factored with pivoting, largest remaining diagonal first, until nothing but rounding is left: that
is its rank. One-sided Jacobi turns pairs of columns of the triangular factor until all are orthogonal. Then their squared norms
are the eigenvalues and the normalised columns the components, without the scatter being formed again. Rounds take
disjoint pairs at once.

Entries are whole numbers ``floor(1024 * c) + 100000``. Sums and deviations are exact integers; a deviation beyond the range
of a long is null. ``identity_error`` is measured on the whitened rows in a pass of its own.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped; of the rest, rows of another
length than the most frequent one (the longer one on a tie) can't be compared and are dropped too, as are empty vectors;
repeated and null ids give rows of their own; directions without variance are no components, so equal vectors give no
rows and a table of rank r gives at most r components; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwise.llm.common import ship_code, stored

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
SWEEPS = 60
LONG = np.iinfo(np.int64)


def matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The vectors of a block, one a row."""
    return np.asarray(batch.column("x").flatten(), dtype=np.int64).reshape(-1, dim)


def as_lists(m: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, d = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(m.reshape(-1), type=kind))


# ---------------------------------------------------------------------------
# the driver's part: matrices of the dimension's square
# ---------------------------------------------------------------------------


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order): ``a[order][:, order] = L @ L.T``, L lower triangular with as many columns as ``a`` has rank."""
    a = a.copy()
    d = len(a)
    order, low = np.arange(d), np.zeros((d, d))
    rest = np.diag(a).copy()
    floor = d * np.finfo(float).eps * rest.max(initial=0.0)
    for k in range(d):
        p = k + int(np.argmax(rest[k:]))
        if rest[p] <= floor:
            return low[:, :k], order
        for v in (order, rest):
            v[[k, p]] = v[[p, k]]
        low[[k, p], :k] = low[[p, k], :k]
        a[[k, p]] = a[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        low[k, k] = np.sqrt(rest[k])
        low[k + 1 :, k] = (a[k + 1 :, k] - low[k + 1 :, :k] @ low[k, :k]) / low[k, k]
        rest[k + 1 :] -= low[k + 1 :, k] ** 2
    return low, order


def round_robin(m: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs in which each of ``m`` (even) columns meets every other one once."""
    seats, rounds = list(range(m)), []
    for _ in range(m - 1):
        rounds.append((np.array(seats[: m // 2]), np.array(seats[: m // 2 - 1 : -1])))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return rounds


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components) of ``factor @ factor.T``, the largest first; components are columns.

    Stops when no pair of columns is further from orthogonal than rounding makes them."""
    u = factor.copy()
    r = u.shape[1]
    if r % 2:
        u = np.hstack([u, np.zeros((len(u), 1))])
    rounds = round_robin(u.shape[1]) if r > 1 else []
    tol = np.finfo(float).eps * np.sqrt(max(1, len(u)))
    for _ in range(SWEEPS):
        turned = False
        for i, j in rounds:
            x, y = u[:, i], u[:, j]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            far = np.abs(xy) > tol * np.sqrt(xx * yy)
            if not far.any():
                continue
            turned = True
            zeta = (yy - xx) / np.where(far, 2 * xy, 1.0)
            t = np.where(far, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            u[:, i], u[:, j] = c * x - c * t * y, c * t * x + c * y
        if not turned:
            break
    values = (u * u).sum(0)
    best = np.argsort(-values, kind="stable")[:r]
    return values[best], u[:, best] / np.sqrt(values[best])


def components(scatter: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``scatter / n``, falling, and unit components as columns; none for directions without variance."""
    low, order = pivoted_cholesky(scatter)
    values, vectors = one_sided_jacobi(low)
    back = np.empty_like(vectors)
    back[order] = vectors
    return values / n, back


# ---------------------------------------------------------------------------
# passes over the vectors
# ---------------------------------------------------------------------------


def whole_vectors(emb: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x) of the rows that can be used, ``x`` as long numbers."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    fine = emb.filter(v.isNotNull() & ~bad & (F.size(v) > 0))
    return fine.select(
        F.col(id_col).alias("vec_id"),
        F.transform(v, lambda e: F.floor(e.cast("double") * SCALE).cast("long") + SHIFT).alias("x"),
    )


def sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """n and the exact sum of every dimension. A task sends one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, np.zeros(dim, dtype=np.int64)
        for b in batches:
            x = matrix(b, dim)
            n, s = n + len(x), s + x.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), as_lists(s[None, :], pa.int64())], ["n", "s"])

    parts = rows.select("x").mapInArrow(run, "n long, s array<long>")
    n = parts.agg(F.sum("n")).first()[0]
    each = parts.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    return n, [int(r["v"]) for r in each.orderBy("i").collect()]  # one row a dimension


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """x - S/n. The difference n*x - S is exact wherever it fits a long."""
    if all(abs(v) < LONG.max // 2 for v in s) and n * max(1, int(np.abs(x).max(initial=0))) < LONG.max // 2:
        return (x * n - np.array(s, dtype=np.int64)) / n
    mean = np.array([v // n for v in s], dtype=np.int64)
    return (x - mean) - np.array([(v % n) / n for v in s])


def scatter(rows: DataFrame, dim: int, n: int, s: list[int]) -> np.ndarray:
    """The sum of the centred vectors' outer products. Tasks add up their blocks; their matrices are added row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            c = centred(matrix(b, dim), n, s)
            total += c.T @ c
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), type=pa.int32()), as_lists(total, pa.float64())], ["i", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            np.add.at(total, np.asarray(b.column("i")), np.asarray(b.column("v").flatten()).reshape(len(b), -1))
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, type=pa.int32()), as_lists(total[used], pa.float64())], ["i", "v"])

    kind = "i int, v array<double>"
    parts = rows.select("x").mapInArrow(run, kind).repartition("i").mapInArrow(add, kind)
    out = np.zeros((dim, dim))
    for r in parts.collect():  # one row a dimension
        out[r["i"]] = r["v"]
    return (out + out.T) / 2


def project(rows: DataFrame, n: int, s: list[int], values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """(vec_id, deviation, w): the whitened coordinates of every vector."""
    axes = vectors / np.sqrt(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = matrix(b, len(s))
            far = [sum((n * int(e) - t) ** 2 for e, t in zip(row, s, strict=True)) for row in x] if _wide(x, n, s) else (
                ((x * n - np.array(s, dtype=np.int64)) ** 2).sum(1).tolist()
            )
            deviation = pa.array([v if v <= LONG.max else None for v in far], type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), deviation, as_lists(centred(x, n, s) @ axes, pa.float64())], ["vec_id", "deviation", "w"]
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, deviation long, w array<double>")


def _wide(x: np.ndarray, n: int, s: list[int]) -> bool:
    """Whether a deviation of the block may pass the range of a long."""
    low, high = x.min(0).tolist(), x.max(0).tolist()
    return sum(max(abs(n * a - t), abs(n * b - t)) ** 2 for a, b, t in zip(low, high, s, strict=True)) > LONG.max


def identity_error(projected: DataFrame, k: int, n: int) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity; centred before multiplying."""
    means = projected.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(k)]).first()
    off = [F.col("w")[i] - F.lit(float(means[i])) for i in range(k)]
    cov = projected.agg(*[F.sum(off[i] * off[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    return max(abs(cov[f"c{i}_{j}"] / n - (i == j)) for i in range(k) for j in range(i, k))


def whiten(emb: DataFrame, keep: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    spark = emb.sparkSession
    ship_code(spark)
    id_kind = emb.schema[id_col].dataType.simpleString()
    empty = spark.createDataFrame(
        [], f"vec_id {id_kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    rows = stored(whole_vectors(emb, id_col, vector_col), "vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return empty
    dim = lengths[0]["d"]
    rows = rows.filter(F.size("x") == dim)
    n, s = sums(rows, dim)
    total = scatter(rows, dim, n, s)
    values, vectors = components(total, n)
    values, vectors = values[:keep], vectors[:, :keep]
    if not len(values):
        return empty
    share = [float(v) for v in values / (np.trace(total) / n)]
    projected = stored(project(rows, n, s, values, vectors), "whitened")
    error = identity_error(projected, len(values), n)
    return projected.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened")).select(
        "vec_id",
        (F.col("i") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.array(*[F.lit(v) for v in share]), F.col("i") + 1).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
