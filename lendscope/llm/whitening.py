"""Embedding whitening by spectral divide and conquer.

Vectors become whole numbers, so everything that runs over the rows is exact:
one aggregate gives n and the sums, a second the products of the centred
entries.  Only the d x d sums of products (d: the length of a vector) come to
the driver, where the covariance is formed without rounding but the last one.

Its components are found by QDWH: the polar factor of the covariance less a
shift is its matrix sign, half of it plus the identity is the projector onto
the eigenvectors above the shift, and an orthonormal basis of the projector's
range and of its complement splits the covariance into two smaller ones.  That
goes on until a part is diagonal; parts below the wanted components are left.

The model (d sums, d x k directions) is broadcast and the rows are whitened in
Arrow batches; nothing else moves.

Scale: the list of distinct vectors is one shuffle, equal vectors meet map-side.
A task sends d (d + 1) / 2 sums whatever its rows.  d is a property of the
embedding (64 here), not of the number of rows; the driver holds d x d numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

SCALE, OFFSET = 64, 1_000_000  # fixed values of the contract: x = floor(64 c) + 1000000
EPS = np.finfo(float).eps
SAFE = 1 << 62


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by the QR-based dynamically weighted Halley iteration.

    For a symmetric matrix that is its sign.  Eigenvalues below the rounding of
    the norm may end anywhere in [-1, 1]; ``split`` looks for that.
    """
    n = len(a)
    x, low = a / np.linalg.norm(a), EPS / n
    for _ in range(40):
        d = np.cbrt(4 * (1 - low * low) / low ** 4) if low < 1 else 0.0
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low * low) / (low * low * root)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))[0]
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        moved, x = np.linalg.norm(new - x), new
        if moved < np.cbrt(EPS) and 1 - low < 100 * EPS:
            break
    return x


def split(a: np.ndarray, shift: float, tries: int = 4) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below ``shift``; None where one of them is empty."""
    n = len(a)
    projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = int(round(np.trace(projector)))
    if not 0 < k < n:
        return None
    rnd, best = np.random.default_rng(n), None
    for _ in range(tries):
        q = np.linalg.qr(projector @ rnd.standard_normal((n, k)))[0]
        q = np.linalg.qr(projector @ q, mode="complete")[0]
        left = np.linalg.norm(q[:, k:].T @ a @ q[:, :k])
        if best is None or left < best[0]:
            best = left, q
        if left <= 10 * n * EPS * np.linalg.norm(a):
            return q[:, :k], q[:, k:]
    # An eigenvalue lies on the shift: the caller tries another one.
    return None if best[0] > 1e-10 * np.linalg.norm(a) else (best[1][:, :k], best[1][:, k:])


def leading_eigenvectors(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues, falling, and their unit eigenvectors as columns."""
    whole = np.linalg.norm(v)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    parts = [(v, np.eye(len(v)))]  # the part of the greatest eigenvalues last
    while parts and len(values) < k:
        a, basis = parts.pop()
        diagonal = np.diag(a)
        if np.linalg.norm(a - np.diag(diagonal)) <= EPS * whole:
            for i in np.argsort(-diagonal, kind="stable"):
                values.append(float(diagonal[i]))
                vectors.append(basis[:, i])
            continue
        ends = float(diagonal.min()), float(diagonal.max())
        shifts = [float(np.median(diagonal)), float(diagonal.mean()),
                  *(ends[0] + (ends[1] - ends[0]) * f for f in (0.31, 0.71, 0.13, 0.87, 0.53))]
        found = next((s for s in map(lambda x: split(a, x), shifts) if s), None)
        if found is None:  # eigenvalues that agree to rounding: a rotation makes the part diagonal
            found = _rotated(a)
            if found is None:
                values += [float(x) for x in diagonal]
                vectors += list(basis.T)
                continue
        for q in reversed(found):
            part = q.T @ a @ q
            parts.append(((part + part.T) / 2, basis @ q))
    order = np.argsort(-np.array(values), kind="stable")[:k]
    return np.array(values)[order], np.stack([vectors[i] for i in order], axis=1)


def _rotated(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Splits a part of two rows by its rotation; greater parts without a gap are left as they are."""
    if len(a) != 2:
        return None
    angle = 0.5 * np.arctan2(2 * a[0, 1], a[0, 0] - a[1, 1])
    c, s = np.cos(angle), np.sin(angle)
    return np.array([[c], [s]]), np.array([[-s], [c]])


@dataclass(frozen=True)
class Model:
    """n, the sums and the k whitening directions (columns over the roots of their eigenvalues)."""

    n: int
    sums: list[int]
    directions: np.ndarray
    explained: list[float]
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: long where it fits, else whole numbers without bound."""
        s = np.array(self.sums, dtype=object)
        if len(x) and (int(np.abs(x).max()) * self.n + max(map(abs, self.sums))) < SAFE:
            return x * np.int64(self.n) - s.astype(np.int64)
        return x.astype(object) * self.n - s

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(float) @ self.directions


def whole_numbers(embedding: Column) -> Column:
    """x = floor(64 c) + 1000000 of every entry."""
    return F.transform(embedding, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(OFFSET))


def is_usable(embedding: Column) -> Column:
    """Neither null nor empty, and every entry a finite number."""
    return embedding.isNotNull() & (F.size(embedding) > 0) & F.coalesce(F.forall(
        embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    d = len(column[0])
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _products(y: np.ndarray) -> np.ndarray:
    """Sums of products, exact, as whole numbers without bound."""
    if int(np.abs(y).max()) ** 2 * len(y) < 1 << 53:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    return y.astype(object).T @ y.astype(object)


def _cells(m: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    i, j = np.triu_indices(len(m))
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(list(m[i, j]), kind)], ["i", "j", "v"])


def _sum_cells(cells: DataFrame, d: int) -> np.ndarray:
    """The symmetric d x d matrix of summed cells; d (d + 1) / 2 rows come to the driver."""
    out = np.zeros((d, d), dtype=object)
    for i, j, v in cells.groupBy("i", "j").agg(F.sum("v")).collect():
        out[i, j] = out[j, i] = v
    return out


def fit(vectors: DataFrame, components: int = 16) -> Model | None:
    """The model of distinct vectors ``x`` (array of long, one length, a written table); None without rows.

    Components whose eigenvalue is rounding of the trace are left out: a
    constant direction has no whitened coordinate.
    """
    n, shortest, longest = vectors.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x"))).first()
    if not n:
        return None
    if shortest != longest:
        raise ValueError(f"vectors of {shortest} and of {longest} entries have no common covariance")
    d = int(longest)
    # One column an entry, in one row: at most d sums of the driver.
    totals = vectors.agg(*[F.sum(F.col("x")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(d)]).first()
    sums = [int(t) for t in totals]
    centre = np.array([s // n for s in sums], dtype=np.int64)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                g = _products(_matrix(batch.column(0)) - centre)
                total = g if total is None else total + g
        if total is not None:
            yield _cells(total, pa.decimal128(38, 0))

    g = _sum_cells(vectors.select("x").mapInArrow(products, "i int, j int, v decimal(38,0)"), d)
    rest = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    # Covariance times n * n, without rounding: the sums of products are centred by whole numbers.
    whole = [[n * int(g[i, j]) - rest[i] * rest[j] for j in range(d)] for i in range(d)]
    trace = sum(whole[i][i] for i in range(d))
    if not trace:
        return Model(n, sums, np.zeros((d, 0)), [])
    v = np.array([[c / (n * n) for c in row] for row in whole])
    e, q = leading_eigenvectors(v, min(components, d))
    real = e > d * EPS * (trace / (n * n))
    e, q = e[real], q[:, real]
    model = Model(n, sums, q / np.sqrt(e), [float(x) for x in e / (trace / (n * n))])

    def white(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                w = model.whitened(model.centred(_matrix(batch.column(0))))
                g = w.T @ w
                total = g if total is None else total + g
        if total is not None:
            yield _cells(total, pa.float64())

    # Added as decimals, whose sum does not depend on the order of the tasks.
    cells = vectors.select("x").mapInArrow(white, "i int, j int, v double").withColumn("v", F.col("v").cast("decimal(38,18)"))
    covariance = _sum_cells(cells, len(e)).astype(float) / n
    return Model(n, sums, model.directions, model.explained, float(np.abs(covariance - np.eye(len(e))).max()))


SCHEMA = ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, "
          "identity_error double")


def whiten(rows: DataFrame, components: int = 16, embedding: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """Each usable row's whitened coordinates: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds a null, NaN or infinite entry
    give nothing.  Equal vectors count once in the fit, every row is whitened;
    rows with one or no vec_id stay rows of their own.  Directions without
    variance have no component, so a table of one distinct vector, like an
    empty one, gives an empty result.  Vectors of several lengths are an error,
    as are entries of 2 ** 57 and more, which have no long x.  Other columns
    are not read.
    """
    spark = rows.sparkSession
    x = rows.where(is_usable(F.col(embedding))).select(
        F.col(vec_id).cast("long").alias("vec_id"), whole_numbers(F.col(embedding)).alias("x"))
    model = fit(materialize(x.select("x").distinct(), "whitening-fit"), components)
    if model is None or not model.explained:
        return spark.createDataFrame([], SCHEMA)
    k = len(model.explained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            centred = model.centred(_matrix(batch.column("x")))
            w = model.whitened(centred)
            if centred.dtype != object and int(np.abs(centred).max()) ** 2 * centred.shape[1] >= SAFE:
                centred = centred.astype(object)
            deviation = pa.array((centred * centred).sum(axis=1).tolist(), pa.decimal128(38, 0))
            m = len(w)
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n)), deviation.take(at), pa.array(w.ravel()),
                pa.array(np.tile(np.array(model.explained), m)), pa.array(np.full(m * k, model.identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(run, SCHEMA)


def op12_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, 16 components; a deviation beyond a long (some 10 ** 8 distinct vectors) is an error, never cut."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
