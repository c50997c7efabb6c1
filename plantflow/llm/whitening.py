"""Whitening of embeddings on their leading components, found by contour integration (FEAST).

Vectors become integers, so sums are exact and so are products as long as doubles hold them; the covariance
comes from one pass of partial sums, centred at the rounded mean before multiplying. What is left is a matrix of the
dimensions alone. Its spectrum is cut into intervals by inertia counts (signs of the pivots of the LDL' of the shifted
tridiagonal form); Spark tasks work on an interval each: a quadrature of complex shifted solves around it projects
a random block onto its eigenvectors, Rayleigh-Ritz extracts them, and the interval is done when it holds as
many as its inertia counts say. Two further passes measure the whitened covariance and write the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .tables import written
from .textarrays import give_back

SCALE, SHIFT = 1024, 100_000
#: Nodes on the upper half of a contour, and steps of subspace iteration at most.
NODES = 8
STEPS = 40
#: Eigenvalues of an interval, where gaps allow it.
SHARE = 4
#: Two eigenvalues nearer than this share of the largest are not cut apart.
APART = 1e-7
#: Eigenvalues up to this share of the trace count as zero; the component has no direction.
ZERO = 1e-12
#: Entries beyond this have no x that a long holds.
MOST = 2.0**50
_SUMS = "i int, j int, v double"
_PAIRS = "value double, vector array<double>"


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix similar to a symmetric one, by Householder reflections."""
    a = v.astype(np.float64).copy()
    n = a.shape[0]
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x[0] += size if x[0] >= 0 else -size
        x /= np.linalg.norm(x)
        part = a[k + 1 :, k + 1 :]
        w = part @ x
        w = 2 * (w - (x @ w) * x)
        part -= np.outer(w, x) + np.outer(x, w)
        a[k + 1 :, k] -= 2 * x * (x @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, 1).copy()


def above(diagonal: np.ndarray, off: np.ndarray, shift: float) -> int:
    """How many eigenvalues are larger than shift: positive pivots, by Sylvester's law of inertia."""
    tiny = np.finfo(float).eps * (np.abs(diagonal).max() + np.abs(off).max(initial=0) + abs(shift)) + np.finfo(float).tiny
    count, pivot = 0, 1.0
    for k, x in enumerate(diagonal):
        pivot = x - shift - (off[k - 1] ** 2 / pivot if k else 0)
        if abs(pivot) < tiny:
            pivot = -tiny
        count += int(pivot > 0)
    return count


def intervals(v: np.ndarray, most: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside), from the top, that hold the `most` largest eigenvalues at least."""
    n = v.shape[0]
    diagonal, off = tridiagonal(v)
    edge = np.abs(off)
    reach = np.r_[edge, 0] + np.r_[0, edge]
    top, bottom = float((diagonal + reach).max()), float((diagonal - reach).min())
    size = max(abs(top), abs(bottom))
    if size == 0:
        return []
    top, bottom = top + 1e-6 * size, bottom - 1e-6 * size

    def value(rank: int) -> float:
        low, high = bottom, top
        while high - low > APART * size / 8:
            mid = (low + high) / 2
            low, high = (mid, high) if above(diagonal, off, mid) >= rank else (low, mid)
        return (low + high) / 2

    values, cuts = [value(1)], [top]
    while cuts[-1] > bottom and len(values) < n + 1:
        rank = len(values)
        after = value(rank + 1) if rank < n else bottom - 1e-3 * size
        gap = values[-1] - after
        held = above(diagonal, off, cuts[-1])
        if gap > APART * size and (rank - held >= SHARE or rank >= most):
            cuts.append((values[-1] + after) / 2)
        if rank >= most and len(cuts) > 1 and above(diagonal, off, cuts[-1]) >= most:
            break
        values.append(after)
    counts = [above(diagonal, off, c) for c in cuts]
    return [(float(low), float(high), b - a) for high, low, a, b in zip(cuts, cuts[1:], counts, counts[1:], strict=False) if b > a]


def feast(v: np.ndarray, low: float, high: float, held: int) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues between low and high, falling, and their unit vectors as columns.

    ValueError if there are not `held` of them when the iteration ends.
    """
    n = v.shape[0]
    block = min(n, max(2 * held, held + 4))
    y = np.random.default_rng(n).standard_normal((n, block))
    middle, radius = (low + high) / 2, (high - low) / 2
    angle = np.pi * (np.arange(NODES) + 0.5) / NODES
    shifts = middle + radius * np.exp(1j * angle)
    size, best = np.abs(v).sum(axis=1).max(), np.inf
    for _ in range(STEPS):
        q = sum(np.real(radius * np.exp(1j * t) * np.linalg.solve(z * np.eye(n) - v, y.astype(complex))) for t, z in zip(angle, shifts, strict=True)) / NODES
        q, _ = np.linalg.qr(q)
        q, _ = np.linalg.qr(q)
        e, u = np.linalg.eigh(q.T @ v @ q)
        y = q @ u
        inside = (e > low) & (e < high)
        rest = np.linalg.norm(v @ y[:, inside] - y[:, inside] * e[inside], axis=0).max(initial=0) / size
        if inside.sum() == held and (rest < 1e-15 or (rest < 1e-13 and rest >= best / 2)):
            break
        best = min(best, rest)
    if inside.sum() != held:
        raise ValueError(f"{held} eigenvalues between {low} and {high} by inertia, {int(inside.sum())} found")
    order = np.flatnonzero(inside)[::-1]
    return e[order], y[:, order] / np.linalg.norm(y[:, order], axis=0)


def leading(spark: SparkSession, v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest eigenvalues, falling, and unit vectors whose largest entry is positive; a task an interval."""
    parts = intervals(v, min(most, v.shape[0]))
    if not parts:
        return np.zeros(0), np.zeros((v.shape[0], 0))
    sent = spark.sparkContext.broadcast(v)

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for low, high, held in frame.itertuples(index=False):
                e, u = feast(sent.value, low, high, held)
                yield pd.DataFrame({"value": e, "vector": list(u.T)})

    found = spark.createDataFrame(parts, "low double, high double, held int").repartition(len(parts)).mapInPandas(run, _PAIRS).collect()  # as many as dimensions at most
    found = sorted(found, key=lambda r: -r["value"])[:most]
    vectors = np.array([r["vector"] for r in found]).T
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return np.array([r["value"] for r in found]), vectors * sign


def _integers(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, x) of the vectors that take part."""
    good = F.expr(f"`{vector}` IS NOT NULL AND forall(`{vector}`, c -> c IS NOT NULL AND NOT isnan(c) AND abs(double(c)) <= {MOST})")
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    return vectors.select(F.col(vec_id).alias("id"), F.when(good & (F.size(vector) > 0), x).alias("x")).where("x IS NOT NULL")


def _lists(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _gram(rows: DataFrame, d: int, of) -> np.ndarray:
    """The sum over rows of the outer products of of(x); partial sums meet in a shuffle by entry."""
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                y = of(batch.column(1))
                total = total + y.T @ y
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])], names=["i", "j", "v"])
        give_back()

    out = np.zeros((d, d))
    for r in rows.mapInArrow(run, _SUMS).groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # entries of one matrix
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The exact sum over dimensions of (n*x - S)^2 of each row."""
    s = np.array(sums, dtype=object)
    reach = max(abs(n * int(x.min()) - max(sums)), abs(n * int(x.max()) - min(sums)))
    if reach * reach * x.shape[1] < 1 << 62 and n * int(np.abs(x).max()) < 1 << 62:
        y = n * x - s.astype(np.int64)
        return (y * y).sum(axis=1).tolist()
    y = n * x.astype(object) - s
    return (y * y).sum(axis=1).tolist()


def whitened(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact) of each vector and component.

    A vector takes part unless it is null, empty or holds an entry that is null, not finite or beyond MOST. If lengths
    differ, those of the most frequent length take part, of two such lengths the larger. Components of no variance
    (one vector, equal vectors, fewer dimensions) are left out; an empty table gives no rows. Repeated rows and null
    ids stay as they are; equal eigenvalues have some orthonormal vectors of their space. deviation is null where a
    long does not hold it, deviation_exact where 38 digits do not. Other columns are not read.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vec_id].dataType
    out = T.StructType([T.StructField(vec_id, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")), T.StructField("deviation_exact", T.DecimalType(38, 0))])
    rows = written(_integers(vectors, vec_id, vector), "integers")  # five passes read it
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], out)
    d, n = length["d"], length["count"]
    rows = rows.where(F.size("x") == d)
    found = rows.select(F.posexplode("x").alias("k", "c")).groupBy("k").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s")).collect()  # a row a dimension
    sums = [int(r["s"]) for r in sorted(found, key=lambda r: r["k"])]
    centre = np.array([round(Fraction(s, n)) for s in sums], np.int64)
    rest = np.array([float(Fraction(s, n) - int(c)) for s, c in zip(sums, centre, strict=True)])
    v = _gram(rows, d, lambda x: (_lists(x, d) - centre).astype(np.float64)) / n - np.outer(rest, rest)
    value, vector_of = leading(spark, v, components)
    trace = float(np.trace(v))
    some = value > ZERO * trace
    value, vector_of = value[some], vector_of[:, some]
    k = value.size
    if not k:
        return spark.createDataFrame([], out)
    turn = vector_of / np.sqrt(value)

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - centre).astype(np.float64) - rest) @ turn

    # the whitened rows with a column of ones, so that their means are in the same sum
    sums2 = _gram(rows, k + 1, lambda x: (lambda w: np.column_stack([w, np.ones(len(w))]))(project(_lists(x, d))))
    mean = sums2[k, :k] / n
    identity_error = float(np.abs(sums2[:k, :k] / n - np.outer(mean, mean) - np.eye(k)).max())
    explained = value / trace
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x = _lists(batch.column(1), d)
                exact = _deviations(x, n, sums)
                m = len(exact)
                each = pa.array(np.repeat(np.arange(m), k))
                columns = [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array([e if e < 1 << 63 else None for e in exact], pa.int64()).take(each), pa.array(project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, identity_error)), pa.array([e if e < 10**38 else None for e in exact], pa.decimal128(38, 0)).take(each)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], names=arrow.names)
        give_back()

    return rows.mapInArrow(run, out)
