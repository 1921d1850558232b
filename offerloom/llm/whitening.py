"""Whitening of embeddings by spectral divide and conquer.

The covariance V of all vectors is a small matrix (its side is the vectors' length, whatever the number of rows). The
orthogonal polar factor of V - shift is the matrix sign function, so half of its sum with the identity is the projector
onto the eigenvectors above the shift. Each polar factor comes from QDWH iterations (dynamically weighted Halley steps, at
most about six). The projector and its complement split the space into two invariant subspaces, V is compressed to each,
and both are split again until single directions are left: the components.

Rows pass three aggregations (sums, centred products, the covariance of what comes out) and one map that holds the
components; no row is shuffled, and what comes to the driver has a size of width squared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import table

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
MOST_WIDTH = 8192  # of a vector: V and its components are held by the driver and by each task
STEPS = 30  # QDWH takes about six; more means that the shift hits an eigenvalue
EPS = np.finfo(np.float64).eps
NO_VARIANCE = 1e-11  # of the largest eigenvalue: directions below have no variance to scale by


def _halley(low: float) -> tuple[float, float, float]:
    """Weights of the step that lifts singular values in [low, 1] most."""
    d = (4 * (1 - low**2) / low**4) ** (1 / 3)
    a = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d)))
    b = (a - 1) ** 2 / 4
    return float(a), float(b), float(a + b - 1)


def polar(matrix: np.ndarray) -> np.ndarray | None:
    """The orthogonal polar factor of a symmetric matrix; None where it is singular to working precision."""
    n = len(matrix)
    norm = np.sqrt(np.abs(matrix).sum(axis=0).max() * np.abs(matrix).sum(axis=1).max())
    if norm == 0:
        return None
    x = matrix / norm
    # A lower bound of the smallest singular value, from the triangular factor; too low a bound costs a step or two.
    r = np.linalg.qr(x, mode="r")
    if np.abs(np.diag(r)).min() <= n * EPS:
        return None
    low = 1 / (np.sqrt(n) * max(1.0, np.abs(np.linalg.inv(r)).sum(axis=0).max()))
    low, eye = min(1.0, max(low, EPS)), np.eye(n)
    for _ in range(STEPS):
        a, b, c = _halley(low) if low < 1 else (3.0, 1.0, 3.0)
        before = x
        if c > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))[0]
            x = b / c * x + (a - b / c) / np.sqrt(c) * q[:n] @ q[n:].T
        else:
            lower = np.linalg.cholesky(eye + c * x.T @ x)
            half = np.linalg.solve(lower, x.T)
            x = b / c * x + (a - b / c) * np.linalg.solve(lower.T, half).T
        x = (x + x.T) / 2
        low = min(1.0, low * (a + b * low**2) / (1 + c * low**2))
        if abs(low - 1) < 10 * EPS and np.abs(x - before).max() < EPS ** (1 / 3):
            return x
    return None


def _split(matrix: np.ndarray, shift: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the eigenvectors above the shift, and of those below it."""
    n = len(matrix)
    sign = polar(matrix - shift * np.eye(n))
    if sign is None:
        return None
    above = (sign + np.eye(n)) / 2
    rank = round(float(np.trace(above)))
    if not 0 < rank < n or abs(np.trace(above) - rank) > 1e-6:
        return None
    start = np.hstack([above @ rng.normal(size=(n, rank)), rng.normal(size=(n, n - rank))])
    start[:, rank:] -= above @ start[:, rank:]
    basis = np.linalg.qr(start)[0]
    # One step of subspace iteration takes out what a badly conditioned start leaves.
    again = np.hstack([above @ basis[:, :rank], basis[:, rank:] - above @ basis[:, rank:]])
    basis = np.linalg.qr(again)[0]
    return basis[:, :rank], basis[:, rank:]


def eigenvectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    whole = (matrix + matrix.T) / 2
    size = np.linalg.norm(whole)
    rng = np.random.default_rng(0)

    def parts(basis: np.ndarray) -> list[np.ndarray]:
        own = basis.T @ whole @ basis
        own = (own + own.T) / 2
        n = len(own)
        middle = float(np.trace(own)) / n
        if n == 1 or np.linalg.norm(own - middle * np.eye(n)) <= n * EPS * size:
            return [basis]
        # The mean lies between the eigenvalues, the median of the diagonal halves them better; others step aside.
        spread = np.linalg.norm(own - middle * np.eye(n)) / np.sqrt(n)
        for shift in [float(np.median(np.diag(own))), middle, *(middle + spread * rng.uniform(-0.7, 0.7, 40))]:
            halves = _split(own, shift, rng)
            if halves is not None:
                return [part for half in halves for part in parts(basis @ half)]
        raise ArithmeticError("no shift splits the spectrum")

    found = np.hstack(parts(np.eye(len(whole))))
    found = np.linalg.qr(found)[0]
    values = np.einsum("ij,ik,kj->j", found, whole, found)
    order = np.argsort(-values, kind="stable")
    return values[order], found[:, order]


def _whole(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The integer vectors of a batch, one row each, filled up to width."""
    lists = batch.column("x")
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.full((len(lists), width), SHIFT, np.int64)
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lists)), lengths), place] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


class Moments:
    """n and the sums S of the vectors; differences to the mean are taken before anything is multiplied."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s - s // n * n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n x - S)^2, exact."""
        off = x - self.base
        if float(np.abs(off).max(initial=0) + 1) ** 2 * float(self.n) ** 2 * max(1, x.shape[1]) < 2**62:
            return ((self.n * off - self.rest) ** 2).sum(axis=1).tolist()
        return [sum((self.n * int(v) - int(r)) ** 2 for v, r in zip(row, self.rest, strict=True)) for row in off]


def _products(width: int, vectors: Callable[[np.ndarray], np.ndarray]):
    """Sums of products of each two coordinates (place: first * width + second), once for each task."""
    up = np.triu_indices(width)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((width, width)), False
        for batch in batches:
            y = vectors(batch)
            total += y.T @ y
            some = some or len(batch) > 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(up[0] * width + up[1]), pa.array(total[up])], names=["place", "value"])

    return rows


def _product_matrix(rows: DataFrame, width: int, vectors: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    sums = rows.mapInArrow(_products(width, vectors), "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    got = sums.toArrow()
    out = np.zeros(width * width)
    out[got["place"].to_numpy()] = got["value"].to_numpy()
    out = out.reshape(width, width)
    return out + np.triu(out, 1).T


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), n, deviation (decimal, exact), whitened, explained, identity_error.

    vectors: vec_id long, embedding array of floats; other columns are ignored. Each entry c counts as x = floor(1024 * c) +
    100000. The fit takes all rows whose vector is neither null nor holds a null or non-finite entry; the others are left
    out of the result too. Rows without an id and repeated rows count and are returned each. Shorter vectors are filled up
    with entries of zero. Directions without variance (all of them, if there is one row or all are equal) can't be scaled
    and give no rows; of an eigenvalue that repeats, any orthonormal eigenvectors serve. An empty table gives no rows.
    identity_error is the largest entry of the covariance of the whitened rows less the identity, measured on all of them.
    """
    spark = vectors.sparkSession
    empty = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform("embedding", lambda c: F.floor(SCALE * c.cast("double")) + F.lit(SHIFT))
    rows = vectors.where(F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x")
    )
    n, width = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n or not width:
        return spark.createDataFrame([], empty)
    if width > MOST_WIDTH:
        raise ValueError(f"vectors of {width} entries; at most {MOST_WIDTH} are supported")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += _whole(batch, width).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], names=["place", "value"])

    by_place = rows.mapInArrow(sums, "place long, value long").groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("s"))
    means = Moments(n, [int(r["s"]) for r in sorted(by_place.collect())])
    covariance = _product_matrix(rows, width, lambda batch: means.centred(_whole(batch, width))) / n
    trace = float(np.trace(covariance))
    values, found = eigenvectors(covariance)
    used = int((values[:components] > NO_VARIANCE * max(values[0], 0.0)).sum()) if trace > 0 else 0
    if not used:
        return spark.createDataFrame([], empty)
    scaled = found[:, :used] / np.sqrt(values[:used])
    shared = spark.sparkContext.broadcast(scaled)
    out = _product_matrix(rows, used, lambda batch: means.centred(_whole(batch, width)) @ shared.value) / n
    error = float(np.abs(out - np.eye(used)).max())
    explained = values[:used] / trace

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _whole(batch, width)
            whitened = means.centred(x) @ shared.value
            deviation = pa.array([str(d) for d in means.deviations(x)], pa.string()).cast(pa.decimal128(38, 0))
            which = np.repeat(np.arange(len(x)), used)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(which)),
                    pa.array(np.tile(np.arange(1, used + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(which), n, np.int64)),
                    deviation.take(pa.array(which)),
                    pa.array(whitened.ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(which), error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(results, empty)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitened(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").cast("long"))
