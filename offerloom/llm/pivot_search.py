"""Exact top-k inner products with a pivot-distance index.

Vectors get one more coordinate, sqrt(M - |x|^2) with M the largest squared length (0 for a query), so that the highest
inner product is the smallest distance. Every vector is keyed by its nearest pivot and its distance to it; the table,
range-partitioned by that key, is cut into blocks, each a thin annulus around a pivot.

A query's own block gives its first k scores, hence a radius beyond which nothing can enter. By the triangle inequality
only annuli that meet [d - radius, d + radius] around each pivot (d: the query's distance to it) are expanded; the others
are never read. Whatever is expanded is scored in whole numbers, so bounds decide where to look, never what is returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import saved, table

SCALE = 1024
K = 10
QUERY_STEP = 100
PIVOTS = 32
SAMPLE_ROWS = 2048  # rows from which the pivots are drawn
BLOCK_ROWS = 2048
CHUNK_QUERIES = 512
LIMIT = (1 << 31) - 1


def _integers(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and floor(SCALE * x) of the valid rows, as int64, padded with zeros up to width."""
    ids, lists = batch.column("vec_id"), batch.column("embedding")
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    valid = ids.is_valid().to_numpy(zero_copy_only=False) & lists.is_valid().to_numpy(zero_copy_only=False)
    valid[owner[~np.isfinite(flat)]] = False
    out = np.zeros((len(lengths), max(1, width)), np.int64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    good = valid[owner]
    out[owner[good], place[good]] = np.clip(np.floor(SCALE * flat[good]), -LIMIT, LIMIT).astype(np.int64)
    return ids.filter(pa.array(valid)).to_numpy(zero_copy_only=False).astype(np.int64), out[valid]


def _distances(vectors: np.ndarray, lift: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of each lifted vector to each pivot."""
    x = np.c_[vectors.astype(np.float64), lift]
    squares = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _lift(vectors: np.ndarray, most: float) -> np.ndarray:
    return np.sqrt(np.maximum(0, most - (vectors.astype(np.float64) ** 2).sum(axis=1)))


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products, exact: in floating point while every partial sum is a whole number below 2^53."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    if bound < 2**53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k highest scores but those of the query's own id, ties to the smaller id."""
    keep = np.flatnonzero(ids != own)
    if len(keep) > 4 * k:
        least = np.partition(scores[keep], len(keep) - k)[len(keep) - k]
        keep = keep[scores[keep] >= least]
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def _pivots(sample: np.ndarray, most: float) -> np.ndarray:
    """Up to PIVOTS lifted vectors of the sample, each the farthest from those before."""
    x = np.c_[sample.astype(np.float64), _lift(sample, most)]
    chosen = [0]
    far = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < PIVOTS and far.max(initial=0) > 0:
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def _keyed(width: int, most: float, pivots: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = _integers(batch, width)
            if not len(ids):
                continue
            far = _distances(vectors, _lift(vectors, most), pivots)
            pivot = far.argmin(axis=1)
            raw = [v.tobytes() for v in vectors.astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(pivot.astype(np.int32)), pa.array(far[np.arange(len(ids)), pivot]), pa.array(raw)],
                names=["vec_id", "pivot", "distance", "vector"],
            )

    return rows


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows packed into blocks of at most BLOCK_ROWS of one pivot."""

    def packed(rows: pa.RecordBatch) -> pa.RecordBatch:
        distance = rows.column("distance").to_numpy()
        columns = {
            "pivot": [rows.column("pivot")[0].as_py()],
            "low": [distance[0]],
            "high": [distance[-1]],
            "ids": [rows.column("vec_id").to_numpy().tobytes()],
            "vectors": [b"".join(rows.column("vector").to_pylist())],
        }
        return pa.RecordBatch.from_pydict(columns, schema=BLOCK_SCHEMA)

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        rows = pa.Table.from_batches([*waiting, batch]).combine_chunks().to_batches()
        waiting = []
        if not rows:
            continue
        rows = rows[0]
        pivot = rows.column("pivot").to_numpy()
        start = 0
        for end in [*(np.flatnonzero(np.diff(pivot)) + 1), len(pivot)]:
            while end - start >= BLOCK_ROWS or (end - start and end < len(pivot)):
                yield packed(rows.slice(start, min(BLOCK_ROWS, end - start)))
                start += min(BLOCK_ROWS, end - start)
        if start < len(pivot):
            waiting = [rows.slice(start)]
    if waiting:
        yield packed(waiting[0])


BLOCK_SCHEMA = pa.schema(
    [("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("ids", pa.binary()), ("vectors", pa.binary())]
)


def _home(width: int, most: float, pivots: np.ndarray, k: int, step: int):
    """The queries of each block with the radius that their k best scores in it leave open."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw_ids, raw_vectors in zip(batch.column("ids"), batch.column("vectors"), strict=True):
                ids = np.frombuffer(raw_ids.as_py(), np.int64)
                vectors = np.frombuffer(raw_vectors.as_py(), np.int32).reshape(len(ids), width).astype(np.int64)
                own = np.flatnonzero(ids % step == 0)
                if not len(own):
                    continue
                scores = _scores(vectors[own], vectors)
                far = _distances(vectors[own], np.zeros(len(own)), pivots)
                radius = np.full(len(own), np.inf)
                for j, i in enumerate(own):
                    best = _best(scores[j], ids, ids[i], k)
                    if len(best) == k:
                        squares = float((vectors[i].astype(np.float64) ** 2).sum()) + most - 2.0 * scores[j][best[-1]]
                        radius[j] = np.sqrt(max(0.0, squares)) * (1 + 1e-9) + 1e-3
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[own]),
                        pa.array([vectors[i].astype(np.int32).tobytes() for i in own], pa.binary()),
                        pa.array(radius),
                        pa.array(list(far), pa.list_(pa.float64())),
                    ],
                    names=["query_id", "vector", "radius", "far"],
                )

    return rows


def _expanded(width: int, k: int):
    """The k best of each query of a chunk in a block, for queries whose ball meets the block's annulus."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                get = lambda c: batch.column(c)[row]  # noqa: B023, E731
                ids = np.frombuffer(get("ids").as_py(), np.int64)
                vectors = np.frombuffer(get("vectors").as_py(), np.int32).reshape(len(ids), width).astype(np.int64)
                asked = get("queries").values
                far = np.array([x[get("pivot").as_py()] for x in asked.field("far").to_pylist()])
                radius = asked.field("radius").to_numpy()
                meets = (far - radius <= get("high").as_py()) & (far + radius >= get("low").as_py())
                names = asked.field("query_id").to_numpy()
                raw = asked.field("vector").to_pylist()
                open_ = np.flatnonzero(meets)
                if not len(open_):
                    continue
                queries = np.stack([np.frombuffer(raw[j], np.int32) for j in open_]).astype(np.int64)
                scores = _scores(queries, vectors)
                best = [_best(scores[n], ids, names[j], k) for n, j in enumerate(open_)]
                owner = np.repeat(np.arange(len(open_)), [len(b) for b in best])
                at = np.concatenate(best)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[open_][owner]), pa.array(ids[at]), pa.array(scores[owner, at])],
                    names=["query_id", "vec_id", "score"],
                )

    return rows


def top_k(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k highest integer inner products of each query.

    vectors: vec_id long, embedding array of floats; other columns are ignored. Queries are the rows whose vec_id is
    divisible by query_step, candidates all rows of another vec_id. Each component x counts as floor(1024 * x), within 32
    bits. Rows without id or vector, or with a null or non-finite component, take no part; shorter vectors are padded with
    zeros. Ties go to the smaller vec_id. Of repeated query ids one is asked; repeated candidates are ranked each. Fewer
    than k candidates give fewer rows, an empty table none.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    if width <= 0:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            squares = (_integers(batch, width)[1].astype(np.float64) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([float(squares.max(initial=0))])], names=["most"])

    most = float(rows.mapInArrow(lengths, "most double").agg(F.max("most")).first()[0])
    drawn = rows.where("vec_id is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toArrow()
    sample = np.concatenate([_integers(b, width)[1] for b in drawn.to_batches()] or [np.zeros((0, width))])
    if not len(sample):
        sample = np.zeros((1, width), np.int64)
    pivots = _pivots(sample, most)
    keyed = rows.mapInArrow(_keyed(width, most, pivots), "vec_id long, pivot int, distance double, vector binary")
    order = ["pivot", "distance", "vec_id"]
    blocks = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _blocks, "pivot int, low double, high double, ids binary, vectors binary"
    )
    blocks = saved(blocks.withColumn("block", F.monotonically_increasing_id()))
    asked = blocks.select("ids", "vectors").mapInArrow(
        _home(width, most, pivots, k, query_step), "query_id long, vector binary, radius double, far array<double>"
    )
    asked = asked.groupBy("query_id").agg(F.min(F.struct("radius", "vector", "far")).alias("q"))
    count = max(1, -(-asked.count() // CHUNK_QUERIES))
    chunk = F.pmod(F.xxhash64("query_id"), F.lit(count))
    chunks = saved(
        asked.select("query_id", "q.*").groupBy(chunk.alias("chunk")).agg(
            F.collect_list(F.struct("query_id", "vector", "radius", "far")).alias("queries")
        )
    )
    # The widest ring of a chunk around each pivot; single queries are held against it again where blocks are expanded.
    rings = (
        chunks.select("chunk", F.explode("queries").alias("q"))
        .select("chunk", "q.radius", F.posexplode("q.far").alias("pivot", "far"))
        .groupBy("chunk", "pivot")
        .agg(F.min(F.col("far") - F.col("radius")).alias("inner"), F.max(F.col("far") + F.col("radius")).alias("outer"))
    )
    spots = blocks.select("block", "pivot", "low", "high")
    met = rings.join(spots, "pivot").where("inner <= high and outer >= low").select("chunk", "block")
    pairs = met.join(chunks, "chunk").join(blocks.select("block", "pivot", "low", "high", "ids", "vectors"), "block")
    found = pairs.select("queries", "pivot", "low", "high", "ids", "vectors").mapInArrow(
        _expanded(width, k), "query_id long, vec_id long, score long"
    )
    place = F.expr("row_number() over (partition by query_id order by score desc, vec_id)")
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
