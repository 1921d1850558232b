"""Hard negatives by a secondary-sort shuffle.

Anchors are a stated query set, scored against all rows in blocks: anchors are packed into chunks, rows into cells, and each
pair of a chunk and a cell is one group of work, so neither side has to fit anywhere whole. A first pass leaves the best
scores of the anchor's own label, from which the positives and their score windows follow. A second pass leaves, of each
cell, only those other rows that can come first in one of the windows.

What is left is packed into keys (anchor, falling score, positive before negative, id) and goes through
repartitionAndSortWithinPartitions, partitioned by the anchor alone. A task then reads the keys of an anchor as a stream:
a positive opens its window, negatives inside an open window are emitted until it has had its share, and nothing of an
anchor is kept but its open windows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import saved, table

SCALE = 256
ANCHOR_STEP = 50
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # hundredths of the positive's score that a negative may have
BLOCK_ROWS = 2048
CELL_ROWS = 65_536
CHUNK_ANCHORS = 8192
SLICE_ANCHORS = 256  # scored at once against a block
MOST_FOUND = 500_000  # rows of a cell, before those that others have overtaken go
LEAST = np.iinfo(np.int64).min
KEY = ">QQBQ"
OFFSET = 1 << 63


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers in 32 bits each, or 64 where one does not fit."""
    fits = len(x) == 0 or max(abs(int(x.min())), abs(int(x.max()))) < 1 << 31
    return b"4" * fits + b"8" * (not fits) + x.astype(np.int32 if fits else np.int64).tobytes()


def _unpack(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32 if raw[:1] == b"4" else np.int64, offset=1).astype(np.int64).reshape(rows, -1)


def _blocks(width: int):
    """Rows (vec_id, label, x) packed by up to BLOCK_ROWS."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                lists = part.column("x")
                lengths = np.diff(lists.offsets.to_numpy())
                x = np.zeros((len(part), width), np.int64)
                place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                x[np.repeat(np.arange(len(part)), lengths), place] = lists.flatten().to_numpy(zero_copy_only=False)
                own = [part.column(c).to_numpy().astype(np.int64).tobytes() for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_pydict({"ids": [own[0]], "labels": [own[1]], "vectors": [_pack(x)]})

    return rows


def _anchors(step: int):
    """The rows of blocks that are anchors."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                at = np.flatnonzero(ids % step == 0)
                x = _unpack(row["vectors"], len(ids))[at]
                labels = np.frombuffer(row["labels"], np.int64)[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), pa.array(labels), pa.array([_pack(v) for v in x], pa.binary())],
                    names=["vec_id", "label", "vector"],
                )

    return rows


def _scores(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Inner products, exact: in floating point while every partial sum is a whole number below 2^53."""
    if float(np.abs(one).max(initial=0)) * float(np.abs(two).max(initial=0)) * one.shape[1] < 2**53:
        return (one.astype(np.float64) @ two.T.astype(np.float64)).astype(np.int64)
    return one @ two.T


def _highest(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k highest scores and of those that tie with the last; LEAST never counts."""
    floor = np.full(len(scores), LEAST + 1)
    if scores.shape[1] > k:
        floor = np.maximum(floor, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
    return np.nonzero(scores >= floor[:, None])


def _first(group: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of each group, higher scores first, ties by smaller id."""
    order = np.lexsort((ids, -scores, group))
    start = np.r_[0, np.flatnonzero(np.diff(group[order])) + 1]
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return order[place < k]


class _Chunk:
    """Anchors of a chunk, and what the cell at hand has left for them."""

    def __init__(self, anchors: list[dict], windows: bool, positives: int, negatives: int, share: tuple[int, int]):
        self.ids = np.array([a["vec_id"] for a in anchors], np.int64)
        self.labels = np.array([a["label"] for a in anchors], np.int64)
        self.vectors = np.concatenate([_unpack(a["vector"], 1) for a in anchors])
        self.windows = None
        self.slots = max(1, positives)
        self.keep = negatives if windows else positives
        if windows:
            # Equal positive scores have the same window; an empty one has its ends crossed.
            self.windows = np.tile(np.array([1, 0], np.int64), (positives, len(anchors), 1))
            for i, a in enumerate(anchors):
                for j, score in enumerate(sorted(set(a["scores"] or []))):
                    self.windows[j, i] = window(score, share)
        self.found: list[np.ndarray] = []

    def meet(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        for at in range(0, len(self.ids), SLICE_ANCHORS):
            cut = slice(at, at + SLICE_ANCHORS)
            scores = _scores(self.vectors[cut], vectors)
            same = self.labels[cut, None] == labels[None, :]
            if self.windows is None:
                fits = same & (self.ids[cut, None] != ids[None, :])
                self._take(0, at, np.where(fits, scores, LEAST), ids)
                continue
            for number, ends in enumerate(self.windows[:, cut]):
                fits = ~same & (scores >= ends[:, :1]) & (scores <= ends[:, 1:])
                if fits.any():
                    self._take(number, at, np.where(fits, scores, LEAST), ids)
        if sum(f.shape[1] for f in self.found) > MOST_FOUND:
            self.found = [self._best()]

    def _take(self, number: int, at: int, scores: np.ndarray, ids: np.ndarray) -> None:
        x, y = _highest(scores, self.keep)
        best = _first(x, scores[x, y], ids[y], self.keep)
        x, y = x[best], y[best]
        self.found.append(np.stack([x + at, np.full(len(x), number), scores[x, y], ids[y]]))

    def _best(self) -> np.ndarray:
        found = np.concatenate(self.found or [np.zeros((4, 0), np.int64)], axis=1)
        return found[:, _first(found[0] * self.slots + found[1], found[2], found[3], self.keep)]

    def left(self) -> pa.RecordBatch:
        rows = np.unique(self._best()[[0, 2, 3]], axis=1)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[rows[0]]), pa.array(rows[1]), pa.array(rows[2])], names=["anchor_id", "score", "vec_id"]
        )


def window(score: int, share: tuple[int, int]) -> tuple[int, int]:
    """Lowest and highest whole score of a negative for a positive's score."""
    return -(-share[0] * score // 100), share[1] * score // 100


def _met(windows: bool, positives: int, negatives: int, share: tuple[int, int]):
    """What each pair of chunk and cell leaves; the row of anchors comes before the blocks of the cell."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, chunk = None, None
        for batch in batches:
            groups = list(zip(batch.column("chunk").to_pylist(), batch.column("cell").to_pylist(), strict=True))
            for i in range(len(batch)):
                if groups[i] != group:
                    if chunk is not None:
                        yield chunk.left()
                    group, chunk = groups[i], None
                if batch.column("anchors")[i].is_valid:
                    chunk = _Chunk(batch.column("anchors")[i].as_py(), windows, positives, negatives, share)
                elif chunk is not None:
                    ids, labels = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("ids", "labels"))
                    chunk.meet(ids, labels, _unpack(batch.column("vectors")[i].as_py(), len(ids)))
        if chunk is not None:
            yield chunk.left()

    return rows


def _pairs(blocks: DataFrame, anchors: DataFrame, chunks: int, cells: int, work) -> DataFrame:
    """anchor_id, score, vec_id that each meeting of a chunk of anchors and a cell of blocks leaves."""
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    packed = anchors.groupBy(chunk.alias("chunk")).agg(F.collect_list(F.struct(*anchors.columns)).alias("anchors"))
    left = packed.select("chunk", every(cells).alias("cell"), "anchors")
    cell = F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int")
    right = blocks.select(every(chunks).alias("chunk"), cell.alias("cell"), "ids", "labels", "vectors")
    both = left.unionByName(right, allowMissingColumns=True)
    dealt = both.repartition(_partitions(blocks.sparkSession), "chunk", "cell")
    dealt = dealt.sortWithinPartitions("chunk", "cell", F.col("anchors").isNull())
    return dealt.mapInArrow(work, "anchor_id long, score long, vec_id long")


def _partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def _key(kind: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("anchor_id", "score", "vec_id"))
            keys = [struct.pack(KEY, a + OFFSET, OFFSET - 1 - s, kind, i + OFFSET) for a, s, i in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], names=["key"])

    return rows


def negatives_of(keys: Iterator[bytes], positives: int, negatives: int, share: tuple[int, int]) -> Iterator[tuple]:
    """(anchor, positive, rank, negative, positive score, negative score) of sorted keys, anchor by anchor."""
    anchor, opened, windows = None, 0, []
    for key in keys:
        own, score, kind, vec_id = struct.unpack(KEY, key)
        if own != anchor:
            anchor, opened, windows = own, 0, []
        score, vec_id = OFFSET - 1 - score, vec_id - OFFSET
        if kind == 0:
            if opened < positives:
                windows.append([vec_id, score, *window(score, share), 0])
                opened += 1
            continue
        # Scores fall, so a window that lies above this one is over.
        windows = [w for w in windows if w[2] <= score and w[4] < negatives]
        for w in windows:
            if score <= w[3]:
                w[4] += 1
                yield anchor - OFFSET, w[0], w[4], vec_id, w[1], score


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    vectors: DataFrame,
    anchor_step: int = ANCHOR_STEP,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    share: tuple[int, int] = (LOW, HIGH),
    scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    vectors: vec_id long, label (whole number), embedding array of floats; other columns are ignored. Each component x counts
    as floor(scale * x), a row's score is its integer inner product with the anchor, ties go to the smaller vec_id. Anchors
    are the rows whose vec_id is divisible by anchor_step, an anchor's positives its first rows of the same label, and for
    each positive the first rows of another label whose score lies within share (hundredths of the positive's score, ends
    included) are returned. Positives without such rows give none; a negative score has no window.

    Rows without id, label or vector, or with a null or non-finite component, take no part. Of rows that repeat an id the one
    with the smallest label and then the smallest vector takes part. Shorter vectors are filled up with zeros. An empty table
    gives no rows. Scores have to fit 64 bits.
    """
    spark = vectors.sparkSession
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform("embedding", lambda c: F.floor(scale * c.cast("double")))
    given = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    rows = vectors.where(given & ~F.coalesce(bad, F.lit(True))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("x")
    )
    n, width = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        return spark.createDataFrame([], RESULT)
    single = rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("row")).select("vec_id", "row.*")
    packed = single.mapInArrow(_blocks(max(1, width)), "ids binary, labels binary, vectors binary")
    blocks = saved(packed.withColumn("block", F.monotonically_increasing_id()))
    anchors = saved(blocks.mapInArrow(_anchors(anchor_step), "vec_id long, label long, vector binary"))
    chunks = max(1, -(-anchors.count() // CHUNK_ANCHORS))
    # Work for all cores, or cells of a bounded size, whichever are more.
    cores = -(-2 * spark.sparkContext.defaultParallelism // chunks)
    cells = max(-(-n // CELL_ROWS), min(-(-n // BLOCK_ROWS), cores))
    best = _pairs(blocks, anchors, chunks, cells, _met(False, positives, negatives, share))
    place = F.expr("row_number() over (partition by anchor_id order by score desc, vec_id)")
    chosen = saved(best.withColumn("place", place).where(F.col("place") <= positives).drop("place"))
    scores = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list("score").alias("scores"))
    open_ = anchors.join(scores, "vec_id")
    near = _pairs(blocks, open_, chunks, cells, _met(True, positives, negatives, share))
    keys = chosen.mapInArrow(_key(0), "key binary").unionByName(near.mapInArrow(_key(1), "key binary"))
    dealt = keys.rdd.map(lambda row: (bytes(row[0]), None)).repartitionAndSortWithinPartitions(
        _partitions(spark), lambda key: zlib.crc32(key[:8])
    )
    found = dealt.mapPartitions(lambda part: negatives_of((key for key, _ in part), positives, negatives, share))
    return spark.createDataFrame(found, RESULT, verifySchema=False)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_sum(list_transform(list_zip(a.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id
),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
),
r AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM r WHERE rank <= 3
"""
