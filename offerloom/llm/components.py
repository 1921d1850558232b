"""Links inside buckets and connected components, for groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import saved

BLOCK = 1024
BLOCK_BYTES = 4 << 20
PART_LINKS = 50_000  # of a partition while links are contracted
MOST_BROADCAST = 200_000  # links (16 bytes each) whose smallest neighbours are sent to all


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of a symmetric matrix, as two arrays of positions."""
    left = np.ones(len(near), bool)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    while left.any():
        front = np.array([int(np.argmax(left))])
        left[front] = False
        while len(front):
            reach = near[front]
            new = np.flatnonzero(reach.any(axis=0) & left)
            ends.append((front[np.argmax(reach[:, new], axis=0)] if len(new) else new, new))
            left[new] = False
            front = new
    return np.concatenate([a for a, _ in ends]), np.concatenate([b for _, b in ends])


def _links(near: Callable[..., np.ndarray], extra: bool):
    """Links of each group of rows (bucket, one, two); the rows of a group follow each other."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        bucket, one, two = (batch.column(c).to_numpy() for c in ("bucket", "one", "two"))
        node, first, second = (batch.column(c).to_numpy() for c in ("node", "s1", "s2"))
        cut = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(one) != 0) | (np.diff(two) != 0)) + 1
        found = []
        for a, b in zip(np.r_[0, cut], np.r_[cut, len(node)], strict=True):
            if b - a > 1:
                own = (batch.column("extra")[a:b].to_pylist(),) if extra else ()
                x, y = _forest(near(first[a:b].view(np.uint64), second[a:b].view(np.uint64), *own))
                found.append(np.stack([node[a:b][x], node[a:b][y]]))
        ends = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        ends = ends[:, ends[0] != ends[1]]
        return pa.RecordBatch.from_arrays([pa.array(ends.max(axis=0)), pa.array(ends.min(axis=0))], names=["a", "b"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            whole = pa.Table.from_batches([*waiting, batch]).combine_chunks().to_batches()[0]
            same = np.ones(len(whole), bool)
            for c in ("bucket", "one", "two"):
                values = whole.column(c).to_numpy()
                same &= values == values[-1]
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield of(whole.slice(0, cut))
            waiting = [whole.slice(cut)]
        if waiting:
            yield of(waiting[0])

    return rows


def bucket_links(rows: DataFrame, near: Callable[..., np.ndarray], extra: DataFrame | None = None) -> DataFrame:
    """Spanning links (a > b) between near nodes that share a bucket.

    rows: bucket long, node long, s1 long, s2 long. near takes both signature halves of a group and gives its matrix;
    extra (node, extra binary) has a third part, which only rows in company carry; rows may say how long it is (bytes).
    A bucket of over BLOCK rows or BLOCK_BYTES bytes is cut into blocks by node, and each pair of blocks is a group of its own, so that no
    task holds a whole bucket and every pair of rows still meets.
    """
    heavy = F.sum("bytes") if "bytes" in rows.columns else F.lit(0)
    counts = saved(rows.groupBy("bucket").agg(F.count("*").alias("count"), heavy.alias("heavy")).where("count > 1"))
    cuts = F.greatest(F.ceil(F.col("count") / BLOCK), F.ceil(F.col("heavy") / BLOCK_BYTES))
    blocks = F.least("count", cuts).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.explode(
        F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    met = (
        rows.join(counts, "bucket")
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", pairs)
        .withColumn("one", F.least("own", "other"))
        .withColumn("two", F.greatest("own", "other"))
        .select("bucket", "one", "two", "node", "s1", "s2")
    )
    if extra is not None:
        met = met.join(extra, "node").select("bucket", "one", "two", "node", "s1", "s2", "extra")
    sorted_rows = met.repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two")
    return sorted_rows.mapInArrow(_links(near, extra is not None), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node that it reaches) of every node with a link; links: a, b (long).

    Alternating large-star and small-star steps: a node's neighbours are joined to its smallest neighbour. Smallest
    neighbours are aggregated on the map side, so a node with very many links is no hot spot. Steps have partitions by the
    number of links that are left, and up to MOST_BROADCAST links the smallest neighbours travel to the links.
    """

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def least_of(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        least = saved(edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).coalesce(parts))
        return least, F.broadcast(least) if before[0] <= MOST_BROADCAST else least

    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(edges)
    while before[0]:
        parts = -(-before[0] // PART_LINKS)
        edges = edges.coalesce(parts)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        _, sent = least_of(both)
        large = both.where("b > a").join(sent, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = saved(large.where("a <> b").distinct().coalesce(parts))
        least, sent = least_of(large)
        small = large.join(sent, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = saved(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct().coalesce(parts))
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
