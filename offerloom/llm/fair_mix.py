"""Mixing sources to target weights by Pfair scheduling.

The documents of a source are cut into blocks of BLOCK_DOCS. With weight w (a share of all slots), its k-th block may not
start before slot floor((k - 1) / w) and is due by slot ceil(k / w); each slot goes to the released block with the earliest
deadline. At every slot each source has then had within one block of w times the slots so far.

Weights are whole numbers of slots in a period, so windows and the schedule repeat: one period is scheduled, and a block's
slot follows from its number in its source alone. Nothing else of the schedule depends on the order of other documents.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import saved, table

BLOCK_DOCS = 16
PERIOD = 1000  # slots; more if there are many sources
BUCKET_DOCS = 4096


def whole_weights(weights: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """Slots of each source in a period, by largest remainders and at least one each; they add up to the period."""
    names = sorted(weights)
    period = max(period, 8 * len(names))
    total = sum(max(0.0, weights[n]) for n in names) or 1.0
    exact = {n: max(0.0, weights[n]) / total * (period - len(names)) for n in names}
    slots = {n: 1 + int(exact[n]) for n in names}
    for n in sorted(names, key=lambda n: (int(exact[n]) - exact[n], n))[: period - sum(slots.values())]:
        slots[n] += 1
    return slots


def schedule(slots: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, number in the period from 0, release, deadline, slot) of each block of one period."""
    period = sum(slots.values())
    releases = sorted(
        (k * period // n, -(-(k + 1) * period // n), name, k) for name, n in slots.items() for k in range(n)
    )
    ready: list[tuple[int, str, int, int]] = []
    out, at = [], 0
    for slot in range(period):
        while at < len(releases) and releases[at][0] <= slot:
            release, deadline, name, k = releases[at]
            heapq.heappush(ready, (deadline, name, k, release))
            at += 1
        deadline, name, k, release = heapq.heappop(ready)
        out.append((name, k, release, deadline, slot))
    return out


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """docs with the struct column `mix`: block (in its source, from 0), release, deadline, slot, position.

    position orders the mixture: slot times block_docs, plus the place in the block. All rows stay. Without weights a
    source's target is the square root of its size, so a hot source doesn't drown the others; sources that weights lack get
    the smallest share. A source that has run out leaves its slots empty, and the others keep their shares among each
    other. In its source a document's place follows the hash of its id, so any prefix is a fair draw. Null sources count
    as one source, null ids and repeated rows are placed like others. An empty table gives no rows.
    """
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.coalesce(F.col("source"), F.lit("")).alias("name"),
        F.xxhash64("doc_id").alias("hash"),
        F.col("doc_id").alias("id"),
    )
    # One row for each source comes to the driver, as the weights do.
    counts = {r["name"]: r["n"] for r in keyed.groupBy("name").agg(F.count("*").alias("n")).collect()}
    target = {n: (weights.get(n, 0.0) if weights is not None else c**0.5) for n, c in counts.items()}
    slots = whole_weights(target)
    spark = docs.sparkSession
    dealt = [(n, slots[n], sum(slots.values()), k, r, d, s) for n, k, r, d, s in schedule(slots)] if slots else []
    # As an Arrow table the rows need no Python workers on the executors.
    names = ["name", "share", "period", "turn", "release", "deadline", "slot"]
    kinds = pa.schema([(c, pa.string() if c == "name" else pa.int64()) for c in names])
    plan = spark.createDataFrame(pa.Table.from_pylist([dict(zip(names, t, strict=True)) for t in dealt], kinds))
    buckets = max(1, -(-sum(counts.values()) // BUCKET_DOCS))
    keyed = keyed.withColumn("bucket", F.pmod("hash", F.lit(buckets)))
    sizes = keyed.groupBy("name", "bucket").agg(F.count("*").alias("n"))
    before = F.expr("sum(n) over (partition by name order by bucket rows between unbounded preceding and 1 preceding)")
    bases = saved(sizes.select("name", "bucket", F.coalesce(before, F.lit(0)).alias("base")))
    own = F.expr("row_number() over (partition by name, bucket order by hash, id)") - 1
    placed = keyed.withColumn("own", own).join(bases, ["name", "bucket"])
    place = F.col("base") + F.col("own")
    block = F.floor(place / block_docs)
    shares = saved(plan.select("name", "share").distinct())
    turns = placed.withColumn("place", place).withColumn("block", block).join(F.broadcast(shares), "name")
    turns = turns.withColumn("turn", F.col("block") % F.col("share"))
    rows = turns.join(F.broadcast(plan.drop("share")), ["name", "turn"])
    start = F.floor(F.col("block") / F.col("share")) * F.col("period")
    mix = F.struct(
        F.col("block"),
        (start + F.col("release")).alias("release"),
        (start + F.col("deadline")).alias("deadline"),
        (start + F.col("slot")).alias("slot"),
        ((start + F.col("slot")) * block_docs + F.col("place") % block_docs).alias("position"),
    )
    return rows.select("doc.*", mix.alias("mix"))


def op7_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixed(docs).select("doc_id", "source", "mix.*")
