"""SimHash near-dedup with pigeonring filtering.

The 64 bits of a fingerprint form a ring of m = 2 * (radius + 1) segments. If two fingerprints differ in at most `radius`
bits, then some segment starts a chain whose first l segments differ in at most l * radius / m bits together, for every l
(the strong form of the pigeonhole principle on a ring). The leading segments of such a chain have a budget below one, so
they are equal, and of those with a budget below two at most one differs. These equal segments are the bucket key; in a
bucket, pairs must keep every budget of the chain before their full distance is counted.

Only different fingerprints are compared. Buckets give spanning links, never all pairs; those above a size are cut into
blocks, and each pair of blocks is compared, so the comparisons grow with the square of a bucket of different nodes.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import U64, mixed, saved, table
from offerloom.llm.components import bucket_links, components

BITS = 64
SEED = 42
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(raw: bytes, size: int) -> np.ndarray:
    """XXH64 of every run of `size` words (A-Z lower-cased); of the whole sequence if it is shorter."""
    words = raw.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    last = max(1, len(words) - size + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((digest(join(words[i : i + size]), SEED) for i in range(last)), np.uint64, last)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is one if it is set in over half of the hashes; zero without any."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(size: int) -> Column:
    """A function of the text column."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(shingle_hashes((t or "").encode(), size)) for t in texts], dtype="int64")

    return of


def _chain(radius: int) -> tuple[int, list[int]]:
    """Bits of a segment, and the budget of the first l segments of a chain for l = 1, 2, ..."""
    segments = 2 * (radius + 1)
    return BITS // segments, [length * radius // segments for length in range(1, segments + 1)]


def _keys(radius: int) -> list[int]:
    """Masks of the bits that must be equal, for a ring turned so that the chain starts at bit 0."""
    bits, budgets = _chain(radius)
    equal, loose = budgets.count(0), budgets.count(1)
    segment = lambda i: ((1 << bits) - 1) << (bits * i)
    fixed = sum(segment(i) for i in range(equal))
    return [fixed + sum(map(segment, c)) for c in combinations(range(equal, equal + loose), max(0, loose - 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ring_rows(nodes: DataFrame, radius: int) -> DataFrame:
    """bucket, node, s1 (fingerprint turned to the start of the chain), s2 (0) for every start and key.

    nodes: node (the fingerprint).
    """
    bits, budgets = _chain(radius)
    masks = _keys(radius)
    starts = F.explode(F.array(*[F.lit(bits * i) for i in range(len(budgets))]))
    turned = F.expr("case when turn = 0 then node else shiftrightunsigned(node, turn) | shiftleft(node, 64 - turn) end")
    keys = F.explode(F.array(*[F.lit(_signed(m)) for m in masks]))
    return (
        nodes.withColumn("turn", starts)
        .withColumn("s1", turned)
        .withColumn("mask", keys)
        .select(
            F.xxhash64("turn", "mask", F.col("s1").bitwiseAND(F.col("mask"))).alias("bucket"),
            "node",
            "s1",
            F.lit(0).cast("long").alias("s2"),
        )
    )


def near_in_chain(radius: int):
    """Pairs of turned fingerprints that keep every budget of the chain, the last of which is the radius itself."""
    bits, budgets = _chain(radius)

    def near(one: np.ndarray, _: np.ndarray) -> np.ndarray:
        differ = one[:, None] ^ one[None, :]
        kept = np.ones(differ.shape, bool)
        for length, budget in enumerate(budgets, 1):
            mask = U64((1 << min(BITS, bits * length if length < len(budgets) else BITS)) - 1)
            kept[kept] = np.bitwise_count(differ[kept] & mask) <= budget
        return kept

    return near


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links) of each row.

    Fingerprints link at `radius` or fewer differing bits. Null and empty texts, and texts without words, have
    fingerprint zero and link like any other. Rows without an id take part; a component of none but such rows has no
    component_id. Columns besides doc_id and text are ignored; an empty table gives no rows.
    """
    marked = saved(docs.select("doc_id", fingerprints(shingle)("text").alias("node")))
    classes = saved(marked.groupBy("node").agg(F.min("doc_id").alias("first")))
    roots = components(bucket_links(ring_rows(classes.select("node"), radius), near_in_chain(radius)))
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_class = saved(rooted.join(least, "root").select("node", "component_id"))
    return marked.join(by_class, "node").select(
        "doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
