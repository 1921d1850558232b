"""N-gram Jaccard join with an R-tree over count vectors.

A document is its set of word shingles. Shingles are hashed into groups, and the numbers of shingles in the groups are the
coordinates of a point. Two sets share at most the sum of the smaller coordinates, so a pair, or two boxes with their upper
corners, can be dropped when that sum is below what the similarity asks of their sizes.

The directory. Sizes are cut into classes of one ratio, so a pair lies in one class or in two neighbours. In a class, linked
sets differ in less than m shingles; the groups are dealt into m parts, and by the pigeonhole principle some part has equal
coordinates (and equal shingles) in both. Descending with that as the search region reaches, in each part, the node of equal
coordinates alone: its key is (class, part, hash of the part). Of m parts, at least one in e is equal on average, so sets of
many parts need only the first MOST_PARTS of them: that linked sets differ in all of these has a chance of (1 - 1/e + 0.02)^112, less
than that of two 64-bit hashes being equal. Parts without a shingle, equal in very many sets, are told apart by the parts of a
second dealing (of sets of over DEALT_AGAIN parts they are left out, as the others suffice). This is where boxes of plain count vectors fail: unrelated
sets of n shingles differ by about sqrt(n) in every coordinate, linked ones by up to 0.18 n in all, so that above some fifty
shingles the boxes of a plain tree overlap nearly everywhere.

The tree in a node. A node's sets are first held against the one that meets most others, and what links to it is contracted
to one component. Nodes that still hold several components are searched: few sets by pairs, many in leaves sorted by size
and coordinates, with boxes, under branches of leaves. Pairs of branches and then of leaves descend as long as the sum of
their smaller upper corners allows a link; in a pair of leaves the same bound is asked of every two sets, and what survives
is counted exactly. Leaves give spanning links between components, never all pairs.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import U64, mixed, pieces, saved, table
from offerloom.llm.components import components
from offerloom.llm.simhash import LOWER, fingerprint

SHINGLE = 4
LEAST = 85  # hundredths of the union that linked sets share
GROUPS = 32  # coordinates of a box, and of the point of a small set
IN_A_GROUP = 16  # shingles at most, roughly, before a point has more coordinates
MOST_PARTS = 112  # of a set that have a node of the directory
DEALT_AGAIN = 64  # parts of a set up to which its empty ones are told apart; (1 - 1/e + 0.02)^64 is about 2^-40
RECENT = 100_000  # sets a task remembers, not to list the keys of a copy again
FEW = 16  # sets of a node that are compared as pairs
LEAF = 256  # sets of a leaf
LEAF_BYTES = 1 << 20  # of the points of a leaf
DENSE = 4  # pairs for each set of a pair of leaves; where more may link, the leaves are compared as a whole
MOST_BROADCAST = 200_000  # nodes (some 40 bytes each) that are sent to the texts rather than the texts to them
FANOUT = 32  # leaves of a branch
TEXT_BYTES = 4 << 20  # of the texts a worker has at hand at once, unless one text is longer


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """64-bit hashes of the different shingles of a text, sorted: word hashes, mixed along each run of `size` words."""
    words = (text or "").encode().translate(LOWER).split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    runs = len(words) - size + 1
    if runs <= 0:
        # The whole sequence; its length keeps it apart from runs of `size` words.
        return mixed(np.array([xxhash.xxh3_64_intdigest(hashes.tobytes())], np.uint64), len(words)) if words else hashes
    out = mixed(hashes[:runs])
    for k in range(1, size):
        out = mixed(out + hashes[k : k + runs], k)
    return np.unique(out)


def size_classes(least: int, largest: int = 1 << 40) -> list[int]:
    """The smallest size of each class; a set links only into its own class and the ones beside it."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(starts[-1] * 100 // least + 1)
    return starts


def parts_of(starts: list[int], least: int, number: int) -> int:
    """One more than the shingles in which two linked sets can differ, the smaller being in class `number`."""
    return (100 - least) * (starts[number + 1] - 1) // least + 1


def _dealt(hashes: np.ndarray, parts: int, used: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the first `used` of so many parts of sorted hashes, and which of these have no hash."""
    part = ((hashes >> U64(32)) * U64(parts)) >> U64(32)
    ends = np.searchsorted(part, np.arange(used + 1, dtype=np.uint64))
    sums = np.r_[U64(0), np.cumsum(mixed(hashes[: ends[-1]]), dtype=np.uint64)]
    return sums[ends[1:]] - sums[ends[:-1]], ends[1:] == ends[:-1]


def part_keys(hashes: np.ndarray, number: int, parts: int) -> np.ndarray:
    """Keys of the parts of a set (sorted hashes): sets with the same shingles in a part have one in common."""
    used = min(parts, MOST_PARTS)
    sums, empty = _dealt(hashes, parts, used)
    place = mixed(np.arange(used, dtype=np.uint64) + U64(number << 40), 1)
    keys = mixed(sums ^ place)
    if not empty.any():
        return keys
    if parts > DEALT_AGAIN:
        return keys[~empty]
    again = _dealt(np.sort(mixed(hashes, 5)), parts, parts)[0]
    spots = mixed(np.arange(parts, dtype=np.uint64), 3)
    return np.r_[keys[~empty], mixed((again ^ spots)[None, :] + keys[empty][:, None]).ravel()]


def point(hashes: np.ndarray, groups: int | None = None) -> np.ndarray:
    """Shingles in each group. Groups are a power of two, more for larger sets, told by the low bits of a hash."""
    if groups is None:
        groups = GROUPS
        while groups * IN_A_GROUP < len(hashes):
            groups *= 2
    return np.bincount((hashes & U64(groups - 1)).astype(np.int64), minlength=groups)


def packed_point(counts: np.ndarray) -> bytes:
    """The counts in a byte each, or in eight where one does not fit; the first byte tells which."""
    small = not len(counts) or counts.max() < 256
    return (b"1" if small else b"8") + counts.astype(np.uint8 if small else np.int64).tobytes()


def unpacked_point(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if raw[:1] == b"1" else np.int64, offset=1).astype(np.int64)


def overlap_bound(one: np.ndarray, two: np.ndarray) -> int:
    """Sum of the smaller coordinates, by the groups of the point that has fewer."""
    groups = min(len(one), len(two))
    return int(np.minimum(one.reshape(-1, groups).sum(axis=0), two.reshape(-1, groups).sum(axis=0)).sum())


def _marks(size: int, least: int, with_prints: bool):
    """node (a name of the set; null if empty), its size and point, and its keys in its own class and the one below.

    The keys of a set that the task has just listed are left out. print: the SimHash of the set, if asked for.
    """
    starts = size_classes(least)

    def lists(arrays: list[np.ndarray]) -> pa.Array:
        offsets = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(arrays).view(np.int64)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: set[int] = set()
        for batch in pieces(batches, "text", TEXT_BYTES):
            nodes, sizes, points, prints, keys = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_set(text, size)
                raw = hashes.tobytes()
                node = int(np.uint64(xxhash.xxh3_64_intdigest(raw)).view(np.int64)) if raw else None
                own = np.zeros(0, np.uint64)
                if node is not None and node not in recent:
                    number = bisect_right(starts, len(hashes)) - 1
                    classes = [number, number - 1] if number else [number]
                    own = np.concatenate([part_keys(hashes, k, parts_of(starts, least, k)) for k in classes])
                    if len(recent) >= RECENT:
                        recent.clear()
                    recent.add(node)
                nodes.append(node)
                sizes.append(len(hashes))
                points.append(packed_point(point(hashes)))
                prints.append(fingerprint(hashes) if with_prints else 0)
                keys.append(own)
            if nodes:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("text_key"),
                        pa.array(nodes, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(points, pa.binary()),
                        pa.array(prints, pa.int64()),
                        lists(keys),
                    ],
                    names=["doc_id", "text_key", "node", "size", "point", "print", "keys"],
                )

    return rows


def _sets(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", TEXT_BYTES):
            raw = [shingle_set(t, size).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(raw, pa.binary())], names=["node", "set"])

    return rows


def may_link(shared: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """Whether sets of these sizes in all, that share at most so much, can be linked."""
    return (100 + least) * shared >= least * sizes


def linked(one: np.ndarray, two: np.ndarray, least: int) -> bool:
    """The similarity of two sorted sets, exactly."""
    if 100 * min(len(one), len(two)) < least * max(len(one), len(two)):
        return False
    shared = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * shared >= least * (len(one) + len(two) - shared)


def _company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (bucket, node) rows, each once, without buckets of a single node; the ends of a partition stay in any case."""
    pending: list[pa.RecordBatch] = []
    first, joined = None, False
    for batch in batches:
        merged = pa.Table.from_batches([*pending, batch]).combine_chunks().to_batches()
        if not merged:
            continue
        rows = merged[0]
        bucket, node = (rows.column(c).to_numpy() for c in ("bucket", "node"))
        new = np.r_[True, (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1])]
        rows, bucket = rows.filter(pa.array(new)), bucket[new]
        first = bucket[0] if first is None else first
        alike = bucket[1:] == bucket[:-1]
        after = np.r_[joined, alike]
        yield rows.slice(0, len(rows) - 1).filter(pa.array(after[:-1] | alike | (bucket[:-1] == first)))
        pending, joined = [rows.slice(len(rows) - 1)], bool(after[-1])
    yield from pending


def _bounded(least: int):
    """Pairs whose points allow a link."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = zip(batch.column("p1").to_pylist(), batch.column("p2").to_pylist(), strict=True)
            shared = np.array([overlap_bound(unpacked_point(x), unpacked_point(y)) for x, y in points], np.int64)
            one, two = batch.column("n1").to_numpy(), batch.column("n2").to_numpy()
            fits = may_link(shared, one + two, least) & (100 * np.minimum(one, two) >= least * np.maximum(one, two))
            fits = pa.array(fits)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(fits) for c in ("a", "b")], names=["a", "b"])

    return rows


def _verified(least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("s1"), batch.column("s2"), strict=True)
            fits = [linked(*(np.frombuffer(s.as_buffer(), np.uint64) for s in pair), least) for pair in pairs]
            fits = pa.array(fits, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(fits) for c in ("a", "b")], names=["a", "b"])

    return rows


LEAF_SCHEMA = pa.schema(
    [
        ("bucket", pa.int64()),
        ("smallest", pa.int64()),
        ("corner", pa.list_(pa.int32())),
        ("low_root", pa.int64()),
        ("high_root", pa.int64()),
        ("nodes", pa.list_(pa.int64())),
        ("roots", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int64())),
        ("points", pa.list_(pa.binary())),
    ]
)
LEAF_COLUMNS = (
    "bucket long, smallest long, corner array<int>, low_root long, high_root long, "
    "nodes array<long>, roots array<long>, sizes array<long>, points array<binary>"
)


def _folded(raw: bytes, groups: int) -> np.ndarray:
    return unpacked_point(raw).reshape(-1, groups).sum(axis=0)


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted entries packed into leaves of one node of the directory each, with their boxes."""
    waiting: list[dict] = []
    heavy = 0

    def packed() -> pa.RecordBatch:
        points = np.stack([_folded(e["point"], GROUPS) for e in waiting])
        leaf = {
            "bucket": waiting[0]["bucket"],
            "smallest": min(e["size"] for e in waiting),
            "corner": points.max(axis=0).tolist(),
            "low_root": min(e["root"] for e in waiting),
            "high_root": max(e["root"] for e in waiting),
            **{f"{c}s": [e[c] for e in waiting] for c in ("node", "root", "size", "point")},
        }
        return pa.RecordBatch.from_pylist([leaf], schema=LEAF_SCHEMA)

    for batch in batches:
        for at in range(0, len(batch), LEAF):
            for entry in batch.slice(at, LEAF).to_pylist():
                full = len(waiting) >= LEAF or heavy + len(entry["point"]) > LEAF_BYTES
                if waiting and (full or waiting[0]["bucket"] != entry["bucket"]):
                    yield packed()
                    waiting, heavy = [], 0
                waiting.append(entry)
                heavy += len(entry["point"])
    if waiting:
        yield packed()


def near_points(points: list[bytes], sizes: np.ndarray, roots: np.ndarray, first: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of sets of different components whose points allow a link: between the first sets and the others, or,
    without others, among all."""
    groups = min(len(unpacked_point(p)) for p in points)
    grid = np.stack([_folded(p, groups) for p in points])
    alone = first == len(points)
    found = []
    for i in range(first):
        start = i + 1 if alone else first
        fits = roots[start:] != roots[i]
        fits &= 100 * np.minimum(sizes[i], sizes[start:]) >= least * np.maximum(sizes[i], sizes[start:])
        at = np.flatnonzero(fits) + start
        at = at[may_link(np.minimum(grid[i], grid[at]).sum(axis=1), sizes[i] + sizes[at], least)]
        found.append(np.stack([np.full(len(at), i), at]))
    x, y = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return x, y


def _leaf_pairs(least: int):
    """Pairs of a pair of leaves that may link; one row without nodes if they are too many."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one, two = batch.column("l1")[i].as_py(), batch.column("l2")[i].as_py()
                sides = ["1"] if one == two else ["1", "2"]
                get = lambda name, i=i, sides=sides: [x for s in sides for x in batch.column(name + s)[i].as_py()]  # noqa: B023
                nodes, roots, sizes = (np.array(get(c), np.int64) for c in ("nodes", "roots", "sizes"))
                x, y = near_points(get("points"), sizes, roots, len(batch.column("nodes1")[i].values), least)
                if len(x) > DENSE * len(nodes):
                    ends = [pa.nulls(1, pa.int64())] * 2
                else:
                    # A set may be in both leaves' halves of one node only once, so ends differ.
                    ends = [pa.array(np.maximum(nodes[x], nodes[y])), pa.array(np.minimum(nodes[x], nodes[y]))]
                count = len(ends[0])
                spots = [pa.array(np.full(count, n, np.int64)) for n in (one, two)]
                yield pa.RecordBatch.from_arrays([*spots, *ends], names=["l1", "l2", "a", "b"])

    return rows


def spanning(roots: np.ndarray, sets: list[np.ndarray], first: int, least: int) -> list[tuple[int, int]]:
    """Positions of sets that link and join components, exactly; first as in near_points."""
    sizes = np.array([len(s) for s in sets])
    _, label = np.unique(roots, return_inverse=True)
    out = []
    for i, j in zip(*near_points([packed_point(point(s)) for s in sets], sizes, roots, first, least), strict=True):
        if label[i] != label[j] and linked(sets[i], sets[j], least):
            label[label == label[j]] = label[i]
            out.append((int(i), int(j)))
    return out


def _leaf_links(least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                sides = ["1"] if batch.column("l1")[i] == batch.column("l2")[i] else ["1", "2"]
                members = [batch.column("members" + s)[i].values for s in sides]
                nodes, roots = (np.concatenate([m.field(c).to_numpy() for m in members]) for c in ("node", "root"))
                sets = [np.frombuffer(s.as_buffer(), np.uint64) for m in members for s in m.field("set")]
                pairs = spanning(roots, sets, len(members[0]), least)
                one, two = nodes[[p[0] for p in pairs]], nodes[[p[1] for p in pairs]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(one, two)), pa.array(np.minimum(one, two))], names=["a", "b"])

    return rows


def _boxes_allow(one: str, two: str, least: int) -> Column:
    """Whether two boxes can hold a linked pair, and hold more than one component."""
    corner = F.zip_with(f"{one}.corner", f"{two}.corner", lambda x, y: F.least(x, y).cast("long"))
    shared = F.aggregate(corner, F.lit(0).cast("long"), lambda total, x: total + x)
    wide = F.col(f"{one}.smallest") + F.col(f"{two}.smallest")
    roots = F.least(f"{one}.low_root", f"{two}.low_root") < F.greatest(f"{one}.high_root", f"{two}.high_root")
    return roots & ((100 + least) * shared >= least * wide)


def _tree_pairs(entries: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Descend the trees of directory nodes with many sets; entries: bucket, node, root, size, point.

    The leaves, and rows (l1, l2, a, b): pairs of sets of two leaves that may link, or two leaves with very many such pairs.
    """
    order = ["bucket", "size", "point", "node"]
    ordered = entries.repartitionByRange(*order).sortWithinPartitions(*order)
    leaves = ordered.select("bucket", "node", "root", "size", "point").mapInArrow(_leaves, LEAF_COLUMNS)
    leaves = saved(leaves.withColumn("leaf", F.monotonically_increasing_id()).withColumn("branch", F.expr(f"leaf div {FANOUT}")))
    corner = F.array(*[F.max(F.get("corner", F.lit(i))) for i in range(GROUPS)]).alias("corner")
    box = [F.min("smallest").alias("smallest"), corner, F.min("low_root").alias("low_root"), F.max("high_root").alias("high_root")]
    branches = leaves.groupBy("bucket", "branch").agg(*box)
    same = F.col("one.bucket") == F.col("two.bucket")
    upper = branches.alias("one").join(branches.alias("two"), same & (F.col("one.branch") <= F.col("two.branch")))
    upper = upper.where(_boxes_allow("one", "two", least)).select(
        F.col("one.bucket").alias("bucket"), F.col("one.branch").alias("b1"), F.col("two.branch").alias("b2")
    )
    spots = leaves.select("bucket", "branch", "leaf", "smallest", "corner", "low_root", "high_root")
    on = lambda side, branch: (F.col(f"{side}.bucket") == F.col("up.bucket")) & (F.col(f"{side}.branch") == F.col(f"up.{branch}"))
    lower = upper.alias("up").join(spots.alias("one"), on("one", "b1")).join(spots.alias("two"), on("two", "b2"))
    lower = lower.where((F.col("one.leaf") <= F.col("two.leaf")) & _boxes_allow("one", "two", least))
    met = lower.select(F.col("one.leaf").alias("l1"), F.col("two.leaf").alias("l2"))
    held = ("nodes", "roots", "sizes", "points")
    content = lambda n: leaves.select(F.col("leaf").alias(f"l{n}"), *[F.col(c).alias(f"{c}{n}") for c in held])
    pairs = met.join(content(1), "l1").join(content(2), "l2")
    return leaves, saved(pairs.mapInArrow(_leaf_pairs(least), "l1 long, l2 long, a long, b long"))


def _dense_links(leaves: DataFrame, dense: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Spanning links between the components of pairs of leaves (l1, l2), compared as a whole."""
    used = dense.select(F.col("l1").alias("leaf")).unionByName(dense.select(F.col("l2").alias("leaf"))).distinct()
    single = leaves.join(used, "leaf").select("leaf", F.explode(F.arrays_zip("nodes", "roots")).alias("e"))
    filled = single.select("leaf", F.col("e.nodes").alias("node"), F.col("e.roots").alias("root")).join(sets, "node")
    # A leaf has at most LEAF sets.
    whole = filled.groupBy("leaf").agg(F.collect_list(F.struct("node", "root", "set")).alias("members"))
    side = lambda n: whole.select(F.col("leaf").alias(f"l{n}"), F.col("members").alias(f"members{n}"))
    return dense.join(side(1), "l1").join(side(2), "l2").mapInArrow(_leaf_links(least), "a long, b long").distinct()


def similar_documents(docs: DataFrame, shingle: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles (size of its set) and component_id (smallest doc_id reachable by links, itself included).

    Words are runs of other bytes than blanks, A-Z in lower case; a text of fewer than `shingle` words has its whole
    sequence for one shingle. Documents link when 100 * intersection >= least * union of their sets (least from 51 to 99),
    counted exactly over 64-bit hashes of the shingles. Null and empty texts and texts without words have no shingles and
    link with nothing, not even each other. Equal sets link whatever their texts. Rows without an id take part; a component
    of none but such rows has no component_id. Rows that repeat an id are documents of their own. Other columns than doc_id
    and text are ignored; an empty table gives no rows. Texts are read whole, however long.
    """
    marked, shared = directory(docs, shingle, least)
    classes = classes_of(marked)
    roots = linked_nodes(docs, classes, shared, shingle, least)
    grouped = classes.select("node", "first.doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_node = saved(grouped.join(smallest, "root").select("node", "component_id"))
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    found = marked.select("doc_id", "size", "node").join(by_node, "node", "left")
    return found.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def classes_of(marked: DataFrame) -> DataFrame:
    """The different sets: node, size, point, print and the first document (smallest id) that has it."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    same = [F.min(c).alias(c) for c in ("size", "point", "print")]
    return saved(marked.where("node is not null").groupBy("node").agg(first, *same))


def directory(docs: DataFrame, shingle: int, least: int, with_prints: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text_key, node, size, point, print), and (bucket, node, count) of the directory's nodes in company."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    listed = saved(
        given.mapInArrow(
            _marks(shingle, least, with_prints),
            "doc_id long, text_key binary, node long, size long, point binary, print long, keys array<long>",
        )
    )
    rows = listed.select(F.explode("keys").alias("bucket"), "node")
    # Range partitions split a node of the directory that very many sets share; keys of one set go before they are counted.
    order = ["bucket", "node"]
    met = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_company, "bucket long, node long")
    met = saved(met.distinct())
    counts = met.groupBy("bucket").agg(F.count("*").alias("count")).where("count > 1")
    return saved(listed.drop("keys")), saved(met.join(counts, "bucket").select("bucket", "node", "count"))


def _bounded_pairs(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    spot = lambda n, name: classes.select(F.col("node").alias(name), F.col("size").alias(f"n{n}"), F.col("point").alias(f"p{n}"))
    return saved(pairs.join(spot(1, "a"), "a").join(spot(2, "b"), "b").mapInArrow(_bounded(least), "a long, b long"))


def _sets_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node and set (sorted hashes) of the nodes, read from the texts again."""
    wanted = saved(nodes.join(classes, "node").select("node", "first.doc_id", "first.text_key"))
    if wanted.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_key().alias("key"), "text")
    named = texts.join(wanted, texts["id"].eqNullSafe(wanted["doc_id"]) & (texts["key"] == wanted["text_key"]))
    return saved(named.select("node", "text").mapInArrow(_sets(shingle), "node long, set binary").dropDuplicates(["node"]))


def _verified_pairs(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    side = lambda n, name: sets.select(F.col("node").alias(name), F.col("set").alias(f"s{n}"))
    return saved(pairs.join(side(1, "a"), "a").join(side(2, "b"), "b").mapInArrow(_verified(least), "a long, b long"))


def _candidates(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a > b) of each node's sets with the one that meets most others, and all pairs where a node has few sets."""
    weight = shared.groupBy("node").agg(F.sum("count").alias("weight"))
    heart = shared.join(weight, "node").groupBy("bucket").agg(F.max_by("node", F.struct("weight", "node")).alias("other"))
    ends = [F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")]
    stars = saved(shared.join(heart, "bucket").where("node <> other").select(*ends).distinct())
    few = shared.where(F.col("count").between(3, FEW))
    twice = few.alias("x").join(few.alias("y"), F.expr("x.bucket = y.bucket and x.node > y.node"))
    pairs = twice.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    return stars, pairs.join(stars, ["a", "b"], "left_anti")


def _ends(*pairs: DataFrame) -> DataFrame:
    """The different values of both columns of pairs, as `node`."""
    ends = [df.select(F.col(c).alias("node")) for df in pairs for c in df.columns]
    return reduce(DataFrame.unionByName, ends).distinct()


def linked_nodes(
    docs: DataFrame, classes: DataFrame, shared: DataFrame, shingle: int, least: int, guesses: DataFrame | None = None
) -> DataFrame:
    """node and root of every node that links reach another from. guesses: pairs (a > b) to be verified first."""
    stars, pairs = _candidates(shared)
    if guesses is not None:
        stars = stars.unionByName(guesses).distinct()
    stars, pairs = _bounded_pairs(stars, classes, least), _bounded_pairs(pairs, classes, least)
    sets = _sets_of(docs, classes, _ends(stars, pairs), shingle)
    roots = saved(components(_verified_pairs(stars, sets, least)))

    def rooted(df: DataFrame, name: str) -> DataFrame:
        root = roots.select(F.col("node").alias(name), F.col("root").alias("_root"))
        return df.join(root, name, "left").withColumn(f"{name}_root", F.coalesce("_root", name)).drop("_root")

    apart = rooted(rooted(pairs, "a"), "b").where("a_root <> b_root").select("a", "b")
    near = _verified_pairs(apart, sets, least)
    held = rooted(shared.where(F.col("count") > FEW).select("bucket", "node"), "node").withColumnRenamed("node_root", "root")
    open_ = held.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    entries = held.join(open_.select("bucket"), "bucket").join(classes.select("node", "size", "point"), "node")
    leaves, found = _tree_pairs(entries, least)
    sparse, dense = found.where("a is not null").select("a", "b").distinct(), saved(found.where("a is null").select("l1", "l2"))
    crowd = leaves.join(_ends(dense).withColumnRenamed("node", "leaf"), "leaf").select(F.explode("nodes").alias("node"))
    sets = _sets_of(docs, classes, _ends(sparse).unionByName(crowd).distinct(), shingle)
    links = near.unionByName(_verified_pairs(sparse, sets, least)).unionByName(_dense_links(leaves, dense, sets, least))
    # What the second round links are components of the first: both rounds compose.
    joined = rooted(rooted(links, "a"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    merged = components(joined).select(F.col("node").alias("root"), F.col("root").alias("last"))
    once = roots.join(merged, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    # Nodes that only the second round reaches are their own roots in the first.
    late = merged.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("last").alias("root"))
    return saved(once.unionByName(late))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))
