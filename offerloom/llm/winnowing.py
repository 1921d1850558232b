"""Benchmark decontamination by winnowing.

Of every window of WINDOW consecutive words, the k-gram (GRAM words) with the smallest hash is the window's fingerprint.
Equal windows have equal fingerprints, so every shared span of WINDOW words or more meets in the join of fingerprints; a
hit is then extended to its windows and compared word by word. An item of fewer words is one window, whose only k-gram is
the whole item.

The fingerprints of the benchmark are also folded into a table of bits, sixteen for each up to MOST_SLOTS in all: a document
window whose bit is not set can't have a partner and is not shuffled. Long texts are read in segments that overlap by a
window less one word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import U64, mixed, pieces, saved, table, utf8_bytes

WINDOW = 10
GRAM = 5
LEAST_SLOTS, MOST_SLOTS = 1 << 22, 1 << 27  # bits of the table, which every task holds
SLOT_BITS = 16  # bits for each fingerprint
PIECE_BYTES = 1 << 18
SEGMENT_BYTES = 1 << 20  # of a text that is longer, about
POSITION_BITS = 24
WORD_BYTE = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
CANDIDATES = "array<struct<start:int,n:int,print:long,words:string>>"


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte, end byte and hash of each word of lower-cased bytes; a word ends with its text."""
    inside = WORD_BYTE[data]
    before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    first, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, first, "right") - 1
    # A word's hash is a polynomial of its bytes: the difference of two prefix sums, shifted to the word's start.
    base = U64(0x9E3779B97F4A7C15)
    inverse = U64(pow(int(base), -1, 1 << 64))
    powers = np.cumprod(np.full(len(data) + 1, base, np.uint64))
    shifts = np.cumprod(np.full(len(data) + 1, inverse, np.uint64))
    sums = np.r_[U64(0), np.cumsum(mixed(data.astype(np.uint64)) * powers[: len(data)])]
    return row, first, end, mixed((sums[end] - sums[first]) * shifts[first])


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of `size` consecutive words."""
    count = max(0, len(hashes) - size + 1)
    out = np.full(count, size, np.uint64)
    for k in range(size):
        out = mixed(out ^ hashes[k : k + count], k)
    return out


def _window_prints(hashes: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and fingerprint of each window of `size` words within a row."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = min(size, GRAM) if size == WINDOW else size
    grams = _grams(hashes, gram)
    low = grams >> U64(POSITION_BITS) << U64(POSITION_BITS) | np.arange(len(grams), dtype=np.uint64)
    least = low[:count]
    for k in range(1, size - gram + 1):
        least = np.minimum(least, low[k : k + count])
    start = np.flatnonzero(row[:count] == row[size - 1 :])
    return start, grams[(least[start] & U64((1 << POSITION_BITS) - 1)).astype(np.int64)]


def _is_wanted(prints: np.ndarray, table_: np.ndarray) -> np.ndarray:
    slot = (prints >> U64(20)).astype(np.int64) & (64 * len(table_) - 1)
    return (table_[slot >> 6] >> (slot & 63).astype(np.uint64)) & U64(1) > 0


def _segments(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text's bytes, cut outside of words into segments of about SEGMENT_BYTES."""
    at = 0
    while at < len(data):
        stop = min(len(data), at + SEGMENT_BYTES)
        if stop < len(data):
            outside = np.flatnonzero(~WORD_BYTE[data[stop : stop + SEGMENT_BYTES]])
            while not len(outside) and stop < len(data):
                stop = min(len(data), stop + SEGMENT_BYTES)
                outside = np.flatnonzero(~WORD_BYTE[data[stop : stop + SEGMENT_BYTES]])
            stop += int(outside[0]) if len(outside) else 0
        yield data[at:stop]
        at = stop


def _listed_windows(data: np.ndarray, offsets: np.ndarray, sizes: list[int], wanted: np.ndarray | None, only_short: bool):
    """Words of each text, and a list of its windows, of a piece of texts; a single long text goes by segments."""
    count = len(offsets) - 1
    found: list[list[dict]] = [[] for _ in range(count)]
    long = count == 1 and len(data) > SEGMENT_BYTES
    if long and only_short:
        inside = WORD_BYTE[data]
        long = int((inside[1:] & ~inside[:-1]).sum() + inside[0]) >= WINDOW
    if long:
        sizes = [WINDOW] if only_short else sizes
        parts = ((s, np.array([0, len(s)])) for s in _segments(data))
    else:
        parts = iter([(data, offsets)])
    counts = np.zeros(count, np.int64)
    kept: list[bytes] = []  # the last words of the segments before
    carried = np.zeros(0, np.uint64)
    for part, places in parts:
        row, first, end, hashes = _words(part, places)
        own_counts = np.bincount(row, minlength=count)
        # Words carried over lie in front; windows of these alone have been listed.
        before, hashes, row = len(carried), np.r_[carried, hashes], np.r_[np.zeros(len(carried), row.dtype), row]
        begin = np.cumsum(own_counts) - own_counts - counts + before
        word = lambda w: kept[w] if w < before else part[first[w - before] : end[w - before]].tobytes()  # noqa: B023, E731
        for size in sizes:
            start, prints = _window_prints(hashes, row, size)
            new = start + size > before
            start, prints = start[new], prints[new]
            if wanted is not None:
                hit = _is_wanted(prints, wanted)
                start, prints = start[hit], prints[hit]
            if only_short and size < WINDOW:
                fits = own_counts[row[start]] == size
                start, prints = start[fits], prints[fits]
            for s, p in zip(start.tolist(), prints.view(np.int64).tolist(), strict=True):
                own = int(row[s])
                words = b" ".join(word(w) for w in range(s, s + size)).decode()
                found[own].append({"start": s - int(begin[own]), "n": size, "print": p, "words": words})
        counts += own_counts
        last = range(max(0, len(hashes) - WINDOW + 1), len(hashes))
        kept, carried = [word(w) for w in last], hashes[last.start :]
    return counts, found


def _windows(sizes: list[int], wanted: np.ndarray | None, only_short: bool):
    """Per row of (id, text): the number of words, and the windows whose bit is set in wanted (all, if None).

    only_short: a window below WINDOW words is listed for rows of just so many words (an item is one window).
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE_BYTES):
            raw, offsets = utf8_bytes(batch.column("text"))
            data, offsets = LOWER[raw[offsets[0] : offsets[-1]]], offsets - offsets[0]
            counts, found = _listed_windows(data, offsets, sizes, wanted, only_short)
            fields = pa.list_(
                pa.struct([("start", pa.int32()), ("n", pa.int32()), ("print", pa.int64()), ("words", pa.string())])
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(found, fields)], names=["id", "n_words", "found"]
            )

    return rows


def _listed(df: DataFrame, id_column: str, sizes: list[int], wanted: np.ndarray | None, only_short: bool) -> DataFrame:
    rows = df.select(F.col(id_column).alias("id"), F.col("text"))
    return rows.mapInArrow(_windows(sizes, wanted, only_short), f"id {dict(rows.dtypes)['id']}, n_words long, found {CANDIDATES}")


def _table(prints: DataFrame, count: int) -> np.ndarray:
    """The bits of the fingerprints, 64 to a number; at most MOST_SLOTS bits, whatever the size of the benchmark."""
    slots = LEAST_SLOTS
    while slots < min(MOST_SLOTS, SLOT_BITS * count):
        slots *= 2
    slot = F.expr(f"shiftrightunsigned(print, 20) & {slots - 1}L")
    bits = prints.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("place"))
    got = bits.agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(slots // 64, np.uint64)
    out[got["place"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated.

    docs: doc_id, text; items: item_id, text; ids of any type; other columns are ignored. Null texts have no words; items
    without words match nothing. Items without an id hit like others and count as one, but are not in items_sha256; repeated
    items count once by id, and repeated documents are rows of their own. Texts are read whole, however long. Empty tables
    are fine: without items nothing is hit.
    """
    sizes = list(range(1, WINDOW + 1))
    listed = _listed(items, "item_id", sizes, None, True)
    test = saved(listed.select("id", F.explode("found").alias("w")).select("id", "w.n", "w.print", "w.words").distinct())
    wanted = _table(test, test.count())
    present = sorted(r.n for r in test.select("n").distinct().collect())
    own = saved(_listed(docs, "doc_id", present, wanted, False).withColumn("row", F.monotonically_increasing_id()))
    train = own.select("row", F.explode("found").alias("w")).select("row", "w.*")
    spans = saved(test.select("print", "words").distinct())
    hits = saved(train.join(spans, ["print", "words"]).select("row", "start", "n", "print", "words"))
    covered = hits.select("row", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("word"))
    n_hit = covered.distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    pairs = hits.select("row", "print", "words").distinct().join(test, ["print", "words"]).select("row", "id").distinct()
    ids = F.sort_array(F.collect_list(F.col("id").cast("string")))
    named = pairs.groupBy("row").agg(ids.alias("ids"), F.count("*").alias("n_items"))
    return (
        own.select("row", F.col("id").alias("doc_id"), "n_words")
        .join(n_hit, "row", "left")
        .join(named, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", F.coalesce("ids", F.array().cast("array<string>"))), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = """
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') FROM benchmark
),
items AS (
  SELECT DISTINCT id, n, array_to_string(w[s : s + n - 1], ' ') AS words
  FROM (SELECT id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s
        FROM words WHERE kind = 'i' AND len(w) > 0)
),
spans AS (
  SELECT id, n, s, array_to_string(w[s : s + n - 1], ' ') AS words
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS s
        FROM words, (SELECT DISTINCT n FROM items) WHERE kind = 'd' AND len(w) >= n)
),
hits AS (SELECT * FROM spans WHERE words IN (SELECT words FROM items)),
covered AS (
  SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY id
),
pairs AS (SELECT DISTINCT h.id, i.id AS item FROM hits h JOIN items i USING (words)),
named AS (
  SELECT id, count(*) AS n_items, string_agg(CAST(item AS VARCHAR), ',' ORDER BY CAST(item AS VARCHAR)) AS ids
  FROM pairs GROUP BY id
)
SELECT w.id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN covered USING (id) LEFT JOIN named USING (id) WHERE kind = 'd'
"""
