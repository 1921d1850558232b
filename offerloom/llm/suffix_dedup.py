"""Exact substring dedup by bucket-pointer refinement of suffix buckets.

A byte goes when a string of `length` bytes that covers it also starts anywhere else. Sorting every suffix of a corpus
would shuffle it many times over, so only anchor suffixes take part: of every window of `length` bytes, the q-gram with
the smallest scattered value among its first starts. Equal windows have equal anchors at equal places, and an anchor owns
a run of windows.

Buckets are named by fingerprints, so that no global numbering is needed:

1. The initial bucket of a suffix is its q-gram. The bucket of the prefix of twice the size is named by the bucket at its
   start and the bucket at the later offset `size`; each refinement reuses the names that the one before has made.
2. Anchors whose prefix bucket holds one suffix are final; Spark counts buckets with map-side combining.
3. Buckets that are left are refined by the bucket names at the offsets of the whole run that the anchor owns. Runs
   with a partner are repeated as a whole.
4. Only runs without a partner, and one member of each other run of their bucket, are looked at further: a bucket that
   fits a task window by window, a larger one by halving. The windows are split by the offset of their anchor, each half
   gets the name of the bytes that its windows share as its bucket, and steps 2 and 3 are repeated, down to one window.

Two names of 64 bits decide, one alone only selects what is looked at further. Both derive from 64-bit names of 32 bytes,
so two different windows of a bucket pass for equal with a chance of about 2^-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import BATCH_ROWS, U64, longs, mixed, pieces, release, saved, table, utf8_bytes

LENGTH = 200
GRAM = 8
CORE = 32
PIECE_BYTES = 1 << 18
POSITION_BITS = 24
RUN_BITS = 24  # a run is packed as first start << RUN_BITS | number of windows
RUN_MASK = (1 << RUN_BITS) - 1
BUCKET_ROWS = 2048  # larger buckets are halved


def _names(data: np.ndarray, top: int) -> np.ndarray:
    """Bucket names of the prefixes of `top` bytes (a power of two, at least GRAM) at each position where one fits."""
    n = len(data) - GRAM + 1
    ids = np.empty(n, np.uint64)
    for k in range(min(GRAM, n)):
        part = data[k : k + (n - k + GRAM - 1) // GRAM * GRAM]
        ids[k::GRAM] = np.frombuffer(part.tobytes(), "<u8")
    size = GRAM
    while size < top:
        ids = mixed(ids[:-size] ^ mixed(ids[size:], size), size)
        size *= 2
    return ids


def _span_names(ids: np.ndarray, start: np.ndarray, size: np.ndarray, salt: int) -> np.ndarray:
    """Names of the strings [start, start + size), size >= CORE, from the names at their later offsets."""
    name = mixed(size.astype(np.uint64), salt)
    for k in range(0, int(size.max(initial=0)), CORE):
        at = start + np.minimum(k, size - CORE)
        name = np.where(k < size, mixed(name ^ mixed(ids[at], salt), k), name)
    return name


def _windows_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each `width` consecutive ones."""
    low, size = values, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[: len(low) - (width - size)], low[width - size :]) if width > size else low


def _runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, first window, last window and anchor of each run, as positions of data; windows stay within a row."""
    starts = len(data) - length + 1
    if starts <= 0:
        return (np.zeros(0, np.int64),) * 4
    grams = mixed(_names(data, GRAM).copy())
    order = (grams >> U64(POSITION_BITS) << U64(POSITION_BITS)) | np.arange(len(grams), dtype=np.uint64)
    width = length - CORE + 1
    anchor = (_windows_min(order, width)[:starts] & U64((1 << POSITION_BITS) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first = np.arange(starts)
    inside = row[:starts] == row[length - 1 :]
    first, anchor, row = first[inside], anchor[inside], row[:starts][inside]
    if not len(first):
        return (np.zeros(0, np.int64),) * 4
    edge = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(first) != 1)) + 1
    begin, end = np.r_[0, edge], np.r_[edge, len(first)] - 1
    return row[begin], first[begin], first[end], anchor[begin]


def _segments(batch: pa.RecordBatch, length: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, byte of the text at which the segment starts); a giant text comes in several."""
    data, offsets = utf8_bytes(batch.column("text"))
    if len(batch) > 1 or offsets[-1] - offsets[0] <= 2 * most:
        yield data[offsets[0] : offsets[-1]], offsets - offsets[0], 0
        return
    data = data[offsets[0] : offsets[-1]]
    for at in range(0, len(data), most):
        part = data[at : at + most + length - 1]
        yield part, np.array([0, len(part)]), at


def _anchor_rows(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE_BYTES):
            for data, offsets, shift in _segments(batch, length, PIECE_BYTES):
                row, first, last, anchor = _runs(data, offsets, length)
                if not len(row):
                    continue
                ids = _names(data, CORE)
                begin = offsets[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("text_key").take(pa.array(row)),
                        longs((first - begin + shift) << RUN_BITS | (last - first + 1)),
                        longs(ids[anchor]),
                        longs(_span_names(ids, first, last - first + length, 1) ^ mixed((anchor - first).astype(np.uint64))),
                    ],
                    names=["text_key", "run", "core", "whole"],
                )

    return rows


def _contexts(length: int):
    """The bytes under each run listed with a text. Copies of a text follow each other; one of them is enough."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in pieces(batches, "text", PIECE_BYTES):
            keys, listed = batch.column("text_key"), batch.column("runs").to_pylist()
            for key, text, runs in zip(keys, batch.column("text").to_pylist(), listed, strict=True):
                if key.as_py() == before:
                    continue
                before, raw = key.as_py(), text.encode()
                starts = [r["run"] >> RUN_BITS for r in runs]
                ends = [s + (r["run"] & RUN_MASK) + length - 1 for s, r in zip(starts, runs, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([before] * len(runs), pa.binary()),
                        pa.array([r["run"] for r in runs], pa.int64()),
                        pa.array([r["core"] for r in runs], pa.int64()),
                        pa.array([raw[s:e] for s, e in zip(starts, ends, strict=True)], pa.binary()),
                    ],
                    names=["text_key", "run", "core", "context"],
                )

    return rows


def _windows(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, ...]:
    """Row of the batch, start in its text, and both halves of the name, of each window of its runs."""
    data = np.frombuffer(b"".join(batch.column("context").to_pylist()), np.uint8)
    run = batch.column("run").to_numpy()
    size = run & RUN_MASK
    at = np.cumsum(size + length - 1) - (size + length - 1)
    row = np.repeat(np.arange(len(run)), size)
    step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    ids, full = _names(data, CORE), np.full(len(row), length)
    where = at[row] + step
    return row, (run >> RUN_BITS)[row] + step, _span_names(ids, where, full, 2), _span_names(ids, where, full, 3)


def _repeated(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which names are there twice."""
    order = np.lexsort((two, one))
    same = (np.diff(one[order].view(np.int64)) == 0) & (np.diff(two[order].view(np.int64)) == 0)
    twice = np.zeros(len(one), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    return twice


def _joined(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and packed run of consecutive windows."""
    new = np.r_[True, (np.diff(row) != 0) | (np.diff(start) != 1)][: len(row)]
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(row)])
    return row[first], start[first] << RUN_BITS | size


def _repeated_in_buckets(length: int):
    """Windows that are there twice. The rows of a bucket come one after another, so the last one waits for more."""

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, start, one, two = _windows(batch, length)
        twice = _repeated(one, two)
        row, run = _joined(row[twice], start[twice])
        return pa.RecordBatch.from_arrays(
            [batch.column("text_key").take(pa.array(row)), longs(run)], names=["text_key", "run"]
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            table_ = pa.Table.from_batches([*waiting, batch]).combine_chunks().to_batches()
            whole = table_[0]
            core = whole.column("core").to_numpy()
            cut = int(np.searchsorted(core, core[-1]))
            if cut:
                yield found(whole.slice(0, cut))
            waiting = [whole.slice(cut)]
        if waiting:
            yield found(waiting[0])

    return rows


CONTEXTS = "text_key binary, run long, core long, context binary"
NODES = "text_key binary, run long, at int, low int, core long, whole long, context binary"


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs with `at`, the offset of the anchor: the first place of the context where the bytes of the bucket are."""
    for batch in batches:
        if not len(batch):
            continue
        data, starts = _context_bytes(batch)
        row = np.repeat(np.arange(len(batch)), np.diff(starts))
        ids = _names(data, CORE)
        hits = np.flatnonzero(ids == batch.column("core").to_numpy().view(np.uint64)[row[: len(ids)]])
        _, first = np.unique(row[hits], return_index=True)
        at = pa.array((hits[first] - starts[:-1]).astype(np.int32))
        low = pa.array(np.zeros(len(batch), np.int32))
        columns = [batch.column("text_key"), batch.column("run"), at, low, batch.column("context")]
        yield pa.RecordBatch.from_arrays(columns, names=["text_key", "run", "at", "low", "context"])


def _context_bytes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    contexts = batch.column("context").to_pylist()
    return np.frombuffer(b"".join(contexts), np.uint8), np.cumsum([0, *map(len, contexts)])


def _halves(length: int, width: int):
    """Each run cut in two: windows whose anchor is `low` to low + width - 1 bytes after their start, and the next `width`.

    `core` names the bytes that all windows of such offsets share, `whole` those under the windows that the run has.
    """

    def half(batch: pa.RecordBatch, data: np.ndarray, ids: np.ndarray, starts: np.ndarray, upper: bool) -> pa.RecordBatch:
        run, at = batch.column("run").to_numpy(), batch.column("at").to_numpy().astype(np.int64)
        low = batch.column("low").to_numpy().astype(np.int64) + (width if upper else 0)
        high = np.minimum(low + width - 1, length - CORE)
        least, most = np.maximum(low, at - (run & RUN_MASK) + 1), np.minimum(high, at)
        own = np.flatnonzero(least <= most)
        run, at, low, high, least, most = (x[own] for x in (run, at, low, high, least, most))
        begin, first, size = starts[own], at - most, most - least + 1
        core = _span_names(ids, begin + at - low, length - (high - low), width) ^ mixed(low.astype(np.uint64), width)
        whole = _span_names(ids, begin + first, size - 1 + length, width + length) ^ mixed(most.astype(np.uint64))
        cuts = zip((begin + first).tolist(), (begin + first + size - 1 + length).tolist(), strict=True)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("text_key").take(pa.array(own)),
                longs(((run >> RUN_BITS) + first) << RUN_BITS | size),
                pa.array(most.astype(np.int32)),
                pa.array(low.astype(np.int32)),
                longs(core),
                longs(whole),
                pa.array([data[a:b].tobytes() for a, b in cuts], pa.binary()),
            ],
            names=["text_key", "run", "at", "low", "core", "whole", "context"],
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            data, starts = _context_bytes(batch)
            ids = _names(data, CORE)
            for upper in (False, True):
                yield half(batch, data, ids, starts, upper)

    return rows


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of up to BATCH_ROWS."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, len(batch), BATCH_ROWS):
            part = batch.slice(at, BATCH_ROWS)
            if waiting and sum(map(len, waiting)) + len(part) > BATCH_ROWS:
                yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                waiting = []
            waiting.append(part)
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def _first_halves(length: int, width: int):
    """Contexts, anchors and first halves in one Python step: each step of a stage has a worker of its own for each task,
    and these stay in an executor's memory."""
    contexts, halves = _contexts(length), _halves(length, width)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return halves(_anchored(_gathered(contexts(batches))))

    return rows


def _text_key():
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("text_key")


def _grouped(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs with a partner, which are repeated as a whole; and `member` (text_key, run), one of each group of equal runs in
    the buckets where others have none, with the number of groups, `members`."""
    groups = saved(
        runs.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("text_key", "run")).alias("member"))
    )
    # Saved as keys alone, so that the runs, which may carry their bytes, can go.
    found = saved(runs.join(groups.where("n > 1").select("core", "whole"), ["core", "whole"]).select("text_key", "run"))
    alone = groups.groupBy("core").agg(F.count("*").alias("members"), F.min("n").alias("least")).where("least = 1")
    return found, groups.join(saved(alone.where("members > 1").select("core", "members")), "core")


def repeated_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """text_key and runs (array of packed window runs) of the texts with repeated windows."""
    texts = docs.select(_text_key(), F.coalesce("text", F.lit("")).alias("text"))
    anchors = texts.where(F.octet_length("text") >= length).mapInArrow(
        _anchor_rows(length), "text_key binary, run long, core long, whole long"
    )
    shared = saved(anchors.groupBy("core").count().where("count > 1").select("core"))
    live = saved(anchors.join(shared, "core"))
    found, closer = _grouped(live)
    closer = saved(closer.select("core", "members", "member"))

    def listed(which: str) -> DataFrame:
        runs = F.collect_list(F.struct("member.run", "core")).alias("runs")
        return texts.join(saved(closer.where(which).groupBy("member.text_key").agg(runs)), "text_key")

    fits, large = f"members <= {BUCKET_ROWS}", f"members > {BUCKET_ROWS}"
    small = listed(fits).mapInArrow(_contexts(length), CONTEXTS)
    if not closer.where(large).isEmpty():
        nodes, step, width = listed(large), _first_halves, length - CORE + 1
        while width > 1:
            width = -(-width // 2)
            halves = saved(nodes.mapInArrow(step(length, width), NODES))
            whole, members = _grouped(halves.select("text_key", "run", "core", "whole"))
            found = found.unionByName(whole)
            left = members.select("core", "members", "member.*")
            left = saved(halves.join(left, ["text_key", "run", "core"]))
            small = small.unionByName(left.where(fits).select("text_key", "run", "core", "context"))
            nodes, step = left.where(large).select("text_key", "run", "at", "low", "context"), _halves
            if nodes.isEmpty():
                break
    dealt = small.repartition("core").sortWithinPartitions("core")
    found = found.unionByName(dealt.mapInArrow(_repeated_in_buckets(length), "text_key binary, run long"))
    return saved(found.groupBy("text_key").agg(F.collect_set("run").alias("runs")))


def _marked(text: str | None, runs, length: int) -> tuple[bytes, np.ndarray]:
    """The bytes of a text and which of them go."""
    raw = (text or "").encode()
    gone = np.zeros(len(raw) + 1, np.int64)
    if runs is not None and len(runs):
        runs = np.asarray(runs, np.int64)
        first, size = runs >> RUN_BITS, runs & RUN_MASK
        np.add.at(gone, first, 1)
        np.add.at(gone, first + size + length - 1, -1)
    return raw, np.cumsum(gone)[:-1] > 0


def _report(length: int):
    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def report(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        rows = []
        for text, own in zip(texts, runs, strict=True):
            raw, gone = _marked(text, own, length)
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if gone.any() else raw
            spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
            rows.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return report


def _kept(length: int):
    @F.pandas_udf("string")
    def kept(texts: pd.Series, runs: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, runs, strict=True):
            raw, gone = _marked(text, own, length)
            out.append(np.frombuffer(raw, np.uint8)[~gone].tobytes().decode(errors="ignore") if gone.any() else text)
        return pd.Series(out, dtype=object)

    return kept


def _with_runs(docs: DataFrame, length: int) -> DataFrame:
    """docs as struct `doc`, with the repeated runs of its text."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _text_key())
    runs = repeated_runs(docs, length)
    release(docs.sparkSession)
    return rows.join(runs, "text_key", "left")


def removal_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs (doc_id, text; others are ignored).

    Null text counts as empty (0 bytes). Texts under `length` bytes stay as they are. Repeated rows are separate
    documents, so both lose what they share. An empty table gives no rows.
    """
    rows = _with_runs(docs.select("doc_id", "text"), length)
    report = _report(length)(F.col("doc.text"), F.col("runs"))
    return rows.select("doc.doc_id", report.alias("r")).select("doc_id", "r.*")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes cut out of `text`; all rows and other columns stay.

    A character cut in two goes as a whole. `n_chars`, where there is one, follows the new text. Null text stays null.
    """
    rows = _with_runs(docs, length)
    text = _kept(length)(F.col("doc.text"), F.col("runs"))
    out = rows.select(F.col("doc"), text.alias("kept"))
    columns = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return out.select(*[columns.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(table(spark, sf_dir, "documents"))
