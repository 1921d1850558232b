"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HELD_OUT_FOLDS = 5
U64 = np.uint64


BATCH_ROWS = 1000


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Texts and vectors can be long, so Python workers get them in batches of few rows and bytes."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(rows, str(min(BATCH_ROWS, int(spark.conf.get(rows)) or BATCH_ROWS)))
    spark.conf.set(size, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the session's spark.checkpoint.dir.

    Only a local session without one (tests) gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="offerloom-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle and checkpoint files of steps that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def saved(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder; lineage ends there, and files of finished steps can go."""
    shared_folder(df.sparkSession)
    release(df.sparkSession)
    return df.checkpoint()


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from; rows without an id are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT_FOLDS == 0, F.lit(True))


def utf8_bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and the offset of each (one more at the end); null counts as empty."""
    strings = pc.fill_null(strings.cast(pa.large_string()), "")
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a piece stay below most_bytes, or the piece is a single row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(lengths):
            if i > start and total + n > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(lengths):
            yield batch.slice(start)
    # Workers live on for other stages; what Arrow keeps for itself goes back.
    pa.default_memory_pool().release_unused()


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit integers scattered by multiply and shift."""
    x = (x + U64(salt)) * U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    return x


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
