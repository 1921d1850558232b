"""Crawl ingestion, duplicate removal, staleness and health as Structured Streaming jobs.

Every job reads files with an explicit schema, keeps its state in its own checkpoint folder and can be
run to completion with `availableNow` or left running.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators import dedup, store
from ..session import shared_dir


def file_stream(
    spark: SparkSession, path: str, schema: StructType, glob: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


#: Keeps the state on the executors' disks instead of in the JVM's memory, with bounded buffers and without a read before each write.
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def run_to_files(stream: DataFrame, out: str, checkpoint: str, state_store: dict[str, str] | None = None) -> None:
    """Append the stream to parquet files until the present input is used up; state_store: settings of the session meanwhile."""
    conf, settings = stream.sparkSession.conf, state_store or {}
    before = {name: conf.get(name, None) for name in settings}
    for name, value in settings.items():
        conf.set(name, value)
    try:
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def run_now(stream: DataFrame, name: str, state_store: dict[str, str] | None = None) -> DataFrame:
    """Run a stream over the present input into the shared folder and read the result as a table."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    run_to_files(stream, f"{base}/out", f"{base}/state", state_store)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


# --- ingestion ------------------------------------------------------------------------------------------


def ingest_batch(root: str, now: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: merge the micro-batch into the bucketed store under its batch id.

    A batch that was cut off before its line of the log overwrites its own folders when it comes again, and one that
    went through is skipped, so a restart neither loses nor repeats a batch.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        found = store.open_store(batch.sparkSession, root)
        runs = batch.select("merchant_id").distinct().withColumn("error", F.lit(None).cast("string"))
        store.apply_batch(found, f"stream-{batch_id}", batch, runs, now)

    return merge


def stream_crawl_ingest(offers: DataFrame, root: str, checkpoint: str, now: str) -> None:
    """Merge a stream of unified offers into the store under `root`, one version for each micro-batch."""
    query = (
        offers.writeStream.foreachBatch(ingest_batch(root, now))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


# --- duplicates -------------------------------------------------------------------------------------------


def stream_dedup(stream: DataFrame, ts: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """First observation per key while the key is within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def stream_keep_richest(stream: DataFrame, ts: str, scope: list[str], span: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """The richest observation of each key in each span of time, over all micro-batches, when the watermark passes its end.

    The state is one row for each key and span: keys are those of the batch dedup, and the row with the longest terms
    stays, the first one on ties.
    """
    watched = stream.withWatermark(ts, delay).withColumn("_span", F.window(ts, span))
    return dedup.dedup_keep_richest(watched, ["_span", *scope]).drop("_span")


# --- staleness ----------------------------------------------------------------------------------------------


def stream_ttl(stream: DataFrame, key: str, ts: str, days: int = 2, delay: str = "1 hour") -> DataFrame:
    """One row per key and silence longer than `days`: (key, last_seen, stale_at).

    The state is the last observation only; an event-time timer fires when the watermark passes
    last_seen + days, and a gap inside the input is reported when the next observation arrives.
    """
    kind = dict(stream.dtypes)[key]
    gap_ms = days * 86_400_000
    gap_us = gap_ms * 1000

    def watch(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def stale(last_us: int) -> pd.DataFrame:
            last = pd.Timestamp(last_us, unit="us")
            return pd.DataFrame({key: [keys[0]], "last_seen": [last], "stale_at": [last + pd.Timedelta(days=days)]})

        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield stale(last)
            return
        # First and last observation per slot of one gap length: no silence fits inside a slot, so the
        # gaps between slots are all there are, and memory is bounded by the time span, not by the rows.
        slots: dict[int, tuple[int, int]] = {}
        for batch in batches:
            at_us = batch[ts].astype("datetime64[us]").astype("int64")
            for slot, low, high in at_us.groupby(at_us // gap_us).agg(["min", "max"]).itertuples():
                old = slots.get(slot, (low, high))
                slots[slot] = (min(old[0], int(low)), max(old[1], int(high)))
        last = state.get[0] if state.exists else None
        for slot in sorted(slots):
            low, high = slots[slot]
            if last is not None and low - last > gap_us:
                yield stale(last)
            last = high if last is None else max(last, high)
        if last is None:
            return
        state.update((last,))
        due = last // 1000 + gap_ms
        if due > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(due)
        else:
            state.remove()
            yield stale(last)

    return (
        stream.select(key, ts)
        .withWatermark(ts, delay)
        .groupBy(key)
        .applyInPandasWithState(
            watch,
            f"{key} {kind}, last_seen timestamp, stale_at timestamp",
            "last_us long",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


# --- rates and health -----------------------------------------------------------------------------------------


def stream_rate_counts(
    stream: DataFrame, key: str, ts: str, size: str = "1 hour", step: str = "5 minutes", delay: str = "10 minutes"
) -> DataFrame:
    """Events per key in sliding windows, emitted when the watermark closes a window."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, size, step).alias("w"), key)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n")
    )


def stream_run_health(stream: DataFrame, key: str, status: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """Runs per key, status and day, emitted when the day is closed."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 day").alias("w"), key, status)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("day_start"), key, status, "n")
    )
