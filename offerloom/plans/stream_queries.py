"""Streaming jobs run to completion over the event and offer files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import store
from ..session import shared_dir
from ..streaming import streams
from .lifecycle_queries import (
    BATCH_ONE,
    BATCH_TWO,
    MERGED,
    MERGED_TEXT,
    NOW,
    RICHEST,
    as_batch,
    crawl,
    start_state,
    stored_offers,
)
from .registry import base, query


def event_stream(s, sf):
    schema = base(s, sf, "events").schema
    stream = streams.file_stream(s, sf, schema, "events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "s1_stream_crawl_ingest",
    "fx_crawl",
    f"with b1 as ({BATCH_ONE}), b2 as ({BATCH_TWO}) {MERGED_TEXT} from ({MERGED})",
)
def _(s, sf):
    """Offer files of two crawls ingested by a stream that stops between them; the same as two batch merges."""
    root = f"{shared_dir(s)}/ingest-{uuid.uuid4().hex}"
    store.create_store(s, f"{root}/store", start_state(s, sf))
    for number in (1, 2):
        batch = as_batch(crawl(s, sf, number))
        batch.repartition("merchant_id").write.mode("append").parquet(f"{root}/in")
        offers = streams.file_stream(s, f"{root}/in", batch.schema)
        streams.stream_crawl_ingest(offers, f"{root}/store", f"{root}/state", NOW)
    return stored_offers(store.open_store(s, f"{root}/store"))


@query(
    "s2_stream_keep_richest",
    "fx_crawl",
    f"select batch, supermarket_id as merchant_id, pos, title, bank, wallet, discount from ({RICHEST})",
)
def _(s, sf):
    """The richest offer of each key, from observations that come in several micro-batches."""
    root = f"{shared_dir(s)}/richest-{uuid.uuid4().hex}"
    rows = crawl(s, sf).withColumn("seen_at", F.timestamp_add("day", F.col("batch"), F.lit("2026-01-01 00:00:00").cast("timestamp")))
    # As many files as there are tasks elsewhere, half of them in each micro-batch: no task grows with the share of a file.
    files = max(int(s.conf.get("spark.sql.shuffle.partitions")), 4)
    rows.repartition(files, "title").write.parquet(f"{root}/in")
    # A row of a later day moves the watermark past all others; its own span stays open.
    late = rows.limit(1).withColumns({"seen_at": F.lit("2026-02-01").cast("timestamp"), "bank": F.lit("fin")})
    late.write.mode("append").parquet(f"{root}/in")
    stream = streams.file_stream(s, f"{root}/in", rows.schema, files_per_batch=files // 2)
    found = streams.stream_keep_richest(stream, "seen_at", ["batch", "merchant_id"], delay="20 days")
    streams.run_to_files(found, f"{root}/out", f"{root}/state", streams.ON_DISK)
    return s.read.schema(found.schema).parquet(f"{root}/out").select("batch", "merchant_id", "pos", "title", "bank", "wallet", "discount")


@query(
    "s2_stream_dedup",
    None,
    "select user_id, event_type, count(*) as n from (select distinct user_id, event_type from events) group by 1, 2",
)
def _(s, sf):
    """With a watermark delay longer than the data, keep-first equals a batch distinct."""
    first = streams.stream_dedup(event_stream(s, sf), "ts", ["user_id", "event_type"], "60 days")
    out = streams.run_now(first.select("user_id", "event_type"), "dedup")
    return out.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query(
    "s3_stream_ttl",
    None,
    """with e as (select user_id, ts, lead(ts) over (partition by user_id order by ts) as nxt, max(ts) over () as last from events)
    select user_id, ts as last_seen, ts + interval '2' day as stale_at from e where nxt > ts + interval '2' day
    or (nxt is null and date_trunc('millisecond', ts) + interval '2' day <= date_trunc('millisecond', last - interval '1' hour))""",
)
def _(s, sf):
    out = streams.run_now(streams.stream_ttl(event_stream(s, sf), "user_id", "ts", 2, "1 hour"), "ttl")
    return out.select("user_id", F.col("last_seen").cast("timestamp_ntz"), F.col("stale_at").cast("timestamp_ntz"))


CLOSED = "(select date_trunc('millisecond', max(ts)) - interval '10' minute from events)"


@query(
    "s4_stream_rate_counts",
    None,
    f"""with w as (select time_bucket(interval '5' minute, ts) - unnest(range(12)) * interval '5' minute as window_start, user_id from events)
    select window_start, window_start + interval '1' hour as window_end, user_id, count(*) as n from w where window_start + interval '1' hour <= {CLOSED} group by 1, 2, 3""",
)
def _(s, sf):
    out = streams.run_now(streams.stream_rate_counts(event_stream(s, sf), "user_id", "ts"), "rates", streams.ON_DISK)
    return out.select(F.col("window_start").cast("timestamp_ntz"), F.col("window_end").cast("timestamp_ntz"), "user_id", "n")


@query(
    "s5_stream_run_health",
    None,
    """select date_trunc('day', ts) as day_start, user_id % 100 as merchant_id, case when event_type = 'error' then 'error' else 'success' end as status, count(*) as n from events
    where date_trunc('day', ts) + interval '1' day <= (select date_trunc('millisecond', max(ts)) - interval '1' hour from events) group by 1, 2, 3""",
)
def _(s, sf):
    runs = event_stream(s, sf).select(
        "ts",
        (F.col("user_id") % 100).alias("merchant_id"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
    )
    out = streams.run_now(streams.stream_run_health(runs, "merchant_id", "status", "ts"), "health")
    return out.select(F.col("day_start").cast("timestamp_ntz"), "merchant_id", "status", "n")
