"""The offer store as folders of merchant buckets, kept by reference.

Every table is cut into a fixed number of buckets by merchant. A version of the store is a manifest: for each table the
folders of its buckets. A crawl reads the buckets of the merchants that it touches, writes new folders for these alone, and
its manifest refers to the old folders of all others; history is only ever added to. The line that names the new manifest is
appended last and carries the batch id, so a batch that was cut off can be run again (its folders are overwritten) and one
that went through is not applied twice.

One writer at a time. What comes to the driver is the manifest: a line for each table and bucket, and for each batch of
history, whatever the size of the tables.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import reliable_checkpoint
from . import lifecycle
from .dedup import dedup_keep_richest

BUCKETS = 64
HISTORY_BUCKET = -1
LOG = "version long, batch_id string, buckets int, schemas map<string,string>"
MANIFEST = "name string, bucket int, folder string, rows long"


@dataclass(frozen=True)
class Store:
    """A version of the store; `folders` has (table, bucket, folder, rows), relative to the root."""

    spark: SparkSession
    root: str
    version: int
    buckets: int
    schemas: dict[str, StructType]
    folders: tuple[tuple[str, int, str, int], ...]

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or some of its buckets, with a column `bucket`."""
        wanted = None if buckets is None else set(buckets)
        found = [f for t, b, f, _ in self.folders if t == name and (wanted is None or b in wanted)]
        kind = self.schemas[name]
        if not found:
            return self.spark.createDataFrame([], kind).withColumn("bucket", F.lit(None).cast("int"))
        paths = [f"{self.root}/{f}" for f in found]
        df = self.spark.read.schema(StructType([*kind.fields])).option("basePath", f"{self.root}/{name}").parquet(*paths)
        return df.select(*kind.fieldNames(), F.col("bucket").cast("int").alias("bucket"))

    def table(self, name: str) -> DataFrame:
        return self.read(name).drop("bucket")


def bucket_of(merchant: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(merchant.cast("string")), F.lit(buckets)).cast("int")


def _log(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(LOG).json(f"{root}/_log")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def open_store(spark: SparkSession, root: str, version: int | None = None) -> Store:
    """The newest version of the store, or an older one."""
    log = _log(spark, root)
    if log is None:
        raise FileNotFoundError(f"no store under {root}")
    line = (log if version is None else log.filter(F.col("version") == version)).orderBy(F.desc("version")).first()
    rows = spark.read.schema(MANIFEST).json(f"{root}/_manifests/{line['version']}").collect()
    kinds = {name: StructType.fromJson(json.loads(text)) for name, text in line["schemas"].items()}
    return Store(spark, root, line["version"], line["buckets"], kinds, tuple(sorted(tuple(r) for r in rows)))


def has_batch(spark: SparkSession, root: str, batch_id: int | str) -> bool:
    log = _log(spark, root)
    return log is not None and bool(log.filter(F.col("batch_id") == str(batch_id)).take(1))


def _publish(store: Store, batch_id: int | str) -> Store:
    """Write the manifest of a version, then the line of the log that makes it the newest."""
    spark = store.spark
    lines = spark.createDataFrame(list(store.folders), MANIFEST)
    lines.coalesce(1).write.mode("overwrite").json(f"{store.root}/_manifests/{store.version}")
    schemas = {name: kind.json() for name, kind in store.schemas.items()}
    log = spark.createDataFrame([(store.version, str(batch_id), store.buckets, schemas)], LOG)
    log.coalesce(1).write.mode("append").json(f"{store.root}/_log")
    return store


def create_store(spark: SparkSession, root: str, tables: dict[str, DataFrame], buckets: int = BUCKETS) -> Store:
    """A store of the tables given: offers, terms, merchants (bucketed) and history."""
    kinds = {name: df.schema for name, df in tables.items()}
    empty = Store(spark, root, 0, buckets, kinds, ())
    first = {name: with_bucket(name, df, buckets) for name, df in tables.items() if name != "terms"}
    terms = tables["terms"].join(tables["offers"].select(F.col("id").alias("offer_id"), "merchant_id"), "offer_id")
    first["terms"] = terms.withColumn("bucket", bucket_of(F.col("merchant_id"), buckets)).drop("merchant_id")
    return commit(empty, "create", first, list(range(buckets)))


def with_bucket(name: str, df: DataFrame, buckets: int) -> DataFrame:
    if name == "history":
        return df.withColumn("bucket", F.lit(HISTORY_BUCKET))
    return df.withColumn("bucket", bucket_of(F.col("id" if name == "merchants" else "merchant_id"), buckets))


def write_buckets(store: Store, name: str, df: DataFrame, batch_id: int | str) -> list[tuple[str, int, str, int]]:
    """Write the rows by their column `bucket`; the entries of the manifest. Small buckets share a task, a large one is split."""
    folder = f"{name}/batch={batch_id}"
    columns = [*store.schemas[name].fieldNames(), "bucket"]
    df.select(*columns).hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{store.root}/{folder}")
    counts = store.spark.read.schema("bucket int").parquet(f"{store.root}/{folder}").groupBy("bucket").agg(F.count("*").alias("n"))
    return [(name, r["bucket"], f"{folder}/bucket={r['bucket']}", r["n"]) for r in counts.collect()]


def commit(store: Store, batch_id: int | str, tables: dict[str, DataFrame], touched: list[int]) -> Store:
    """The next version: the buckets touched come from `tables`, all others stay as they are."""
    gone = set(touched)
    fresh = [line for name, df in tables.items() for line in write_buckets(store, name, df, batch_id)]
    kept = [line for line in store.folders if line[1] not in gone or line[0] not in tables]
    following = Store(store.spark, store.root, store.version + 1, store.buckets, store.schemas, tuple(sorted([*kept, *fresh])))
    return _publish(following, batch_id)


def _touched(merchants: DataFrame, buckets: int) -> list[int]:
    return sorted(r[0] for r in merchants.select(bucket_of(F.col("merchant_id"), buckets)).distinct().collect())


def _whole_runs(runs: DataFrame) -> DataFrame:
    """Runs with all their columns, those left out filled in."""
    text = F.lit(None).cast("string")
    missing = {"error": text, "aggregator": F.lit(False), "name": text, "url": text, "default_brand": text}
    return runs.withColumns({c: v for c, v in missing.items() if c not in runs.columns})


def apply_batch(store: Store, batch_id: int | str, batch: DataFrame, runs: DataFrame, now: str, method: str = "traditional") -> Store:
    """Merge a crawl into the buckets of the merchants that it touches.

    `batch`: unified offers with merchant_id and pos (merchant_brands for aggregators). `runs`: one row for each crawled
    source with merchant_id and, where needed, error, aggregator, name, url and default_brand. Offers of an aggregator go to
    the brands they name, else to its default brand, else to the generic fuel entry; brands that are new become merchants.
    An aggregator keeps no offers of its own. Sources with an error or without offers only get a line of history.
    """
    if has_batch(store.spark, store.root, batch_id):
        return open_store(store.spark, store.root)
    runs = _whole_runs(runs)
    good = batch.join(runs.filter(F.col("error").isNull()).select("merchant_id"), "merchant_id", "left_semi")
    kept = reliable_checkpoint(dedup_keep_richest(good, ["merchant_id"]))
    via = runs.filter("aggregator").select("merchant_id", F.col("name").alias("_via"), F.col("url").alias("_url"), "default_brand")
    direct = kept.join(via, "merchant_id", "left_anti")
    routed = reliable_checkpoint(_routed(kept, via, store.table("merchants")))
    shared = [c for c in kept.columns if c != "merchant_brands"]
    offers = direct.select(*shared).unionByName(routed.select(*shared))
    stored = reliable_checkpoint(lifecycle.batch_offers(offers))
    emptied = routed.select(F.col("source").alias("merchant_id")).distinct()
    touched = _touched(stored.select("merchant_id").unionByName(emptied), store.buckets)

    def bucketed(df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", bucket_of(F.col("merchant_id"), store.buckets))

    old = {name: store.read(name, touched) for name in ("offers", "terms", "merchants")}
    merged = lifecycle.upsert_offers(old["offers"].drop("bucket"), stored, now, deactivate_crawled=True)
    merged = lifecycle.deactivate_all(merged, emptied)
    terms = lifecycle.terms_rows(bucketed(stored), keep=["bucket"])
    brands = routed.select(F.col("merchant_id").alias("id"), F.col("brand").alias("name"), F.col("_url").alias("url"), F.lit("fuel").alias("category"), "pos")
    merchants = lifecycle.upsert_merchants(old["merchants"].drop("bucket"), brands)
    merchants = lifecycle.touch_merchants(merchants, stored.select("merchant_id"), now)
    tables = {
        "offers": bucketed(merged),
        "terms": lifecycle.replace_terms(old["terms"], terms),
        "merchants": with_bucket("merchants", merchants, store.buckets),
        "history": with_bucket("history", _history(runs, direct, routed, now, method), store.buckets),
    }
    return commit(store, batch_id, tables, touched)


def _routed(kept: DataFrame, via: DataFrame, merchants: DataFrame) -> DataFrame:
    """The offers of aggregators as offers of brands: merchant_id of the brand, source the aggregator, brand, _via, _url."""
    from .relational import route_by_brand

    if "merchant_brands" not in kept.columns:
        kept = kept.withColumn("merchant_brands", F.array().cast("array<string>"))
    own = kept.join(via, "merchant_id")
    named = route_by_brand(own, merchants.select("id", "name"), F.col("default_brand"))
    merchant = F.coalesce(F.col("brand_id").cast("string"), F.md5("brand"))
    return named.withColumn("source", F.col("merchant_id").cast("string")).withColumn("merchant_id", merchant)


def _history(runs: DataFrame, direct: DataFrame, routed: DataFrame, now: str, method: str) -> DataFrame:
    """A line for each source, and for each brand that an aggregator's offers went to."""
    plain = lifecycle.history_rows(runs.filter("not aggregator").select("merchant_id", "error"), direct, now, method)
    pairs = routed.groupBy("source", "merchant_id").agg(F.count("*").alias("n"), F.first("_via").alias("via"))
    line = lambda merchant, n, note: (
        F.col(merchant).alias("merchant_id"),
        F.lit("success").alias("status"),
        F.col(n).cast("long").alias("promotions_found"),
        note.alias("error_message"),
        F.lit(now).cast("timestamp_ntz").alias("scraped_at"),
    )
    brands = pairs.select(*line("merchant_id", "n", F.concat(F.lit(f"Method: {method} (via "), "via", F.lit(")"))))
    sums = pairs.groupBy("source").agg(F.sum("n").alias("n"), F.count("*").alias("brands"))
    own = sums.select(*line("source", "n", F.concat(F.lit("Aggregator: routed to "), F.col("brands").cast("string"), F.lit(" brand(s)"))))
    others = runs.filter("aggregator").join(sums.select(F.col("source").alias("merchant_id")), "merchant_id", "left_anti")
    # An aggregator with an error or without offers has the line of any other source.
    idle = lifecycle.history_rows(others.select("merchant_id", "error"), direct.limit(0), now, method)
    return plain.unionByName(brands).unionByName(own).unionByName(idle)


def age(store: Store, batch_id: int | str, now: str, days: int = 2, as_of: str | None = None) -> Store:
    """Deactivate offers not seen for `days` days, and expired ones with `as_of`; only buckets with such offers are written."""
    if has_batch(store.spark, store.root, batch_id):
        return open_store(store.spark, store.root)

    def aged(offers: DataFrame) -> DataFrame:
        out = lifecycle.deactivate_stale(offers, now, days)
        return out if as_of is None else lifecycle.deactivate_expired(out, as_of)

    before = store.read("offers").withColumn("_was", F.col("is_active").cast("boolean"))
    touched = sorted(r[0] for r in aged(before).filter("_was and not is_active").select("bucket").distinct().collect())
    if not touched:
        return store
    return commit(store, batch_id, {"offers": aged(store.read("offers", touched))}, touched)


def register_merchants(store: Store, batch_id: int | str, seen: DataFrame) -> Store:
    """Insert or refresh merchants by name (name, url, category, pos); buckets without a change stay as they are."""
    if has_batch(store.spark, store.root, batch_id):
        return open_store(store.spark, store.root)
    known = store.read("merchants")
    merged = with_bucket("merchants", lifecycle.upsert_merchants(known.drop("bucket"), seen), store.buckets)
    named = merged.join(seen.select("name").distinct(), "name", "left_semi")
    touched = sorted(r[0] for r in named.select("bucket").distinct().collect())
    if not touched:
        return store
    return commit(store, batch_id, {"merchants": merged.filter(F.col("bucket").isin(touched))}, touched)
