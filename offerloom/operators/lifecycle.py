"""Merging crawls into the offer store, as plans that compute the next snapshot of each table.

Nothing is updated in place: every function returns the next state, `write_snapshot` stores it beside
the old one and switches the pointer last, so a job that dies half way leaves the old state readable.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import dates, terms as terms_fn
from ..functions.money import extract_min_purchase
from ..functions.text import blank_to_null, or_blank
from ..session import reliable_checkpoint
from .dedup import dedup_keep_richest, keep_best
from .unify import offer_id, offer_key

REPLACED = [
    "discount",
    "payment_method",
    "store_types",
    "valid_days",
    "valid_from",
    "valid_until",
    "terms_raw",
    "exclusions",
    "requirements",
    "cap",
    "stackable",
    "min_purchase",
]
KEPT = ["wallet", "card_type", "url", "image_url"]


def _now(now: str | dt.datetime) -> Column:
    return F.lit(str(now)).cast("timestamp_ntz")


def upsert_merchants(merchants: DataFrame, seen: DataFrame) -> DataFrame:
    """Insert new names, refresh url and category of known ones. `seen` has name, url, category, pos."""
    last = keep_best(seen.select("name", "url", "category", "pos"), {"name": F.col("name")}, [F.col("pos")], largest=True)
    side = last.select("name", F.col("url").alias("_url"), F.col("category").alias("_category"))
    joined = merchants.join(side, "name", "full_outer")
    known = {c: F.col(c) for c in merchants.columns}
    known["url"] = F.coalesce("_url", "url")
    known["category"] = F.coalesce("_category", "category", F.lit("supermarket"))
    kind = dict(merchants.dtypes)["id"]
    if kind == "string":
        known["id"] = F.coalesce("id", F.md5("name"))
    if "enabled" in known:
        known["enabled"] = F.coalesce(F.col("enabled").cast("int"), F.lit(1))
    if "scrape_count" in known:
        known["scrape_count"] = F.coalesce("scrape_count", F.lit(0))
    return joined.select(*[v.alias(c) for c, v in known.items()])


def touch_merchants(merchants: DataFrame, touched: DataFrame, now: str) -> DataFrame:
    """Crawl time and run counter of the merchants in `touched` (column merchant_id)."""
    side = touched.select(F.col("merchant_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    joined = merchants.join(side, "id", "left")
    hit = F.col("_hit").isNotNull()
    return (
        joined.withColumn("last_scraped", F.when(hit, _now(now)).otherwise(F.col("last_scraped").cast("timestamp_ntz")))
        .withColumn("scrape_count", F.coalesce("scrape_count", F.lit(0)) + hit.cast("int"))
        .select(*merchants.columns)
    )


def batch_offers(batch: DataFrame) -> DataFrame:
    """The batch reduced to its last row per natural key (column pos gives the order)."""
    merchant, title, bank = offer_key()
    keyed = batch.withColumns({"title": title, "bank": bank})
    return keep_best(
        keyed, {"merchant": merchant, "title": F.col("title"), "bank": F.col("bank")}, [F.col("pos")], largest=True
    )


def upsert_offers(current: DataFrame, batch: DataFrame, now: str, deactivate_crawled: bool = False) -> DataFrame:
    """Next state of the offers.

    Known keys take the batch values of the replaced columns and keep wallet, card type, url and image;
    they become active again. New keys are inserted. With `deactivate_crawled`, offers of the merchants
    and sources in the batch that the batch does not name become inactive.
    """
    reduced = batch_offers(batch)
    kinds = dict(current.dtypes)
    columns, batch_columns = list(kinds), reduced.columns
    renamed = reduced.select(*[F.col(c).alias(f"_n_{c}") for c in batch_columns], F.lit(True).alias("_new"))
    base = current.select("*", F.lit(True).alias("_old"))
    same = (
        (F.col("merchant_id") == F.col("_n_merchant_id"))
        & (F.col("title") == F.col("_n_title"))
        & (or_blank(F.col("bank")) == F.col("_n_bank"))
    )
    joined = base.join(renamed, same, "full_outer")
    is_new, is_old = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    have = set(batch_columns)

    def fresh(name: str, fallback: Column) -> Column:
        return F.col(f"_n_{name}") if name in have else fallback

    if deactivate_crawled:
        crawled = reduced.select(
            F.col("merchant_id").alias("_c_merchant"),
            or_blank(F.col("source") if "source" in have else F.lit("")).alias("_c_source"),
        ).distinct().select("*", F.lit(True).alias("_crawled"))
        source = or_blank(F.col("source")) if "source" in columns else F.lit("")
        joined = joined.join(
            crawled,
            (F.col("merchant_id") == F.col("_c_merchant")) & (source == F.col("_c_source")),
            "left",
        )
        still = F.col("is_active").cast("boolean") & F.col("_crawled").isNull()
    else:
        still = F.col("is_active").cast("boolean")

    out = []
    for name in columns:
        kind = kinds[name]
        if name == "id":
            new_id = F.md5(F.concat_ws("|", F.col("_n_merchant_id").cast("string"), "_n_title", "_n_bank"))
            value = F.coalesce(F.col("id"), new_id)
        elif name in ("merchant_id", "title", "source"):
            value = F.coalesce(F.col(name), fresh(name, F.lit(None)))
        elif name == "bank":
            value = F.when(is_old, or_blank(F.col("bank"))).otherwise(F.col("_n_bank"))
        elif name in REPLACED:
            value = F.when(is_new, fresh(name, F.col(name))).otherwise(F.col(name))
        elif name == "is_active":
            value = is_new | F.coalesce(still, F.lit(False))
        elif name == "scraped_at":
            value = F.when(is_new, _now(now)).otherwise(F.col(name).cast("timestamp_ntz"))
        else:
            value = F.when(is_old, F.col(name)).otherwise(fresh(name, F.lit(None)))
        out.append(value.cast("timestamp_ntz" if name == "scraped_at" else kind).alias(name))
    return joined.select(*out)


def replace_terms(current: DataFrame, fresh: DataFrame, key: str = "offer_id") -> DataFrame:
    """New terms rows win; offers without new terms keep theirs."""
    return current.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def terms_rows(offers: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Parsed terms rows of the offers that carry legal text, with the columns to keep besides."""
    kept = offers.filter(or_blank(F.col("terms_raw")) != "").select(
        *(keep or []),
        offer_id().alias("offer_id"),
        F.col("terms_raw").alias("raw_text"),
        F.filter(F.array("bank", "wallet"), lambda x: or_blank(x) != "").alias("payment_methods"),
    )
    return terms_fn.parse_terms(kept, "raw_text").select(
        *(keep or []),
        "offer_id",
        "raw_text",
        terms_fn.listed(F.col("exclusions")).alias("exclusions"),
        terms_fn.listed(F.col("requirements")).alias("requirements"),
        F.col("cap").alias("max_discount"),
        extract_min_purchase(F.col("raw_text"), "coto").alias("min_purchase"),
        "valid_days",
        "payment_methods",
    )


def append_history(history: DataFrame, rows: DataFrame) -> DataFrame:
    return history.unionByName(rows, allowMissingColumns=True)


def history_rows(runs: DataFrame, inserted: DataFrame, now: str, method: str = "traditional") -> DataFrame:
    """One row per crawled source: `runs` has merchant_id, error (NULL when the crawl went through).

    Sources that found nothing get a note; failed ones keep their error and change nothing else.
    """
    counts = inserted.groupBy("merchant_id").agg(F.count("*").alias("n"))
    found = F.coalesce("n", F.lit(0))
    failed = F.col("error").isNotNull()
    note = (
        F.when(failed, F.col("error"))
        .when(found == 0, F.lit("No promotions found"))
        .otherwise(F.lit(f"Method: {method}"))
    )
    return runs.join(counts, "merchant_id", "left").select(
        "merchant_id",
        F.when(failed, "error").otherwise("success").alias("status"),
        F.when(failed, 0).otherwise(found).cast("long").alias("promotions_found"),
        note.alias("error_message"),
        _now(now).alias("scraped_at"),
    )


def deactivate_all(offers: DataFrame, merchants: DataFrame) -> DataFrame:
    """Deactivate every offer of the merchants named (column merchant_id)."""
    side = merchants.select("merchant_id").distinct().withColumn("_hit", F.lit(True))
    joined = offers.join(side, "merchant_id", "left")
    return joined.withColumn("is_active", F.col("is_active").cast("boolean") & F.col("_hit").isNull()).select(*offers.columns)


def deactivate_missing(offers: DataFrame, crawl: DataFrame) -> DataFrame:
    """Deactivate active offers of crawled merchants that the crawl no longer shows."""
    keys = crawl.select(
        "merchant_id", "title", or_blank(F.col("bank")).alias("_bank")
    ).distinct()
    seen = keys.withColumn("_seen", F.lit(True))
    crawled = crawl.select("merchant_id").distinct().withColumn("_crawled", F.lit(True))
    joined = (
        offers.withColumn("_bank", or_blank(F.col("bank")))
        .join(crawled, "merchant_id", "left")
        .join(seen, ["merchant_id", "title", "_bank"], "left")
    )
    gone = F.col("_crawled").isNotNull() & F.col("_seen").isNull()
    return joined.withColumn("is_active", F.col("is_active").cast("boolean") & ~gone).select(*offers.columns)


def deactivate_stale(offers: DataFrame, now: str, days: int = 2) -> DataFrame:
    """Deactivate offers not seen for more than `days` days."""
    old = F.col("scraped_at").cast("timestamp_ntz") < _now(now) - F.make_dt_interval(days=F.lit(days))
    return offers.withColumn("is_active", F.col("is_active").cast("boolean") & ~F.coalesce(old, F.lit(False)))


def deactivate_expired(offers: DataFrame, as_of: str | dt.date) -> DataFrame:
    gone = F.coalesce(F.col("valid_until") < F.lit(str(as_of)).cast("date"), F.lit(False))
    return offers.withColumn("is_active", F.col("is_active").cast("boolean") & ~gone)


def backfill_dates(offers: DataFrame, columns: tuple[str, ...] = ("valid_from", "valid_until"), keep_raw: bool = False) -> DataFrame:
    """Normalise stored date texts; `changed` marks the rows that differ.

    `keep_raw` is the second pass: only texts that are not ISO yet, and an unreadable text stays.
    """
    out, changed = offers, F.lit(False)
    for name in columns:
        raw = F.col(name)
        iso = dates.normalize_date_text(raw)
        if keep_raw:
            iso = F.when(raw.rlike(r"^\d{4}-"), raw).otherwise(F.coalesce(blank_to_null(iso), raw))
        changed = changed | (or_blank(iso) != or_blank(raw))
        out = out.withColumn(f"_{name}", iso)
    out = out.withColumn("changed", changed)
    for name in columns:
        out = out.withColumn(name, F.col(f"_{name}")).drop(f"_{name}")
    return out


STORE_TABLES = ("offers", "terms", "merchants", "history")


def apply_crawl(
    store: dict[str, DataFrame],
    batch: DataFrame,
    runs: DataFrame,
    now: str,
    materialize: bool = False,
    tables: tuple[str, ...] = STORE_TABLES,
) -> dict[str, DataFrame]:
    """Merge one crawl batch into the store.

    `batch` holds unified offers with merchant_id and pos, `runs` one row per crawled merchant with its
    error. Batch rows of failed merchants are ignored. Per merchant: richest duplicate kept, offers of
    the merchant deactivated, batch upserted; merchants with an empty or failed crawl only get history.
    All results read the reduced batch; `materialize` stores it once instead of computing it for each.
    Only the `tables` named are planned.
    """
    good = batch.join(runs.filter(F.col("error").isNull()).select("merchant_id"), "merchant_id", "left_semi")
    kept = dedup_keep_richest(good, ["merchant_id"])
    if materialize:
        kept = reliable_checkpoint(kept)
    stored = batch_offers(kept)
    plans = {
        "offers": lambda: upsert_offers(store["offers"], kept, now, deactivate_crawled=True),
        "terms": lambda: replace_terms(store["terms"], terms_rows(stored)),
        "merchants": lambda: touch_merchants(store["merchants"], stored.select("merchant_id"), now),
        "history": lambda: append_history(store["history"], history_rows(runs, kept, now)),
    }
    return {name: plans[name]() for name in tables}


def route_aggregator(batch: DataFrame, merchants: DataFrame, default_brand: str | None = None) -> DataFrame:
    """Aggregator offers as offers of the brands they name; unknown brands get an id from their name."""
    from .relational import route_by_brand

    routed = route_by_brand(batch, merchants, F.lit(default_brand).cast("string"))
    merchant = F.coalesce(F.col("brand_id").cast("string"), F.md5("brand"))
    return routed.withColumn("source", F.col("merchant_id").cast("string")).withColumn("merchant_id", merchant)


def replace_user_methods(current: DataFrame, submitted: DataFrame) -> DataFrame:
    """Users in `submitted` get exactly their submitted methods; blank names and types are skipped."""
    named = submitted.filter((or_blank(F.col("entity_name")) != "") & (or_blank(F.col("entity_type")) != ""))
    first = named.groupBy("user_id", "entity_name").agg(F.min_by("entity_type", "pos").alias("entity_type"))
    users = submitted.select("user_id").distinct()
    return current.join(users, "user_id", "left_anti").unionByName(first.select(*current.columns))


def upsert_user_prefs(users: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """Partial profile updates: NULL keeps the old value; emails compare lower-case and trimmed.

    New users start with notify_daily off and hour 9. Of several users with one email the first id stays.
    """
    email = F.lower(F.trim("email"))
    base = users.withColumn("email", email)
    base = keep_best(base, {"email": F.col("email")}, [F.col("id")])
    side = keep_best(changes.withColumn("email", email), {"email": F.col("email")}, [F.col("pos")], largest=True)
    fields = ["telegram_chat_id", "notify_daily", "notify_hour"]
    renamed = side.select("email", *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_new"))
    joined = base.join(renamed, "email", "full_outer")
    changed = F.col("_new").isNotNull()
    out = {
        "email": F.col("email"),
        "telegram_chat_id": F.coalesce(F.col("_telegram_chat_id"), F.col("telegram_chat_id")),
        "notify_daily": F.coalesce(F.col("_notify_daily").cast("int"), F.col("notify_daily").cast("int"), F.lit(0)),
        "notify_hour": F.coalesce(
            F.when(F.col("_notify_hour").between(0, 23), F.col("_notify_hour")), F.col("notify_hour"), F.lit(9)
        ),
        "updated_at": F.when(changed, _now(now)),
    }
    return joined.select("id", *[v.alias(n) for n, v in out.items()])


# --- snapshots ---------------------------------------------------------------------------------------


def empty_tables(spark: SparkSession, schemas: dict[str, StructType]) -> dict[str, DataFrame]:
    """The reset state: every table empty, with its schema."""
    return {name: spark.createDataFrame([], kind) for name, kind in schemas.items()}


def write_snapshot(tables: dict[str, DataFrame], root: str, batch_id: int | str) -> None:
    """Write every table under `root/<table>/snapshot=<batch>` and switch the pointer last.

    Writing the same batch id again overwrites its own files only, so a retried batch is harmless.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        # Files follow the partitions of the merge (hashed by key, sized by adaptive execution): a hot
        # merchant is spread, and no task writes more than its own file.
        df.write.mode("overwrite").parquet(f"{root}/{name}/snapshot={batch_id}")
    # The pointer is a log: one appended line per finished batch, the newest line counts.
    _, seq, _ = _last_pointer(spark, root)
    schemas = {name: df.schema.json() for name, df in tables.items()}
    pointer = spark.createDataFrame([(str(batch_id), seq + 1, schemas)], POINTER)
    pointer.coalesce(1).write.mode("append").json(f"{root}/_current")


POINTER = "batch_id string, seq long, schemas map<string,string>"


def _last_pointer(spark: SparkSession, root: str) -> tuple[str | None, int, dict[str, str]]:
    try:
        rows = spark.read.schema(POINTER).json(f"{root}/_current").orderBy(F.desc("seq")).take(1)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None, 0, {}
    return (rows[0]["batch_id"], rows[0]["seq"], rows[0]["schemas"]) if rows else (None, 0, {})


def current_batch(spark: SparkSession, root: str) -> str | None:
    return _last_pointer(spark, root)[0]


def read_snapshot(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables of the newest snapshot, with the schema they were written with (an empty table has no files)."""
    batch, _, schemas = _last_pointer(spark, root)
    if batch is None:
        raise FileNotFoundError(f"no snapshot under {root}")
    out = {}
    for name in names:
        kind = StructType.fromJson(json.loads(schemas[name]))
        df = spark.read.schema(kind).parquet(f"{root}/{name}/snapshot={batch}")
        out[name] = df.select(*kind.fieldNames())
    return out


def replace_merchant_offers(offers: DataFrame, path: str) -> None:
    """Overwrite only the merchants in `offers`: dynamic partition overwrite by merchant.

    Rows are clustered by merchant first, so small merchants are one file each and a large one is split by size.
    """
    offers.hint("rebalance", F.col("merchant_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("merchant_id").parquet(path)


def replaced_merchant_offers(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """The same as a plan: all rows of the merchants in `fresh` go, the fresh rows come."""
    return current.join(fresh.select("merchant_id").distinct(), "merchant_id", "left_anti").unionByName(
        fresh, allowMissingColumns=True
    )
