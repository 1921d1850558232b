"""Joins, projections and aggregates over the offer store.

Joins carry no broadcast hints: adaptive execution broadcasts a side it has measured to be small and
splits the partitions of a hot merchant otherwise. Aggregates combine on the map side.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as terms_fn
from ..functions.text import blank_to_null, or_blank
from . import filters
from .ordering import chunked, running_totals

LISTING = [
    "id",
    "title",
    "discount",
    "bank",
    "wallet",
    "card_type",
    "payment_method",
    "store_types",
    "valid_days",
    "valid_from",
    "valid_until",
    "image_url",
    "cap",
    "stackable",
    "is_active",
    "scraped_at",
    "merchant_name",
    "exclusions",
    "requirements",
    "max_discount",
    "min_purchase",
]
DIGEST = [
    "id",
    "title",
    "discount",
    "bank",
    "wallet",
    "payment_method",
    "valid_days",
    "store_types",
    "cap",
    "min_purchase",
    "stackable",
    "merchant_name",
]
BOT = [
    "id",
    "title",
    "discount",
    "bank",
    "wallet",
    "card_type",
    "payment_method",
    "store_types",
    "valid_days",
    "valid_from",
    "valid_until",
    "cap",
    "min_purchase",
    "merchant_name",
    "category",
]


# --- joins ----------------------------------------------------------------------------------------


def with_merchant(offers: DataFrame, merchants: DataFrame, key: str = "merchant_id") -> DataFrame:
    """Offers with the name and category of their merchant; offers of unknown merchants drop out."""
    side = merchants.select(
        F.col("id").alias(key),
        F.col("name").alias("merchant_name"),
        F.coalesce("category", F.lit("supermarket")).alias("category"),
    )
    return offers.join(side, key)


def first_terms(terms: DataFrame, order: str | None = None) -> DataFrame:
    """One terms row per offer: the one with the smallest `order`."""
    if order is None or order not in terms.columns:
        return terms.dropDuplicates(["offer_id"])
    rest = [c for c in terms.columns if c != "offer_id"]
    best = terms.groupBy("offer_id").agg(F.min_by(F.struct(*rest), order).alias("best"))
    return best.select("offer_id", "best.*")


def keep_first_terms(terms: DataFrame, key: str = "promotion_id", order: str = "id") -> DataFrame:
    """Drop repeated terms rows, keeping the one with the smallest id per offer."""
    rest = [c for c in terms.columns if c != key]
    return terms.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("best")).select(key, "best.*")


def with_terms(offers: DataFrame, terms: DataFrame) -> DataFrame:
    """Left join of the single terms row; parsed lists win over the offer's own when not empty."""
    side = terms.select(
        F.col("offer_id").alias("id"),
        F.col("raw_text"),
        F.col("exclusions").alias("_exclusions"),
        F.col("requirements").alias("_requirements"),
        F.col("max_discount"),
        F.col("min_purchase").alias("tc_min_purchase"),
        F.col("valid_days").alias("tc_valid_days"),
        F.col("payment_methods"),
    )
    joined = offers.join(side, "id", "left")
    for name in ("exclusions", "requirements"):
        parsed = F.when(F.size(F.col(f"_{name}")) > 0, F.col(f"_{name}"))
        own = F.col(name) if name in offers.columns else F.lit(None).cast("array<string>")
        joined = joined.withColumn(name, F.coalesce(parsed, own, F.array().cast("array<string>"))).drop(f"_{name}")
    return joined


def with_raw_terms(offers: DataFrame, raw_terms: DataFrame) -> DataFrame:
    """As `with_terms`, for unparsed terms (offer_id, raw_text): only the joined rows are parsed."""
    packed = offers.select("id", F.struct(*[F.col(c) for c in offers.columns]).alias("_offer"))
    side = raw_terms.select(F.col("offer_id").alias("id"), "raw_text")
    parsed = terms_fn.parse_terms(packed.join(side, "id", "left"), "raw_text")
    joined = parsed.select(
        "_offer.*",
        "raw_text",
        F.when(F.col("raw_text").isNotNull(), F.col("cap")).alias("max_discount"),
        terms_fn.listed(F.col("exclusions")).alias("_exclusions"),
        terms_fn.listed(F.col("requirements")).alias("_requirements"),
    )
    for name in ("exclusions", "requirements"):
        own = F.col(name) if name in offers.columns else F.array().cast("array<string>")
        parsed_items = F.when(F.size(F.col(f"_{name}")) > 0, F.col(f"_{name}"))
        joined = joined.withColumn(name, F.coalesce(parsed_items, own)).drop(f"_{name}")
    return joined


def merchant_active_counts(merchants: DataFrame, offers: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Every merchant with its number of valid offers, zero included."""
    counts = offers.filter(filters.valid_on(as_of)).groupBy("merchant_id").agg(F.count("*").alias("n"))
    return merchants.join(counts, merchants["id"] == counts["merchant_id"], "left").select(
        *[merchants[c] for c in merchants.columns], F.coalesce("n", F.lit(0)).alias("active_offers")
    )


def history_with_merchant(history: DataFrame, merchants: DataFrame) -> DataFrame:
    side = merchants.select(F.col("id").alias("merchant_id"), "name")
    return history.join(side, "merchant_id").select(
        "id", "name", "scraped_at", "status", "promotions_found", "error_message"
    )


def missing_from_crawl(offers: DataFrame, crawl: DataFrame) -> DataFrame:
    """Active offers of crawled merchants whose key is not in the crawl.

    Keys compare the stored form: missing bank as ''. An empty crawl names
    no merchant and so misses nothing.
    """
    keys = crawl.select("merchant_id", "title", or_blank(F.col("bank")).alias("bank"))
    crawled = keys.select("merchant_id").distinct()
    stored = offers.filter(filters.is_active()).withColumn("bank", or_blank(F.col("bank")))
    return stored.join(crawled, "merchant_id", "left_semi").join(
        keys.distinct(), ["merchant_id", "title", "bank"], "left_anti"
    )


def attach_footnotes(cards: DataFrame, notes: DataFrame, text_col: str = "card_text") -> DataFrame:
    """Legal text of the page footnote a card refers to by its '(N)' marker."""
    numbered = cards.withColumn("footnote_num", F.coalesce(F.regexp_extract(text_col, r"\((\d+)\)", 1).try_cast("int"), F.lit(0)))
    side = notes.select("page_id", F.col("n").alias("footnote_num"), F.col("text").alias("legal_text"))
    return numbered.join(side, ["page_id", "footnote_num"], "left").withColumn("legal_text", or_blank(F.col("legal_text")))


def join_details(listing: DataFrame, details: DataFrame, key: str, keep_missing: bool = True) -> DataFrame:
    """Detail fields win over listing fields; a missing detail keeps the listing row or drops it."""
    shared = [c for c in details.columns if c in listing.columns and c != key]
    side = details.withColumnsRenamed({c: f"_d_{c}" for c in shared})
    joined = listing.join(side, key, "left" if keep_missing else "inner")
    for c in shared:
        joined = joined.withColumn(c, F.coalesce(F.col(f"_d_{c}"), F.col(c))).drop(f"_d_{c}")
    return joined


def route_by_brand(
    offers: DataFrame,
    merchants: DataFrame,
    default_brand: Column | None = None,
    generic: str = "Combustible (genérico)",
) -> DataFrame:
    """One row per brand of an aggregator offer; offers without a brand use the default, then the generic one."""
    fallback = F.coalesce(default_brand if default_brand is not None else F.lit(None).cast("string"), F.lit(generic))
    brands = F.when(F.size("merchant_brands") > 0, F.col("merchant_brands")).otherwise(F.array(fallback))
    routed = offers.withColumn("brand", F.explode(brands))
    side = merchants.select(F.col("name").alias("brand"), F.col("id").alias("brand_id"))
    return routed.join(side, "brand", "left")


# --- projections ------------------------------------------------------------------------------------


def _pick(df: DataFrame, names: list[str]) -> DataFrame:
    have = set(df.columns)
    return df.select(*[F.col(n) if n in have else F.lit(None).cast("string").alias(n) for n in names])


def offer_list_view(joined: DataFrame) -> DataFrame:
    return _pick(joined, LISTING)


def digest_view(joined: DataFrame) -> DataFrame:
    return _pick(joined, DIGEST)


def bot_view(joined: DataFrame) -> DataFrame:
    return _pick(joined, BOT)


def offer_detail(offers: DataFrame, merchants: DataFrame, terms: DataFrame, offer_id) -> DataFrame:
    """One offer with merchant and terms; no row when it does not exist."""
    one = offers.filter(F.col("id") == F.lit(offer_id))
    return with_terms(with_merchant(one, merchants), terms.filter(F.col("offer_id") == F.lit(offer_id)))


def lookup_labels(names: DataFrame, name_col: str, labels: dict[str, tuple[str, str]]) -> DataFrame:
    """Display label and initials of an entity: exact key, else either contains the other, else word initials."""
    key = F.lower(F.trim(F.col(name_col)))
    exact_initials = near_initials = None
    for known, (_, initials) in labels.items():
        same, near = key == known, key.contains(known) | F.lit(known).contains(key)
        exact_initials = F.when(same, initials) if exact_initials is None else exact_initials.when(same, initials)
        near_initials = F.when(near, initials) if near_initials is None else near_initials.when(near, initials)
    words = F.slice(F.split(F.col(name_col), " "), 1, 2)
    default = F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    blank = or_blank(F.col(name_col)) == ""
    return names.withColumn(
        "initials", F.when(blank, "??").otherwise(F.coalesce(exact_initials, near_initials, default))
    ).withColumn("label", F.when(blank, "Desconocido").otherwise(F.col(name_col)))


# --- aggregates ---------------------------------------------------------------------------------------


def active_by_merchant(
    merchants: DataFrame, offers: DataFrame, as_of: dt.date | str, min_count: int = 0, category: str | None = None
) -> DataFrame:
    counted = merchant_active_counts(merchants, offers, as_of).withColumn(
        "category", F.coalesce("category", F.lit("supermarket"))
    )
    return counted.filter(filters.category_in(category) & (F.col("active_offers") >= min_count)).orderBy(
        F.desc("active_offers"), "name"
    )


def overview_stats(merchants: DataFrame, offers: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Valid offers, distinct banks, enabled merchants and the newest observation, in one row."""
    enabled = merchants.filter(F.col("enabled").cast("int") == 1).agg(F.count("*").alias("n"))
    return (
        offers.filter(filters.valid_on(as_of))
        .agg(
            F.count("*").alias("total_offers"),
            F.count_distinct(blank_to_null(F.col("bank"))).alias("total_banks"),
            F.max("scraped_at").alias("last_updated"),
        )
        .withColumn("total_merchants", enabled.scalar())
    )


def top_banks(offers: DataFrame, as_of: dt.date | str, k: int = 5) -> DataFrame:
    counts = (
        offers.filter(filters.valid_on(as_of) & (or_blank(F.col("bank")) != ""))
        .groupBy(F.col("bank").alias("name"))
        .agg(F.count("*").alias("n"))
    )
    return counts.orderBy(F.desc("n"), "name").limit(k)


def entity_facet(offers: DataFrame) -> DataFrame:
    """Offers per bank and per wallet, card networks left out. One scan feeds both columns."""
    entities = offers.select(F.explode(F.array("bank", "wallet")).alias("name")).filter(filters.is_issuer(F.col("name")))
    return entities.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name")


def category_stats(joined: DataFrame) -> DataFrame:
    """Per category: offers, merchants with offers, banks; the total row has category NULL."""
    measures = [
        F.count("*").alias("offers"),
        F.count_distinct("merchant_id").alias("merchants"),
        F.count_distinct(blank_to_null(F.col("bank"))).alias("banks"),
    ]
    return joined.rollup("category").agg(*measures)


def merchant_report(merchants: DataFrame, offers: DataFrame) -> DataFrame:
    """Per merchant: all offers, active ones, newest observation."""
    per = offers.groupBy("merchant_id").agg(
        F.count("*").alias("total_offers"),
        F.count_if(filters.is_active()).alias("active_offers"),
        F.max("scraped_at").alias("last_scraped"),
    )
    return merchants.select(F.col("id").alias("merchant_id"), "name").join(per, "merchant_id", "left").select(
        "merchant_id",
        "name",
        F.coalesce("total_offers", F.lit(0)).alias("total_offers"),
        F.coalesce("active_offers", F.lit(0)).alias("active_offers"),
        "last_scraped",
    )


def payment_report(offers: DataFrame, k: int = 10, blank_is_missing: bool = False) -> DataFrame:
    """Active offers per payment entity; '' counts as a value of its own unless `blank_is_missing`."""
    bank, wallet = F.col("bank"), F.col("wallet")
    if blank_is_missing:
        bank, wallet = blank_to_null(bank), blank_to_null(wallet)
    label = F.coalesce(bank, wallet, F.lit("Sin especificar"))
    counts = offers.filter(filters.is_active()).groupBy(label.alias("payment")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "payment").limit(k)


def discount_report(offers: DataFrame, k: int = 10) -> DataFrame:
    kept = offers.filter(filters.is_active() & (or_blank(F.col("discount")) != ""))
    return kept.groupBy("discount").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "discount").limit(k)


def totals(offers: DataFrame) -> DataFrame:
    return offers.filter(filters.is_active()).agg(
        F.count("*").alias("active_offers"), F.count_distinct("merchant_id").alias("merchants")
    )


def last_success(history: DataFrame) -> DataFrame:
    return history.filter(F.col("status") == "success").agg(F.max("scraped_at").alias("last_success"))


def dashboard_metrics(listing: DataFrame) -> DataFrame:
    """Rows, distinct banks ('' counts, NULL does not), merchants, rows with requirements."""
    return listing.agg(
        F.count("*").alias("offers"),
        F.count_distinct("bank").alias("banks"),
        F.count_distinct("merchant_name").alias("merchants"),
        F.count_if(F.size("requirements") > 0).alias("with_requirements"),
    )


def size_by(listing: DataFrame, column: str) -> DataFrame:
    return listing.groupBy(column).agg(F.count("*").alias("n"))


def methods_by_type(methods: DataFrame, size: int = 500) -> DataFrame:
    """A user's method names per type, in chunks, with the number selected."""
    unique = methods.dropDuplicates(["user_id", "entity_type", "entity_name"])
    return chunked(unique, ["user_id", "entity_type"], ["entity_name"], ["entity_name"], size)


def trailing_event_count(events: DataFrame, key: str, ts: str, now: str, seconds: int = 3600, limit: int = 3) -> DataFrame:
    """Events per key strictly newer than now - N seconds, and whether the limit is reached."""
    recent = F.col(ts) > (F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(seconds)))
    return (
        events.filter(recent & (F.col(ts) <= F.lit(now).cast("timestamp_ntz")))
        .groupBy(key)
        .agg(F.count("*").alias("n"))
        .withColumn("limited", F.col("n") >= limit)
    )


def trailing_count_per_event(events: DataFrame, key: str, ts: str, seconds: int = 3600) -> DataFrame:
    """For every event, the events of its key in the N seconds up to and including it.

    The count is the difference of two running counts of the key, at the event and N seconds before. Running counts are
    taken once for each moment, over ranges of about equal size, so neither a busy key nor a burst ends in one task.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    moments = events.select(F.col(key).alias("key"), at.alias("of")).groupBy("key", "of").agg(F.count("*").alias("n"))
    none = F.lit(0).cast("long")
    line = lambda when, kind, n: F.struct(when.alias("at"), F.lit(kind).alias("kind"), n.alias("n"))
    lines = F.array(line(F.col("of"), 0, F.col("n")), line(F.col("of"), 1, none), line(F.col("of") - seconds * 1_000_000, 1, none))
    asked = moments.select("key", "of", F.explode(lines).alias("l")).select("key", "of", "l.*")
    running = running_totals(asked, ["key"], ["at", "kind", "of"], F.col("n"), "total")
    now, then = F.col("at") == F.col("of"), F.col("at") < F.col("of")
    counts = running.filter("kind = 1").groupBy("key", "of").agg(
        (F.sum(F.when(now, F.col("total"))) - F.sum(F.when(then, F.col("total")))).alias("trailing")
    )
    placed = events.withColumn("_of", at)
    joined = placed.join(counts, placed[key].eqNullSafe(counts["key"]) & placed["_of"].eqNullSafe(counts["of"]))
    return joined.select(*[placed[c] for c in events.columns], "trailing")


def run_summary(history: DataFrame, run_id: Column) -> DataFrame:
    """Per run: ok and failed sources, offers found, elapsed seconds."""
    return history.groupBy(run_id.alias("run_id")).agg(
        F.count_if(F.col("status") == "success").alias("ok"),
        F.count_if(F.col("status") == "error").alias("failed"),
        F.sum("promotions_found").alias("offers"),
        (F.unix_micros(F.max("scraped_at").cast("timestamp")) - F.unix_micros(F.min("scraped_at").cast("timestamp"))).alias(
            "elapsed_micros"
        ),
    )


def source_summary(history: DataFrame, key: str = "merchant_id") -> DataFrame:
    """Per source: runs, errors, offers; the grand total has a NULL key."""
    return history.rollup(key).agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.sum("promotions_found").alias("offers"),
    )


def with_entity_label(df: DataFrame) -> DataFrame:
    return df.withColumn("entity", terms_fn.entity_label(F.col("bank"), F.col("wallet")))
