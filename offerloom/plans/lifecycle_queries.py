"""Queries that merge crawls, age offers and maintain merchants, users and terms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import or_blank, split_csv
from ..operators import dedup, filters, lifecycle, relational, store
from ..schema import HISTORY, OFFERS, TERMS
from ..session import shared_dir
from ..sources import tables
from .extraction_queries import ISO_TEXT, RAW_DATE, raw_dates
from .fixtures import AS_OF, fixture
from .registry import history, merchants, methods, promos, query, show

NOW = "1998-06-01 12:00:00"
ENTITY = "coalesce(nullif(lower(trim(bank)), ''), nullif(lower(trim(wallet)), ''))"
HAS_ONLINE = "(contains(lower(coalesce(store_types, '')), '.com') or contains(lower(coalesce(store_types, '')), 'online'))"
RICH_KEY = f"{ENTITY}, lower(trim(coalesce(discount, ''))), lower(trim(coalesce(valid_days, ''))), {HAS_ONLINE}"


def crawl(spark: SparkSession, sf: str, batch: int | None = None) -> DataFrame:
    df = fixture(spark, sf, "fx_crawl").withColumnRenamed("supermarket_id", "merchant_id")
    return df if batch is None else df.filter(F.col("batch") == batch)


RICHEST = f"""select * from fx_crawl where {ENTITY} is not null
  qualify row_number() over (partition by batch, supermarket_id, {RICH_KEY} order by length(coalesce(terms_raw, '')) desc, pos) = 1"""


@query(
    "e1_dedup_keep_richest",
    "fx_crawl",
    f"select batch, supermarket_id as merchant_id, pos, title, bank, wallet, discount from ({RICHEST})",
)
def _(s, sf):
    kept = dedup.dedup_keep_richest(crawl(s, sf), ["batch", "merchant_id"])
    return kept.select("batch", "merchant_id", "pos", "title", "bank", "wallet", "discount")


FIRST_KEYS = {
    "entity_discount_days_stores": "lower(coalesce(nullif(bank, ''), nullif(wallet, ''), '')), discount, lower(coalesce(valid_days, '')), lower(coalesce(store_types, ''))",
    "squeezed": "lower(regexp_replace(concat(coalesce(bank, ''), coalesce(wallet, ''), discount, coalesce(valid_days, '')), '\\s+', '', 'g'))",
    "bank_wallet_discount_days": "lower(trim(coalesce(bank, ''))), lower(trim(coalesce(wallet, ''))), lower(trim(discount)), lower(trim(coalesce(valid_days, '')))",
    "title_discount": "lower(title), discount",
    "title": "title",
    "title_bank_discount": "title, bank, discount",
}


@query(
    "e2_dedup_keep_first",
    "fx_crawl",
    " union all ".join(
        f"select '{name}' as key_set, batch, supermarket_id as merchant_id, pos from (select * from fx_crawl qualify row_number() over "
        f"(partition by supermarket_id, {keys} order by batch, pos, id) = 1)".replace(", id)", ")")
        for name, keys in FIRST_KEYS.items()
    ),
)
def _(s, sf):
    rows = crawl(s, sf).withColumn("card_type", F.lit(None).cast("string"))
    out = None
    for name in FIRST_KEYS:
        part = dedup.dedup_keep_first(rows, name, ["batch", "pos"], ["merchant_id"]).select(
            F.lit(name).alias("key_set"), "batch", "merchant_id", "pos"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "e2_dedup_text_prefix",
    "fx_crawl",
    """select size, merchant_id, pos from (select 40 as size, supermarket_id as merchant_id, batch, pos, row_number() over (partition by supermarket_id, left(regexp_replace(terms_raw, '\\s+', ' ', 'g'), 40) order by batch, pos) as rn from fx_crawl
    union all select 120, supermarket_id, batch, pos, row_number() over (partition by supermarket_id, left(regexp_replace(terms_raw, '\\s+', ' ', 'g'), 120) order by batch, pos) from fx_crawl) where rn = 1""",
)
def _(s, sf):
    parts = [
        dedup.dedup_text_prefix(crawl(s, sf), n, ["batch", "pos"], ["merchant_id"], "terms_raw").select(
            F.lit(n).alias("size"), "merchant_id", "pos"
        )
        for n in (40, 120)
    ]
    return parts[0].unionByName(parts[1])


@query(
    "g2_union_then_distinct",
    "fx_crawl",
    "select supermarket_id as merchant_id, title, bank, discount from fx_crawl group by all",
)
def _(s, sf):
    both = tables.union_sources([crawl(s, sf, 1), crawl(s, sf, 2).drop("brands")])
    return both.select("merchant_id", "title", "bank", "discount").distinct()


@query(
    "g5_first_strategy",
    "fx_crawl",
    """select supermarket_id as merchant_id, strategy, pos from (select *, case when brands <> '' then 1 when contains(coalesce(store_types, ''), 'App') then 2 else 3 end as strategy from fx_crawl)
    qualify strategy = min(strategy) over (partition by supermarket_id)""",
)
def _(s, sf):
    rank = F.when(F.col("brands") != "", 1).when(or_blank(F.col("store_types")).contains("App"), 2).otherwise(3)
    rows = crawl(s, sf).withColumn("strategy", rank)
    return dedup.first_strategy(rows, "merchant_id", "strategy").select("merchant_id", "strategy", "pos")


KEY = "merchant_id, title, bank"
STORED = """select supermarket_id as merchant_id, title, coalesce(bank, '') as bank, coalesce(wallet, '') as wallet, discount, valid_days, store_types, terms_raw, pos
  from ({source}) qualify row_number() over (partition by supermarket_id, title, coalesce(bank, '') order by pos desc) = 1"""
BATCH_ONE = STORED.format(source=f"select * from ({RICHEST}) where batch = 1")
BATCH_TWO = STORED.format(source=f"select * from ({RICHEST}) where batch = 2")


def as_batch(df: DataFrame) -> DataFrame:
    text = F.lit("").cast("string")
    lists = F.array().cast("array<string>")
    return df.select(
        F.col("merchant_id").cast("string").alias("merchant_id"),
        "pos",
        "title",
        "bank",
        "wallet",
        "discount",
        "valid_days",
        "store_types",
        "terms_raw",
        F.lit("").alias("source"),
        lists.alias("exclusions"),
        lists.alias("requirements"),
        text.alias("url"),
    )


def start_state(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """An empty store whose merchants are the suppliers."""
    store = lifecycle.empty_tables(spark, {"offers": OFFERS, "terms": TERMS, "history": HISTORY})
    store["merchants"] = merchants(spark, sf).select(
        F.col("id").cast("string").alias("id"),
        "name",
        "url",
        "category",
        F.lit(None).cast("timestamp_ntz").alias("last_scraped"),
        F.lit(0).cast("long").alias("scrape_count"),
    )
    for name, columns in (("offers", ["scraped_at"]), ("history", ["scraped_at"])):
        for c in columns:
            store[name] = store[name].withColumn(c, F.col(c).cast("timestamp_ntz"))
    return store


def runs_of(batch: DataFrame) -> DataFrame:
    return batch.select("merchant_id").distinct().withColumn("error", F.lit(None).cast("string"))


def after_batches(
    spark: SparkSession, sf: str, numbers: tuple[int, ...] = (1, 2), tables: tuple[str, ...] = lifecycle.STORE_TABLES
) -> dict[str, DataFrame]:
    state = start_state(spark, sf)
    for number in numbers:
        batch = as_batch(crawl(spark, sf, number))
        state = lifecycle.apply_crawl(state, batch, runs_of(batch), NOW, tables=tables)
    return state


MERGED = f"""select coalesce(a.merchant_id, b.merchant_id) as merchant_id, coalesce(a.title, b.title) as title, coalesce(a.bank, b.bank) as bank,
  coalesce(a.wallet, b.wallet) as wallet, coalesce(b.discount, a.discount) as discount, b.title is not null or a.merchant_id not in (select merchant_id from b2) as is_active
  from b1 a full join b2 b on a.merchant_id = b.merchant_id and a.title = b.title and a.bank = b.bank"""


@query(
    "w3_upsert_offers",
    "fx_crawl",
    f"""with b1 as ({BATCH_ONE}), b2 as ({BATCH_TWO}) select cast(merchant_id as varchar) as merchant_id, title, bank, wallet, discount, true as is_active,
    md5(concat_ws('|', cast(merchant_id as varchar), title, bank)) as id from ({MERGED})""",
)
def _(s, sf):
    state = start_state(s, sf)["offers"]
    for number in (1, 2):
        kept = dedup.dedup_keep_richest(as_batch(crawl(s, sf, number)), ["merchant_id"])
        state = lifecycle.upsert_offers(state, kept, NOW)
    return state.select("id", "merchant_id", "title", "bank", or_blank(F.col("wallet")).alias("wallet"), "discount", "is_active")


@query(
    "w11_apply_crawl",
    "fx_crawl",
    f"""with b1 as ({BATCH_ONE}), b2 as ({BATCH_TWO}) select cast(merchant_id as varchar) as merchant_id, title, bank, wallet, discount, is_active from ({MERGED})""",
)
def w11_apply_crawl(s, sf):
    offers = after_batches(s, sf, tables=("offers",))["offers"]
    return offers.select("merchant_id", "title", "bank", or_blank(F.col("wallet")).alias("wallet"), "discount", "is_active")


@query(
    "w4_replace_terms",
    "fx_crawl",
    f"""with b1 as ({BATCH_ONE}), b2 as ({BATCH_TWO}), t1 as (select md5(concat_ws('|', cast(merchant_id as varchar), title, bank)) as offer_id, terms_raw from b1 where coalesce(terms_raw, '') <> ''),
    t2 as (select md5(concat_ws('|', cast(merchant_id as varchar), title, bank)) as offer_id, terms_raw from b2 where coalesce(terms_raw, '') <> '')
    select coalesce(t2.offer_id, t1.offer_id) as offer_id, coalesce(t2.terms_raw, t1.terms_raw) as raw_text from t1 full join t2 on t1.offer_id = t2.offer_id""",
)
def _(s, sf):
    return after_batches(s, sf, tables=("terms",))["terms"].select("offer_id", "raw_text")


@query(
    "w5_append_history",
    "fx_crawl",
    f"""with r as ({RICHEST}) select batch, cast(supermarket_id as varchar) as merchant_id, 'success' as status, count(*) as promotions_found, 'Method: traditional' as error_message from r group by 1, 2
    union all select batch, cast(supermarket_id as varchar), 'success', 0, 'No promotions found' from fx_crawl group by batch, supermarket_id having (batch, supermarket_id) not in (select (batch, supermarket_id) from r)
    union all select 9, 'caida', 'error', 0, 'timeout'""",
)
def _(s, sf):
    out = None
    for number in (1, 2):
        batch = as_batch(crawl(s, sf, number))
        state = lifecycle.apply_crawl(start_state(s, sf), batch, runs_of(batch), NOW, tables=("history",))
        part = state["history"].select(F.lit(number).alias("batch"), "merchant_id", "status", "promotions_found", "error_message")
        out = part if out is None else out.unionByName(part)
    # A failed source, next to a batch row of it that must be ignored.
    batch = as_batch(crawl(s, sf, 1)).withColumn("merchant_id", F.lit("caida"))
    failed = batch.select("merchant_id").distinct().withColumn("error", F.lit("timeout"))
    lost = lifecycle.apply_crawl(start_state(s, sf), batch, failed, NOW, tables=("history",))["history"]
    return out.unionByName(lost.select(F.lit(9).alias("batch"), "merchant_id", "status", "promotions_found", "error_message"))


@query(
    "w2_touch_merchants",
    "fx_crawl fx_merchants",
    f"""with r as ({RICHEST}) select cast(m.id as varchar) as id, m.name, (select count(distinct batch) from r where r.supermarket_id = m.id) as scrape_count,
    case when m.id in (select supermarket_id from r) then timestamp '{NOW}' end as last_scraped from fx_merchants m""",
)
def _(s, sf):
    return after_batches(s, sf, tables=("merchants",))["merchants"].select("id", "name", "scrape_count", "last_scraped")


@query(
    "w1_upsert_merchants",
    "fx_merchants",
    """select coalesce(m.name, n.name) as name, coalesce(n.url, m.url) as url, coalesce(n.category, m.category, 'supermarket') as category from fx_merchants m
    full join (select 'Supplier#' || lpad(cast(c_custkey as varchar), 9, '0') as name, 'http://new/' || c_custkey as url, 'fuel' as category from customer where c_custkey % 7 = 0) n on n.name = m.name""",
)
def _(s, sf):
    from .registry import base

    key = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    seen = base(s, sf, "customer").filter(F.col("c_custkey") % 7 == 0).select(
        F.concat(F.lit("Supplier#"), key).alias("name"),
        F.concat(F.lit("http://new/"), F.col("c_custkey").cast("string")).alias("url"),
        F.lit("fuel").alias("category"),
        F.col("c_custkey").alias("pos"),
    )
    return lifecycle.upsert_merchants(merchants(s, sf), seen).select("name", "url", "category")


@query(
    "w6_deactivate_all",
    "fx_promos",
    "select id, is_active = 1 and supermarket_id % 5 <> 0 as is_active from fx_promos",
)
def _(s, sf):
    p = promos(s, sf)
    some = p.select("merchant_id").filter(F.col("merchant_id") % 5 == 0)
    return lifecycle.deactivate_all(p, some).select("id", "is_active")


CRAWLED = "select distinct supermarket_id as m, title as t, coalesce(bank, '') as b from fx_crawl where batch = 2"


@query(
    "w7_deactivate_missing",
    "fx_promos fx_crawl",
    f"""with c as ({CRAWLED}) select p.id, p.is_active = 1 and (p.supermarket_id not in (select m from c) or exists (select 1 from c where c.m = p.supermarket_id and c.t = p.title and c.b = coalesce(p.bank, ''))) as is_active from fx_promos p""",
)
def _(s, sf):
    return lifecycle.deactivate_missing(promos(s, sf), crawl(s, sf, 2)).select("id", "is_active")


@query(
    "c7_missing_from_crawl",
    "fx_promos fx_crawl",
    f"""with c as ({CRAWLED}) select p.id, p.supermarket_id as merchant_id, p.title from fx_promos p where p.is_active = 1 and p.supermarket_id in (select m from c)
    and not exists (select 1 from c where c.m = p.supermarket_id and c.t = p.title and c.b = coalesce(p.bank, ''))""",
)
def _(s, sf):
    return relational.missing_from_crawl(promos(s, sf), crawl(s, sf, 2)).select("id", "merchant_id", "title")


@query(
    "g3_except_titles",
    "fx_promos fx_crawl",
    "select distinct supermarket_id as merchant_id, title from fx_promos except select supermarket_id, title from fx_crawl where batch = 2",
)
def _(s, sf):
    keys = ["merchant_id", "title"]
    return promos(s, sf).select(*keys).distinct().join(crawl(s, sf, 2).select(*keys).distinct(), keys, "left_anti")


@query(
    "g4_distinct_items",
    "fx_promos",
    """select id, coalesce(array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), '|'), '') as items from
    (select id, list_filter([bank, wallet, bank, store_types], lambda v: coalesce(v, '') <> '') as x from fx_promos)""",
)
def _(s, sf):
    items = F.filter(F.array("bank", "wallet", "bank", "store_types"), lambda v: or_blank(v) != "")
    return show(promos(s, sf).select("id", F.array_distinct(items).alias("items")))


@query(
    "w8_deactivate_stale",
    "fx_promos",
    f"select id, is_active = 1 and not scraped_at < timestamp '{NOW}' - interval '2' day as is_active from fx_promos",
)
def _(s, sf):
    return lifecycle.deactivate_stale(promos(s, sf), NOW, 2).select("id", "is_active")


@query(
    "w9_deactivate_expired",
    "fx_promos",
    f"select id, is_active = 1 and not coalesce(valid_until < date '{AS_OF}', false) as is_active from fx_promos",
)
def _(s, sf):
    return lifecycle.deactivate_expired(promos(s, sf), AS_OF).select("id", "is_active")


@query(
    "w10_backfill_dates",
    None,
    f"""select o_orderkey as id, {ISO_TEXT} as strict, {ISO_TEXT} <> {RAW_DATE} as changed,
    case when regexp_matches({RAW_DATE}, '^[0-9]{{4}}-') then {RAW_DATE} else coalesce(nullif({ISO_TEXT}, ''), {RAW_DATE}) end as kept from orders""",
)
def _(s, sf):
    rows = raw_dates(s, sf).select("id", F.col("raw").alias("valid_from"))
    strict = lifecycle.backfill_dates(rows, ("valid_from",)).select("id", F.col("valid_from").alias("strict"), "changed")
    kept = lifecycle.backfill_dates(rows, ("valid_from",), keep_raw=True).select("id", F.col("valid_from").alias("kept"))
    return strict.join(kept, "id")


@query(
    "w12_replace_merchant_offers",
    "fx_promos",
    """select id, title, discount from fx_promos where supermarket_id % 10 <> 3 union all select id, title, concat('nuevo ', discount) from fx_promos where supermarket_id % 10 = 3 and id % 2 = 0""",
)
def _(s, sf):
    p = promos(s, sf)
    fresh = p.filter((F.col("merchant_id") % 10 == 3) & (F.col("id") % 2 == 0))
    fresh = fresh.withColumn("discount", F.concat(F.lit("nuevo "), "discount"))
    return lifecycle.replaced_merchant_offers(p, fresh).select("id", "title", "discount")


@query(
    "w13_replace_user_methods",
    "fx_payment_methods",
    """select user_id, entity_name, entity_type from fx_payment_methods where user_id % 3 <> 0 union all
    select distinct user_id, 'MODO', 'wallet' from fx_payment_methods where user_id % 3 = 0 and user_id % 2 = 0""",
)
def _(s, sf):
    current = methods(s, sf)
    users = current.filter(F.col("user_id") % 3 == 0).select("user_id").distinct()
    even = F.col("user_id") % 2 == 0
    sent = users.select("user_id", F.when(even, "MODO").otherwise("").alias("entity_name"), F.lit("wallet").alias("entity_type"), F.lit(1).alias("pos"))
    again = users.select("user_id", F.when(even, "MODO").otherwise("").alias("entity_name"), F.lit("bank").alias("entity_type"), F.lit(2).alias("pos"))
    return lifecycle.replace_user_methods(current, sent.unionByName(again))


@query(
    "w14_upsert_user_prefs",
    "fx_users",
    f"""select lower(trim(email)) as email, case when id % 4 = 0 then 'chat' || id else telegram_chat_id end as telegram_chat_id, case when id % 4 = 1 then 0 else notify_daily end as notify_daily,
    case when id % 4 = 2 then 21 else notify_hour end as notify_hour, id % 4 <> 3 as touched from fx_users
    union all select 'nuevo@mail.example', 'n1', 0, 9, true""",
)
def _(s, sf):
    users = fixture(s, sf, "fx_users")
    k = F.col("id") % 4
    changes = users.filter(k != 3).select(
        F.upper("email").alias("email"),
        F.when(k == 0, F.concat(F.lit("chat"), F.col("id").cast("string"))).alias("telegram_chat_id"),
        F.when(k == 1, 0).alias("notify_daily"),
        F.when(k == 2, 21).when(k == 0, 99).alias("notify_hour"),
        F.col("id").alias("pos"),
    )
    first = users.filter(F.col("id") == 0).select(
        F.lit("Nuevo@mail.example ").alias("email"),
        F.lit("n1").alias("telegram_chat_id"),
        F.lit(None).cast("int").alias("notify_daily"),
        F.lit(None).cast("int").alias("notify_hour"),
        F.col("id").alias("pos"),
    )
    out = lifecycle.upsert_user_prefs(users, changes.unionByName(first), NOW)
    return out.select("email", "telegram_chat_id", "notify_daily", "notify_hour", F.col("updated_at").isNotNull().alias("touched"))


@query(
    "c11_route_by_brand",
    "fx_crawl fx_merchants",
    """with b as (select pos, case when brands = 'YPF, Shell' then ['YPF', 'Shell'] when brands = 'Axion y Puma' then ['Axion', 'Puma'] when supermarket_id % 2 = 0 then ['YPF'] else ['Combustible (genérico)'] end as brands from fx_crawl where batch = 2)
    select pos, unnest(brands) as brand from b""",
)
def _(s, sf):
    batch = crawl(s, sf, 2).withColumn("merchant_brands", split_csv(F.col("brands"), also_y=True))
    default = F.when(F.col("merchant_id") % 2 == 0, "YPF")
    return relational.route_by_brand(batch, merchants(s, sf), default).select("pos", "brand")


@query(
    "w15_reset",
    "fx_promos",
    "select 'filled' as state, count(*) as n, count(distinct supermarket_id) as merchants from fx_promos union all select 'reset', 0, 0",
)
def _(s, sf):
    """A store filled with the offers, and the same store after a reset: the tables are there, and empty."""
    root = f"{shared_dir(s)}/reset-{uuid.uuid4().hex}"
    filled = promos(s, sf).select(
        F.col("id").cast("string").alias("id"), F.col("merchant_id").cast("string").alias("merchant_id"), "title"
    )
    lifecycle.write_snapshot({"offers": filled}, root, 1)
    before = lifecycle.read_snapshot(s, root, ["offers"])["offers"]
    lifecycle.write_snapshot(lifecycle.empty_tables(s, {"offers": filled.schema}), root, 2)
    after = lifecycle.read_snapshot(s, root, ["offers"])["offers"]
    counts = [F.count("*").alias("n"), F.count_distinct("merchant_id").alias("merchants")]
    both = [df.agg(*counts).select(F.lit(state).alias("state"), "*") for state, df in (("filled", before), ("reset", after))]
    return both[0].unionByName(both[1])


@query(
    "a12_export",
    "fx_promos",
    f"select id, title, bank from fx_promos where is_active = 1 and (valid_until is null or valid_until >= date '{AS_OF}') and valid_from <= date '{AS_OF}'",
)
def _(s, sf):
    root = f"{shared_dir(s)}/export-{uuid.uuid4().hex}"
    active = promos(s, sf).filter(filters.valid_on(AS_OF)).select("id", "title", "bank")
    tables.export(active, f"{root}/csv", "csv")
    tables.export(active, f"{root}/json", "json")
    back = s.read.option("header", True).schema("id long, title string, bank string").csv(f"{root}/csv")
    other = s.read.schema("id long, title string, bank string").json(f"{root}/json")
    return back.join(other.select("id"), "id", "left_semi").select("id", "title", F.coalesce("bank", F.lit("")).alias("bank"))


@query(
    "w11_snapshot_round_trip",
    "fx_crawl",
    f"""with b1 as ({BATCH_ONE}), b2 as ({BATCH_TWO}) select cast(merchant_id as varchar) as merchant_id, title, bank, discount from ({MERGED}) where is_active""",
)
def _(s, sf):
    """Batch one merged twice with a stored snapshot between, then batch two: the same as merging each once."""
    root = f"{shared_dir(s)}/store-{uuid.uuid4().hex}"
    state = start_state(s, sf)
    for number, step in ((1, "a"), (1, "b"), (2, "c")):
        batch = as_batch(crawl(s, sf, number))
        lifecycle.write_snapshot(lifecycle.apply_crawl(state, batch, runs_of(batch), NOW, materialize=True), root, step)
        state = lifecycle.read_snapshot(s, root, list(state))
    return state["offers"].filter("is_active").select("merchant_id", "title", "bank", "discount")


# --- the store in buckets ------------------------------------------------------------------------------


def new_store(spark: SparkSession, sf: str, buckets: int = 16) -> store.Store:
    """A bucketed store without offers, in a folder of its own."""
    return store.create_store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", start_state(spark, sf), buckets)


def stored_offers(found: store.Store) -> DataFrame:
    return found.table("offers").select("merchant_id", "title", "bank", or_blank(F.col("wallet")).alias("wallet"), "discount", "is_active")


MERGED_TEXT = "select cast(merchant_id as varchar) as merchant_id, title, bank, wallet, discount, is_active"


@query("w11_bucketed_store", "fx_crawl", f"with b1 as ({BATCH_ONE}), b2 as ({BATCH_TWO}) {MERGED_TEXT} from ({MERGED})")
def _(s, sf):
    """Both batches into a store of merchant buckets; the second comes twice and counts once."""
    found = new_store(s, sf)
    for number in (1, 2, 2):
        batch = as_batch(crawl(s, sf, number))
        found = store.apply_batch(found, number, batch, runs_of(batch), NOW)
    return stored_offers(found)


@query(
    "w11_tenth_of_merchants",
    "fx_crawl",
    f"with b1 as ({BATCH_ONE}), b2 as (select * from ({BATCH_TWO}) where merchant_id % 10 = 3) {MERGED_TEXT} from ({MERGED})",
)
def _(s, sf):
    """A second crawl of one merchant in ten reads and writes the buckets of these alone."""
    found = new_store(s, sf)
    batch = as_batch(crawl(s, sf, 1))
    found = store.apply_batch(found, 1, batch, runs_of(batch), NOW)
    some = as_batch(crawl(s, sf, 2)).filter(F.col("merchant_id").cast("int") % 10 == 3)
    return stored_offers(store.apply_batch(found, 2, some, runs_of(some), NOW))


AGGREGATED = f"""r2 as (select * from ({RICHEST}) where batch = 2), via as (select * from r2 where supermarket_id % 4 = 0),
  brand_rows as (select supermarket_id as source, unnest(case when brands = 'YPF, Shell' then ['YPF', 'Shell'] when brands = 'Axion y Puma' then ['Axion', 'Puma']
    when supermarket_id % 8 = 0 then ['YPF'] else ['Combustible (genérico)'] end) as brand, title, coalesce(bank, '') as bank, coalesce(wallet, '') as wallet, discount, pos from via)"""
ROUTED = """select md5(brand) as merchant_id, title, bank, wallet, discount, true as is_active from brand_rows
  qualify row_number() over (partition by brand, title, bank order by pos desc) = 1"""


def aggregator_batch(s, sf):
    """The store after batch one, and after batch two with every fourth merchant an aggregator."""
    found = new_store(s, sf)
    batch = as_batch(crawl(s, sf, 1))
    found = store.apply_batch(found, 1, batch, runs_of(batch), NOW)
    rows = crawl(s, sf, 2)
    brands = rows.select("pos", split_csv(F.col("brands"), also_y=True).alias("merchant_brands"))
    second = as_batch(rows).join(brands, "pos")
    number = F.col("merchant_id").cast("int")
    runs = runs_of(second).select(
        "*",
        (number % 4 == 0).alias("aggregator"),
        F.concat(F.lit("Fuente "), "merchant_id").alias("name"),
        F.concat(F.lit("http://fuente/"), "merchant_id").alias("url"),
        F.when(number % 8 == 0, "YPF").alias("default_brand"),
    )
    return store.apply_batch(found, 2, second, runs, NOW)


@query(
    "w11_aggregator_batch",
    "fx_crawl",
    f"""with {AGGREGATED}, b1 as ({BATCH_ONE}), b2 as ({STORED.format(source="select * from r2 where supermarket_id % 4 <> 0")})
    select merchant_id, title, bank, wallet, discount, is_active and merchant_id not in (select cast(supermarket_id as varchar) from via) as is_active from ({MERGED_TEXT} from ({MERGED}))
    union all {ROUTED}""",
)
def _(s, sf):
    return stored_offers(aggregator_batch(s, sf))


@query(
    "w11_aggregator_history",
    "fx_crawl",
    f"""with {AGGREGATED}, n as (select source, brand, count(*) as n from brand_rows group by 1, 2), crawled as (select batch, supermarket_id as m, count(*) as all_rows from fx_crawl group by 1, 2),
    rich as (select batch, supermarket_id as m, count(*) as n from ({RICHEST}) group by 1, 2)
    select cast(c.m as varchar) as merchant_id, coalesce(r.n, 0) as promotions_found, case when r.n is null then 'No promotions found' else 'Method: traditional' end as error_message
      from crawled c left join rich r on r.batch = c.batch and r.m = c.m where c.batch = 1 or c.m % 4 <> 0 or r.n is null
    union all select md5(brand), n, 'Method: traditional (via Fuente ' || source || ')' from n
    union all select cast(source as varchar), cast(sum(n) as bigint), 'Aggregator: routed to ' || count(*) || ' brand(s)' from n group by source""",
)
def _(s, sf):
    return aggregator_batch(s, sf).table("history").select("merchant_id", "promotions_found", "error_message")


@query(
    "w1_aggregator_merchants",
    "fx_crawl fx_merchants",
    f"""with {AGGREGATED}, b as (select brand, max_by('http://fuente/' || source, pos) as url from brand_rows group by 1)
    select name, url, category from (select name, url, coalesce(category, 'supermarket') as category from fx_merchants union all select brand, url, 'fuel' from b)""",
)
def _(s, sf):
    """Brands that an aggregator names become merchants with the address of the newest source."""
    return aggregator_batch(s, sf).table("merchants").select("name", "url", F.coalesce("category", F.lit("supermarket")).alias("category"))


@query(
    "w8_age_store",
    "fx_promos",
    f"""select cast(id as varchar) as id, is_active = 1 and not scraped_at < timestamp '1998-01-01 00:00:00' - interval '400' day and not coalesce(valid_until < date '{AS_OF}', false) as is_active from fx_promos""",
)
def _(s, sf):
    """Stale and expired offers of a bucketed store; buckets without any are not written again."""
    tables = start_state(s, sf)
    kinds = {f.name: f.dataType for f in tables["offers"].schema.fields}
    rows = promos(s, sf)
    have = set(rows.columns)
    tables["offers"] = rows.select(*[(F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
    found = store.create_store(s, f"{shared_dir(s)}/store-{uuid.uuid4().hex}", tables)
    return store.age(found, "age", "1998-01-01 00:00:00", 400, AS_OF).table("offers").select("id", "is_active")


@query(
    "w12_partition_overwrite",
    "fx_promos",
    """select id, title, discount from fx_promos where supermarket_id % 10 <> 3 union all select id, title, concat('nuevo ', discount) from fx_promos where supermarket_id % 10 = 3 and id % 2 = 0""",
)
def _(s, sf):
    """Offers in folders by merchant, of which one in ten is overwritten and the others stay as written."""
    path = f"{shared_dir(s)}/merchants-{uuid.uuid4().hex}"
    p = promos(s, sf).select("merchant_id", "id", "title", "discount")
    lifecycle.replace_merchant_offers(p, path)
    fresh = p.filter((F.col("merchant_id") % 10 == 3) & (F.col("id") % 2 == 0))
    lifecycle.replace_merchant_offers(fresh.withColumn("discount", F.concat(F.lit("nuevo "), "discount")), path)
    return s.read.schema(p.schema).parquet(path).select("id", "title", "discount")
