"""Queries over stored offers: filters, joins, aggregates, orders, entry points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import terms as terms_fn
from ..functions.text import or_blank
from ..operators import digest, filters, match, ordering, relational
from ..schema import OFFERS, evolve_schema
from ..sources.catalog import ENTITY_LABELS
from . import entry_points as ask
from .fixtures import AS_OF, NOW_EVENTS, fixture
from .registry import base, history, merchants, methods, promos, query, raw_terms, show, store_terms

VALID = (
    f"(is_active = 1 and (valid_until is null or valid_until >= date '{AS_OF}') "
    f"and (valid_from is null or valid_from <= date '{AS_OF}'))"
)
CORE = "id, supermarket_id as merchant_id, title, discount, bank, wallet"
CORE_COLUMNS = ("id", "merchant_id", "title", "discount", "bank", "wallet")
JOINED = "fx_promos p join fx_merchants m on m.id = p.supermarket_id"
FOLD_DAYS = "strip_accents(lower(valid_days))"
NO_DAYS = "coalesce(valid_days, '') = ''"
TODAY = f"({NO_DAYS} or {FOLD_DAYS} like '%lunes%' or {FOLD_DAYS} like '%todos los d%' or {FOLD_DAYS} like '%diario%')"
ONLINE = "(lower(store_types) like '%online%' or lower(store_types) like '%.com%' or lower(store_types) like '%web%' or lower(store_types) like '%app%')"
ONSITE = "(coalesce(store_types, '') = '' or not (lower(store_types) like '%online%' or lower(store_types) like '%.com%' or lower(store_types) like '%web%'))"
NETWORKS = "('visa', 'mastercard', 'visa/mastercard', 'american express', 'amex', 'visa y mastercard', 'tarjeta visa', 'tarjeta mastercard')"


def core(df):
    return show(df, *CORE_COLUMNS)


# --- filters ----------------------------------------------------------------------------------------


@query("b1_valid_on", "fx_promos", f"select {CORE} from fx_promos where {VALID}")
def _(s, sf):
    return core(promos(s, sf).filter(filters.valid_on(AS_OF)))


@query(
    "b2_state_filter",
    "fx_promos",
    f"""select 'activa' as state, {CORE} from fx_promos where {VALID}
    union all select 'proxima', {CORE} from fx_promos where is_active = 1 and valid_from > date '{AS_OF}'
    union all select 'finalizada', {CORE} from fx_promos where is_active = 1 and valid_until < date '{AS_OF}'""",
)
def _(s, sf):
    p = promos(s, sf)
    parts = [
        core(p.filter(filters.state_is(state, AS_OF))).select(F.lit(label).alias("state"), "*")
        for label, state in (("activa", "otro"), ("proxima", " PROXIMA "), ("finalizada", "finalizada"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "b3_category_filter",
    "fx_merchants",
    "select id, name, category from fx_merchants where lower(coalesce(category, 'supermarket')) in ('supermarket', 'fuel')",
)
def _(s, sf):
    return merchants(s, sf).filter(filters.category_in(" Supermarket, FUEL,,")).select("id", "name", "category")


@query(
    "b4_merchant_filter",
    "fx_merchants",
    """select 'ignore_case' as mode, id, name from fx_merchants where lower(name) = 'supplier#000000003'
    union all select 'exact', id, name from fx_merchants where name = 'Supplier#000000004'
    union all select 'contains', id, name from fx_merchants where lower(name) like '%00001%'""",
)
def _(s, sf):
    m = merchants(s, sf)
    picks = (("ignore_case", "SUPPLIER#000000003"), ("exact", "Supplier#000000004"), ("contains", "00001"))
    parts = [
        m.filter(filters.merchant_is(value, mode, "name")).select(F.lit(mode).alias("mode"), "id", "name")
        for mode, value in picks
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "b5_entity_filter",
    "fx_promos",
    f"""select {CORE} from fx_promos where contains(strip_accents(lower(coalesce(bank, ''))), 'nation_1')
    or contains(strip_accents(lower(coalesce(wallet, ''))), 'nation_1') or contains(strip_accents(lower(title)), 'nation_1')""",
)
def _(s, sf):
    p = promos(s, sf)
    return core(p.filter(filters.entity_contains(p, "Nation_1", include_title=True)))


@query(
    "b6_day_filter",
    "fx_promos",
    f"""select {CORE} from fx_promos where {NO_DAYS} or {FOLD_DAYS} like '%miercoles%' or {FOLD_DAYS} like '%sabado%'
    or {FOLD_DAYS} like '%todos los d%'""",
)
def _(s, sf):
    return core(promos(s, sf).filter(filters.day_in("miércoles, SABADO")))


@query("b7_valid_on_weekday", "fx_promos", f"select {CORE} from fx_promos where {TODAY}")
def _(s, sf):
    return core(promos(s, sf).filter(filters.valid_on_weekday(AS_OF)))


@query(
    "b8_modality_filter",
    "fx_promos",
    f"""select 'online' as modality, {CORE} from fx_promos where {ONLINE}
    union all select 'presencial', {CORE} from fx_promos where {ONSITE}
    union all select 'both', {CORE} from fx_promos where {ONLINE} or {ONSITE}""",
)
def _(s, sf):
    p = promos(s, sf)
    parts = [
        core(p.filter(filters.modality_in(csv))).select(F.lit(label).alias("modality"), "*")
        for label, csv in (("online", "online"), ("presencial", "Presencial,otra"), ("both", "presencial,online"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "b9_text_search",
    "fx_promos fx_terms",
    f"""select p.id, p.title from fx_promos p join fx_terms t on t.promotion_id = p.id
    where contains(strip_accents(lower(title)), 'lamp') or contains(strip_accents(lower(raw_text)), '20.000')""",
)
def _(s, sf):
    t = raw_terms(s, sf).select(F.col("promotion_id").alias("id"), F.col("raw_text").alias("terms_raw"))
    p = promos(s, sf).join(t, "id")
    return p.filter(filters.text_contains(p, "lamp") | filters.text_contains(p, "20.000")).select("id", "title")


@query(
    "b9_title_pattern",
    "fx_promos",
    "select id, title from fx_promos where regexp_matches(title, 'URGENT$|^red ', 'i')",
)
def _(s, sf):
    return promos(s, sf).filter(filters.title_matches("URGENT$|^red ")).select("id", "title")


@query(
    "b10_discount_kind_filter",
    "fx_promos",
    f"""select 'percent' as kind, {CORE} from fx_promos where contains(discount, '%')
    union all select 'cuotas', {CORE} from fx_promos where contains(lower(discount), 'cuota')
    union all select 'cashback', {CORE} from fx_promos where contains(lower(discount), 'cashback') or contains(lower(discount), 'reintegro')""",
)
def _(s, sf):
    p = promos(s, sf)
    parts = [
        core(p.filter(filters.discount_kind_is(kind))).select(F.lit(kind).alias("kind"), "*")
        for kind in ("percent", "cuotas", "cashback")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "b11_network_exclusion",
    "fx_promos",
    f"select {CORE} from fx_promos where coalesce(bank, '') <> '' and lower(bank) not in {NETWORKS}",
)
def _(s, sf):
    return core(promos(s, sf).filter(filters.is_issuer(F.col("bank"))))


@query(
    "b15_drop_unidentified",
    "fx_promos",
    f"select {CORE} from fx_promos where coalesce(nullif(trim(bank), ''), nullif(trim(wallet), '')) is not null",
)
def _(s, sf):
    return core(promos(s, sf).filter(filters.identified()))


@query(
    "b16_required_fields",
    "fx_promos",
    """select id, title <> '' and discount <> '' as both, title <> '' or discount <> '' as one, discount <> '' as discount,
    bank <> '' as bank, length(trim(title)) > 3 and length(trim(title)) < 200 as title_length, length(trim(title)) >= 5 as title_five
    from fx_promos""",
)
def _(s, sf):
    policies = {
        "both": "title_and_discount",
        "one": "title_or_discount",
        "discount": "discount",
        "bank": "bank",
        "title_length": "title_length",
        "title_five": "title_five",
    }
    return promos(s, sf).select("id", *[filters.required_fields(p).alias(n) for n, p in policies.items()])


@query(
    "b17_users_to_notify",
    "fx_users",
    "select id, telegram_chat_id from fx_users where coalesce(telegram_chat_id, '') <> '' and notify_daily = 1",
)
def _(s, sf):
    from .fixtures import fixture

    return fixture(s, sf, "fx_users").filter(filters.users_to_notify()).select("id", "telegram_chat_id")


# --- projections -------------------------------------------------------------------------------------

EXCLUSIONS = "regexp_extract(raw_text, 'QUEDAN EXCLUIDOS? DEL DESCUENTO[:\\s]+([^\\.]+)\\.', 1)"
CAP = (
    "case when raw_text like '%SIN TOPE%' then 'SIN TOPE' when regexp_matches(raw_text, 'TOPE DE REINTEGRO') then "
    "concat('$', regexp_extract(raw_text, 'TOPE DE REINTEGRO: \\$ ([0-9.]+)\\.', 1)) else '' end"
)
LISTING_SQL = f"""select p.id, title, discount, bank, wallet, store_types, valid_days, cast(valid_from as varchar) as valid_from,
  cast(valid_until as varchar) as valid_until, p.is_active, m.name as merchant_name,
  replace({EXCLUSIONS}, ', ', '|') as exclusions,
  case when p.id % 2 = 0 then 'COMPRA MÍNIMA $15000' else '' end as requirements, {CAP} as max_discount
  from {JOINED} join fx_terms t on t.promotion_id = p.id"""
LISTING_COLUMNS = (
    "id",
    "title",
    "discount",
    "bank",
    "wallet",
    "store_types",
    "valid_days",
    "valid_from",
    "valid_until",
    "is_active",
    "merchant_name",
    "exclusions",
    "requirements",
    "max_discount",
)


@query("p1_offer_list_view", "fx_promos fx_merchants fx_terms", f"{LISTING_SQL} where {VALID}")
def _(s, sf):
    valid = promos(s, sf).filter(filters.valid_on(AS_OF))
    joined = relational.with_terms(relational.with_merchant(valid, merchants(s, sf)), store_terms(s, sf))
    return show(relational.offer_list_view(joined), *LISTING_COLUMNS)


@query(
    "p2_offer_detail",
    "fx_promos fx_merchants fx_terms",
    f"select p.id, title, bank, m.name as merchant_name, t.raw_text, {CAP} as max_discount from {JOINED} "
    "join fx_terms t on t.promotion_id = p.id where p.id = 42",
)
def _(s, sf):
    one = relational.offer_detail(promos(s, sf), merchants(s, sf), store_terms(s, sf), 42)
    return one.select("id", "title", "bank", "merchant_name", "raw_text", "max_discount")


@query(
    "p3_digest_and_bot_view",
    "fx_promos fx_merchants",
    f"""select p.id, title, discount, bank, wallet, store_types, valid_days, m.name as merchant_name,
    coalesce(category, 'supermarket') as category from {JOINED} where {VALID}""",
)
def _(s, sf):
    joined = relational.with_merchant(promos(s, sf).filter(filters.valid_on(AS_OF)), merchants(s, sf))
    bot = relational.bot_view(joined).select("id", "category")
    shown = relational.digest_view(joined).select(
        "id", "title", "discount", "bank", "wallet", "store_types", "valid_days", "merchant_name"
    )
    return shown.join(bot, "id")


@query(
    "p5_entity_label",
    "fx_promos",
    """select id, coalesce(nullif(bank, ''), nullif(wallet, ''), 'N/A') as entity,
    coalesce(nullif(concat_ws(' · ', nullif(bank, ''), nullif(wallet, '')), ''), 'Sin entidad') as parts from fx_promos""",
)
def _(s, sf):
    none = F.lit("")
    return promos(s, sf).select(
        "id",
        terms_fn.entity_label(F.col("bank"), F.col("wallet")).alias("entity"),
        terms_fn.entity_parts(F.col("bank"), F.col("wallet"), none).alias("parts"),
    )


def _lookup_sql() -> str:
    exact = " ".join(f"when k = '{k}' then '{v[1]}'" for k, v in ENTITY_LABELS.items())
    near = " ".join(f"when contains(k, '{k}') or contains('{k}', k) then '{v[1]}'" for k, v in ENTITY_LABELS.items())
    return f"""select name, n, case {exact} {near} else
      upper(concat(left(split_part(name, ' ', 1), 1), left(split_part(name, ' ', 2), 1))) end as initials
      from (select name, lower(trim(name)) as k, n from (select p_name as name, count(*) as n from part group by 1
      union all select concat('Banco ', n_name), 1 from nation union all select c_mktsegment, count(*) from customer group by 1))"""


@query("p7_merchant_lookup", None, _lookup_sql())
def _(s, sf):
    names = (
        base(s, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n"))
        .unionByName(base(s, sf, "nation").select(F.concat(F.lit("Banco "), "n_name").alias("name"), F.lit(1).cast("long").alias("n")))
        .unionByName(base(s, sf, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("n")))
    )
    return relational.lookup_labels(names, "name", ENTITY_LABELS).select("name", "n", "initials")


# --- joins --------------------------------------------------------------------------------------------


@query(
    "c1_with_merchant",
    "fx_promos fx_merchants",
    f"select p.id, p.supermarket_id as merchant_id, m.name as merchant_name, coalesce(m.category, 'supermarket') as category from {JOINED}",
)
def _(s, sf):
    return relational.with_merchant(promos(s, sf), merchants(s, sf)).select("id", "merchant_id", "merchant_name", "category")


@query(
    "c2_with_terms",
    "fx_promos fx_terms",
    f"""select p.id, t.raw_text, case when t.raw_text is not null then {CAP} end as max_discount, replace({EXCLUSIONS}, ', ', '|') as exclusions
    from fx_promos p left join fx_terms t on t.promotion_id = p.id and t.promotion_id % 5 <> 4""",
)
def _(s, sf):
    some = store_terms(s, sf).filter(F.col("offer_id") % 5 != 4)
    out = relational.with_terms(promos(s, sf), some).withColumn(
        "exclusions", F.when(F.col("raw_text").isNotNull(), F.col("exclusions"))
    )
    return show(out, "id", "raw_text", "max_discount", "exclusions")


ACTIVE_COUNTS = f"""select m.id, m.name, coalesce(m.category, 'supermarket') as category, count(p.id) as active_offers
  from fx_merchants m left join (select * from fx_promos where {VALID}) p on p.supermarket_id = m.id group by m.id, m.name, m.category"""


@query("c3_merchant_active_counts", "fx_promos fx_merchants", f"select id, name, active_offers from ({ACTIVE_COUNTS})")
def _(s, sf):
    return relational.merchant_active_counts(merchants(s, sf), promos(s, sf), AS_OF).select("id", "name", "active_offers")


@query(
    "c4_history_with_merchant",
    "fx_history fx_merchants",
    """select h.id, m.name, h.scraped_at, h.status, h.promotions_found, h.error_message
    from fx_history h join fx_merchants m on m.id = h.supermarket_id""",
)
def _(s, sf):
    return relational.history_with_merchant(history(s, sf), merchants(s, sf))


MATCHED = f"""select distinct u.user_id, p.id as offer_id from fx_promos p join fx_payment_methods u on
  (contains(strip_accents(lower(p.bank)), strip_accents(lower(u.entity_name))) or contains(strip_accents(lower(p.wallet)), strip_accents(lower(u.entity_name)))
  or contains(strip_accents(lower(p.title)), strip_accents(lower(u.entity_name)))) where {VALID}"""


@query("c5_match_users", "fx_promos fx_payment_methods", MATCHED)
def _(s, sf):
    return match.match_users(promos(s, sf), methods(s, sf), AS_OF)


@query("c5_match_users_today", "fx_promos fx_payment_methods", f"{MATCHED} and {TODAY}")
def _(s, sf):
    return match.match_users(promos(s, sf), methods(s, sf), AS_OF, today_only=True)


@query("c5_match_users_many_names", "fx_promos fx_payment_methods", MATCHED)
def _(s, sf):
    return match.match_users(promos(s, sf), methods(s, sf), AS_OF)


@query(
    "c8_keep_first_terms",
    "fx_history",
    "select id, supermarket_id, status from fx_history qualify row_number() over (partition by supermarket_id order by id) = 1",
)
def _(s, sf):
    h = history(s, sf).withColumnRenamed("merchant_id", "supermarket_id")
    return relational.keep_first_terms(h, "supermarket_id", "id").select("id", "supermarket_id", "status")


@query(
    "c9_join_details",
    "fx_promos fx_terms",
    """select 'keep' as mode, p.id, title, coalesce(t.raw_text, '') as terms_raw from fx_promos p
    left join (select * from fx_terms where promotion_id % 4 <> 1) t on t.promotion_id = p.id
    union all select 'drop', p.id, title, t.raw_text from fx_promos p join fx_terms t on t.promotion_id = p.id and t.promotion_id % 4 <> 1""",
)
def _(s, sf):
    details = raw_terms(s, sf).filter(F.col("promotion_id") % 4 != 1).select(F.col("promotion_id").alias("id"), F.col("raw_text").alias("terms_raw"))
    listing = promos(s, sf).select("id", "title", F.lit("").alias("terms_raw"))
    keep = relational.join_details(listing, details, "id").select(F.lit("keep").alias("mode"), "*")
    return keep.unionByName(relational.join_details(listing, details, "id", keep_missing=False).select(F.lit("drop").alias("mode"), "*"))


# --- aggregates -----------------------------------------------------------------------------------------


@query(
    "d1_active_by_merchant",
    "fx_promos fx_merchants",
    f"select id, name, category, active_offers from ({ACTIVE_COUNTS}) where active_offers >= 1 and category = 'fuel'",
)
def _(s, sf):
    out = relational.active_by_merchant(merchants(s, sf), promos(s, sf), AS_OF, 1, "fuel")
    return out.select("id", "name", "category", "active_offers")


@query(
    "d2_overview_stats",
    "fx_promos fx_merchants",
    f"""select count(*) as total_offers, count(distinct nullif(bank, '')) as total_banks, max(scraped_at) as last_updated,
    (select count(*) from fx_merchants where enabled = 1) as total_merchants from fx_promos where {VALID}""",
)
def _(s, sf):
    return relational.overview_stats(merchants(s, sf), promos(s, sf), AS_OF)


FACET = f"""select name, count(*) as n from (select unnest([bank, wallet]) as name from fx_promos where {VALID})
  where coalesce(name, '') <> '' and lower(name) not in {NETWORKS} group by name"""


@query("d3_entity_facet", "fx_promos", FACET)
def _(s, sf):
    return relational.entity_facet(promos(s, sf).filter(filters.valid_on(AS_OF)))


@query(
    "d4_category_stats",
    "fx_promos fx_merchants",
    f"""select coalesce(category, 'supermarket') as category, count(*) as offers, count(distinct p.supermarket_id) as merchants,
    count(distinct nullif(bank, '')) as banks from {JOINED} where {VALID} group by 1
    union all select null, count(*), count(distinct p.supermarket_id), count(distinct nullif(bank, '')) from {JOINED} where {VALID}""",
)
def _(s, sf):
    return relational.category_stats(relational.with_merchant(promos(s, sf).filter(filters.valid_on(AS_OF)), merchants(s, sf)))


@query(
    "d5_merchant_report",
    "fx_promos fx_merchants",
    """select m.id as merchant_id, m.name, count(p.id) as total_offers, count(case when p.is_active = 1 then 1 end) as active_offers,
    max(p.scraped_at) as last_scraped from fx_merchants m left join fx_promos p on p.supermarket_id = m.id group by 1, 2""",
)
def _(s, sf):
    return relational.merchant_report(merchants(s, sf), promos(s, sf))


@query(
    "d6_payment_report",
    "fx_promos",
    """select 'as_stored' as mode, * from (select coalesce(bank, wallet, 'Sin especificar') as payment, count(*) as n from fx_promos
    where is_active = 1 group by 1 order by n desc, payment limit 10)
    union all select 'blank_missing', * from (select coalesce(nullif(bank, ''), nullif(wallet, ''), 'Sin especificar') as payment, count(*) as n
    from fx_promos where is_active = 1 group by 1 order by n desc, payment limit 10)""",
)
def _(s, sf):
    p = promos(s, sf)
    stored = relational.payment_report(p).select(F.lit("as_stored").alias("mode"), "*")
    return stored.unionByName(relational.payment_report(p, blank_is_missing=True).select(F.lit("blank_missing").alias("mode"), "*"))


@query(
    "d7_discount_report",
    "fx_promos",
    "select discount, count(*) as n from fx_promos where is_active = 1 and coalesce(discount, '') <> '' group by 1 order by n desc, discount limit 10",
)
def _(s, sf):
    return relational.discount_report(promos(s, sf))


@query(
    "d8_totals",
    "fx_promos",
    "select count(*) as active_offers, count(distinct supermarket_id) as merchants from fx_promos where is_active = 1",
)
def _(s, sf):
    return relational.totals(promos(s, sf))


@query("d9_last_success", "fx_history", "select max(scraped_at) as last_success from fx_history where status = 'success'")
def _(s, sf):
    return relational.last_success(history(s, sf))


@query(
    "d10_dashboard_metrics",
    "fx_promos fx_merchants fx_terms",
    f"""select count(*) as offers, count(distinct bank) as banks, count(distinct m.name) as merchants,
    count(case when p.id % 2 = 0 then 1 end) as with_requirements from {JOINED} join fx_terms t on t.promotion_id = p.id where {VALID}""",
)
def _(s, sf):
    return relational.dashboard_metrics(ask.dashboard(promos(s, sf), merchants(s, sf), store_terms(s, sf), AS_OF))


@query(
    "d10_size_by_merchant",
    "fx_promos fx_merchants",
    f"select m.name as merchant_name, count(*) as n from {JOINED} where {VALID} group by 1",
)
def _(s, sf):
    joined = relational.with_merchant(promos(s, sf).filter(filters.valid_on(AS_OF)), merchants(s, sf))
    return relational.size_by(joined, "merchant_name")


@query(
    "d11_offers_grouped_by_merchant",
    "fx_promos fx_merchants",
    f"""with ranked as (select m.name as merchant_name, p.id, discount, row_number() over (partition by m.name order by discount desc, p.id) as rn
    from {JOINED}) select merchant_name, cast((rn - 1) // 5 as int) as chunk_no, count(*) as n,
    string_agg(cast(id as varchar), ',' order by rn) as ids from ranked group by 1, 2""",
)
def _(s, sf):
    joined = relational.with_merchant(promos(s, sf), merchants(s, sf))
    lists = match.offers_grouped_by_merchant(joined, ["merchant_name"], ["id", "discount"], size=5)
    return lists.select(
        "merchant_name", "chunk_no", "n", F.array_join(F.transform("items", lambda x: x["id"].cast("string")), ",").alias("ids")
    )


@query(
    "d12_methods_by_type",
    "fx_payment_methods",
    """select user_id, entity_type, count(distinct entity_name) as n, string_agg(distinct entity_name, ', ' order by entity_name) as names
    from fx_payment_methods group by 1, 2""",
)
def _(s, sf):
    lists = relational.methods_by_type(methods(s, sf))
    return lists.select(
        "user_id", "entity_type", "n", F.array_join(F.transform("items", lambda x: x["entity_name"]), ", ").alias("names")
    )


@query(
    "d13_trailing_event_count",
    None,
    f"""select user_id, count(*) as n, count(*) >= 3 as limited from events where ts > timestamp '{NOW_EVENTS}' - interval '86400' second
    and ts <= timestamp '{NOW_EVENTS}' group by 1""",
)
def _(s, sf):
    return relational.trailing_event_count(base(s, sf, "events"), "user_id", "ts", NOW_EVENTS, 86400, 3)


@query(
    "d13_trailing_count_per_event",
    None,
    """select event_id, user_id, count(*) over (partition by user_id order by ts range between interval '3599.999999' second preceding
    and current row) as trailing from events""",
)
def _(s, sf):
    out = relational.trailing_count_per_event(base(s, sf, "events"), "user_id", "ts", 3600)
    return out.select("event_id", "user_id", "trailing")


@query(
    "d14_run_summary",
    "fx_history",
    """select cast(cast(scraped_at as date) as varchar) as run_id, count(case when status = 'success' then 1 end) as ok,
    count(case when status = 'error' then 1 end) as failed, cast(sum(promotions_found) as bigint) as offers,
    epoch_us(max(scraped_at)) - epoch_us(min(scraped_at)) as elapsed_micros from fx_history group by 1""",
)
def _(s, sf):
    return relational.run_summary(history(s, sf), F.col("scraped_at").cast("date").cast("string"))


@query(
    "d14_source_summary",
    "fx_history",
    """select supermarket_id as merchant_id, count(*) as runs, count(case when status = 'error' then 1 end) as errors,
    cast(sum(promotions_found) as bigint) as offers from fx_history group by 1
    union all select null, count(*), count(case when status = 'error' then 1 end), cast(sum(promotions_found) as bigint) from fx_history""",
)
def _(s, sf):
    return relational.source_summary(history(s, sf))


@query(
    "d18_page_count",
    "fx_promos",
    f"select count(*) as total, cast(greatest(ceil(count(*) / 8.0), 1) as bigint) as pages from fx_promos where {VALID}",
)
def _(s, sf):
    return ordering.page_count(promos(s, sf).filter(filters.valid_on(AS_OF)), 8)


# --- orders, limits ------------------------------------------------------------------------------------


@query("f1_newest_first", "fx_promos", "select id, scraped_at from fx_promos order by scraped_at desc, id desc limit 100")
def _(s, sf):
    return ordering.newest_first(promos(s, sf)).select("id", "scraped_at").limit(100)


@query(
    "f2_by_merchant_then_discount",
    "fx_promos fx_merchants",
    f"""select 'text' as mode, * from (select p.id, m.name as merchant_name, discount from {JOINED} order by m.name, discount desc, p.id limit 50)
    union all select 'typed', * from (select p.id, m.name as merchant_name, discount from {JOINED}
    order by m.name, cast(regexp_extract(discount, '(\\d+)', 1) as int) desc, p.id limit 50)""",
)
def _(s, sf):
    joined = relational.with_merchant(promos(s, sf), merchants(s, sf)).select("id", "merchant_name", "discount")
    plain = ordering.by_merchant_then_discount(joined).limit(50).select(F.lit("text").alias("mode"), "*")
    typed = ordering.by_merchant_then_discount(joined, typed=True).limit(50).select(F.lit("typed").alias("mode"), "*")
    return plain.unionByName(typed)


@query(
    "f3_by_merchant_then_newest",
    "fx_promos fx_merchants",
    f"select p.id, m.name as merchant_name from {JOINED} where {VALID} order by m.name, p.scraped_at desc, p.id desc limit 200",
)
def _(s, sf):
    joined = relational.with_merchant(promos(s, sf).filter(filters.valid_on(AS_OF)), merchants(s, sf))
    return ordering.by_merchant_then_newest(joined, 200).select("id", "merchant_name")


@query("f4_paginate", "fx_promos", "select id from fx_promos order by scraped_at desc, id desc limit 20 offset 40")
def _(s, sf):
    return ordering.paginate(promos(s, sf), ["-scraped_at", "-id"], 3, 20).select("id")


@query(
    "f4_paginate_deep",
    "fx_promos",
    "select id from fx_promos order by scraped_at desc, id desc limit 100 offset 12000",
)
def _(s, sf):
    return ordering.paginate(promos(s, sf), ["-scraped_at", "-id"], 121, 100).select("id")


@query(
    "f5_top_k_by_count",
    "fx_promos",
    f"""select bank as name, count(*) as n from fx_promos where {VALID} and coalesce(bank, '') <> '' group by 1 order by n desc, name limit 5""",
)
def _(s, sf):
    return relational.top_banks(promos(s, sf), AS_OF, 5)


@query(
    "f6_recent_runs",
    "fx_history",
    "select id, supermarket_id as merchant_id, scraped_at, status from fx_history order by scraped_at desc, id desc limit 50",
)
def _(s, sf):
    return ordering.recent(history(s, sf), 50).select("id", "merchant_id", "scraped_at", "status")


@query(
    "f7_latest_n",
    "fx_promos fx_merchants",
    f"select p.id, m.name as merchant_name from {JOINED} where p.is_active = 1 and lower(m.name) like '%0001%' order by p.scraped_at desc, p.id desc limit 15",
)
def _(s, sf):
    return ask.latest_active(promos(s, sf), merchants(s, sf), 15, "0001").select("id", "merchant_name")


@query("f8_distinct_sorted", "fx_promos", "select distinct bank from fx_promos where coalesce(bank, '') <> '' order by bank")
def _(s, sf):
    return ordering.distinct_sorted(promos(s, sf), "bank")


# --- set operations ---------------------------------------------------------------------------------------


@query(
    "g1_union_all_entities",
    "fx_promos",
    "select id, bank as entity from fx_promos where coalesce(bank, '') <> '' union all select id, wallet from fx_promos where coalesce(wallet, '') <> ''",
)
def _(s, sf):
    p = promos(s, sf)
    return p.select("id", F.explode(F.array("bank", "wallet")).alias("entity")).filter(or_blank(F.col("entity")) != "")


# --- entry points --------------------------------------------------------------------------------------

Q1_WHERE = (
    f"{VALID} and lower(coalesce(category, 'supermarket')) in ('supermarket', 'fuel') and {ONSITE} and contains(discount, '%') "
    f"and ({NO_DAYS} or {FOLD_DAYS} like '%jueves%' or {FOLD_DAYS} like '%todos los d%')"
)
Q1 = ask.OfferFilters(category="supermarket,fuel", modality="presencial", discount_type="percent", days="Jueves")


@query(
    "q1_list_offers",
    "fx_promos fx_merchants fx_terms",
    f"{LISTING_SQL} where {Q1_WHERE} order by p.scraped_at desc, p.id desc limit 20",
)
def q1_list_offers(s, sf):
    raw = fixture(s, sf, "fx_terms").withColumnRenamed("promotion_id", "offer_id")
    page, _ = ask.list_offers(promos(s, sf), merchants(s, sf), raw, Q1, AS_OF)
    return show(page, *LISTING_COLUMNS)


@query(
    "q1_list_offers_count",
    "fx_promos fx_merchants",
    f"select count(*) as total, cast(greatest(ceil(count(*) / 20.0), 1) as bigint) as pages from {JOINED} where {Q1_WHERE}",
)
def _(s, sf):
    return ask.list_offers(promos(s, sf), merchants(s, sf), store_terms(s, sf), Q1, AS_OF)[1]


@query("q2_offers_today", "fx_promos fx_merchants fx_terms", f"{LISTING_SQL} where {VALID} and {TODAY}")
def _(s, sf):
    return show(ask.offers_today(promos(s, sf), merchants(s, sf), store_terms(s, sf), AS_OF), *LISTING_COLUMNS)


@query(
    "q3_offer_detail",
    "fx_promos fx_merchants fx_terms",
    f"{LISTING_SQL} where p.id = 77",
)
def _(s, sf):
    one = relational.offer_detail(promos(s, sf), merchants(s, sf), store_terms(s, sf), 77)
    return show(relational.offer_list_view(one), *LISTING_COLUMNS)


@query(
    "q4_bank_facet",
    "fx_promos fx_merchants",
    f"""select name, count(*) as n from (select unnest([bank, wallet]) as name from {JOINED} where {VALID}
    and lower(coalesce(category, 'supermarket')) in ('supermarket') and {ONSITE}) where coalesce(name, '') <> '' and lower(name) not in {NETWORKS} group by name""",
)
def q4_bank_facet(s, sf):
    f = ask.OfferFilters(category="supermarket", modality="presencial", bank="ignored")
    return ask.bank_facet(promos(s, sf), merchants(s, sf), f, AS_OF)


@query(
    "q5_merchants",
    "fx_promos fx_merchants",
    f"select id, name, category, active_offers from ({ACTIVE_COUNTS}) where active_offers > 0",
)
def _(s, sf):
    return ask.merchants_with_offers(merchants(s, sf), promos(s, sf), AS_OF).select("id", "name", "category", "active_offers")


@query(
    "q6_stats",
    "fx_promos fx_merchants",
    f"""select 'bank' as part, * from (select bank as name, count(*) as n from fx_promos where {VALID} and coalesce(bank, '') <> '' group by 1 order by n desc, name limit 5)
    union all select 'merchant', name, active_offers from ({ACTIVE_COUNTS})""",
)
def _(s, sf):
    p, m = promos(s, sf), merchants(s, sf)
    top = relational.top_banks(p, AS_OF).select(F.lit("bank").alias("part"), "name", "n")
    per = relational.merchant_active_counts(m, p, AS_OF).select(F.lit("merchant").alias("part"), "name", F.col("active_offers").alias("n"))
    return top.unionByName(per)


@query(
    "q7_my_offers",
    "fx_promos fx_merchants fx_payment_methods",
    f"select p.id, title, discount, m.name as merchant_name from {JOINED} join ({MATCHED} and {TODAY} and u.user_id = 6) x on x.offer_id = p.id",
)
def _(s, sf):
    mine = match.my_offers(promos(s, sf), merchants(s, sf), methods(s, sf), 6, AS_OF)
    return mine.select("id", "title", "discount", "merchant_name")


@query(
    "q8_run_log",
    "fx_history fx_merchants",
    """select h.id, m.name, h.scraped_at, h.status from fx_history h join fx_merchants m on m.id = h.supermarket_id
    order by h.scraped_at desc, h.id desc limit 50""",
)
def _(s, sf):
    return ask.run_log(history(s, sf), merchants(s, sf)).select("id", "name", "scraped_at", "status")


@query(
    "q9_bot_query",
    "fx_promos fx_merchants fx_payment_methods",
    f"""select * from (
    select 'today' as command, p.id, m.name as merchant_name from {JOINED} where {VALID} and {TODAY} order by m.name, p.scraped_at desc, p.id desc limit 200)
    union all select * from (select 'mine', p.id, m.name from {JOINED} join ({MATCHED} and u.user_id = 4) x on x.offer_id = p.id where {TODAY}
      order by m.name, p.scraped_at desc, p.id desc limit 200)
    union all select * from (select 'search', p.id, m.name from {JOINED} where {VALID} and contains(lower(title), 'urgent') order by m.name, p.scraped_at desc, p.id desc limit 200)
    union all select * from (select 'bank', p.id, m.name from {JOINED} where {VALID} and (contains(lower(bank), 'nation_2') or contains(lower(wallet), 'nation_2')
      or contains(lower(title), 'nation_2')) order by m.name, p.scraped_at desc, p.id desc limit 200)
    union all select * from (select 'merchant', p.id, m.name from {JOINED} where {VALID} and contains(lower(m.name), '00002') order by m.name, p.scraped_at desc, p.id desc limit 200)
    union all select * from (select 'fuel', p.id, m.name from {JOINED} where {VALID} and {TODAY} and category = 'fuel' order by m.name, p.scraped_at desc, p.id desc limit 200)""",
)
def _(s, sf):
    p, m = promos(s, sf), merchants(s, sf)
    own = methods(s, sf).filter(F.col("user_id") == 4)
    runs = {
        "today": ask.bot_query(p, m, AS_OF, today_only=True),
        "mine": ask.bot_query(p, m, AS_OF, today_only=True, methods=own),
        "search": ask.bot_query(p, m, AS_OF, search="Urgent"),
        "bank": ask.bot_query(p, m, AS_OF, bank="Nation_2"),
        "merchant": ask.bot_query(p, m, AS_OF, merchant="00002"),
        "fuel": ask.bot_query(p, m, AS_OF, today_only=True, category="fuel"),
    }
    out = None
    for name, df in runs.items():
        part = df.select(F.lit(name).alias("command"), "id", "merchant_name")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "q10_dashboard",
    "fx_promos fx_merchants",
    f"""select p.id, title, bank, m.name as merchant_name from {JOINED} where {VALID} and bank = 'NATION_3' and regexp_matches(title, 'low|high', 'i')""",
)
def _(s, sf):
    rows = ask.dashboard(promos(s, sf), merchants(s, sf), store_terms(s, sf), AS_OF, bank="NATION_3", title_pattern="low|high")
    return rows.select("id", "title", "bank", "merchant_name")


@query(
    "q11_report",
    "fx_promos fx_merchants",
    """select 'merchant' as part, m.name as name, count(case when p.is_active = 1 then 1 end) as n from fx_merchants m left join fx_promos p on p.supermarket_id = m.id group by 2
    union all select 'payment', * from (select coalesce(bank, wallet, 'Sin especificar') as name, count(*) as n from fx_promos where is_active = 1 group by 1 order by n desc, name limit 10)
    union all select 'discount', * from (select discount as name, count(*) as n from fx_promos where is_active = 1 and coalesce(discount, '') <> '' group by 1 order by n desc, name limit 10)
    union all select 'total', 'active', count(*) from fx_promos where is_active = 1""",
)
def _(s, sf):
    r = ask.report(merchants(s, sf), promos(s, sf))
    parts = [
        r["merchants"].select(F.lit("merchant").alias("part"), "name", F.col("active_offers").alias("n")),
        r["payments"].select(F.lit("payment").alias("part"), F.col("payment").alias("name"), "n"),
        r["discounts"].select(F.lit("discount").alias("part"), F.col("discount").alias("name"), "n"),
        r["totals"].select(F.lit("total").alias("part"), F.lit("active").alias("name"), F.col("active_offers").alias("n")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


LINE_SQL = """concat('*', discount, '* — ', coalesce(nullif(bank, ''), nullif(wallet, ''), 'N/A'),
  case when coalesce(valid_days, '') = '' and coalesce(store_types, '') = '' then '' else concat(chr(10), '   ',
  concat_ws(' | ', '📅 ' || nullif(valid_days, ''), '🏪 ' || nullif(store_types, ''))) end)"""


@query(
    "w16_merchant_digests",
    "fx_promos fx_merchants",
    f"""with ranked as (select m.name as merchant_name, {LINE_SQL} as line, row_number() over (partition by m.name order by discount desc, p.id) as rn,
      count(*) over (partition by m.name) as total from {JOINED} where {VALID} and {TODAY})
    select merchant_name, cast((rn - 1) // 40 as int) as chunk_no, total,
      concat_ws(chr(10), case when min(rn) = 1 then concat('*', merchant_name, '*') end, string_agg(line, concat(chr(10), chr(10)) order by rn),
      case when max(rn) = total then concat('_Total: ', cast(total as varchar), case when total = 1 then ' promoción' else ' promociones' end, '  de hoy_') end) as text
    from ranked group by 1, 2, 3""",
)
def _(s, sf):
    return digest.merchant_digests(promos(s, sf), merchants(s, sf), AS_OF)


@query(
    "q12_digests",
    "fx_promos fx_merchants fx_payment_methods fx_users",
    f"""with wanted as (select id as user_id, telegram_chat_id from fx_users where coalesce(telegram_chat_id, '') <> '' and notify_daily = 1),
    pairs as ({MATCHED} and {TODAY}),
    ranked as (select w.user_id, m.name as merchant_name, {LINE_SQL} as line, row_number() over (partition by w.user_id, m.name order by discount desc, p.id) as rn,
      count(*) over (partition by w.user_id, m.name) as total from {JOINED} join pairs x on x.offer_id = p.id join wanted w on w.user_id = x.user_id),
    body as (select user_id, 'merchant' as kind, merchant_name, cast((rn - 1) // 40 as int) as chunk_no,
      concat_ws(chr(10), case when min(rn) = 1 then concat('*', merchant_name, '*') end, string_agg(line, concat(chr(10), chr(10)) order by rn),
      case when max(rn) = total then concat('_Total: ', cast(total as varchar), case when total = 1 then ' promoción' else ' promociones' end, '_') end) as text
      from ranked group by 1, 3, 4, total),
    summary as (select user_id, string_agg(entity_name, ', ' order by entity_name) as names from (select distinct user_id, entity_name from fx_payment_methods) group by 1),
    heads as (select s.user_id, case when b.user_id is null then 'notice' else 'header' end as kind, '' as merchant_name, 0 as chunk_no,
      case when b.user_id is null then concat('👋 ¡Buen lunes!', chr(10), chr(10), 'ℹ️ Hoy no hay promociones activas para tus tarjetas y billeteras.')
      else concat('👋 ¡Buen lunes!', chr(10), '🎯 *Tus promos de hoy* (', names, ')') end as text
      from summary s left join (select distinct user_id from body) b on b.user_id = s.user_id)
    select a.user_id, a.kind, a.merchant_name, a.chunk_no, a.text, w.telegram_chat_id from (select * from body union all select * from heads) a
    join wanted w on w.user_id = a.user_id""",
)
def _(s, sf):
    from .fixtures import fixture

    return ask.digests(fixture(s, sf, "fx_users"), methods(s, sf), promos(s, sf), merchants(s, sf), AS_OF)


@query(
    "a13_evolve_schema",
    "fx_promos",
    """select cast(id as varchar) as id, title, 'supermarket' as card_type, coalesce(wallet, '') as wallet, cast(null as varchar) as min_purchase,
    is_active = 1 as is_active from fx_promos""",
)
def _(s, sf):
    wide = evolve_schema(promos(s, sf), OFFERS, {"card_type": "supermarket", "wallet": ""})
    return wide.select("id", "title", "card_type", "wallet", "min_purchase", "is_active")
