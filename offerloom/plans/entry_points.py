"""The composed questions a user asks: listing, today, detail, facets, statistics, digests, reports."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import digest, filters, match, ordering, relational


@dataclass(frozen=True)
class OfferFilters:
    """Filters of the listing; None means no filter."""

    merchant: str | None = None
    bank: str | None = None
    days: str | None = None
    search: str | None = None
    discount_type: str | None = None
    active_today: bool = False
    category: str | None = None
    state: str = "activa"
    modality: str | None = None


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def filtered(offers: DataFrame, merchants: DataFrame, f: OfferFilters, as_of: dt.date | str) -> DataFrame:
    """Offers joined with their merchant under the filters. Offer tests run before the join."""
    tests = [filters.state_is(f.state, as_of), filters.modality_in(f.modality), filters.day_in(f.days)]
    if f.bank:
        tests.append(filters.entity_contains(offers, f.bank))
    if f.search:
        tests.append(filters.text_contains(offers, f.search))
    if f.discount_type:
        tests.append(filters.discount_kind_is(f.discount_type))
    if f.active_today:
        tests.append(filters.valid_on_weekday(as_of))
    joined = relational.with_merchant(offers.filter(_all(tests)), merchants)
    side = [filters.category_in(f.category)]
    if f.merchant:
        side.append(filters.merchant_is(f.merchant))
    return joined.filter(_all(side))


NEWEST = ["-scraped_at", "-id"]


def list_offers(
    offers: DataFrame,
    merchants: DataFrame,
    terms: DataFrame,
    f: OfferFilters,
    as_of: dt.date | str,
    page: int = 1,
    size: int = 20,
) -> tuple[DataFrame, DataFrame]:
    """(page of the listing, total and page count). Terms, parsed or raw, join only the rows of the page."""
    rows = filtered(offers, merchants, f, as_of)
    shown = ordering.paginate(rows, NEWEST, page, size)
    parsed = "max_discount" in terms.columns
    joined = relational.with_terms(shown, terms) if parsed else relational.with_raw_terms(shown, terms)
    listing = relational.offer_list_view(joined)
    return listing, ordering.page_count(rows, size)


def offers_today(offers: DataFrame, merchants: DataFrame, terms: DataFrame, as_of: dt.date | str) -> DataFrame:
    valid = offers.filter(filters.valid_on(as_of) & filters.valid_on_weekday(as_of))
    joined = relational.with_terms(relational.with_merchant(valid, merchants), terms)
    return ordering.newest_first(relational.offer_list_view(joined))


def bank_facet(offers: DataFrame, merchants: DataFrame, f: OfferFilters, as_of: dt.date | str) -> DataFrame:
    rest = OfferFilters(f.merchant, None, f.days, None, f.discount_type, False, f.category, f.state, f.modality)
    return relational.entity_facet(filtered(offers, merchants, rest, as_of))


def merchants_with_offers(merchants: DataFrame, offers: DataFrame, as_of: dt.date | str, category: str | None = None) -> DataFrame:
    return relational.active_by_merchant(merchants, offers, as_of, min_count=1, category=category)


def bot_query(
    offers: DataFrame,
    merchants: DataFrame,
    as_of: dt.date | str,
    *,
    today_only: bool = False,
    category: str | None = None,
    bank: str | None = None,
    merchant: str | None = None,
    search: str | None = None,
    methods: DataFrame | None = None,
    limit: int = 200,
) -> DataFrame:
    """The chat commands: today, mine, search, bank, merchant, fuel."""
    tests = [filters.valid_on(as_of)]
    if today_only:
        tests.append(filters.valid_on_weekday(as_of))
    if bank:
        tests.append(filters.entity_contains(offers, bank, include_title=True))
    if search:
        tests.append(filters.text_contains(offers, search))
    rows = offers.filter(_all(tests))
    if methods is not None:
        hits = match.name_hits(rows, match.method_names(methods)).select(F.col("offer_id").alias("id")).distinct()
        rows = rows.join(hits, "id", "left_semi")
    joined = relational.with_merchant(rows, merchants)
    if category:
        joined = joined.filter(filters.category_in(category))
    if merchant:
        joined = joined.filter(filters.merchant_is(merchant, "contains"))
    top = ordering.by_merchant_then_newest(joined, limit)
    return relational.bot_view(top)


def dashboard(
    offers: DataFrame,
    merchants: DataFrame,
    terms: DataFrame,
    as_of: dt.date | str,
    merchant: str | None = None,
    bank: str | None = None,
    title_pattern: str | None = None,
) -> DataFrame:
    tests = [filters.valid_on(as_of)]
    if bank:
        tests.append(filters.bank_is(bank))
    if title_pattern:
        tests.append(filters.title_matches(title_pattern))
    joined = relational.with_terms(relational.with_merchant(offers.filter(_all(tests)), merchants), terms)
    if merchant:
        joined = joined.filter(filters.merchant_is(merchant, "exact"))
    return joined


def latest_active(offers: DataFrame, merchants: DataFrame, limit: int, merchant: str | None = None) -> DataFrame:
    joined = relational.with_merchant(offers.filter(filters.is_active()), merchants)
    if merchant:
        joined = joined.filter(filters.merchant_is(merchant, "contains"))
    return ordering.newest_first(joined).limit(limit)


def report(merchants: DataFrame, offers: DataFrame) -> dict[str, DataFrame]:
    return {
        "merchants": relational.merchant_report(merchants, offers).orderBy(F.desc("active_offers"), "name"),
        "payments": relational.payment_report(offers),
        "discounts": relational.discount_report(offers),
        "totals": relational.totals(offers),
    }


def run_log(history: DataFrame, merchants: DataFrame, limit: int = 50) -> DataFrame:
    return ordering.recent(relational.history_with_merchant(history, merchants), limit)


digests = digest.build_digests
