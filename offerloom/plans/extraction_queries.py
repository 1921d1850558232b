"""Queries that apply the extraction rules to card texts and legal texts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import dates, money, rules, terms, text
from ..operators import filters
from ..operators.unify import fanout_offers, unify_offer
from . import sqltext as q
from .fixtures import AS_OF
from .registry import base, cards, promos, query, raw_terms, show

DAY = dt.date.fromisoformat(AS_OF)
YEAR = f"'{DAY.year}'"
T = "card_text"


def sql_columns(columns: dict[str, str], source: str = "fx_cards", key: str = "id") -> str:
    return f"select {key}, " + ", ".join(f"{v} as {k}" for k, v in columns.items()) + f" from {source}"


def blank(x: str) -> str:
    return f"coalesce({x}, '')"


# --- text ------------------------------------------------------------------------------------------


@query(
    "h1_clean_text",
    None,
    "select doc_id, md5(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) as cleaned from documents",
)
def _(s, sf):
    return base(s, sf, "documents").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("cleaned"))


@query("h2_fold_accents", None, "select doc_id, md5(strip_accents(lower(text))) as folded from documents")
def _(s, sf):
    return base(s, sf, "documents").select("doc_id", F.md5(text.norm(F.col("text"))).alias("folded"))


@query(
    "h3_spaced_name",
    "fx_cards",
    "select id, upper(regexp_replace(strip_accents(image_url), '[_-]', ' ', 'g')) as name from fx_cards",
)
def _(s, sf):
    return cards(s, sf).select("id", text.spaced_name(F.col("image_url")).alias("name"))


STRIP = "html"
for _tag in ("script", "style", "template", "noscript"):
    STRIP = f"regexp_replace({STRIP}, '<{_tag}[^>]*>.*?</{_tag}>', ' ', 'gis')"
HTML_TEXT = f"trim(regexp_replace(regexp_replace({STRIP}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("h4_html_to_text", None, f"select page_id, length({HTML_TEXT}) as n, md5({HTML_TEXT}) as body from pages")
def _(s, sf):
    body = text.html_to_text(F.col("html"))
    return base(s, sf, "pages").select("page_id", F.length(body).alias("n"), F.md5(body).alias("body"))


@query(
    "h7_absolutize_url",
    "fx_cards",
    """select id, case when image_url = '' then '' when image_url like 'http%' then image_url else 'https://shop.example' || image_url end as url
    from fx_cards""",
)
def _(s, sf):
    return cards(s, sf).select("id", text.absolutize(F.col("image_url"), "https://shop.example").alias("url"))


@query(
    "h7_first_link",
    None,
    "select page_id, nullif(regexp_extract(html, '<a\\s[^>]*href=[\"'']([^\"'']+)[\"'']', 1), '') as link from pages",
)
def _(s, sf):
    return base(s, sf, "pages").select("page_id", text.first_link(F.col("html")).alias("link"))


@query(
    "h8_path_category",
    None,
    """select p_partkey, case p_partkey % 3 when 0 then 'Ropa Y Calzado' when 1 then 'Economia' else '' end as category from part""",
)
def _(s, sf):
    k = F.col("p_partkey") % 3
    href = F.when(k == 0, "/beneficios/ropa-y-calzado/12").when(k == 1, "/beneficios/economia").otherwise("/otros/x")
    return base(s, sf, "part").select("p_partkey", text.path_category(href).alias("category"))


@query(
    "h9_truncate",
    "fx_cards",
    """select id, left(card_text, 40) as head, case when length(card_text) <= 80 then card_text else left(card_text, 77) || '...' end as short,
    case when length(card_text) > 40 then left(card_text, 40) || '…' else card_text end as method from fx_cards""",
)
def _(s, sf):
    c = F.col("card_text")
    return cards(s, sf).select(
        "id", text.prefix(c, 40).alias("head"), text.ellipsis(c, 80).alias("short"), text.clip_method(c).alias("method")
    )


@query(
    "h10_split_csv",
    "fx_promos",
    """select id, coalesce(array_to_string(list_filter(list_transform(string_split(coalesce(valid_days, ''), ','), lambda x: trim(x)), lambda x: x <> ''), '|'), '') as days,
    coalesce(array_to_string(list_filter(list_transform(string_split(replace(coalesce(valid_days, ''), ' y ', ','), ','), lambda x: trim(x)), lambda x: x <> ''), '|'), '') as days_y from fx_promos""",
)
def _(s, sf):
    days = F.col("valid_days")
    return show(promos(s, sf).select("id", text.split_csv(days).alias("days"), text.split_csv(days, True).alias("days_y")))


@query("h11_undouble_title", "fx_promos", "select id, trim(concat(discount, ' en ', title)) as title from fx_promos")
def _(s, sf):
    once = F.concat("discount", F.lit(" en "), "title")
    return promos(s, sf).select(
        "id", text.undouble_title(F.concat(once, once), F.col("discount")).alias("title")
    )


@query(
    "h12_marker_removal",
    "fx_promos",
    "select id, title as merchant, concat('Lunes ', trim(title)) as conditions from fx_promos",
)
def _(s, sf):
    full = F.concat("discount", F.lit(" | "), "title")
    fragment = F.concat(F.lit("<p>Lunes <a href='/x'>ver más</a> "), "title", F.lit("</p>"))
    return promos(s, sf).select(
        "id",
        text.strip_benefit_label(full, F.col("discount")).alias("merchant"),
        text.drop_links(fragment).alias("conditions"),
    )


TITLE_ONE = r"(\d+%\s*de\s*descuento[^.!?\n]{10,200})"
TITLE_TWO = r"([^.!?\n]{10,100}\d+%\s*de\s*descuento)"


@query(
    "h13_title_from_text",
    "fx_cards",
    f"select id, coalesce({q.squeeze(q.first(T, [TITLE_ONE, TITLE_TWO]))}, concat('Promoción ', id % 7)) as title from fx_cards",
)
def _(s, sf):
    return cards(s, sf).select("id", text.title_from_text(F.col(T), (F.col("id") % 7).cast("string")).alias("title"))


@query(
    "h14_alt_text_offers",
    "fx_promos",
    """select id, discount || ' de descuento' as title, regexp_extract(discount, '\\d+\\s*%', 0) as discount, '/i/' || id || '.png' as image_url
    from fx_promos where id % 2 = 0""",
)
def _(s, sf):
    html = F.concat(
        F.lit('<div><img class="x" alt="'),
        F.when(F.col("id") % 2 == 0, F.concat("discount", F.lit(" de descuento"))).otherwise("logo"),
        F.lit('" src="/i/'),
        F.col("id").cast("string"),
        F.lit('.png"></div>'),
    )
    found = promos(s, sf).select("id", F.explode(text.alt_offers(html)).alias("o"))
    return found.select("id", "o.title", "o.discount", "o.image_url")


# --- discount ---------------------------------------------------------------------------------------

TIMES = r"(\d+)\s*x\s*(\d+)"
BASE_DISCOUNT = (
    f"coalesce({q.label(q.g(T, money.PERCENT), '%')}, {q.g(T, TIMES)} || 'x' || {q.g(T, TIMES, 2)}, "
    + "'$' || " + q.g(T, r"\$\s*(\d+[\d.,]*)") + f", left({T}, 50))"
)
CUOTAS = q.label(q.g(T, money.INSTALMENTS), " cuotas sin interés")
LISTED = ", ".join(q.g(T, money.INSTALMENTS_LIST, i) for i in (1, 2, 3))
CUOTAS_LIST = (
    f"coalesce(case len(list_filter([{LISTED}], lambda x: x is not null)) when 0 then null when 1 then list_filter([{LISTED}], lambda x: x is not null)[1] "
    f"else array_to_string(list_filter([{LISTED}], lambda x: x is not null)[:-2], ', ') || ' y ' || list_filter([{LISTED}], lambda x: x is not null)[-1] end, "
    f"{q.g(T, money.INSTALMENTS_SHORT)}) || ' cuotas sin interés'"
)
CUOTAS_MAS = q.label(q.first(T, money.INSTALMENTS_MASONLINE), " cuotas sin interés")
# The "any percent" rule uses look-around; the same test as two conditions: cut interest rates out first.
NO_RATES = f"regexp_replace({T}, '\\d+\\s*%\\s*(?:de\\s+)?(?:inter[eé]s|tna|tea|cft)', ' ', 'gi')"


def _above_zero(x: str) -> str:
    return f"case when cast({x} as int) > 0 then cast(cast({x} as int) as varchar) || '%' end"


ANY_PERCENT = q.g(NO_RATES, r"(?:^|\D)(\d{1,2})\s*%")
DISCOUNTS = {
    "base": BASE_DISCOUNT,
    "legal": f"coalesce({CUOTAS}, {q.label(q.first(T, money.PERCENT_LEGAL), '%')})",
    "card": blank(f"coalesce({CUOTAS}, {q.label(q.g(T, money.PERCENT), '%')})"),
    "dia": blank(f"coalesce({q.label(q.g(T, money.PERCENT_DIA), '%')}, " + q.label(q.g(T, r"(\d+)\s*cuotas?\s*sin\s*inter[eé]s"), " CSI") + ")"),
    "shell": blank(q.label(q.first(T, money.PERCENT_SHELL), "%")),
    "puma": f"coalesce({q.label(q.first(T, money.PERCENT_PUMA), '%')}, {BASE_DISCOUNT})",
    "cencosud": blank(f"coalesce({q.label(q.g(T, money.PERCENT), '%')}, {CUOTAS_LIST})"),
    "coto": blank(f"coalesce({q.label(q.first(T, money.PERCENT_COTO), '%')}, {CUOTAS})"),
    "masonline": blank(
        f"coalesce(case when cast({q.g(T, money.REFUND_MASONLINE)} as int) > 0 then {q.label(q.g(T, money.REFUND_MASONLINE), '% reintegro')} end, "
        f"{_above_zero(q.g(T, money.PERCENT_MASONLINE[0]))}, {_above_zero(ANY_PERCENT)}, {CUOTAS_MAS})"
    ),
}


@query("h15_extract_discount", "fx_cards", sql_columns({f"d_{k}": v for k, v in DISCOUNTS.items()}))
def _(s, sf):
    return cards(s, sf).select("id", *[money.extract_discount(F.col(T), p).alias(f"d_{p}") for p in DISCOUNTS])


INSTALMENTS = {
    "coto": CUOTAS,
    "masonline": CUOTAS_MAS,
    "cencosud": CUOTAS_LIST,
    "wallet": q.label(q.g(T, r"(\d+)\s*cuotas?"), " cuotas"),
}


@query("h16_extract_instalments", "fx_cards", sql_columns({f"i_{k}": v for k, v in INSTALMENTS.items()}))
def _(s, sf):
    return cards(s, sf).select("id", *[money.extract_instalments(F.col(T), p).alias(f"i_{p}") for p in INSTALMENTS])


@query(
    "h17_discount_kind",
    "fx_promos",
    """select id, case when contains(lower(discount), 'cuota') or contains(lower(discount), 'csi') then 'cuotas'
    when contains(lower(discount), 'cashback') or contains(lower(discount), 'reintegro') then 'cashback' when contains(discount, '%') then 'percent' else 'other' end as kind,
    case when discount like '%\\%' escape '\\' then discount else coalesce(nullif(regexp_extract(discount, '^(\\d+)\\s*cuotas?', 1), '') || ' CSI', discount) end as short,
    cast(regexp_extract(discount, '\\d+', 0) as double) as amount from fx_promos""",
)
def _(s, sf):
    d = F.col("discount")
    return promos(s, sf).select(
        "id",
        money.discount_kind(d).alias("kind"),
        money.discount_short_label(d).alias("short"),
        money.discount_value(d).cast("double").alias("amount"),
    )


# --- money ----------------------------------------------------------------------------------------------

RAW = q.g(T, r"\$\s*([\d.,]+)")


@query(
    "h18_ar_amount",
    "fx_cards",
    sql_columns({"amount": q.amount(RAW), "label": q.money(RAW)}),
)
def _(s, sf):
    raw = text.grab(F.col(T), r"\$\s*([\d.,]+)")
    return cards(s, sf).select("id", money.parse_ar_amount(raw).alias("amount"), money.money_label(raw).alias("label"))


UP = f"upper({T})"
NO_CAP = f"case when {q.m(T, money.NO_CAP)} then 'Sin tope' end"
NO_CAP_CASED = f"case when {q.m(T, '[Ss]in +[Tt]ope', False)} then 'Sin tope' end"
NO_CAP_UPPER = f"case when {q.m(UP, 'SIN +TOPE', False)} then 'SIN TOPE' end"


def _mas_cap() -> str:
    picks = []
    for i, p in enumerate(money.CAP_MASONLINE):
        raw = q.g(T, p)
        shown = q.money(raw, False)
        if i == 0:
            shown = f"{shown} || coalesce(' ' || lower({q.g(T, p, 2)}), '')"
        picks.append(f"case when {q.amount(raw)} > 0 then {shown} end")
    cap = f"coalesce({', '.join(picks)}, {NO_CAP})"
    each = f"lower({q.g(T, money.CAP_FREQUENCY)})"
    often = f"case {each} when 'mes' then ' mensual' when 'semana' then ' semanal' when 'día' then ' diario' when 'dia' then ' diario' else ' por ' || {each} end"
    return f"coalesce(case when regexp_matches(lower({cap}), 'usuario|mensual|semanal|diario|transacci') or {each} is null then {cap} else {cap} || {often} end, '')"


def _coto_cap() -> str:
    raw = "case " + " ".join(f"when {q.g(T, p)} is not null then {q.g(T, p)}" for p in money.CAP_COTO) + " end"
    period = "case " + " ".join(f"when {q.g(T, p)} is not null then {q.g(T, p, 2)}" for p in money.CAP_COTO) + " end"
    shown = f"({q.money(raw, False)} || coalesce(' ' || lower({period}), ''))"
    full = f"case when contains({UP}, 'POR CLIENTE') and not contains({shown}, 'por cliente') then {shown} || ' por cliente' else {shown} end"
    return f"coalesce({full}, '$' || {raw}, '')"


CAPS = {
    "terms": blank(f"coalesce({NO_CAP_UPPER}, {q.money(q.first(UP, money.CAP_TERMS, False))})"),
    "title": blank(f"coalesce({NO_CAP_UPPER}, {q.money(q.first(UP, money.CAP_TITLE, False))})"),
    "card": blank(f"coalesce({NO_CAP}, {q.positive_money(T, money.CAP_CARD)})"),
    "wallet": blank(q.money(q.g(T, money.CAP_WALLET[0]), False)),
    "dia": blank(f"coalesce({NO_CAP_CASED}, '$' || {q.g(T, money.CAP_DIA[0])})"),
    "shell": blank(f"coalesce({NO_CAP_CASED}, '$' || rtrim({q.g(T, money.CAP_SHELL[0])}, '.'))"),
    "puma": blank(f"'$' || {q.g(T, money.CAP_PUMA[0])}"),
    "cencosud": blank(q.money(q.first(T, money.CAP_CENCOSUD))),
    "masonline": _mas_cap(),
    "coto": _coto_cap(),
    "detail": blank(f"coalesce('$' || {RAW}, case when not contains(lower({T}), 'sin tope') then {q.squeeze(T)} end)"),
}


@query(
    "h19_extract_cap",
    "fx_cards",
    sql_columns({f"c_{k}": v for k, v in CAPS.items()}),
)
def _(s, sf):
    src = F.col(T)
    picks = [
        money.extract_cap(F.upper(src) if p == "terms" else src, p).alias(f"c_{p}") for p in CAPS
    ]
    return cards(s, sf).select("id", *picks)


MINIMUMS = {
    "card": blank(q.positive_money(T, money.MINIMUM_CARD)),
    "puma": blank(f"'$' || {q.first(T, money.MINIMUM_PUMA)}"),
    "masonline": blank(f"coalesce({q.money(q.first(T, money.MINIMUM_MASONLINE))}, case when {q.m(T, money.NO_MINIMUM)} then 'Sin mínimo' end)"),
    "coto": blank(q.money(q.first(T, money.MINIMUM_COTO))),
}


@query("h20_extract_min_purchase", "fx_cards", sql_columns({f"m_{k}": v for k, v in MINIMUMS.items()}))
def _(s, sf):
    return cards(s, sf).select("id", *[money.extract_min_purchase(F.col(T), p).alias(f"m_{p}") for p in MINIMUMS])


RATES = {f"cencosud_{k}": blank(q.label(q.g(T, p), "%")) for k, p in money.RATES_CENCOSUD.items()}
RATES |= {f"masonline_{k}": blank(q.label(q.g(T, p, 1, False), "%")) for k, p in money.RATES_MASONLINE.items()}


@query("h21_extract_rates", "fx_cards", sql_columns(RATES))
def _(s, sf):
    picks = [
        c.alias(f"{profile}_{k}")
        for profile in ("cencosud", "masonline")
        for k, c in money.extract_rates(F.col(T), profile).items()
    ]
    return cards(s, sf).select("id", *picks)


DELAY = "coalesce(" + ", ".join(
    f"{q.g(T, p)} || case when {q.m(q.g(T, p, 0), 'h[aá]biles?')} then ' días hábiles' else ' días' end || ' posteriores a la compra'"
    for p in money.CREDIT_DELAY
) + ", '')"


@query("h22_credit_delay", "fx_cards", sql_columns({"delay": DELAY}))
def _(s, sf):
    return cards(s, sf).select("id", money.extract_credit_delay(F.col(T)).alias("delay"))


@query(
    "h23_cap_is_meaningful",
    "fx_cards",
    f"select id, case when regexp_matches({CAPS['card']}, '\\d') then {CAPS['card']} end as cap, "
    f"cast({q.amount(q.g(CAPS['card'], '([0-9][0-9.,]*)'))} as double) as cap_amount, {q.m(CAPS['card'], money.NO_CAP)} as cap_unlimited from fx_cards",
)
def _(s, sf):
    cap = money.extract_cap(F.col(T), "card")
    typed = money.cap_typed(cap)
    return cards(s, sf).select(
        "id",
        money.cap_is_meaningful(cap).alias("cap"),
        typed["cap_amount"].cast("double").alias("cap_amount"),
        typed["cap_unlimited"].alias("cap_unlimited"),
    )


# --- dates -----------------------------------------------------------------------------------------------

RAW_DATE = """case o_orderkey % 7 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y/%-m/%-d')
  when 2 then strftime(o_orderdate, '%d/%m/%Y') when 3 then strftime(o_orderdate, '%-d-%-m-%y') when 4 then '31/02/2026'
  when 5 then strftime(o_orderdate, '%-d') || ' de SETIEMBRE de ' || strftime(o_orderdate, '%Y') else 'siempre' end"""
ISO_TEXT = """case o_orderkey % 7 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y-%m-%d')
  when 2 then strftime(o_orderdate, '%Y-%m-%d') when 3 then '20' || strftime(o_orderdate, '%y-%m-%d') when 4 then '2026-02-31'
  when 5 then strftime(o_orderdate, '%Y') || '-09-' || strftime(o_orderdate, '%d') else '' end"""


def raw_dates(s, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 7
    spelled = F.concat(F.dayofmonth(d).cast("string"), F.lit(" de SETIEMBRE de "), F.year(d).cast("string"))
    short = F.concat_ws("-", F.dayofmonth(d).cast("string"), F.month(d).cast("string"), F.date_format(d, "yy"))
    slashed = F.concat_ws("/", F.year(d).cast("string"), F.month(d).cast("string"), F.dayofmonth(d).cast("string"))
    raw = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, slashed).when(k == 2, F.date_format(d, "dd/MM/yyyy"))
        .when(k == 3, short).when(k == 4, "31/02/2026").when(k == 5, spelled).otherwise("siempre")
    )
    return base(s, sf, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw"), d.cast("date").alias("day"))


@query(
    "h24_normalize_date",
    None,
    f"select o_orderkey as id, {RAW_DATE} as raw, {ISO_TEXT} as iso_text, cast(try_cast({ISO_TEXT} as date) as varchar) as iso_date from orders",
)
def _(s, sf):
    return show(
        raw_dates(s, sf).select(
            "id",
            "raw",
            dates.normalize_date_text(F.col("raw")).alias("iso_text"),
            dates.normalize_date(F.col("raw")).alias("iso_date"),
        )
    )


def _terms_dates(t: str) -> tuple[str, str]:
    a, b, w, y = [q.g(t, dates.TERMS_SAME_MONTH, i) for i in range(1, 5)]
    d2, m2, y2 = [q.g(t, dates.TERMS_UNTIL, i) for i in range(1, 4)]
    d3, w3, y3 = [q.g(t, dates.TERMS_UNTIL_WORDS, i) for i in range(1, 4)]
    w4, y4 = [q.g(t, dates.TERMS_WHOLE_MONTH, i) for i in range(1, 3)]
    first = q.day("'1'", q.month(w4), y4)
    since = f"case when {y} is not null then {q.day(a, q.month(w), y)} when {y2} is not null then null when {y3} is not null then null else {first} end"
    until = (
        f"case when {y} is not null then {q.day(b, q.month(w), y)} when {y2} is not null then {q.day(d2, m2, y2)} "
        f"when {y3} is not null then {q.day(d3, q.month(w3), y3)} else {q.last_day(first)} end"
    )
    return since, until


def _range(since: str, until: str, source: str, key: str = "id") -> str:
    return f"select {key}, {since} as valid_from, {until} as valid_until from {source}"


@query(
    "h25_validity_from_terms",
    "fx_terms fx_cards",
    f"""select 'terms' as source, * from ({_range(*_terms_dates('raw_text'), 'fx_terms', 'promotion_id as id')})
    union all select 'cards', * from ({_range(*_terms_dates('card_text'), 'fx_cards')})""",
)
def _(s, sf):
    t = raw_terms(s, sf).select(F.lit("terms").alias("source"), F.col("promotion_id").alias("id"), F.col("raw_text").alias("t"))
    both = t.unionByName(cards(s, sf).select(F.lit("cards").alias("source"), "id", F.col("card_text").alias("t")))
    return show(both.select("source", "id", dates.validity_from_terms(F.col("t")).alias("v")).select("source", "id", "v.*"))


def _parts(p: str, n: int, t: str = T) -> list[str]:
    return [q.g(t, p, i) for i in range(1, n + 1)]


def _profile_dates() -> dict[str, tuple[str, str]]:
    out = {}
    d, mo, y = _parts(dates.BASE_UNTIL, 3)
    d0, m0, y0 = _parts(dates.BASE_FROM, 3)
    out["base"] = (q.day(d0, m0, f"coalesce({y0}, {YEAR})"), q.day(d, mo, f"coalesce({y}, {YEAR})"))

    d1, m1, y1 = _parts(dates.LEGAL_UNTIL, 3)
    a, b, w, y = _parts(dates.LEGAL_SAME_MONTH, 4)
    d3, w3, y3 = _parts(dates.LEGAL_UNTIL_WORDS, 3)
    w4, y4 = _parts(dates.LEGAL_WHOLE_MONTH, 2)
    first = q.day("'1'", q.month(w4), y4)
    same_year = f"coalesce({y}, {YEAR})"
    out["legal"] = (
        f"case when {y1} is not null then null when {w} is not null then {q.day(a, q.month(w), same_year)} when {w3} is not null then null else {first} end",
        f"case when {y1} is not null then {q.day(d1, m1, y1)} when {w} is not null then {q.day(b, q.month(w), same_year)} "
        f"when {w3} is not null then {q.day(d3, q.month(w3), f'coalesce({y3}, {YEAR})')} else {q.last_day(first)} end",
    )

    a, b, w, y = _parts(dates.SIMPLE_RANGE, 4)
    out["simple"] = (q.day(a, q.month(w), f"coalesce({y}, {YEAR})"), q.day(b, q.month(w), f"coalesce({y}, {YEAR})"))

    a, w1, y1, b, w2, y2 = _parts(dates.MAS_WORDS, 6)
    since = f"case when {y1} is not null then {q.day(a, q.month(w1), y1)}"
    until = f"case when {y1} is not null then {q.day(b, q.month(w2), y2)}"
    for p in dates.MAS_NUMERIC:
        e1, f1, z1, e2, f2, z2 = _parts(p, 6)
        since += f" when {z1} is not null then {q.day(e1, f1, z1)}"
        until += f" when {z1} is not null then {q.day(e2, f2, z2)}"
    om = q.g(T, dates.MAS_DAYS_OF_MONTH)
    first = q.day("'1'", q.month(om), YEAR)
    since += f" when {q.month(om)} is not null then {first}"
    until += f" when {q.month(om)} is not null then {q.last_day(first)}"
    word, year = _parts(dates.MAS_MONTH, 2)
    first = q.day("'1'", q.month(word), f"coalesce({year}, {YEAR})")
    out["masonline"] = (f"{since} else {first} end", f"{until} else {q.last_day(first)} end")

    r = [q.g(T, dates.COTO_DAYS_RANGE, i) for i in range(3, 9)]
    a, w1, y1, b, w2, y2 = _parts(dates.COTO_FROM_RANGE, 6)
    s1, s2, s3, s4 = [q.g(T, dates.COTO_SPECIFIC, i) for i in (2, 3, 4, 5)]
    e1, e2, ew, ey = _parts(dates.COTO_SAME_MONTH, 4)

    def spelled(dd: str, mm: str, yy: str) -> str:
        return q.day(dd, q.month(mm), f"coalesce({yy}, {YEAR})")

    out["coto"] = (
        f"case when {r[0]} is not null then {spelled(r[0], r[1], r[2])} when {a} is not null then {spelled(a, w1, y1)} "
        f"when {q.month(s3)} is not null then {spelled(s1, s3, s4)} when {q.month(ew)} is not null then {spelled(e1, ew, ey)} end",
        f"case when {r[0]} is not null then {spelled(r[3], r[4], r[5])} when {a} is not null then {spelled(b, w2, y2)} "
        f"when {q.month(s3)} is not null then {spelled(f'coalesce({s2}, {s1})', s3, s4)} when {q.month(ew)} is not null then {spelled(e2, ew, ey)} end",
    )

    a, m1, y1, b, m2, y2 = _parts(dates.CENCOSUD_RANGE, 6)
    c, w1, z1, d, w2, z2 = _parts(dates.CENCOSUD_WORDS, 6)
    out["cencosud"] = (
        f"case when {y1} is not null then {q.day(a, m1, y1)} else {q.day(c, q.month(w1), z1)} end",
        f"case when {y1} is not null then {q.day(b, m2, y2)} else {q.day(d, q.month(w2), z2)} end",
    )

    a, m1, y1, b, m2, y2 = _parts(dates.SHELL_RANGE, 6)
    c, m3, y3 = _parts(dates.SHELL_FROM, 3)
    d, m4, y4 = _parts(dates.SHELL_UNTIL, 3)

    def loose(dd: str, mm: str, yy: str) -> str:
        return q.day(dd, mm, f"coalesce({yy}, {YEAR})")

    out["shell"] = (
        f"case when {a} is not null then {loose(a, m1, y1)} else {loose(c, m3, y3)} end",
        f"case when {a} is not null then {loose(b, m2, y2)} else {loose(d, m4, y4)} end",
    )
    d, mo, y = _parts(dates.PAGE_UNTIL, 3)
    out["page"] = ("cast(null as varchar)", q.day(d, mo, y))
    return out


PROFILE_DATES = _profile_dates()


@query(
    "h26_validity_from_text",
    "fx_cards",
    sql_columns(
        {f"{p}_{side}": sql for p, pair in PROFILE_DATES.items() for side, sql in zip(("since", "until"), pair)}
    ),
)
def _(s, sf):
    ranges = cards(s, sf).select("id", *[dates.validity_from_text(F.col(T), p, DAY).alias(p) for p in PROFILE_DATES])
    sides = (("since", "valid_from"), ("until", "valid_until"))
    return ranges.select(
        "id", *[F.col(f"{p}.{name}").cast("string").alias(f"{p}_{side}") for p in PROFILE_DATES for side, name in sides]
    )


@query(
    "h27_loose_dates",
    None,
    f"""select o_orderkey as id, case o_orderkey % 7 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 2 then strftime(o_orderdate, '%Y-%m-%d')
    when 4 then '2026-02-31' end as loose, cast(cast(o_orderdate as date) as varchar) as dotnet from orders""",
)
def _(s, sf):
    ms = F.concat(F.lit("/Date("), (F.unix_date("day") * F.lit(86400000).cast("long") + 3600000).cast("string"), F.lit(")/"))
    return show(
        raw_dates(s, sf).select(
            "id", dates.parse_date_loose(F.col("raw")).alias("loose"), dates.dotnet_date(ms).alias("dotnet")
        )
    )


@query(
    "h28_weekday_es",
    "fx_promos",
    "select id, ['Lunes','Martes','Miércoles','Jueves','Viernes','Sábado','Domingo'][isodow(valid_from)] as weekday from fx_promos",
)
def _(s, sf):
    return promos(s, sf).select("id", dates.weekday_es(F.col("valid_from")).alias("weekday"))


WEEK_SQL = "['Lunes','Martes','Miércoles','Jueves','Viernes','Sábado','Domingo']"
SHORT_SQL = "['lun','mar','mie','jue','vie','sab','dom']"


def _canon(x: str) -> str:
    return f"{WEEK_SQL}[list_position({SHORT_SQL}, left(strip_accents(lower({x})), 3))]"


def _named(t: str, p: str) -> str:
    """Days named in the text, in order of first appearance."""
    found = f"list_transform({q.every(t, f'({p})')}, lambda x: {_canon('x')})"
    return f"list_filter({found}, lambda x, i: list_position({found}, x) = i)"


def _mas_days(default: str) -> str:
    pair = f"list_filter([{_canon(q.g(T, dates.DAY_PAIR, 1))}, {_canon(q.g(T, dates.DAY_PAIR, 2))}], lambda x: x is not null)"
    listed = f"list_transform({q.every(f'coalesce({q.g(T, dates.DAY_LIST, 0)}, chr(48))', f'({dates.DAYS})')}, lambda x: {_canon('x')})"
    one = f"coalesce(list_position({WEEK_SQL}, {_canon(q.g(T, dates.DAY_RANGE, 1))}), 0)"
    two = f"coalesce(list_position({WEEK_SQL}, {_canon(q.g(T, dates.DAY_RANGE, 2))}), 0)"
    span = f"case when {one} > 0 and {two} >= {one} then list_slice({WEEK_SQL}, {one}, {two}) else [] end"
    days = f"list_filter({WEEK_SQL}, lambda d: list_contains(list_concat(list_concat({pair}, {listed}), {span}), d))"
    return f"case when {q.m(T, dates.ALL_WEEK)} or len({days}) = 7 then 'Todos los días' when len({days}) > 0 then array_to_string({days}, ', ') else {default} end"


def _title_case(x: str) -> str:
    return f"(upper(left({x}, 1)) || lower(substr({x}, 2)))"


def _coto_days() -> str:
    arms = []
    for p in (dates.COTO_DAYS_RANGE, dates.COTO_FROM_RANGE, dates.COTO_OF_MONTH, dates.COTO_DAYS, dates.COTO_DAY_TO_DAY):
        one, two = _title_case(q.g(T, p, 1)), _title_case(q.g(T, p, 2))
        if p == dates.COTO_FROM_RANGE:
            value = "null"
        elif p == dates.COTO_OF_MONTH:
            value = one
        else:
            value = f"concat_ws(' y ', {one}, {two})"
        arms.append(f"when {q.m(T, p)} then {value}")
    whole = f"coalesce({q.g(T, dates.COTO_SPECIFIC, 0)}, '')"
    found = f"list_transform({q.every(whole, f'({dates.DAY})')}, lambda x: {_title_case('x')})"
    mentions = f"array_to_string(list_filter({found}, lambda x, i: list_position({found}, x) = i), ', ')"
    return f"coalesce(case {' '.join(arms)} end, {mentions}, '')"


FOLDED = f"strip_accents(lower({T}))"
DIA_DAYS = f"list_filter({WEEK_SQL}, lambda d: contains({FOLDED}, strip_accents(lower(d))))"
VALID_DAYS = {
    "terms": f"case when {q.m(T, 'TODOS +LOS +D[ÍI]AS', False)} then 'Todos los días' else coalesce(array_to_string({_named(T, dates.DAY)}, '|'), '') end",
    "masonline": _mas_days("'Martes'"),
    "coto": _coto_days(),
    "dia": f"case when len({DIA_DAYS}) between 1 and 5 then array_to_string({DIA_DAYS}, ', ') else '' end",
    "puma": blank(q.squeeze(q.first(T, [(p, 0) for p in dates.DAYS_PUMA]))),
    "legal": blank(q.squeeze(q.g(T, dates.DAYS_LEGAL, 0))),
    "simple": blank(q.squeeze(q.g(T, dates.DAYS_SIMPLE, 0))),
    "page": blank(q.g(T, dates.DAYS_PAGE, 0)),
    "wallet": f"coalesce({_title_case(q.g(T, dates.DAYS_WALLET, 0))}, 'Todos los días')",
}


@query("h29_extract_valid_days", "fx_cards", sql_columns({f"v_{k}": v for k, v in VALID_DAYS.items()}))
def _(s, sf):
    picks = [dates.extract_valid_days(F.col(T), p, F.lit("Martes")).alias(f"v_{p}") for p in VALID_DAYS]
    return show(cards(s, sf).select("id", *picks))


@query(
    "h29_fill_tab_day",
    "fx_cards",
    f"select id, case when {VALID_DAYS['dia']} = '' then 'Jueves' else {VALID_DAYS['dia']} end as days from fx_cards",
)
def _(s, sf):
    days = dates.extract_valid_days(F.col(T), "dia")
    return cards(s, sf).select("id", dates.fill_tab_day(days, F.lit("jueves")).alias("days"))


@query(
    "f9_week_order",
    "fx_cards",
    f"select id, coalesce(array_to_string(list_filter({WEEK_SQL}, lambda d: list_contains({_named(T, dates.DAYS)}, d)), ', '), '') as days from fx_cards",
)
def _(s, sf):
    return cards(s, sf).select("id", F.array_join(dates.week_order(dates.named_days(F.col(T))), ", ").alias("days"))


# --- entities -------------------------------------------------------------------------------------------

LOW = f"lower({T})"
IMG = "lower(image_url)"
FOLD_SQL = {
    "bank": q.words(FOLDED, rules.BANK_FOLDED),
    "abbreviation": q.chain(FOLDED, rules.BANK_ABBREVIATION),
    "wallet": q.words(FOLDED, rules.WALLET_FOLDED),
}


@query(
    "h30_h31_base_entities",
    "fx_cards",
    sql_columns({"bank": q.words(LOW, rules.BANK), "wallet": q.words(LOW, rules.WALLET)}),
)
def _(s, sf):
    return cards(s, sf).select("id", rules.classify(F.col(T), "bank").alias("bank"), rules.classify(F.col(T), "wallet").alias("wallet"))


@query(
    "h32_folded_entities",
    "fx_cards",
    sql_columns({"bank": f"coalesce({FOLD_SQL['bank']}, {FOLD_SQL['abbreviation']})", "wallet": FOLD_SQL["wallet"]}),
)
def _(s, sf):
    return cards(s, sf).select("id", rules.bank_folded(F.col(T)).alias("bank"), rules.wallet_folded(F.col(T)).alias("wallet"))


@query("h33_coto_bank", "fx_cards", sql_columns({"bank": q.chain(UP, rules.BANK_COTO)}))
def _(s, sf):
    return cards(s, sf).select("id", rules.classify(F.col(T), "coto").alias("bank"))


CLASS = "trim(card_class)"


@query(
    "h34_dia_bank",
    "fx_cards",
    sql_columns(
        {
            "by_class": f"case when {CLASS} in ('', ',') then '' else coalesce({q.chain(CLASS, rules.BANK_DIA_CLASS, True)}, case when length({CLASS}) > 1 then "
            f"array_to_string(list_transform(string_split({CLASS}, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') else '' end) end",
            "by_image": q.chain(IMG, rules.BANK_DIA_IMAGE),
        }
    ),
)
def _(s, sf):
    return cards(s, sf).select(
        "id",
        rules.bank_from_class(F.col("card_class")).alias("by_class"),
        rules.classify(F.col("image_url"), "dia_image").alias("by_image"),
    )


def _context_bank() -> str:
    counted = [(n, q.m(UP, p, False)) for p, n in rules.BANK_CENCOSUD_TEXT]
    total = " + ".join(f"cast({test} as int)" for _, test in counted)
    single = "case " + " ".join(f"when {test} then {q.lit(n)}" for n, test in counted) + " end"
    contextual = "case " + " ".join(
        f"when {q.m(UP, f'{rules.CLIENTS_OF}(?:{p})', False)} then {q.lit(n)}" for p, n in rules.BANK_CENCOSUD_TEXT
    ) + " end"
    issuer = q.g(UP, rules.ISSUED_BY, 1, False)
    names = "case upper(trim(" + issuer + ")) " + " ".join(f"when {q.lit(k)} then {q.lit(v)}" for k, v in rules.ISSUER_NAME.items()) + " end"
    capital = f"array_to_string(list_transform(string_split({issuer}, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"
    modo = f"(contains({UP}, 'TRAVÉS DE MODO') or contains({UP}, 'CON MODO'))"
    return (
        f"coalesce(case when {modo} and {issuer} is not null then coalesce({names}, {capital}) end, "
        f"case when {modo} and {q.m(UP, 'PAGANDO +CON +MODO', False)} and {q.m(UP, 'PARTICIPAN +BANCO', False)} then 'MODO' end, "
        f"case when {total} = 1 then {single} when {total} > 1 then {contextual} end, {q.chain(UP, rules.WALLET_CENCOSUD_TEXT)}, '')"
    )


@query(
    "h35_cencosud_bank",
    "fx_cards",
    sql_columns({"by_image": q.chain(IMG, rules.BANK_CENCOSUD_IMAGE), "by_text": _context_bank()}),
)
def _(s, sf):
    return cards(s, sf).select(
        "id",
        rules.classify(F.col("image_url"), "cencosud_image").alias("by_image"),
        rules.bank_in_context(F.col(T)).alias("by_text"),
    )


# Look-around rules in RE2 form, used by the oracle only: the '+' neighbours become consumed characters.
LAYERED_RE2 = [(p.replace(r"(?<!\+)BNA(?!\+)", r"(?:^|[^+])BNA(?:[^+]|$)"), n) for p, n in rules.BANK_LAYERED]


def _layered() -> tuple[str, str]:
    alt = "upper(regexp_replace(strip_accents(image_url), '[_-]', ' ', 'g'))"
    both = f"upper({T} || ' ' || image_url)"
    club = "coalesce(" + ", ".join(
        q.chain(t, r) for t, r in ((both, rules.LOYALTY), (both, rules.BENEFICIARY), (alt, rules.LOYALTY), (alt, rules.BENEFICIARY))
    ) + ")"
    bank = f"coalesce({q.chain(alt, LAYERED_RE2)}, {q.chain(both, LAYERED_RE2)})"
    wallet = f"coalesce({q.chain(alt, rules.WALLET_LAYERED)}, {q.chain(both, rules.WALLET_LAYERED)})"
    own = "(" + ", ".join(q.lit(n) for n in rules.WALLET_AS_ISSUER) + ")"
    issuer = f"coalesce(club, bank, case when wallet in {own} then wallet end, {q.chain(both, rules.NETWORK)}, '')"
    rest = f"case when club is not null or (bank is null and coalesce(wallet in {own}, false)) then null else wallet end"
    inner = f"select id, {T}, image_url, {club} as club, {bank} as bank, {wallet} as wallet from fx_cards"
    return f"select id, {issuer} as bank, {rest} as wallet from ({inner})", inner


@query("h36_bank_and_wallet", "fx_cards", _layered()[0])
def _(s, sf):
    return cards(s, sf).select("id", rules.bank_and_wallet(F.col(T), F.col("image_url")).alias("e")).select("id", "e.*")


FANOUT = (
    f"case when {q.m(UP, 'BILLETERAS?[[:space:]]+VIRTUALES?', False)} and not {q.m(UP, rules.EXCLUDED_WALLETS, False)} then "
    f"case when len(string_split(names, '|')) >= 2 then string_split(names, '|') when names = '' then "
    f"[{', '.join(q.lit(n) for n in rules.WALLET_FANOUT_DEFAULT)}] else [] end else [] end"
)


@query(
    "h37_wallet_fanout",
    "fx_cards",
    f"""with found as (select id, {T}, {q.hits(UP, rules.WALLET_FANOUT, False, '|')} as names from fx_cards),
    listed as (select id, {FANOUT} as wallets from found)
    select id, w as bank, cast(null as varchar) as wallet, 'QR' as store_types, w || ' 10% - Lunes' as title from (select id, unnest(wallets) as w from listed)
    union all select id, 'Banco X', 'MODO', 'Market', 'igual' from listed where len(wallets) = 0""",
)
def _(s, sf):
    src = cards(s, sf).select(
        "id",
        T,
        F.lit("Banco X").alias("bank"),
        F.lit("MODO").alias("wallet"),
        F.lit("Market").alias("store_types"),
        F.lit("10%").alias("discount"),
        F.lit("igual").alias("title"),
    )
    out = fanout_offers(src, rules.fanout_wallets(F.col(T)), F.lit("Lunes"))
    return out.select("id", "bank", "wallet", "store_types", "title")


SHELL_NAMES = q.hits(UP, rules.WALLET_SHELL, False, "|")


@query(
    "h38_fuel_entities",
    "fx_cards",
    f"select id, {q.chain(UP, rules.BANK_SHELL)} as bank, split_part({SHELL_NAMES}, '|', 1) as wallet, {q.hits(T, rules.PAYMENT_TYPES['shell'][0], True, '/')} as card_type from fx_cards",
)
def _(s, sf):
    return cards(s, sf).select(
        "id",
        rules.classify(F.col(T), "shell_bank").alias("bank"),
        rules.combined_wallet(F.col(T)).alias("wallet"),
        rules.payment_type(F.col(T), "shell").alias("card_type"),
    )


def _cascade(text_sql: str, table: list, position: int) -> str:
    arms = []
    for alternatives, targets in table:
        test = " or ".join("(" + " and ".join(f"contains({text_sql}, {q.lit(w)})" for w in ws) + ")" for ws in alternatives)
        value = q.lit(targets[position]) if targets[position] is not None else "null"
        arms.append(f"when {test} then {value}")
    return "case " + " ".join(arms) + " end"


IMAGE = [_cascade(IMG, rules.IMAGE_CASCADE, i) for i in range(3)]
SILENT = f"coalesce({IMAGE[0]}, {IMAGE[1]}, {IMAGE[2]}) is null"
TITLED = [_cascade(IMG, rules.IMAGE_CASCADE_TITLE, i) for i in range(4)]
SAID = [_cascade(f"lower({T} || ' ')", rules.TEXT_CASCADE, i) for i in range(4)]
SILENT_TITLE = f"coalesce({TITLED[0]}, {TITLED[1]}, {TITLED[2]}) is null"


def _from_title(i: int) -> str:
    return f"coalesce({TITLED[i]}, case when {SILENT_TITLE} then {SAID[i]} end)"


@query(
    "h39_entity_cascade",
    "fx_cards",
    sql_columns(
        {
            "bank": f"coalesce({IMAGE[0]}, case when {SILENT} then {q.words(LOW, rules.BANK)} end)",
            "wallet": f"coalesce({IMAGE[1]}, case when {SILENT} then {q.words(LOW, rules.WALLET)} end)",
            "card_type": IMAGE[2],
            "t_bank": _from_title(0),
            "t_wallet": _from_title(1),
            "t_method": _from_title(3),
        }
    ),
)
def _(s, sf):
    got = rules.entity_from_image(F.col("image_url"), F.col(T))
    titled = rules.entity_from_title(F.col("image_url"), F.col(T), F.lit(""))
    return cards(s, sf).select(
        "id",
        *[c.alias(k) for k, c in got.items()],
        titled["bank"].alias("t_bank"),
        titled["wallet"].alias("t_wallet"),
        titled["payment_method"].alias("t_method"),
    )


TYPES_MAS = [(p.replace(r"\bNARANJA(?!\s*X)\b", r"\bNARANJA\b\s*(?:[^\sX]|$)"), n) for p, n in rules.CARD_TYPES]


@query(
    "h40_card_types",
    "fx_cards",
    sql_columns(
        {
            "masonline": q.hits(T, TYPES_MAS, True),
            "coto": q.hits(T, rules.CARD_TYPES_COTO, True),
            "cencosud": q.hits(T, rules.CARD_TYPES_CENCOSUD, True),
            "network": q.chain(T, [("mastercard", "Mastercard"), ("visa", "Visa"), (r"american\s*express|amex", "American Express")], True),
        }
    ),
)
def _(s, sf):
    picks = [rules.card_types(F.col(T), p).alias(p) for p in ("masonline", "coto", "cencosud")]
    return cards(s, sf).select("id", *picks, rules.card_network(F.col(T)).alias("network"))


@query(
    "h41_payment_type",
    "fx_cards",
    sql_columns({p: q.hits(T, labels, True, sep) for p, (labels, sep) in rules.PAYMENT_TYPES.items()}),
)
def _(s, sf):
    return cards(s, sf).select("id", *[rules.payment_type(F.col(T), p).alias(p) for p in rules.PAYMENT_TYPES])


@query(
    "h42_payment_method",
    "fx_cards",
    sql_columns({"method": q.squeeze(q.g(T, rules.PAYMENT_PHRASE)), "simple": q.squeeze(q.first(T, rules.PAYMENT_PHRASES_SIMPLE))}),
)
def _(s, sf):
    return cards(s, sf).select(
        "id", rules.payment_method(F.col(T)).alias("method"), rules.payment_method(F.col(T), simple=True).alias("simple")
    )


@query(
    "h43_card_from_title",
    "fx_promos",
    """select id, array_to_string(list_transform(string_split(lower(case when bank <> '' then bank when wallet <> '' then wallet else 'Mi Tarjeta' end), ' '),
    lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') as card from fx_promos""",
)
def _(s, sf):
    name = F.coalesce(text.blank_to_null(F.col("bank")), text.blank_to_null(F.col("wallet")), F.lit("Mi Tarjeta"))
    # Only letters may form a card name, so the digits of nation names are spelled as letters and read back.
    spelled = F.translate(name, "_0123456789", "éabcdefghij")
    card = rules.card_from_title(F.concat(F.lit("20% pagando con "), spelled, F.lit(" en un pago")))
    back = F.when(F.col("bank") != "", F.initcap(name)).otherwise(card)
    return promos(s, sf).select("id", F.when(card.isNotNull(), back).alias("card"))


LISTED_BANKS = q.g(T, r"[Pp]articipan\s+(.+?)(?:\.\s*[A-Z]|$)", 1, False)
BANK_NAMES = q.every(f"coalesce({LISTED_BANKS}, '')", r"(Banco\s+[\w\s]+|Billetera\s+\w+|\bICBC\b|\bBBVA\b|\bHSBC\b)")


@query(
    "h44_participating_banks",
    "fx_cards",
    sql_columns(
        {
            "banks": f"coalesce(array_to_string(list_filter(list_transform({BANK_NAMES}, lambda b: trim(regexp_replace(trim(b), '[,y]+$', ''))), lambda b: length(b) > 3), ', '), '')"
        }
    ),
)
def _(s, sf):
    return cards(s, sf).select("id", rules.participating_banks(F.col(T)).alias("banks"))


@query(
    "c10_classify_by_rules",
    "fx_cards",
    f"select id, {T}, {q.words(LOW, rules.BANK)} as name from fx_cards where {q.words(LOW, rules.BANK)} is not null",
)
def _(s, sf):
    return rules.best_by_rules(cards(s, sf).select("id", T), T, rules.rule_sets(s), "bank")


@query(
    "d15_bank_mentions",
    "fx_cards",
    "select id, name, n from (select id, unnest([" + ", ".join(
        f"{{'name': {q.lit(n)}, 'n': len({q.every(UP, p, 0, False)})}}" for p, n in rules.BANK_CENCOSUD_TEXT
    ) + "], recursive := true) from fx_cards) where n > 0",
)
def _(s, sf):
    found = cards(s, sf).select("id", F.explode(rules.bank_mentions(F.col(T))).alias("x"))
    return found.select("id", "x.name", "x.n")


# --- channels and places ------------------------------------------------------------------------------------

STORE_SQL = [f"case when {q.m(T, p)} then {q.lit(n)} end" for p, n in terms.STORE_TYPES[:4]]
STORE_SQL.append(f"case when {q.m(T, terms.STORE_TYPES[4][0])} and not {q.m(T, terms.ONLINE_EXCLUDED)} then 'Carrefour.com.ar' end")


@query("h45_store_types", "fx_cards", sql_columns({"stores": f"concat_ws('|', {', '.join(STORE_SQL)})"}))
def _(s, sf):
    return show(cards(s, sf).select("id", terms.extract_store_types(F.col(T)).alias("stores")))


@query(
    "h6_icon_store_types",
    "fx_promos",
    """select id, case id % 3 when 0 then 'Hipermercado|Online' when 1 then 'Market|Maxi' else '' end as stores from fx_promos""",
)
def _(s, sf):
    k = F.col("id") % 3
    classes = F.when(k == 0, "x-logoIcon y--logoMain z--logoOnline").when(k == 1, "logoMaxi logoMarket").otherwise("logo")
    return show(promos(s, sf).select("id", terms.store_types_from_icons(classes).alias("stores")))


PAYING = f"lower(coalesce({q.g(T, 'pagando[:[:space:]]+([^.]+)')}, ''))"


@query(
    "h46_channels",
    "fx_cards",
    sql_columns(
        {
            "masonline": f"concat_ws(', ', case when {q.m(T, terms.MAS_BRANCH)} or contains({PAYING}, 'sucursal') then 'Sucursal' end, "
            f"case when {q.m(T, terms.MAS_ONLINE)} or contains({PAYING}, 'online') then 'MásOnline' end)",
            "cencosud": "case when " + q.m(T, r"EXCLUSIVO\s+ONLINE|COMPRAS?\s+ONLINE|JUMBO\.COM") + " then 'Online' when "
            + q.m(T, r"V[AÁ]LIDO\s+PRESENCIAL|EN\s+(?:LOS\s+)?(?:LOCALES|COMERCIOS)") + " then 'Presencial' else '' end",
        }
    ),
)
def _(s, sf):
    return cards(s, sf).select(
        "id", *[terms.extract_channels(F.col(T), p).alias(p) for p in ("masonline", "cencosud")]
    )


BRANCH = f"trim(regexp_replace({q.squeeze(q.first(T, terms.COTO_BRANCHES))}, '^,+|,+$', '', 'g'))"
BRANCH = f"case when length({BRANCH}) > 3 then {BRANCH} end"
OUT = " ".join(
    f", coalesce(list_transform({q.every(T, p, 1, False)}, lambda x: trim(x)), [])" for p in terms.MAS_BRANCHES_OUT
)[2:]


@query(
    "h47_branches",
    "fx_cards",
    sql_columns(
        {
            "branches": f"coalesce(case when {q.m(T, terms.COTO_ONLINE)} then coalesce({BRANCH} || ' y Coto Digital', 'Coto Digital') else {BRANCH} end, '')",
            "excluded": f"coalesce(array_to_string(flatten([{OUT}]), ', '), '')",
        }
    ),
)
def _(s, sf):
    return cards(s, sf).select(
        "id", terms.extract_branches(F.col(T)).alias("branches"), terms.excluded_branches(F.col(T)).alias("excluded")
    )


def _categories() -> str:
    picks = []
    for p in terms.CENCOSUD_CATEGORIES:
        named = q.squeeze(q.g(T, p))
        stop = " or ".join(f"starts_with({named}, {q.lit(w)})" for w in terms.NOT_A_CATEGORY)
        picks.append(f"case when length({named}) > 2 and not ({stop}) then {named} end")
    return f"coalesce({', '.join(picks)}, '')"


COTO_CAT = q.squeeze(q.g(T, terms.COTO_CATEGORIES))


@query(
    "h48_categories",
    "fx_cards",
    sql_columns({"coto": f"coalesce(case when length({COTO_CAT}) > 3 then {COTO_CAT} end, '')", "cencosud": _categories()}),
)
def _(s, sf):
    return cards(s, sf).select("id", *[terms.extract_categories(F.col(T), p).alias(p) for p in ("coto", "cencosud")])


@query(
    "h49_refund_and_month",
    "fx_cards",
    sql_columns(
        {
            "refund": blank(f"trim({q.g(T, terms.COTO_REFUND_FORM)})"),
            "month": blank(_title_case(q.g(T, terms.MAS_MONTH_OF_DAY))),
        }
    ),
)
def _(s, sf):
    return cards(s, sf).select("id", terms.refund_form(F.col(T)).alias("refund"), terms.month_of_offer(F.col(T)).alias("month"))


# --- terms --------------------------------------------------------------------------------------------------

R = "raw_text"
TERM_EXCL = f"rtrim(trim({q.first(R, terms.EXCLUSIONS_TERMS, False)}), '.')"
TERM_CAP = blank(
    f"coalesce(case when {q.m(R, 'SIN +TOPE', False)} then 'SIN TOPE' end, {q.money(q.first(R, money.CAP_TERMS, False))})"
)
TERM_STACK = f"case when {q.m(R, 'NO +ACUMULABLE', False)} then false when {q.m(R, 'ACUMULABLE', False)} then true end"
TERM_LEAST = f"coalesce({q.g(R, terms.MINIMUM_TERMS, 1, False)}, {q.g(R, terms.STARTING_AT, 1, False)})"
TERM_REQ = f"coalesce('COMPRA MÍNIMA $' || replace(replace({TERM_LEAST}, '.', ''), ',', '.'), '')"
TERM_DAYS = f"case when {q.m(R, 'TODOS +LOS +D[ÍI]AS', False)} then 'Todos los días' else coalesce(array_to_string({_named(R, dates.DAY)}, '|'), '') end"


@query(
    "h50_parse_terms",
    "fx_terms",
    f"""select promotion_id, {blank(TERM_EXCL)} as exclusions, {TERM_REQ} as requirements, {TERM_DAYS} as valid_days, {TERM_CAP} as cap,
    {TERM_STACK} as stackable, {_terms_dates(R)[0]} as valid_from, {_terms_dates(R)[1]} as valid_until from fx_terms""",
)
def h50_parse_terms(s, sf):
    return show(terms.parse_terms(raw_terms(s, sf), "raw_text"), "promotion_id", *terms.PARSED)


@query(
    "h51_exclusions_terms",
    "fx_terms fx_cards",
    f"""select 'terms' as source, promotion_id as id, {blank(TERM_EXCL)} as exclusions from fx_terms
    union all select 'cards', id, coalesce(rtrim(trim({q.first(UP, terms.EXCLUSIONS_TERMS, False)}), '.'), '') from fx_cards""",
)
def _(s, sf):
    t = raw_terms(s, sf).select(F.lit("terms").alias("source"), F.col("promotion_id").alias("id"), F.col("raw_text").alias("t"))
    both = t.unionByName(cards(s, sf).select(F.lit("cards").alias("source"), "id", F.upper(T).alias("t")))
    return both.select("source", "id", terms.extract_exclusions_terms(F.col("t")).alias("exclusions"))


CLAUSES = " ".join(f", coalesce(list_transform({q.every(UP, p, 1, False)}, lambda x: trim(x)), [])" for p in terms.CLIENT_CLAUSES)[2:]
ONLY = f"trim({q.g(UP, terms.ONLY_FOR, 1, False)})"
ITEMS = (
    f"list_concat(list_filter([case when length({ONLY}) > 3 and not contains({ONLY}, 'EXCLU') then {ONLY} end, "
    f"case when {q.m(UP, terms.FAMILY_USE, False)} then 'CONSUMO FAMILIAR' end, 'COMPRA MÍNIMA $' || replace(replace("
    f"coalesce({q.g(UP, terms.MINIMUM_TERMS, 1, False)}, {q.g(UP, terms.STARTING_AT, 1, False)}), '.', ''), ',', '.')], lambda x: x is not null), "
    f"list_filter(flatten([{CLAUSES}]), lambda x: length(x) > 3))"
)
TIDY = f"list_transform({ITEMS}, lambda x: regexp_replace(x, '^[ .,;]+|[ .,;]+$', '', 'g'))"
KEPT = f"list_filter({TIDY}, lambda x: x <> '' and not regexp_matches(x, 'EXCLU|EXCEPTO|NO INCLUYE|NO VÁLIDO|NO APLICA|TOPE'))"


@query(
    "h52_requirements_terms",
    "fx_cards",
    sql_columns({"requirements": f"coalesce(array_to_string({KEPT}, ', '), '')"}),
)
def _(s, sf):
    return cards(s, sf).select("id", terms.extract_requirements_terms(F.upper(T)).alias("requirements"))


@query(
    "h53_stackable",
    "fx_cards",
    sql_columns(
        {
            "terms": f"case when {q.m(UP, 'NO +ACUMULABLE', False)} then false when {q.m(UP, 'ACUMULABLE', False)} then true end",
            "coto": f"case when {q.m(T, 'NO +ACUMULABLE|NO +ACUMULA +CON')} then 'No' when {q.m(T, 'ACUMULABLE +CON')} then 'Sí' end",
            "masonline": f"case when {q.m(T, 'no +(?:es +)?acumulable|no +acumula|no +se +acumula|incompatible +con +otras')} then 'No' "
            f"when {q.m(T, 'acumulable|se +puede +acumular|compatible +con +otras')} then 'Sí' "
            f"when {q.m(T, 'promoci[oó]n|beneficio|descuento|reintegro')} and {q.m(T, '[Vv]er +legal|[Tt][eé]rminos|[Cc]ondiciones', False)} then 'No (por defecto)' end",
            "cencosud": f"case when {q.m(T, 'no +(?:es +)?acumulable|no +acumula')} then 'No' when " + q.m(T, r"\bacumulable\b") + " then 'Sí' end",
            "other_offers": blank(f"trim({q.g(T, 'NO +ACUMULABLE +CON +([^.]+)')})"),
        }
    ),
)
def _(s, sf):
    c = F.col(T)
    picks = [terms.stackable_label(c, p).alias(p) for p in ("coto", "masonline", "cencosud")]
    return cards(s, sf).select(
        "id", terms.extract_stackable(F.upper(T)).alias("terms"), *picks, terms.stacks_not_with(c).alias("other_offers")
    )


def _all_texts(t: str, patterns: list[str], ci: bool = True) -> str:
    return "flatten([" + ", ".join(f"coalesce(list_transform({q.every(t, p, 1, ci)}, lambda x: trim(x)), [])" for p in patterns) + "])"


SPLIT = f"flatten(list_transform({_all_texts(LOW, terms.EXCLUSIONS_LEGAL)}, lambda t: regexp_split_to_array(t, ',|\\s+y\\s+')))"
LEGAL_EXCL = f"list_sort(list_distinct(list_transform(list_filter(list_transform({SPLIT}, lambda x: trim(x)), lambda x: length(x) > 3), lambda x: upper(left(x, 1)) || lower(substr(x, 2)))))"
EXCL_SQL = {
    "legal": f"coalesce(array_to_string({LEGAL_EXCL}, '; '), '')",
    "page": f"coalesce(array_to_string(list_filter({_all_texts(T, terms.EXCLUSIONS_PAGE)}, lambda x: length(x) > 5), '; '), '')",
    "masonline": f"concat_ws(' | ', trim({q.g(T, terms.MAS_LEFT_OUT, 1, False)}), "
    f"nullif(array_to_string(list_transform({q.every(T, terms.MAS_NOT_VALID, 1, False)}, lambda x: 'No válido ' || trim(x)), ' | '), ''))",
    "coto": "trim(regexp_replace(concat_ws(' | ', trim(" + q.g(T, terms.COTO_EXCLUSIONS_SECTION) + "), "
    f"nullif(array_to_string(list_transform({q.every(T, terms.COTO_NOT_INCLUDED)}, lambda x: 'No incluye ' || trim(x)), ' | '), ''), "
    f"'Quedan excluidas ' || trim({q.g(T, terms.COTO_LEFT_OUT)}), 'No válido para ' || trim({q.g(T, terms.COTO_NOT_VALID)})), '\\s+', ' ', 'g'))",
    "cencosud": f"concat_ws(' | ', 'No válido el ' || {q.g(T, terms.CENCOSUD_NOT_VALID)}, nullif(array_to_string(list_transform(list_filter(list_transform("
    f"{q.every(T, terms.CENCOSUD_NOT_APPLIED, 1, False)}, lambda x: trim(x)), lambda x: length(x) > 5), lambda x: 'No aplica ' || x), ' | '), ''))",
    "shell": blank(f"trim({q.g(T, terms.NO_STACK_SHELL, 0)})"),
    "puma": blank(q.squeeze(q.g(T, terms.NO_STACK_PUMA))),
    "card": blank(f"rtrim(trim({q.g(T, terms.NOT_INCLUDED_CARD)}), '.')"),
}


@query("h54_exclusions", "fx_cards", sql_columns({f"x_{k}": v for k, v in EXCL_SQL.items()}))
def _(s, sf):
    return cards(s, sf).select("id", *[terms.exclusions_label(F.col(T), p).alias(f"x_{p}") for p in EXCL_SQL])


PHRASES = f"list_transform(list_filter({_all_texts(LOW, terms.REQUIREMENTS_LEGAL)}, lambda x: length(x) > 5), lambda x: upper(left(x, 1)) || lower(substr(x, 2)))"
EXTRA = ", ".join(
    ["'Nivel ' || " + q.g(LOW, r"nivel\s+(\d+|[a-z]+)")]
    + [f"case when contains({LOW}, '{c}') then 'Tarjeta {c.title()}' end" for c in terms.PREMIUM_CARDS]
)


@query(
    "h55_requirements",
    "fx_cards",
    sql_columns(
        {
            "legal": f"coalesce(array_to_string(list_sort(list_distinct(list_concat({PHRASES}, list_filter([{EXTRA}], lambda x: x is not null)))), '|'), '')",
            "page": f"coalesce(array_to_string(list_filter({_all_texts(T, terms.REQUIREMENTS_PAGE)}, lambda x: length(x) > 10), '|'), '')",
            "coto": f"concat_ws('|', trim({q.g(T, terms.COTO_FOR_PURCHASE)}), trim({q.g(T, terms.COTO_VALID_FOR)}))",
        }
    ),
)
def _(s, sf):
    return show(cards(s, sf).select("id", *[terms.extract_requirements(F.col(T), p).alias(p) for p in ("legal", "page", "coto")]))


CAPS_RUN = r"([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ\s\d.,;:/()$%\-]{100,})"


@query(
    "h56_terms_text",
    "fx_terms",
    f"""select promotion_id, case when promotion_id % 2 = 0 then {q.squeeze('raw_text')} else coalesce({q.g('raw_text', CAPS_RUN, 1, False)}, '') end as picked from fx_terms""",
)
def _(s, sf):
    footer = F.when(F.col("promotion_id") % 2 == 0, F.array(F.col("raw_text"), F.lit("Corto")))
    return raw_terms(s, sf).select("promotion_id", terms.terms_text(footer, F.col("raw_text")).alias("picked"))


# --- arrays, flags, display -----------------------------------------------------------------------------------


@query(
    "h57_json_text_to_array",
    "fx_promos",
    """select id, case id % 5 when 0 then concat(bank, '|x') when 1 then title when 2 then title else '' end as kept,
    case id % 5 when 0 then concat(bank, '|x') when 1 then title else '' end as strict from fx_promos""",
)
def _(s, sf):
    k = F.col("id") % 5
    raw = (
        F.when(k == 0, F.to_json(F.array("bank", F.lit("x")))).when(k == 1, F.concat(F.lit('"'), "title", F.lit('"')))
        .when(k == 2, F.col("title")).when(k == 3, "").otherwise("17")
    )
    return show(
        promos(s, sf).select(
            "id", terms.json_text_to_array(raw).alias("kept"), terms.json_text_to_array(raw, keep_invalid=False).alias("strict")
        )
    )


@query(
    "h58_array_to_json",
    "fx_promos",
    """select id, concat('["', bank, '","', title, '"]') as json_text, concat(bank, ', ', title) as csv_text from fx_promos""",
)
def _(s, sf):
    items = F.array("bank", "title")
    return promos(s, sf).select("id", terms.array_to_json(items).alias("json_text"), terms.list_to_csv(items).alias("csv_text"))


@query(
    "h59_display",
    "fx_promos",
    """select id, coalesce(strftime(valid_until, '%d/%m/%Y'), 'N/A') as until_label, case when valid_until is null then concat('desde ', cast(valid_from as varchar))
    else concat(cast(valid_from as varchar), ' → ', cast(valid_until as varchar)) end as range_label from fx_promos""",
)
def _(s, sf):
    return promos(s, sf).select(
        "id",
        dates.show_date(F.col("valid_until")).alias("until_label"),
        dates.show_range(F.col("valid_from"), F.col("valid_until")).alias("range_label"),
    )


@query(
    "h60_normalize_flag",
    "fx_promos",
    "select id, case id % 7 when 0 then true when 1 then false when 2 then true when 3 then false when 4 then false when 5 then true end as flag from fx_promos",
)
def _(s, sf):
    k = F.col("id") % 7
    raw = (
        F.when(k == 0, "Sí").when(k == 1, "No").when(k == 2, "true").when(k == 3, "No (por defecto)").when(k == 4, "0").when(k == 5, "1")
    )
    return promos(s, sf).select("id", terms.normalize_flag(raw).alias("flag"))


@query(
    "p4_unify_offer",
    "fx_promos",
    """select id, title, coalesce(store_types, '') as store_types, concat('$', id) as min_purchase, coalesce(wallet, '') as wallet,
    cast(valid_from as varchar) as valid_from, concat(bank, '|b') as exclusions, id % 2 = 0 as stackable from fx_promos""",
)
def _(s, sf):
    p = promos(s, sf)
    raw = p.select(
        "id",
        "title",
        F.col("store_types").alias("aplica_en"),
        F.concat(F.lit("$"), "id").alias("monto_minimo"),
        F.col("wallet").alias("billetera_virtual"),
        F.date_format("valid_from", "d/M/yyyy").alias("valid_from"),
        F.to_json(F.array("bank", F.lit("b"))).alias("exclusions"),
        F.when(F.col("id") % 2 == 0, "Sí").otherwise("No (por defecto)").alias("acumulable"),
    )
    out = unify_offer(raw, "coto").withColumn("id", F.col("id").cast("long"))
    return show(out, "id", "title", "store_types", "min_purchase", "wallet", "valid_from", "exclusions", "stackable")


@query(
    "p6_build_title",
    "fx_promos",
    """select id, concat_ws(' ', nullif(bank, ''), '(vía ' || nullif(wallet, '') || ')', discount, '- ' || coalesce(nullif(valid_days, ''), 'Lunes')) as masonline,
    concat_ws(' ', nullif(bank, ''), discount, '- ' || nullif(valid_days, '')) as coto,
    concat_ws(' ', nullif(bank, ''), discount, case when id % 2 = 0 then '(Online)' end, '- Lunes') as cencosud,
    concat(discount, ' en ', title) as benefit from fx_promos""",
)
def _(s, sf):
    days = F.coalesce(text.blank_to_null(F.col("valid_days")), F.lit("Lunes"))
    c = {n: F.col(n) for n in ("bank", "wallet", "discount")}
    online = F.when(F.col("id") % 2 == 0, "Online").otherwise("")
    return promos(s, sf).select(
        "id",
        terms.build_title("masonline", **c, days=days).alias("masonline"),
        terms.build_title("coto", **c, days=F.col("valid_days")).alias("coto"),
        terms.build_title("cencosud", **c, channel=online, days=F.lit("Lunes")).alias("cencosud"),
        terms.build_title("benefit", discount=F.col("discount"), merchant=F.col("title")).alias("benefit"),
    )


CARD_TITLE = f"coalesce(trim({q.first(T, terms.CARD_TITLES)}), {DISCOUNTS['card']} || ' de descuento')"
CUOTA_TITLE = f"coalesce(trim({q.g(T, terms.INSTALMENT_TITLE)}), {DISCOUNTS['card']})"
RAW_TITLE = f"case when contains(lower({DISCOUNTS['card']}), 'cuotas') then {CUOTA_TITLE} else {CARD_TITLE} end"
ENTITY = f"coalesce({FOLD_SQL['bank']}, {FOLD_SQL['abbreviation']}, {FOLD_SQL['wallet']}, '')"


@query(
    "p6_title_from_card",
    "fx_cards",
    f"select id, trim(regexp_replace(case when entity <> '' and not contains(lower(raw), lower(entity)) then raw || ' con ' || entity else raw end, '\\s+', ' ', 'g')) as title "
    f"from (select id, {RAW_TITLE} as raw, {ENTITY} as entity from fx_cards)",
)
def _(s, sf):
    entity = F.coalesce(rules.bank_folded(F.col(T)), rules.wallet_folded(F.col(T)), F.lit(""))
    return cards(s, sf).select("id", terms.title_from_card(F.col(T), money.extract_discount(F.col(T), "card"), entity).alias("title"))


# --- block tests -----------------------------------------------------------------------------------------------

GENERAL = (
    f"(contains({UP}, 'EXTRA CASH') or {q.m(LOW, filters.INSTITUTIONAL_CASH, False)} or ({q.m(T, filters.INSTITUTIONAL_EXCLUDED)} and not "
    f"{q.m(UP, filters.INSTITUTIONAL_BANKS, False)}) or {q.m(LOW, filters.INSTITUTIONAL_GENERAL, False)} or (length({T}) > 1500 and {q.m(UP, filters.INSTITUTIONAL_RATES, False)}))"
)
ELEMENT_WORDS = [p for p, _ in rules.BANK_FOLDED] + [p for p, _ in rules.WALLET_FOLDED] + ["ualá"] + filters.OFFER_KEYWORDS
BLOCKS = {
    "coto": f"({q.m(T, filters.COTO_BANK_WORDS)} and {q.m(T, filters.COTO_DISCOUNT_WORDS)} and length({T}) > 200 and length({T}) < 10000)",
    "masonline": f"({q.m(T, filters.MAS_DISCOUNT_WORDS)} and {q.m(T, filters.MAS_INFO_WORDS)} and length({T}) > 50 and length({T}) < 2000 and not {GENERAL})",
    "cencosud": f"({q.m(T, filters.CENCOSUD_DISCOUNT_WORDS)} and length({T}) > 30 and length({T}) < 3500)",
    "generic": f"({q.m(T, filters.GENERIC_WORDS)} and length({T}) > 20 and length({T}) < 500)",
    "element": f"(length({T}) >= 50 and {q.m(T, '[0-9]+ *%')} and (" + " or ".join(f"contains({LOW}, {q.lit(w)})" for w in ELEMENT_WORDS) + "))",
}


@query("b12_offer_block_filter", "fx_cards", sql_columns({f"is_{k}": v for k, v in BLOCKS.items()}))
def _(s, sf):
    return cards(s, sf).select("id", *[filters.is_offer_block(F.col(T), p).alias(f"is_{p}") for p in BLOCKS])


FRAGMENT = "concat(case id % 4 when 0 then '+ ' when 1 then 'Con tarjetas 5% adicional ' else '' end, left(card_text, 60 + cast(id % 90 as int)))"
TF = f"trim({FRAGMENT})"
LOW_PERCENT = f"try_cast({q.g(TF, '([0-9]+) *%')} as int) <= 10"


@query(
    "b13_partial_fragment",
    "fx_cards",
    "select id, "
    + q.m(TF, r"^\+\s*\d+\s*%")
    + f" or coalesce({q.m(TF, '^[Cc]on +tarjetas?', False)} and {LOW_PERCENT} and {q.m(TF, 'adicional')}, false) or (length({TF}) < 100 and not "
    f"{q.m(TF, filters.PARTIAL_MAIN)} and not {q.m(TF, filters.PARTIAL_ENTITY, False)}) as partial from fx_cards",
)
def _(s, sf):
    k = F.col("id") % 4
    head = F.when(k == 0, "+ ").when(k == 1, "Con tarjetas 5% adicional ").otherwise("")
    fragment = F.concat(head, F.substring(F.col(T), F.lit(1), (F.col("id") % 90 + 60).cast("int")))
    return cards(s, sf).select("id", filters.is_partial_fragment(fragment).alias("partial"))


GENERAL_TEXT = """concat(card_text, case id % 6 when 0 then ' SERVICIO EXTRA CASH.' when 1 then ' Con tu compra podrás retirar efectivo.'
  when 2 then ' Quedan excluidos los pagos mediante MODO.' when 3 then ' Las siguientes promociones aplican online.' else '' end)"""
GT = f"({GENERAL_TEXT})"


@query(
    "b14_institutional",
    "fx_cards",
    f"select id, (contains(upper{GT}, 'EXTRA CASH') or {q.m(f'lower{GT}', filters.INSTITUTIONAL_CASH, False)} or ({q.m(GT, filters.INSTITUTIONAL_EXCLUDED)} and not "
    f"{q.m(f'upper{GT}', filters.INSTITUTIONAL_BANKS, False)}) or {q.m(f'lower{GT}', filters.INSTITUTIONAL_GENERAL, False)} or (length{GT} > 1500 and {q.m(f'upper{GT}', filters.INSTITUTIONAL_RATES, False)})) as general from fx_cards",
)
def _(s, sf):
    k = F.col("id") % 6
    tail = (
        F.when(k == 0, " SERVICIO EXTRA CASH.").when(k == 1, " Con tu compra podrás retirar efectivo.")
        .when(k == 2, " Quedan excluidos los pagos mediante MODO.").when(k == 3, " Las siguientes promociones aplican online.")
        .otherwise("")
    )
    return cards(s, sf).select("id", filters.is_institutional(F.concat(T, tail)).alias("general"))


LINES = "['No aplica a ' || bank, 'Exclusivo ' || title, 'Salvo feriados', 'Tope ' || discount]"


@query(
    "b18_exclusion_vs_requirement",
    "fx_promos",
    f"""select id, array_to_string(list_filter({LINES}, lambda x: regexp_matches(x, 'no aplica|excluy|salvo|no incluye', 'i')), '|') as exclusions,
    array_to_string(list_filter({LINES}, lambda x: not regexp_matches(x, 'no aplica|excluy|salvo|no incluye', 'i')), '|') as requirements from fx_promos""",
)
def _(s, sf):
    lines = F.array(
        F.concat(F.lit("No aplica a "), "bank"), F.concat(F.lit("Exclusivo "), "title"), F.lit("Salvo feriados"), F.concat(F.lit("Tope "), "discount")
    )
    return show(
        promos(s, sf).select(
            "id", terms.exclusion_lines(lines).alias("exclusions"), terms.requirement_lines(lines).alias("requirements")
        )
    )


@query(
    "u3_sql_functions",
    "fx_cards fx_promos",
    f"""select c.id, trim(regexp_replace(c.card_text, '\\s+', ' ', 'g')) as cleaned, {q.amount(q.g('c.card_text', '([0-9][0-9.,]*)'))} as amount,
    case when contains(lower(p.discount), 'cuota') then 'cuotas' when contains(lower(p.discount), 'reintegro') then 'cashback' else 'percent' end as kind,
    ['Lunes','Martes','Miércoles','Jueves','Viernes','Sábado','Domingo'][isodow(p.valid_from)] as weekday
    from fx_cards c join fx_promos p on p.id = c.id""",
)
def _(s, sf):
    text.register_sql_functions(s)
    joined = cards(s, sf).join(promos(s, sf).select("id", "discount", "valid_from"), "id")
    return joined.selectExpr(
        "id",
        "offer_clean_text(card_text) as cleaned",
        "offer_amount(card_text) as amount",
        "offer_discount_kind(discount) as kind",
        "offer_weekday(valid_from) as weekday",
    )
