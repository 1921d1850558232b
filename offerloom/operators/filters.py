"""Filters and predicates over offers, users, blocks and pages, as boolean columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.rules import BANK_FOLDED, WALLET_FOLDED
from ..functions.text import blank_to_null, contains_any, found, grab, html_to_text, norm, or_blank

# ---------------------------------------------------------------------------------------------
# Fixed values.

CARD_NETWORKS = [
    "visa",
    "mastercard",
    "visa/mastercard",
    "american express",
    "amex",
    "visa y mastercard",
    "tarjeta visa",
    "tarjeta mastercard",
]
ONLINE_WORDS = ["online", ".com", "web", "app"]
ONLINE_WORDS_STRICT = ["online", ".com", "web"]
COTO_BANK_WORDS = (
    r"banco|macro|nacion|ciudad|galicia|provincia|santander|hsbc|bbva|icbc|naranja|mercado\s*pago|modo\b|patagonia|"
    r"supervielle|credicoop|hipotecario|comafi|uala|personal\s*pay|cuenta\s*dni"
)
COTO_DISCOUNT_WORDS = r"\d+\s*%|cuotas?\s*sin\s*inter[eé]s|reintegro|descuento"
MAS_DISCOUNT_WORDS = r"\d+\s*%|cuotas?\s*sin\s*inter|reintegro"
MAS_INFO_WORDS = (
    r"tope|modo|banco|cr[eé]dito|d[eé]bito|m[ií]nimo|tarjeta|pagando|reintegro|aplica|sucursal|acumulable|billetera"
)
CENCOSUD_DISCOUNT_WORDS = r"\d+\s*%|\d+\s*cuotas?\s*sin\s*inter[eé]s|\d+\s*y\s*\d+\s*cuotas?|\d+\s*CSI"
GENERIC_WORDS = r"promocion|descuento|off|banco|tarjeta|%"
OFFER_KEYWORDS = ["descuento", "promoción", "oferta", "ahorro"]

PARTIAL_MAIN = r"(\d{2})\s*%\s*(de\s+)?(descuento|ahorro|reintegro|off)"
PARTIAL_ENTITY = (
    r"MODO|[Bb]anco|Supervielle|Galicia|Macro|HSBC|BBVA|Santander|Patagonia|M[aá]sClub|[Mm]ercado\s*[Pp]ago|"
    r"[Bb]illeteras?\s*[Vv]irtuales?|[Cc]uenta\s*DNI|[Nn]aranja\s*X|[Pp]ersonal\s*[Pp]ay|[Uu]al[aá]"
)
INSTITUTIONAL_CASH = r"podr[aá]s\s+retirar|retir[ao]\s+(?:de\s+)?(?:dinero|efectivo|cash)"
INSTITUTIONAL_EXCLUDED = r"quedan\s+excluidos?\s+los\s+pagos\s+(?:realizados\s+)?mediante\s+(?:MODO|Mercado\s*Pago)"
INSTITUTIONAL_BANKS = (
    r"GALICIA|MACRO|NACI[OÓ]N|BANCO\s+CIUDAD|BANCO\s+PROVINCIA|BAPRO|SANTANDER|BANCO\s+PATAGONIA|SUPERVIELLE|"
    r"HIPOTECARIO|CREDICOOP|HSBC|BBVA|ICBC|BRUBANK|COMAFI|INDUSTRIAL|ITAU"
)
INSTITUTIONAL_GENERAL = r"las\s+siguientes\s+promociones\s+aplican"
INSTITUTIONAL_HEADER = r"^MERCADO\s*PAGO\s+\d+\s+CUOTAS\s+SIN\s+INTER[EÉ]S"
INSTITUTIONAL_CONDITIONS = r"aplica\s+solo\s+si\s+se\s+cumplen\s+todas\s+las\s+condiciones"
INSTITUTIONAL_RATES = r"CFTNA|COSTO\s+FINANCIERO\s+TOTAL"

# End of fixed values.
# ---------------------------------------------------------------------------------------------


def _day(as_of: dt.date | str) -> dt.date:
    return as_of if isinstance(as_of, dt.date) else dt.date.fromisoformat(as_of)


def csv_items(text: str | None) -> list[str]:
    return [x.strip().lower() for x in (text or "").split(",") if x.strip()]


def is_active() -> Column:
    return F.col("is_active").cast("boolean")


def valid_on(as_of: dt.date | str) -> Column:
    """Active, and `as_of` inside the closed validity interval; missing ends are open."""
    day = F.lit(_day(as_of))
    until, since = F.col("valid_until"), F.col("valid_from")
    return is_active() & (until.isNull() | (until >= day)) & (since.isNull() | (since <= day))


def state_is(state: str | None, as_of: dt.date | str) -> Column:
    """'activa' (default), 'proxima' or 'finalizada'."""
    day = F.lit(_day(as_of))
    name = (state or "activa").lower().strip()
    if name == "proxima":
        return is_active() & (F.col("valid_from") > day)
    if name == "finalizada":
        return is_active() & (F.col("valid_until") < day)
    return valid_on(as_of)


def category_in(csv: str | None) -> Column:
    wanted = csv_items(csv)
    if not wanted:
        return F.lit(True)
    return F.lower(F.coalesce(F.col("category"), F.lit("supermarket"))).isin(*wanted)


def merchant_is(name: str, mode: str = "ignore_case", column: str = "merchant_name") -> Column:
    if mode == "exact":
        return F.col(column) == name
    if mode == "contains":
        return F.lower(F.col(column)).contains(name.lower())
    return F.lower(F.col(column)) == name.lower()


def text_of(name: str, columns: list[str]) -> Column:
    return F.col(name) if name in columns else F.lit("")


def entity_contains(df: DataFrame, text: str, include_title: bool = False) -> Column:
    """Substring in bank, wallet or payment method (and title), without case and accents."""
    needle = norm(F.lit(text))
    out = F.lit(False)
    for name in ["bank", "wallet", "payment_method"] + (["title"] if include_title else []):
        out = out | norm(or_blank(text_of(name, df.columns))).contains(needle)
    return out


def bank_is(bank: str) -> Column:
    return F.col("bank") == bank


def _no_days() -> Column:
    return or_blank(F.col("valid_days")) == ""


def day_in(days_csv: str | None) -> Column:
    """Any requested weekday named, or every day, or no restriction."""
    wanted = csv_items(days_csv)
    if not wanted:
        return F.lit(True)
    days = norm(F.col("valid_days"))
    named = F.lit(False)
    for day in wanted:
        named = named | days.contains(norm(F.lit(day)))
    return _no_days() | F.coalesce(named | days.contains("todos los d"), F.lit(False))


def valid_on_weekday(as_of: dt.date | str, accept_daily: bool = True) -> Column:
    """The weekday of `as_of` is named, or the text says every day (or 'diario'), or nothing."""
    day = dates.weekday_name(_day(as_of))
    days = norm(F.col("valid_days"))
    named = days.contains(norm(F.lit(day))) | days.contains("todos los d")
    if accept_daily:
        named = named | days.contains("diario")
    return _no_days() | F.coalesce(named, F.lit(False))


def modality_in(csv: str | None) -> Column:
    """'online' and/or 'presencial'; unknown values are ignored."""
    stores = F.lower(or_blank(F.col("store_types")))
    tests = {
        "online": contains_any(stores, ONLINE_WORDS),
        "presencial": (stores == "") | ~contains_any(stores, ONLINE_WORDS_STRICT),
    }
    chosen = [tests[m] for m in csv_items(csv) if m in tests]
    if not chosen:
        return F.lit(True)
    out = chosen[0]
    for test in chosen[1:]:
        out = out | test
    return out


def text_contains(df: DataFrame, query: str) -> Column:
    """Literal substring of title or terms, without case and accents."""
    needle = norm(F.lit(query))
    out = norm(or_blank(F.col("title"))).contains(needle)
    if "terms_raw" in df.columns:
        out = out | norm(or_blank(F.col("terms_raw"))).contains(needle)
    return out


def title_matches(pattern: str) -> Column:
    """Regular expression over the title, case ignored; a missing title never matches."""
    return F.coalesce(F.col("title").rlike("(?iu)" + pattern), F.lit(False))


def discount_kind_is(kind: str | None) -> Column:
    d = F.lower(or_blank(F.col("discount")))
    tests = {
        "percent": d.contains("%"),
        "cuotas": d.contains("cuota"),
        "cashback": d.contains("cashback") | d.contains("reintegro"),
    }
    return tests.get(kind or "", F.lit(True))


def is_issuer(c: Column) -> Column:
    """A named entity that is not a card network."""
    return (or_blank(c) != "") & ~F.lower(c).isin(*CARD_NETWORKS)


def identified() -> Column:
    """Bank or wallet known."""
    return F.coalesce(blank_to_null(F.trim("bank")), blank_to_null(F.trim("wallet"))).isNotNull()


def not_generic_title(label: str = "promoción carrefour") -> Column:
    """Offers without entity are dropped when the title is only the generic label."""
    return identified() | ~F.lower(or_blank(F.col("title"))).startswith(label)


def required_fields(policy: str) -> Column:
    title, discount, bank = (or_blank(F.col(c)) for c in ("title", "discount", "bank"))
    size = F.length(F.trim(title))
    rules = {
        "title_and_discount": (title != "") & (discount != ""),
        "title_or_discount": (title != "") | (discount != ""),
        "discount": discount != "",
        "bank": bank != "",
        "title_length": (size > 3) & (size < 200),
        "title_five": size >= 5,
        "any_field": (title != "") | (discount != "") | (bank != "") | (or_blank(F.col("wallet")) != ""),
    }
    return rules[policy]


def users_to_notify() -> Column:
    return (or_blank(F.col("telegram_chat_id")) != "") & F.col("notify_daily").cast("boolean")


# --- blocks and pages -------------------------------------------------------------------------------


def is_offer_block(text: Column, source: str, image_count: Column | None = None) -> Column:
    """Is this text block an offer card? Presence tests and length bounds by source."""
    size = F.length(text)
    if source == "coto":
        return found(text, COTO_BANK_WORDS) & found(text, COTO_DISCOUNT_WORDS) & (size > 200) & (size < 10000)
    if source == "masonline":
        return (
            found(text, MAS_DISCOUNT_WORDS)
            & found(text, MAS_INFO_WORDS)
            & (size > 50)
            & (size < 2000)
            & ~is_institutional(text)
        )
    if source == "cencosud":
        images = image_count if image_count is not None else F.lit(1)
        return images.between(1, 2) & found(text, CENCOSUD_DISCOUNT_WORDS) & (size > 30) & (size < 3500)
    if source == "generic":
        return found(text, GENERIC_WORDS) & (size > 20) & (size < 500)
    if source == "element":
        words = [p for p, _ in BANK_FOLDED] + [p for p, _ in WALLET_FOLDED] + ["ualá"] + OFFER_KEYWORDS
        return (size >= 50) & found(text, r"\d+\s*%") & contains_any(F.lower(text), words)
    raise ValueError(f"unknown block source {source}")


def is_partial_fragment(text: Column) -> Column:
    """Fragment of another offer: a '+N%' bonus, a low 'adicional' percent, or a short text without substance."""
    t = F.trim(or_blank(text))
    first_percent = grab(t, r"(\d+)\s*%").try_cast("int")
    bonus = found(t, r"^\+\s*\d+\s*%")
    extra = found(t, r"^[Cc]on\s+tarjetas?", False) & (first_percent <= 10) & found(t, "adicional")
    thin = (F.length(t) < 100) & ~found(t, PARTIAL_MAIN) & ~found(t, PARTIAL_ENTITY, False)
    return bonus | F.coalesce(extra, F.lit(False)) | thin


def is_institutional(text: Column) -> Column:
    """General legal or cash-service text that is no offer of the day."""
    t = or_blank(text)
    upper, lower = F.upper(t), F.lower(t)
    rates = upper.contains("CFTNA") | upper.contains("COSTO FINANCIERO TOTAL NOMINAL")
    return (
        upper.contains("EXTRA CASH")
        | found(lower, INSTITUTIONAL_CASH, False)
        | (found(t, INSTITUTIONAL_EXCLUDED) & ~found(upper, INSTITUTIONAL_BANKS, False))
        | found(lower, INSTITUTIONAL_GENERAL, False)
        | (found(upper, INSTITUTIONAL_HEADER, False) & rates & found(lower, INSTITUTIONAL_CONDITIONS, False))
        | ((F.length(t) > 1500) & found(upper, INSTITUTIONAL_RATES, False))
    )


def is_rendered_page(html: Column, least_html: int = 5000, least_text: int = 500) -> Column:
    """A usable page: document tags, enough markup, enough visible text."""
    lower = F.lower(or_blank(html))
    return (
        (lower.contains("<html") | lower.contains("<body"))
        & (F.length(html) > least_html)
        & (F.length(html_to_text(html)) > least_text)
    )
