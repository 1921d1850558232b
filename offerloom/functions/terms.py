"""Legal text: exclusions, requirements, stackability, channels, branches, categories, titles, flags."""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dates, money
from .text import (
    blank_to_null,
    contains_any,
    first_grab,
    found,
    grab,
    grab_all,
    is_json,
    or_blank,
    rx,
    squeeze,
    strip,
)

# ---------------------------------------------------------------------------------------------
# Patterns per source profile.

SENTENCE = r"[:\s]+([^\.]+(?:\.[A-Z]\.?[^\.]*)*?)(?:\.\s+[A-Z]|\.\s*$|$)"
EXCLUSIONS_TERMS = [
    r"QUEDAN EXCLUIDOS? DEL DESCUENTO" + SENTENCE,
    r"(?:SE EXCLUYE[N]?|NO INCLUYE|NO VÁLIDO PARA|EXCLUYE)" + SENTENCE,
    r"EXCEPTO" + SENTENCE,
]
ONLY_FOR = r"VÁLIDA?\s+ÚNICAMENTE\s+PARA\s+([A-ZÁÉÍÓÚÑ\s]+?)(?:,\s*SE\s+EXCLU|\.|\s*$)"
FAMILY_USE = r"(?:SOLO|EXCLUSIVO)\s+PARA\s+CONSUMO\s+FAMILIAR"
MINIMUM_TERMS = r"COMPRA\s+M[ÍI]NIMA\s+(?:DE\s+)?\$?\s*(\d+[.,\d]*)"
STARTING_AT = r"(?:COMPRAS?\s+)?A\s+PARTIR\s+DE\s+\$\s*([\d.,]+)"
CLIENT_CLAUSES = [
    r"EXCLUSIVO\s+PARA\s+CLIENTES\s+([A-ZÁÉÍÓÚÑ\s]+?)(?:\.|,)",
    r"REQUIERE\s+(?:MEMBRESÍA|TARJETA)\s+([A-ZÁÉÍÓÚÑ\s]+?)(?:\.|,)",
    r"SOLO\s+PARA\s+CLIENTES\s+([A-ZÁÉÍÓÚÑ\s]+?)(?:\.|,)",
]
NOT_A_REQUIREMENT = ["EXCLU", "EXCEPTO", "NO INCLUYE", "NO VÁLIDO", "NO APLICA", "TOPE"]

EXCLUSIONS_LEGAL = [
    r"se\s+excluyen?\s+(?:de\s+la\s+promoción\s+)?([^.]+)",
    r"exclu(?:ye|ído)(?:s)?\s+([^.]+)",
    r"no\s+(?:incluye|aplica|válid[oa])\s+(?:para|en)\s+([^.]+)",
    r"excepto\s+([^.]+)",
]
EXCLUSIONS_PAGE = [
    r"NO\s+VALID[OA]\s+(?:PARA|EN)\s+([^.]+)",
    r"EXCLU(?:YE|IDOS?)\s+([^.]+)",
    r"NO\s+APLICA\s+(?:PARA|A|EN)\s+([^.]+)",
]
REQUIREMENTS_LEGAL = [
    r"(?:solo|únicamente|exclusivamente)\s+(?:para|con)\s+([^.]{5,80})",
    r"(?:válid[oa]|aplicable)\s+(?:solo|únicamente)\s+(?:para|con)\s+([^.]{5,80})",
]
REQUIREMENTS_PAGE = [
    r"(?:SOLO|ÚNICAMENTE|EXCLUSIVAMENTE)\s+(?:PARA|CON)\s+([^.]{10,100})",
    r"VÁLID[OA]\s+(?:SOLO|ÚNICAMENTE)\s+(?:PARA|CON|EN)\s+([^.]{10,100})",
]
PREMIUM_CARDS = ["black", "platinum", "signature", "gold", "infinite"]

COTO_EXCLUSIONS_SECTION = (
    r"EXCLUSIONES?[:\s]+((?s:.+?))(?:DESCUENTOS,\s*PRECIOS\s*Y\s*PROMOCIONES|COTO\s+C\.I\.C\.S\.A|$)"
)
COTO_NOT_INCLUDED = (
    r"NO\s+INCLUYE\s+([^.]+?)(?:\.\s*(?:NO\s+INCLUYE|DESCUENTOS|ESTA\s+PUBLICACI[OÓ]N)|$)"
)
COTO_LEFT_OUT = r"QUEDAN\s+EXCLUIDAS?\s+(?:DE\s+LA\s+PROMOCI[OÓ]N\s+)?([^.]+)"
COTO_NOT_VALID = r"NO\s+V[AÁ]LIDO\s+PARA\s+([^.]+)"
COTO_FOR_PURCHASE = r"PARA\s+LA\s+COMPRA\s+([^.]+?)(?:\.\s*ALCANZA|\.)"
COTO_VALID_FOR = r"PROMOCI[OÓ]N\s+V[AÁ]LIDA\s+PARA\s+([^.]+)"
COTO_BRANCHES = [
    r"SUCURSALES\s+(?:COTO\s+)?(?:DE\s+)?([A-ZÁÉÍÓÚÑ,\s]+?)(?:\s+Y\s+COMPRAS|\s*\.|\s+NO\s+)",
    r"(?:EN\s+)?(?:PROVINCIA[S]?\s+(?:DE\s+)?)?([A-ZÁÉÍÓÚÑ,\s]+?)(?:\s+Y\s+COTO\s+DIGITAL|\s+Y\s+COMPRAS)",
]
COTO_ONLINE = r"COTO\s*DIGITAL|WWW\.COTODIGITAL\.COM\.AR"
COTO_CATEGORIES = (
    r"ALCANZA\s+A\s+(?:LA\s+TOTALIDAD\s+DE\s+)?(?:LOS\s+)?([A-Za-záéíóúñÁÉÍÓÚÑ,\s]+?)(?:\s*\(EXCEPTO|\s*\.|\s+REEMBOLSO)"
)
COTO_REFUND_FORM = r"(?:EL\s+)?REEMBOLSO\s+SE\s+(?:VER[AÁ]\s+REFLEJADO|REALIZAR[AÁ])\s+([^.]+)"

CENCOSUD_CATEGORIES = [
    r"(?:cuotas?\s+sin\s+inter[eé]s\s+)?en\s+([A-Za-záéíóúñÁÉÍÓÚÑ\s,]+?)"
    r"(?:\s+Para\s+compras|\s+Promoci[oó]n|\s+V[aá]lida|\s+Abonando|\s+PROMOCIONES|\.|$)",
    r"Dto\.?\s+(?:en\s+)?([A-Za-záéíóúñÁÉÍÓÚÑ\s,]+?)(?:\s+Para|\s+Promoci[oó]n|\.|$)",
]
NOT_A_CATEGORY = ["Para", "Con", "El", "La", "Los", "Las", "Desde", "Del", "Válido", "Exclusivo"]
CENCOSUD_NOT_VALID = (
    r"NO\s+V[AÁ]LIDO\s+(?:EL\s+)?(\d{1,2}\s+DE\s+\w+\s+DE\s+\d{4}|\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})"
)
CENCOSUD_NOT_APPLIED = r"[Nn]o\s+aplica\s+(?:para\s+)?([^.]+?)(?:\.|V[aá]lido|$)"

MAS_LEFT_OUT = r"[Qq]uedan\s+excluidos?\s+(.+?)(?:\.|$)"
MAS_NOT_VALID = r"[Nn]o\s+v[aá]lido\s+(?:para\s+)?([^.]+?)(?:\.|$)"
MAS_BRANCHES_OUT = [
    r"[Ee]xcluye[ns]?\s+(?:la\s+)?sucursale?s?\s+([^.]+?)(?:\.|$)",
    r"[Ee]xcluye[ns]?\s+(?:las\s+)?tiendas?\s+(?:de\s+)?([^.]+?)(?:\.|$)",
    r"[Nn]o\s+aplica\s+(?:en\s+)?(?:la\s+)?sucursale?s?\s+([^.]+?)(?:\.|$)",
    r"[Nn]o\s+v[aá]lido\s+(?:en\s+)?(?:la\s+)?sucursale?s?\s+([^.]+?)(?:\.|$)",
]
MAS_BRANCH = r"sucursal(?:es)?|tienda(?:s)?\s+f[ií]sica|local(?:es)?|presencial"
MAS_ONLINE = r"M[aá]s\s*Online|online|web|e-?commerce|compra(?:s)?\s+(?:por\s+)?internet|www\."
MAS_MONTH_OF_DAY = r"(?:Lunes|Martes|Mi[eé]rcoles|Jueves|Viernes|S[aá]bado|Domingo)\s+de\s+(\w+)"

NO_STACK_SHELL = r"(?:no\s+acumulable|no\s+combinable)[^.]{0,120}\.?"
NO_STACK_PUMA = r"(no\s+acumulable\s+con\s+[^.]+)"
NOT_INCLUDED_CARD = r"NO\s+INCLUYE\s+([^.]{10,300})"

ONLINE_EXCLUDED = r"NO\s+V[AÁ]LID[OA]\s+(?:PARA\s+)?(?:COMPRAS\s+(?:EN|POR)\s+)?(?:WWW\.)?CARREFOUR\.COM"
STORE_TYPES = [
    (r"carrefour\s*market", "Carrefour Market"),
    (r"carrefour\s*express", "Carrefour Express"),
    (r"carrefour\s*maxi", "Carrefour Maxi"),
    (r"hipermercado", "Hipermercado Carrefour"),
    (r"carrefour\.com", "Carrefour.com.ar"),
]
STORE_ICONS = [
    ("logoMain", "Hipermercado"),
    ("logoMarket", "Market"),
    ("logoExpress", "Express"),
    ("logoMaxi", "Maxi"),
    ("logoOnline", "Online"),
]

EXCLUSION_LINE = r"no aplica|excluy|salvo|no incluye"
CAPITALS = r"A-ZÁÉÍÓÚÑ"
PROMOTION_TEXT = rf"(PROMOCIÓN[{CAPITALS}\s\d.,;:/()$%-]{{200,}})"

# End of fixed values.
# ---------------------------------------------------------------------------------------------

NO_ITEMS = "array<string>"


def _items(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def capitalise(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


# --- exclusions -----------------------------------------------------------------------------------


def extract_exclusions_terms(text: Column) -> Column:
    """Products left out, up to the sentence end; '' when none. Expects upper-case text."""
    return or_blank(F.regexp_replace(strip(first_grab(text, EXCLUSIONS_TERMS, ci=False)), r"\.+$", ""))


def _split_items(texts: Column) -> Column:
    pieces = F.flatten(F.transform(texts, lambda t: F.split(t, rx(r",|\s+y\s+"))))
    return F.filter(F.transform(pieces, strip), lambda x: F.length(x) > 3)


def extract_exclusions(text: Column, profile: str) -> Column:
    """Exclusions by source profile: array<string>; sorted where the order carries no meaning."""
    if profile == "legal":
        lower = F.lower(or_blank(text))
        found_texts = F.concat(*[F.transform(grab_all(lower, p), strip) for p in EXCLUSIONS_LEGAL])
        return F.array_sort(F.array_distinct(F.transform(_split_items(found_texts), capitalise)))
    if profile == "page":
        texts = F.concat(*[F.transform(grab_all(text, p), strip) for p in EXCLUSIONS_PAGE])
        return F.filter(texts, lambda x: F.length(x) > 5)
    if profile == "coto":
        section = strip(grab(text, COTO_EXCLUSIONS_SECTION))
        missing = F.transform(grab_all(text, COTO_NOT_INCLUDED), lambda x: F.concat(F.lit("No incluye "), strip(x)))
        return F.concat(
            _items(section),
            missing,
            _items(
                F.concat(F.lit("Quedan excluidas "), strip(grab(text, COTO_LEFT_OUT))),
                F.concat(F.lit("No válido para "), strip(grab(text, COTO_NOT_VALID))),
            ),
        )
    if profile == "masonline":
        first = strip(grab(text, MAS_LEFT_OUT, 1, ci=False))
        rest = F.transform(grab_all(text, MAS_NOT_VALID, 1, ci=False), lambda x: F.concat(F.lit("No válido "), strip(x)))
        return F.concat(_items(first), rest)
    if profile == "cencosud":
        day = F.concat(F.lit("No válido el "), grab(text, CENCOSUD_NOT_VALID))
        rest = F.filter(
            F.transform(grab_all(text, CENCOSUD_NOT_APPLIED, 1, ci=False), strip), lambda x: F.length(x) > 5
        )
        return F.concat(_items(day), F.transform(rest, lambda x: F.concat(F.lit("No aplica "), x)))
    if profile == "shell":
        return _items(strip(grab(text, NO_STACK_SHELL, 0)))
    if profile == "puma":
        return _items(squeeze(grab(text, NO_STACK_PUMA)))
    if profile == "card":
        return _items(F.regexp_replace(strip(grab(text, NOT_INCLUDED_CARD)), r"\.+$", ""))
    raise ValueError(f"unknown exclusion profile {profile}")


def exclusions_label(text: Column, profile: str) -> Column:
    """Joined exclusions as the sources store them."""
    items = extract_exclusions(text, profile)
    if profile in ("legal", "page"):
        return F.array_join(items, "; ")
    return squeeze(F.array_join(items, " | ")) if profile == "coto" else F.array_join(items, " | ")


# --- requirements -----------------------------------------------------------------------------------


def requirement_items(text: Column) -> Column:
    """Requirements of an upper-case legal text, without exclusions and caps, in order, no repeats."""
    only = strip(grab(text, ONLY_FOR, 1, ci=False))
    only = F.when((F.length(only) > 3) & ~only.contains("EXCLU"), only)
    family = F.when(found(text, FAMILY_USE, False), F.lit("CONSUMO FAMILIAR"))
    least = F.coalesce(grab(text, MINIMUM_TERMS, 1, ci=False), grab(text, STARTING_AT, 1, ci=False))
    least = F.concat(F.lit("COMPRA MÍNIMA $"), F.translate(F.replace(least, F.lit("."), F.lit("")), ",", "."))
    clauses = F.concat(*[F.transform(grab_all(text, p, 1, ci=False), strip) for p in CLIENT_CLAUSES])
    clauses = F.filter(clauses, lambda x: F.length(x) > 3)
    items = F.concat(_items(only, family, least), clauses)
    tidy = F.transform(items, lambda x: F.regexp_replace(x, r"^[ .,;]+|[ .,;]+$", ""))
    kept = F.filter(tidy, lambda x: (x != "") & ~contains_any(F.upper(x), NOT_A_REQUIREMENT))
    return F.array_distinct(kept)


def extract_requirements_terms(text: Column) -> Column:
    return F.array_join(requirement_items(text), ", ")


def extract_requirements(text: Column, profile: str) -> Column:
    if profile == "legal":
        lower = F.lower(or_blank(text))
        texts = F.concat(*[F.transform(grab_all(lower, p), strip) for p in REQUIREMENTS_LEGAL])
        phrases = F.transform(F.filter(texts, lambda x: F.length(x) > 5), capitalise)
        level = F.concat(F.lit("Nivel "), grab(lower, r"nivel\s+(\d+|[a-z]+)"))
        cards = [F.when(lower.contains(c), F.lit(f"Tarjeta {c.title()}")) for c in PREMIUM_CARDS]
        return F.array_sort(F.array_distinct(F.concat(phrases, _items(level, *cards))))
    if profile == "page":
        texts = F.concat(*[F.transform(grab_all(text, p), strip) for p in REQUIREMENTS_PAGE])
        return F.filter(texts, lambda x: F.length(x) > 10)
    if profile == "coto":
        return _items(strip(grab(text, COTO_FOR_PURCHASE)), strip(grab(text, COTO_VALID_FOR)))
    raise ValueError(f"unknown requirement profile {profile}")


def exclusion_lines(lines: Column) -> Column:
    """Condition lines that state an exclusion."""
    return F.filter(lines, lambda x: (x != "") & x.rlike(rx(EXCLUSION_LINE)))


def requirement_lines(lines: Column) -> Column:
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(rx(EXCLUSION_LINE)))


# --- stackable, refund, month ------------------------------------------------------------------------


def extract_stackable(text: Column) -> Column:
    """False for 'NO ACUMULABLE', True for 'ACUMULABLE', NULL when not mentioned (upper-case text)."""
    return F.when(found(text, r"NO\s+ACUMULABLE", False), False).when(found(text, "ACUMULABLE", False), True)


def stackable_label(text: Column, profile: str) -> Column:
    """Source wording: 'No', 'Sí', 'No (por defecto)' or NULL."""
    if profile == "coto":
        return F.when(found(text, r"NO\s+ACUMULABLE|NO\s+ACUMULA\s+CON"), "No").when(
            found(text, r"ACUMULABLE\s+CON"), "Sí"
        )
    if profile == "masonline":
        by_default = found(text, r"promoci[oó]n|beneficio|descuento|reintegro") & found(
            text, r"[Vv]er\s+legal|[Tt][eé]rminos|[Cc]ondiciones", False
        )
        return (
            F.when(found(text, r"no\s+(?:es\s+)?acumulable|no\s+acumula|no\s+se\s+acumula|incompatible\s+con\s+otras"), "No")
            .when(found(text, r"acumulable|se\s+puede\s+acumular|compatible\s+con\s+otras"), "Sí")
            .when(by_default, "No (por defecto)")
        )
    return F.when(found(text, r"no\s+(?:es\s+)?acumulable|no\s+acumula"), "No").when(
        found(text, r"\bacumulable\b"), "Sí"
    )


def stacks_not_with(text: Column) -> Column:
    return or_blank(strip(grab(text, r"NO\s+ACUMULABLE\s+CON\s+([^.]+)")))


def normalize_flag(value: Column) -> Column:
    """Any of the stored encodings of 'stackable' as a boolean."""
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("true", "1", "si", "sí", "yes"), True).when(
        v.isin("false", "0", "no") | v.startswith("no "), False
    )


def refund_form(text: Column) -> Column:
    return or_blank(strip(grab(text, COTO_REFUND_FORM)))


def month_of_offer(text: Column) -> Column:
    return or_blank(F.initcap(grab(text, MAS_MONTH_OF_DAY)))


# --- channels, branches, categories -------------------------------------------------------------------


def store_types_from_icons(classes: Column) -> Column:
    """Store formats from icon class names, in fixed order."""
    return _items(*[F.when(classes.contains(k), F.lit(v)) for k, v in STORE_ICONS])


def extract_store_types(text: Column, online: bool = True) -> Column:
    """Store formats named in a text; the web shop is left out when the text excludes it."""
    picks = [F.when(found(text, p), F.lit(n)) for p, n in STORE_TYPES[:4]]
    if online:
        pattern, name = STORE_TYPES[4]
        picks.append(F.when(found(text, pattern) & ~found(text, ONLINE_EXCLUDED), F.lit(name)))
    return _items(*picks)


def extract_channels(text: Column, profile: str = "masonline") -> Column:
    if profile == "cencosud":
        return or_blank(
            F.when(found(text, r"EXCLUSIVO\s+ONLINE|COMPRAS?\s+ONLINE|JUMBO\.COM"), "Online").when(
                found(text, r"V[AÁ]LIDO\s+PRESENCIAL|EN\s+(?:LOS\s+)?(?:LOCALES|COMERCIOS)"), "Presencial"
            )
        )
    paying = F.lower(or_blank(grab(text, r"pagando[:\s]+([^.]+)")))
    branch = found(text, MAS_BRANCH) | paying.contains("sucursal")
    online = found(text, MAS_ONLINE) | paying.contains("online")
    return F.array_join(_items(F.when(branch, F.lit("Sucursal")), F.when(online, F.lit("MásOnline"))), ", ")


def channel_badges(html: Column) -> Column:
    """ONLINE / TIENDAS badges of a card, in order of appearance."""
    return F.array_distinct(grab_all(html, r"<span[^>]*>\s*(ONLINE|TIENDAS)\s*</span>", 1, ci=False))


def extract_branches(text: Column) -> Column:
    named = F.regexp_replace(squeeze(first_grab(text, COTO_BRANCHES)), r"^,+|,+$", "")
    named = F.trim(named)
    named = F.when(F.length(named) > 3, named)
    online = found(text, COTO_ONLINE)
    return or_blank(
        F.when(online, F.coalesce(F.concat(named, F.lit(" y Coto Digital")), F.lit("Coto Digital"))).otherwise(named)
    )


def excluded_branches(text: Column) -> Column:
    names = F.concat(*[F.transform(grab_all(text, p, 1, ci=False), strip) for p in MAS_BRANCHES_OUT])
    return F.array_join(names, ", ")


def extract_categories(text: Column, profile: str = "coto") -> Column:
    if profile == "coto":
        named = squeeze(grab(text, COTO_CATEGORIES))
        return or_blank(F.when(F.length(named) > 3, named))
    picks = []
    for pattern in CENCOSUD_CATEGORIES:
        named = squeeze(grab(text, pattern))
        stop = F.lit(False)
        for word in NOT_A_CATEGORY:
            stop = stop | named.startswith(word)
        picks.append(F.when((F.length(named) > 2) & ~stop, named))
    return or_blank(F.coalesce(*picks))


# --- long capital blocks and terms text ------------------------------------------------------------------


def capital_blocks(text: Column, least: int, quotes: bool = False) -> Column:
    """Runs of capital-letter text with at least `least` characters after the first."""
    extra = "\"'" if quotes else ""
    return F.regexp_extract_all(
        or_blank(text), F.lit(rx(rf"([{CAPITALS}][{CAPITALS}\s\d.,;:/()$%\-{extra}]{{{least},}})", False)), F.lit(1)
    )


def longest_uppercase_block(text: Column, least: int = 100, quotes: bool = False) -> Column:
    """Longest run of capitals, the first one among equals; '' when there is none."""
    blocks = capital_blocks(text, least, quotes)
    ranked = F.transform(blocks, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("at"), x.alias("block")))
    return or_blank(F.array_max(ranked)["block"])


def terms_text(footer_paragraphs: Column, card_text: Column, least: int = 30) -> Column:
    """Footer paragraphs joined, else the longest capital block, else the 'PROMOCIÓN…' passage."""
    kept = F.filter(F.coalesce(footer_paragraphs, F.array().cast(NO_ITEMS)), lambda p: F.length(p) > least)
    joined = blank_to_null(squeeze(F.array_join(kept, " ")))
    block = blank_to_null(longest_uppercase_block(card_text, 100))
    return or_blank(F.coalesce(joined, block, grab(card_text, PROMOTION_TEXT)))


def promotion_passage(text: Column) -> Column:
    """'PROMOCIÓN…' passage, else the capital blocks joined."""
    passage = grab(text, PROMOTION_TEXT)
    blocks = capital_blocks(text, 100)
    return or_blank(F.coalesce(passage, blank_to_null(F.array_join(blocks, " "))))


# --- the composed parser -------------------------------------------------------------------------------


PARSED = ("exclusions", "requirements", "valid_days", "cap", "stackable", "valid_from", "valid_until")


def parse_terms(df: DataFrame, raw: str) -> DataFrame:
    """All fields of the legal text column `raw` added as columns; empty text gives empty fields.

    The upper-case text and the validity range get a projection of their own, so each is computed once.
    """
    keep = [F.col(c) for c in df.columns if c not in PARSED]
    upper = df.withColumn("_upper", strip(F.upper(or_blank(F.col(raw)))))
    fields = upper.select(*keep, *_parsed_fields(id(SparkContext._gateway)))
    return fields.select("*", "_validity.valid_from", "_validity.valid_until").drop("_validity")


@lru_cache(maxsize=1)
def _parsed_fields(_gateway: int) -> list[Column]:
    """The field expressions over `_upper`; built once per JVM, as they never change."""
    text = F.col("_upper")
    return [
        extract_exclusions_terms(text).alias("exclusions"),
        extract_requirements_terms(text).alias("requirements"),
        dates.extract_valid_days(text, "terms").alias("valid_days"),
        money.extract_cap(text, "terms").alias("cap"),
        extract_stackable(text).alias("stackable"),
        dates.validity_from_terms(text).alias("_validity"),
    ]


def listed(joined: Column) -> Column:
    """Items of a ', '-joined field."""
    return F.filter(F.split(joined, ", "), lambda x: x != "")


# --- arrays, JSON text, titles ---------------------------------------------------------------------------


def json_text_to_array(raw: Column, keep_invalid: bool = True) -> Column:
    """JSON list -> items, JSON string -> one item, other text -> itself (or nothing)."""
    text = F.trim(or_blank(raw))
    empty = F.array().cast(NO_ITEMS)
    listed = F.from_json(F.when(text.startswith("["), text), NO_ITEMS)
    boxed = F.from_json(F.when(text.startswith('"'), F.concat(F.lit("["), text, F.lit("]"))), NO_ITEMS)
    single = F.filter(F.transform(boxed, F.trim), lambda x: x != "")
    other_json = is_json(text)
    rest = F.when(other_json | (text == ""), empty).otherwise(F.array(text) if keep_invalid else empty)
    return F.coalesce(
        F.when(text.startswith("["), F.filter(listed, lambda x: x.isNotNull())), F.when(text.startswith('"'), single), rest
    )


def array_to_json(items: Column) -> Column:
    return F.to_json(F.coalesce(items, F.array().cast(NO_ITEMS)))


def list_to_csv(items: Column) -> Column:
    return F.array_join(F.coalesce(items, F.array().cast(NO_ITEMS)), ", ")


def entity_label(bank: Column, wallet: Column, card_type: Column | None = None) -> Column:
    picks = [blank_to_null(bank), blank_to_null(wallet)]
    if card_type is not None:
        picks.append(blank_to_null(card_type))
    return F.coalesce(*picks, F.lit("N/A"))


def entity_parts(bank: Column, wallet: Column, card_type: Column) -> Column:
    joined = F.concat_ws(" · ", blank_to_null(bank), blank_to_null(wallet), blank_to_null(card_type))
    return F.coalesce(blank_to_null(joined), F.lit("Sin entidad"))


def build_title(profile: str, **c: Column) -> Column:
    """Title from its parts by source profile; blank parts are left out."""
    get = {k: blank_to_null(v) for k, v in c.items()}
    none = F.lit(None).cast("string")

    def part(name: str, left: str = "", right: str = "") -> Column:
        return F.concat(F.lit(left), get.get(name, none), F.lit(right))

    if profile == "masonline":
        parts = [part("bank"), part("wallet", "(vía ", ")"), part("discount"), part("payment_type", "(", ")"), part("days", "- ")]
    elif profile == "coto":
        parts = [part("bank"), part("discount"), part("payment_type", "(", ")"), part("days", "- ")]
    elif profile == "cencosud":
        online = F.when(c["channel"] == "Online", F.lit("(Online)"))
        parts = [part("bank"), part("discount"), part("categories", "en "), online, part("days", "- ")]
    elif profile == "dia":
        parts = [part("bank"), part("discount"), part("channel", "(", ")"), part("days", "- ")]
    elif profile == "benefit":
        return F.coalesce(F.concat(get["discount"], F.lit(" en "), get["merchant"]), get["discount"], get["merchant"], F.lit(""))
    elif profile == "entity":
        return F.coalesce(F.concat(get["discount"], F.lit(" con "), get["entity"]), get["entity"], F.lit(""))
    else:
        raise ValueError(f"unknown title profile {profile}")
    return F.coalesce(blank_to_null(F.concat_ws(" ", *parts)), get.get("fallback", F.lit("")), F.lit(""))


CARD_TITLES = [
    r"(\d+%\s*(?:de\s*)?(?:descuento|ahorro)\s+(?:en|con|si|pagando)[^.!?\n]{5,150})",
    r"(\d+%\s*(?:de\s*)?(?:descuento|ahorro)[^.!?\n]{5,150})",
]
INSTALMENT_TITLE = r"(\d+\s*cuotas?\s*sin\s*inter[eé]s[^.!?\n]{0,120})"


def title_from_card(card_text: Column, discount: Column, entity: Column) -> Column:
    """Describing sentence of the visible card, with the entity added when it is not named."""
    by_instalments = F.coalesce(strip(grab(card_text, INSTALMENT_TITLE)), discount)
    by_percent = F.coalesce(strip(first_grab(card_text, CARD_TITLES)), F.concat(discount, F.lit(" de descuento")))
    title = F.when(F.lower(discount).contains("cuotas"), by_instalments).otherwise(by_percent)
    missing = (or_blank(entity) != "") & ~F.lower(title).contains(F.lower(entity))
    return squeeze(F.when(missing, F.concat(title, F.lit(" con "), entity)).otherwise(title))
