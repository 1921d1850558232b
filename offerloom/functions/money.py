"""Discount labels, instalments, money amounts, caps, minimums, rates and credit delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import (
    bind,
    blank_to_null,
    clean_text,
    first_grab,
    first_shape,
    found,
    grab,
    or_blank,
    rx,
    shape,
    shape_parts,
)

# ---------------------------------------------------------------------------------------------
# Patterns per source profile, in order of preference.

INSTALMENTS = r"(?:hasta\s+)?(\d+)\s*cuotas?\s*sin\s*inter[eé]s"
INSTALMENTS_MASONLINE = [
    r"(\d+)\s*cuotas?\s*sin\s*inter[eé]s",
    r"(\d+)\s*cuotas?\s*fijas?",
    r"(\d+)\s*c(?:uotas?)?\s*s(?:in)?\s*i(?:nter[eé]s)?",
]
INSTALMENTS_LIST = r"(\d+)\s*,?\s*(\d+)?\s*y?\s*(\d+)?\s*cuotas?\s*sin\s*inter[eé]s"
INSTALMENTS_SHORT = r"(\d+)\s*CSI"

PERCENT = r"(\d+)\s*%"
PERCENT_LEGAL = [
    r"BENEFICIO\s+DEL\s+(\d+)\s*%",
    r"(\d+)\s*%\s*(?:DE\s+)?(?:DESCUENTO|AHORRO|REINTEGRO|DEVOLUCI[OÓ]N|BONIFICACI[OÓ]N)",
    PERCENT,
]
PERCENT_DIA = r"(\d{1,3})\s*%\s*(?:de\s+)?(?:descuento|dto\.?|reintegro|bonificaci[oó]n)?"
PERCENT_SHELL = [
    r"(\d{1,3})\s*%\s*de\s*(?:descuento|ahorro)",
    r"ahorrás?\s+un\s+(\d{1,3})\s*%",
    r"(\d{1,3})\s*%\s+(?:sobre\s+precio|en\s+la\s+carga|en\s+combustible|en\s+cargas)",
]
PERCENT_PUMA = [r"(\d+)\s*%\s*(?:de\s+)?(?:descuento|reintegro|cashback|off)", PERCENT]
PERCENT_COTO = [
    r"(\d+)\s*%\s*(?:DE\s+)?(?:DESCUENTO|REINTEGRO|DEVOLUCIÓN|DEVOLUCION)",
    r"(?:DESCUENTO|REINTEGRO|DEVOLUCIÓN|DEVOLUCION)\s*(?:DEL?\s+)?(\d+)\s*%",
]
REFUND_MASONLINE = r"(\d+)\s*%\s*(?:de\s+)?reintegro"
PERCENT_MASONLINE = [
    r"(\d+)\s*%\s*(?:de\s+)?(?:descuento|dto|off|ahorro)",
    r"(?<!\d)(\d{1,2})\s*%(?!\s*(?:de\s+)?(?:inter[eé]s|tna|tea|cft))",
]

NO_CAP = r"sin\s+tope"
CAP_TERMS = [
    r"TOPE\s+(?:DE\s+)?(?:DESCUENTO|REINTEGRO|DEVOLUCIÓN|DEVOLUCION|MÁXIMO|MAXIMO|MENSUAL|SEMANAL|DIARIO)?"
    r"\s*[:\s]*\$?\s*(\d+[\d.,]*)",
    r"TOPE\s*[:\s]*\$?\s*(\d+[\d.,]*)",
    r"\$?\s*(\d+[\d.,]*)\s+TOPE\s+(?:DE\s+)?(?:REINTEGRO|DEVOLUCIÓN|DEVOLUCION)",
    r"HASTA\s+\$?\s*(\d+[\d.,]*)\s+(?:DE\s+)?(?:REINTEGRO|DEVOLUCIÓN|DEVOLUCION|DESCUENTO)",
    r"MÁXIMO\s+(?:DE\s+)?(?:REINTEGRO|DEVOLUCIÓN|DEVOLUCION|DESCUENTO)\s+(?:DE\s+)?\$?\s*(\d+[\d.,]*)",
]
CAP_CARD = [
    r"tope\b[^.$\n]{0,40}\$\s*(\d[\d.,]*)",
    r"tope\s+m[aá]ximo[^.$\n]{0,30}\$\s*(\d[\d.,]*)",
    r"m[aá]ximo\s+de\s+descuento[^.$\n]{0,20}\$\s*(\d[\d.,]*)",
]
CAP_WALLET = [r"tope\b[^.$\n]{0,30}\$\s*(\d[\d.,]*)"]
CAP_DIA = [r"tope\s*(?:m[aá]ximo\s*)?(?:de\s+)?(?:reintegro\s*)?:?\s*\$?\s*([\d.,]+)"]
CAP_SHELL = [r"tope\b[^.]*\$\s*([\d.]+)"]
CAP_PUMA = [r"tope\s+de\s+\$\s*([\d.,]+)"]
CAP_CENCOSUD = [
    r"(?:TOPE|REEMBOLSO\s+M[AÁ]XIMO|M[AÁ]XIMO|Tope\s+(?:m[aá]ximo\s+)?(?:de\s+)?(?:reintegro)?)[:\s]*\$?\s*([\d.,]+)",
    r"\$\s*([\d.,]+)\s*(?:de\s+)?(?:tope|m[aá]ximo)",
]
CAP_TITLE = [
    r"TOPE[:\s]+\$?\s*(\d+[\d.,]*)",
    r"TOPE\s+(?:DE\s+)?(?:DEVOLUCIÓN|DEVOLUCION|REINTEGRO)[:\s]+\$?\s*(\d+[\d.,]*)",
    r"TOPE\s+(?:SEMANAL|MENSUAL|DIARIO)[:\s]+\$?\s*(\d+[\d.,]*)",
    r"\$\s*(\d+[\d.,]*)\s+TOPE",
]
CAP_MASONLINE = [
    r"tope\b[^.$\n]{0,25}\$\s*(\d[\d.,]*)"
    r"(?:\s*(por\s+usuario|mensual|semanal|diario|por\s+transacci[oó]n|por\s+d[ií]a|por\s+semana|por\s+mes))?",
    r"m[aá]ximo\s+(?:de\s+)?(?:reintegro|descuento|beneficio)[:\s]*\$?\s*(\d[\d.,]*)",
    r"(?:reintegro|descuento|beneficio)\s+m[aá]ximo[:\s]*\$?\s*(\d[\d.,]*)",
    r"hasta\s+\$?\s*(\d[\d.,]*)\s+(?:de\s+)?(?:reintegro|descuento|beneficio)",
    r"m[aá]ximo[:\s]*\$?\s*(\d[\d.,]*)",
    r"l[ií]mite\s+(?:de\s+)?\$?\s*(\d[\d.,]*)",
]
CAP_FREQUENCY = r"(?:por|cada)\s+(usuario|mes|semana|d[ií]a|transacci[oó]n)"
CAP_COTO = [
    # (pattern, has a period group)
    r"REEMBOLSO\s+M[AÁ]XIMO[:\s]*\$?\s*([\d.,]+)(?:\s*\([^)]+\))?(?:\s*(SEMANAL|MENSUAL|DIARIO|POR\s+CLIENTE))?",
    r"TOPE\s+(?:DE\s+)?(?:REINTEGRO|DEVOLUCI[OÓ]N|DESCUENTO)?[:\s]*\$?\s*([\d.,]+)"
    r"(?:\s*(SEMANAL|MENSUAL|DIARIO|POR\s+CLIENTE))?",
    r"M[AÁ]XIMO\s+(?:DE\s+)?(?:REINTEGRO|DEVOLUCI[OÓ]N)?[:\s]*\$?\s*([\d.,]+)"
    r"(?:\s*(SEMANAL|MENSUAL|DIARIO|POR\s+CLIENTE))?",
    r"REINTEGRO\s+(?:M[AÁ]XIMO|HASTA)?[:\s]*\$?\s*([\d.,]+)(?:\s*(SEMANAL|MENSUAL|DIARIO|POR\s+CLIENTE))?",
    r"\$\s*([\d.,]+)\s*(?:\([^)]+\))?\s*(SEMANAL|MENSUAL|DIARIO)?\s*(?:POR\s+CLIENTE)?\s*(?:TOPE|M[AÁ]XIMO)",
]

MINIMUM_CARD = [r"m[ií]nimo\s+de\s+compra\s+\$\s*(\d[\d.,]*)"]
MINIMUM_PUMA = [r"pago\s+m[íi]nimo\s+de\s+\$\s*([\d.,]+)", r"compra\s+m[íi]nima\s+de\s+\$\s*([\d.,]+)"]
MINIMUM_MASONLINE = [
    r"m[ií]nimo\s+(?:de\s+)?compra[:\s]*\$?\s*([\d.,]+)",
    r"compra\s+m[ií]nima[:\s]*\$?\s*([\d.,]+)",
    r"monto\s+m[ií]nimo[:\s]*\$?\s*([\d.,]+)",
    r"a\s+partir\s+de\s+\$?\s*([\d.,]+)",
    r"con\s+compras?\s+(?:mayores?\s+)?(?:a|de)\s+\$?\s*([\d.,]+)",
    r"supere[ns]?\s+(?:los\s+)?\$?\s*([\d.,]+)",
]
MINIMUM_COTO = [
    r"A\s+PARTIR\s+DE\s+\$\s*([\d.,]+)",
    r"COMPRA\s+M[ÍI]NIMA\s+(?:DE\s+)?\$\s*([\d.,]+)",
    r"PAGANDO\s+CON\s+[A-Z\s]+\s+DESDE\s+\$\s*([\d.,]+)",
]
NO_MINIMUM = r"sin\s+m[ií]nimo|sin\s+compra\s+m[ií]nima"

RATES_CENCOSUD = {
    "tna": r"(?:TNA|TASA\s+NOMINAL\s+ANUAL)[:\s]*(\d+[,.]?\d*)\s*%",
    "tea": r"(?:TEA|TASA\s+EFECTIVA\s+ANUAL)[:\s]*(\d+[,.]?\d*)\s*%",
    "cft": r"(?:CFTEA?|COSTO\s+FINANCIERO\s+TOTAL)[^:]*[:\s]*(\d+[,.]?\d*)\s*%",
}
RATES_MASONLINE = {
    "tna": r"(?:TNA|[Tt]asa\s+[Nn]ominal\s+[Aa]nual)[:\s]*(\d+[,.]?\d*)\s*%",
    "tea": r"(?:TEA|[Tt]asa\s+[Ee]fectiva\s+[Aa]nual)[:\s]*(\d+[,.]?\d*)\s*%",
    "cft": r"(?:CFT|[Cc]osto\s+[Ff]inanciero\s+[Tt]otal)[^:]*[:\s]*(\d+[,.]?\d*)\s*%",
}

CREDIT_DELAY = [
    r"(?:reflejad[oa]s?|acreditad[oa]s?|ver[aá]n?\s+reflejad[oa]s?).*?(?:en\s+)?(?:los\s+)?(\d+)\s*d[ií]as?\s*"
    r"(?:h[aá]biles?\s*)?(?:posteriores?|siguientes?|despu[eé]s)(?:\s+(?:a|de)\s+la\s+compra)?",
    r"(?:reintegro|descuento|beneficio).*?(?:dentro\s+de\s+)?(?:los\s+)?(\d+)\s*d[ií]as?\s*h[aá]biles?",
    r"(?:plazo|t[eé]rmino)\s+(?:de\s+)?(\d+)\s*d[ií]as?",
    r"(?:hasta|m[aá]ximo)\s+(\d+)\s*d[ií]as?\s*(?:h[aá]biles?\s*)?(?:para|hasta)\s+(?:ver|que\s+se)",
    r"(\d+)\s*d[ií]as?\s*(?:h[aá]biles?\s*)?posteriores?\s+a\s+la\s+compra",
]

# End of fixed values.
# ---------------------------------------------------------------------------------------------


def label(value: Column, suffix: str) -> Column:
    return F.concat(value, F.lit(suffix))


def parse_ar_amount(text: Column) -> Column:
    """'20.000,50' -> 20000.5; NULL when it is not a number."""
    return F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def format_ar_amount(amount: Column) -> Column:
    """20000.0 -> '$20.000'."""
    return F.concat(F.lit("$"), F.translate(F.format_number(amount, 0), ",", "."))


def money_label(raw: Column, keep_raw: bool = True) -> Column:
    """Formatted amount; text that is no number keeps its digits unless `keep_raw` is off."""

    def shown(text: Column) -> Column:
        formatted = format_ar_amount(parse_ar_amount(text))
        return F.coalesce(formatted, F.concat(F.lit("$"), text)) if keep_raw else formatted

    return bind(raw, shown)


# A readable amount above zero, as written.
POSITIVE = r"^(?=.*[1-9])[\d.]+(?:,[\d.]*)?$"


def positive_amount(raw: Column) -> Column:
    """The first '~' part when it is an amount above zero: the packed text itself, else NULL."""
    return bind(raw, lambda x: F.when(F.substring_index(x, "~", 1).rlike(POSITIVE), x))


def positive_money(text: Column, patterns: list[str]) -> Column:
    """First pattern whose amount is above zero."""
    return money_label(F.coalesce(*[positive_amount(grab(text, p)) for p in patterns]), keep_raw=False)


def cap_typed(cap: Column) -> dict[str, Column]:
    """Typed companions of a cap label."""
    return {
        "cap_amount": parse_ar_amount(F.regexp_extract(cap, r"(\d[\d.,]*)", 1)).cast("decimal(18,2)"),
        "cap_unlimited": found(cap, NO_CAP),
    }


def cap_is_meaningful(cap: Column) -> Column:
    """The cap label when it holds a digit, else NULL."""
    return F.when(cap.rlike(r"\d"), cap)


# --- discount -----------------------------------------------------------------------------------


def extract_instalments(text: Column, profile: str = "coto") -> Column:
    if profile == "masonline":
        return label(first_grab(text, INSTALMENTS_MASONLINE), " cuotas sin interés")
    if profile == "wallet":
        return label(grab(text, r"(\d+)\s*cuotas?"), " cuotas")
    if profile == "cencosud":
        counts = F.coalesce(shape(text, INSTALMENTS_LIST, "$1~$2~$3"), grab(text, INSTALMENTS_SHORT))

        def listed(packed: Column) -> Column:
            parts = F.filter(shape_parts(packed), lambda x: x != "")
            head = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), ", ")
            last = F.get(parts, F.size(parts) - 1)
            return F.when(F.size(parts) > 1, F.concat(head, F.lit(" y "), last)).otherwise(last)

        return label(bind(counts, listed), " cuotas sin interés")
    return label(grab(text, INSTALMENTS), " cuotas sin interés")


def percent_above_zero(text: Column, patterns: list[str]) -> Column:
    def positive(found: Column) -> Column:
        value = found.try_cast("int")
        return F.when(value > 0, label(value.cast("string"), "%"))

    return F.coalesce(*[bind(F.regexp_extract(text, rx(p), 1), positive) for p in patterns])


def base_discount(text: Column) -> Column:
    return or_blank(
        F.coalesce(
            label(grab(text, PERCENT), "%"),
            shape(text, r"(\d+)\s*x\s*(\d+)", "$1x$2"),
            F.concat(F.lit("$"), grab(text, r"\$\s*(\d+[\d.,]*)")),
            F.substring(text, 1, 50),
        )
    )


def extract_discount(text: Column, profile: str = "base") -> Column:
    """Discount label by source profile; '' when the text names none."""
    if profile == "base":
        return base_discount(text)
    if profile == "legal":
        return F.coalesce(extract_instalments(text), label(first_grab(text, PERCENT_LEGAL), "%"))
    if profile == "card":
        return or_blank(F.coalesce(extract_instalments(text), label(grab(text, PERCENT), "%")))
    if profile == "dia":
        return or_blank(
            F.coalesce(label(grab(text, PERCENT_DIA), "%"), label(grab(text, r"(\d+)\s*cuotas?\s*sin\s*inter[eé]s"), " CSI"))
        )
    if profile == "shell":
        return or_blank(label(first_grab(text, PERCENT_SHELL), "%"))
    if profile == "puma":
        return F.coalesce(label(first_grab(text, PERCENT_PUMA), "%"), base_discount(text))
    if profile == "cencosud":
        return or_blank(F.coalesce(label(grab(text, PERCENT), "%"), extract_instalments(text, "cencosud")))
    if profile == "coto":
        return or_blank(F.coalesce(label(first_grab(text, PERCENT_COTO), "%"), extract_instalments(text)))
    if profile == "masonline":
        refund = grab(text, REFUND_MASONLINE)
        return or_blank(
            F.coalesce(
                bind(refund, lambda x: F.when(x.try_cast("int") > 0, label(x, "% reintegro"))),
                percent_above_zero(text, PERCENT_MASONLINE),
                extract_instalments(text, "masonline"),
            )
        )
    raise ValueError(f"unknown discount profile {profile}")


def discount_kind(label_text: Column) -> Column:
    d = F.lower(or_blank(label_text))
    return (
        F.when(d.contains("cuota") | d.contains("csi"), "cuotas")
        .when(d.contains("cashback") | d.contains("reintegro"), "cashback")
        .when(d.contains("%"), "percent")
        .when(d.contains("x2") | d.contains("x3") | d.contains("2x1") | d.contains("3x2"), "bundle")
        .otherwise("other")
    )


def discount_short_label(label_text: Column) -> Column:
    """'6 cuotas…' becomes '6 CSI'; percentages and other labels stay."""
    d = or_blank(label_text)
    n = grab(d, r"^(\d+)\s*cuotas?")
    return F.when(d.endswith("%"), d).otherwise(F.coalesce(label(n, " CSI"), d))


def discount_value(label_text: Column) -> Column:
    return parse_ar_amount(F.regexp_extract(or_blank(label_text), r"(\d[\d.,]*)", 1)).cast("decimal(9,2)")


# --- cap, minimum, rates, delay --------------------------------------------------------------------


def _amount_and_period(packed: Column) -> tuple[Column, Column]:
    parts = shape_parts(packed)
    return F.get(parts, F.lit(0)), blank_to_null(F.lower(F.get(parts, F.lit(1))))


def _masonline_cap(text: Column) -> Column:
    packed = F.coalesce(
        *[positive_amount(shape(text, p, "$1~$2" if i == 0 else "$1~")) for i, p in enumerate(CAP_MASONLINE)]
    )

    def shown(x: Column) -> Column:
        raw, period = _amount_and_period(x)
        return F.concat(format_ar_amount(parse_ar_amount(raw)), F.coalesce(F.concat(F.lit(" "), period), F.lit("")))

    cap = F.coalesce(bind(packed, shown), F.when(found(text, NO_CAP), F.lit("Sin tope")))
    each = F.lower(grab(text, CAP_FREQUENCY))

    def with_frequency(x: Column) -> Column:
        name, often = x["cap"], x["each"]
        suffix = (
            F.when(often == "mes", " mensual")
            .when(often == "semana", " semanal")
            .when(often.isin("día", "dia"), " diario")
            .otherwise(F.concat(F.lit(" por "), often))
        )
        named = F.lower(name).rlike("usuario|mensual|semanal|diario|transacci")
        return F.when(named | often.isNull(), name).otherwise(F.concat(name, suffix))

    return or_blank(bind(F.struct(cap.alias("cap"), each.alias("each")), with_frequency))


def _coto_cap(text: Column) -> Column:
    packed = first_shape(text, [(p, "$1~$2") for p in CAP_COTO])
    per_client = F.upper(text).contains("POR CLIENTE")

    def shown(x: Column) -> Column:
        raw, period = _amount_and_period(x["packed"])
        label_text = F.concat(
            format_ar_amount(parse_ar_amount(raw)), F.coalesce(F.concat(F.lit(" "), period), F.lit(""))
        )
        each_client = x["per_client"] & ~F.coalesce(period, F.lit("")).contains("por cliente")
        return F.coalesce(
            F.when(each_client, label(label_text, " por cliente")).otherwise(label_text), F.concat(F.lit("$"), raw)
        )

    return or_blank(bind(F.struct(packed.alias("packed"), per_client.alias("per_client")), shown))


def extract_cap(text: Column, profile: str = "terms") -> Column:
    """Refund cap label by source profile; '' when none is stated."""
    unlimited = F.when(found(text, NO_CAP), F.lit("Sin tope"))
    if profile == "terms":
        none = F.when(found(text, r"SIN\s+TOPE", False), F.lit("SIN TOPE"))
        return or_blank(F.coalesce(none, money_label(first_grab(text, CAP_TERMS, ci=False))))
    if profile == "title":
        upper = F.upper(or_blank(text))
        none = F.when(found(upper, r"SIN\s+TOPE", False), F.lit("SIN TOPE"))
        return or_blank(F.coalesce(none, money_label(first_grab(upper, CAP_TITLE, ci=False))))
    if profile == "card":
        return or_blank(F.coalesce(unlimited, positive_money(text, CAP_CARD)))
    if profile == "wallet":
        return or_blank(money_label(grab(text, CAP_WALLET[0]), keep_raw=False))
    if profile == "dia":
        none = F.when(found(text, r"[Ss]in\s+[Tt]ope", False), F.lit("Sin tope"))
        return or_blank(F.coalesce(none, F.concat(F.lit("$"), grab(text, CAP_DIA[0]))))
    if profile == "shell":
        none = F.when(found(text, r"[Ss]in\s+[Tt]ope", False), F.lit("Sin tope"))
        raw = F.regexp_replace(grab(text, CAP_SHELL[0]), r"\.+$", "")
        return or_blank(F.coalesce(none, F.concat(F.lit("$"), raw)))
    if profile == "puma":
        return or_blank(F.concat(F.lit("$"), grab(text, CAP_PUMA[0])))
    if profile == "cencosud":
        return or_blank(money_label(first_grab(text, CAP_CENCOSUD)))
    if profile == "masonline":
        return _masonline_cap(text)
    if profile == "coto":
        return _coto_cap(text)
    if profile == "detail":
        raw = F.concat(F.lit("$"), grab(text, r"\$\s*([\d.,]+)"))
        said = F.when(~F.lower(text).contains("sin tope"), blank_to_null(clean_text(text)))
        return or_blank(F.coalesce(raw, said))
    raise ValueError(f"unknown cap profile {profile}")


def extract_min_purchase(text: Column, profile: str = "coto") -> Column:
    if profile == "card":
        return or_blank(positive_money(text, MINIMUM_CARD))
    if profile == "puma":
        return or_blank(F.concat(F.lit("$"), first_grab(text, MINIMUM_PUMA)))
    if profile == "masonline":
        none = F.when(found(text, NO_MINIMUM), F.lit("Sin mínimo"))
        return or_blank(F.coalesce(money_label(first_grab(text, MINIMUM_MASONLINE)), none))
    if profile == "coto":
        return or_blank(money_label(first_grab(text, MINIMUM_COTO)))
    raise ValueError(f"unknown minimum profile {profile}")


def extract_rates(text: Column, profile: str = "cencosud") -> dict[str, Column]:
    patterns, ci = (RATES_CENCOSUD, True) if profile == "cencosud" else (RATES_MASONLINE, False)
    return {name: or_blank(label(grab(text, p, 1, ci), "%")) for name, p in patterns.items()}


def extract_credit_delay(text: Column) -> Column:
    packed = first_shape(text, [(p, "$1~$0") for p in CREDIT_DELAY])

    def shown(x: Column) -> Column:
        kind = F.when(found(x, r"h[aá]biles?"), " días hábiles").otherwise(" días")
        return F.concat(F.substring_index(x, "~", 1), kind, F.lit(" posteriores a la compra"))

    return or_blank(bind(packed, shown))
