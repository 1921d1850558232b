"""Dates, validity ranges and weekdays as column expressions.

Every default year comes from `as_of`, a date parameter. Impossible dates become NULL.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import (
    bind,
    first_grab,
    first_shape,
    fold_accents,
    found,
    grab,
    grab_all,
    norm,
    not_blank,
    or_blank,
    shape,
    shape_parts,
    squeeze,
    words,
)

# ---------------------------------------------------------------------------------------------
# Month and weekday names, and the patterns of each source profile.

MONTHS = [
    "enero",
    "febrero",
    "marzo",
    "abril",
    "mayo",
    "junio",
    "julio",
    "agosto",
    "septiembre",
    "octubre",
    "noviembre",
    "diciembre",
]
WEEK = ["Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo"]
EVERY_DAY = "Todos los días"
MONTH = "enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|setiembre|octubre|noviembre|diciembre"
DAY = "lunes|martes|mi[eé]rcoles|jueves|viernes|s[aá]bado|domingo"
DAYS = "lunes|martes|mi[eé]rcoles|jueves|viernes|s[aá]bados?|domingos?"
DMY = r"(\d{1,2})[/\-](\d{1,2})[/\-](\d{2,4})"

TERMS_SAME_MONTH = rf"DESDE\s+EL\s+(\d{{1,2}})\s+(?:AL|HASTA\s+EL)\s+(\d{{1,2}})\s+DE\s+({MONTH})\s+DE\s+(\d{{4}})"
TERMS_UNTIL = r"HASTA\s+EL\s+(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})"
TERMS_UNTIL_WORDS = rf"HASTA\s+EL\s+(\d{{1,2}})\s+DE\s+({MONTH})\s+DE\s+(\d{{4}})"
TERMS_WHOLE_MONTH = rf"DE\s+({MONTH})\s+DE\s+(\d{{4}})"

LEGAL_UNTIL = r"hasta\s+(?:el\s+)?(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})"
LEGAL_SAME_MONTH = (
    rf"(?:desde|del)\s+(?:el\s+)?(\d{{1,2}})\s+(?:al|hasta)\s+(?:el\s+)?(\d{{1,2}})\s+(?:de\s+)?({MONTH})(?:\s+de\s+)?(\d{{4}})?"
)
LEGAL_UNTIL_WORDS = rf"hasta\s+(?:el\s+)?(\d{{1,2}})\s+de\s+({MONTH})(?:\s+de\s+)?(\d{{4}})?"
LEGAL_WHOLE_MONTH = rf"de\s+({MONTH})\s+(?:de\s+)?(\d{{4}})"

SIMPLE_RANGE = rf"(?:desde|del)\s+(\d{{1,2}})\s+(?:al|hasta)\s+(\d{{1,2}})\s+(?:de\s+)?({MONTH})(?:\s+de\s+)?(\d{{4}})?"

BASE_UNTIL = r"hasta\s+(\d{1,2})[/-](\d{1,2})(?:[/-](\d{2,4}))?"
BASE_FROM = r"(?:desde|del)\s+(\d{1,2})[/-](\d{1,2})(?:[/-](\d{2,4}))?"

MAS_WORDS = (
    rf"(?:del?\s+)?(\d{{1,2}})\s+de\s+({MONTH})\s+(?:de\s+)?(\d{{4}})\s+(?:al?|hasta)\s+(?:el\s+)?"
    rf"(\d{{1,2}})\s+de\s+({MONTH})\s+(?:de\s+)?(\d{{4}})"
)
MAS_NUMERIC = [
    rf"desde\s+el\s+{DMY}\s+hasta\s+el\s+{DMY}",
    rf"(?:desde\s+(?:el\s+)?)?{DMY}\s*(?:al?|hasta|y\s+el)\s*{DMY}",
    rf"(?:desde\s+(?:el\s+)?)?{DMY}\s*(?:al?|hasta)\s*(?:el\s+)?{DMY}",
    rf"vigencia[:\s]+{DMY}\s*[-–]\s*{DMY}",
]
MAS_MONTH = r"(?:v[aá]lid[oa]?|vigente?)\s+(?:durante|en|para)\s+(?:el\s+mes\s+de\s+)?(\w+)(?:\s+(?:de\s+)?(\d{4}))?"
MAS_DAYS_OF_MONTH = rf"todos\s+los\s+(?:{DAYS})\s+de\s+(\w+)"

COTO_SPECIFIC = (
    rf"({DAY})\s+(\d{{1,2}})(?:\s*,\s*(?:{DAY})\s+\d{{1,2}})*\s*(?:,?\s*Y\s+(?:{DAY})\s+(\d{{1,2}}))?"
    r"\s+DE\s+(\w+)(?:\s+DE\s+(\d{4}))?"
)
COTO_RANGE = (
    r"(\d{1,2})\s+DE\s+(\w+)(?:\s+DE\s+(\d{4}))?\s+HASTA\s+(?:EL\s+)?(\d{1,2})\s+DE\s+(\w+)(?:\s+DE\s+(\d{4}))?"
)
COTO_DAYS_RANGE = rf"(?:LOS\s+)?D[IÍ]AS?\s+({DAY})(?:\s+Y\s+({DAY}))?\s+(?:DESDE\s+)?(?:EL\s+)?{COTO_RANGE}"
COTO_FROM_RANGE = rf"DESDE\s+(?:EL\s+)?{COTO_RANGE}"
COTO_OF_MONTH = rf"V[AÁ]LIDO\s+(?:PARA\s+)?(?:TODOS\s+)?(?:LOS\s+)?({DAY})\s+DE\s+(\w+)\s+(\d{{4}})"
COTO_DAYS = rf"(?:LOS\s+)?D[IÍ]AS?\s+({DAY})(?:\s+Y\s+({DAY}))?"
COTO_DAY_TO_DAY = rf"DE\s+({DAY})\s+A\s+({DAY})"
COTO_SAME_MONTH = (
    r"DESDE\s+(?:EL\s+)?(\d{1,2})\s+HASTA\s+(?:EL\s+)?(\d{1,2})\s+DE\s+(\w+)(?:\s+DE\s+(\d{4}))?"
)

CENCOSUD_RANGE = (
    rf"(?:entre\s+(?:el\s+)?|del\s+|desde\s+(?:el\s+)?){DMY}\s*(?:y\s+(?:el\s+)?|al\s+|hasta\s+(?:el\s+)?){DMY}"
)
CENCOSUD_WORDS = (
    r"(?:del|desde)\s+(\d{1,2})\s+de\s+(\w+)\s+de\s+(\d{4})\s+(?:al|hasta)\s+(\d{1,2})\s+de\s+(\w+)\s+de\s+(\d{4})"
)

SHELL_DATE = r"(\d{1,2})[/\-](\d{1,2})(?:[/\-](\d{2,4}))?"
SHELL_RANGE = rf"del?\s+{SHELL_DATE}\s+al\s+{SHELL_DATE}"
SHELL_FROM = rf"(?:desde|del?\s+el?)\s+{SHELL_DATE}"
SHELL_UNTIL = rf"(?:hasta|al)\s+{SHELL_DATE}"

PAGE_UNTIL = rf"hasta\s+(?:el\s+)?{DMY}"

DAYS_LEGAL = rf"(?:todos\s+los|los)\s+(?:d[ií]as?\s+)?(?:{DAY})(?:\s+(?:y\s+)?(?:{DAY}))?(?:\s+de\s+\w+)?"
DAYS_SIMPLE = rf"(?:todos\s+los|los)\s+(?:{DAY})(?:\s+de\s+\w+)?"
DAYS_PAGE = rf"(?:todos\s+los|los)\s+(?:{DAY})"
DAYS_WALLET = rf"todos\s+los\s+d[ií]as|lunes\s+a\s+viernes|{DAY}"
DAYS_PUMA = [
    r"todos\s+los\s+d[íi]as",
    r"de\s+lunes\s+a\s+viernes",
    rf"todos\s+los\s+(?:{DAYS})",
    r"los\s+(?:lunes|martes|mi[eé]rcoles|jueves|viernes|s[aá]bados?\s+y\s+domingos?)",
    rf"(?:lunes|martes|mi[eé]rcoles|jueves|viernes|s[aá]bados?)\s+y\s+(?:{DAYS})",
]
ALL_WEEK = (
    r"todos\s+los\s+d[ií]as|toda\s+la\s+semana|v[aá]lid[oa]\s+(?:cualquier|todos?\s+los?)\s+d[ií]as?|lunes\s+a\s+domingo"
)
DAY_PAIR = rf"({DAYS})\s+y\s+({DAYS})"
DAY_LIST = rf"(?:{DAYS})(?:\s*,\s*(?:{DAYS}))+(?:\s+y\s+(?:{DAYS}))?"
DAY_RANGE = rf"({DAYS})\s+a\s+({DAYS})"

# End of fixed values.
# ---------------------------------------------------------------------------------------------


def month_number(word: Column) -> Column:
    """1-12 for a Spanish month name in any case, else NULL."""
    name = F.regexp_replace(F.lower(word), "^setiembre$", "septiembre")
    at = F.array_position(words(*MONTHS), name).cast("int")
    return bind(at, lambda n: F.when(n > 0, n))


def _two(part: Column) -> Column:
    return F.lpad(part.cast("string"), 2, "0")


def full_year(y: Column) -> Column:
    return F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(F.lpad(y, 4, "0"))


def iso_text(day: Column, month: Column, year: Column) -> Column:
    """'YYYY-MM-DD' without checking the calendar."""
    return F.concat(full_year(year), F.lit("-"), _two(month), F.lit("-"), _two(day))


def make_day(day: Column, month: Column, year: Column) -> Column:
    return iso_text(day, month, year).try_cast("date")


def _date_of(day: Column, month: Column, year: Column, default_year: str) -> Column:
    """A date from text parts: the month is a number or a name, a missing year is the default one."""
    number = F.coalesce(month.try_cast("int"), month_number(month))
    return make_day(day, number, F.when(year == "", F.lit(default_year)).otherwise(year))


def _read_range(packed: Column, default_year: str) -> Column:
    """struct<valid_from,valid_until> from 'd~m~y~d~m~y'; a last day of 'L' means the end of its month."""

    def read(parts: Column) -> Column:
        part = [F.get(parts, F.lit(i)) for i in range(6)]
        start = _date_of(part[0], part[1], part[2], default_year)
        end = F.when(part[3] == "L", F.last_day(_date_of(F.lit("1"), part[4], part[5], default_year))).otherwise(
            _date_of(part[3], part[4], part[5], default_year)
        )
        return F.struct(start.alias("valid_from"), end.alias("valid_until"))

    return bind(packed, lambda x: F.when(x.isNotNull(), bind(shape_parts(x), read)))


def _named_month(packed: Column, position: int = 1) -> Column:
    """The packed range when the part at `position` is the name of a month, else NULL."""
    return bind(packed, lambda x: F.when(month_number(F.get(shape_parts(x), F.lit(position))).isNotNull(), x))


# --- single dates ---------------------------------------------------------------------------------


def _packed_iso(packed: Column) -> Column:
    """'y~m~d' -> ISO text; NULL when the month is no number and no month name."""

    def read(parts: Column) -> Column:
        y, m, d = [F.get(parts, F.lit(i)) for i in range(3)]
        return iso_text(d, F.coalesce(m.try_cast("int"), month_number(m)), y)

    return bind(packed, lambda x: F.when(x.isNotNull(), bind(shape_parts(x), read)))


def normalize_date_text(value: Column) -> Column:
    """ISO text of the accepted date forms, calendar not checked; '' for anything else."""
    packed = first_shape(
        F.trim(value),
        [
            (r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", "$1~$2~$3"),
            (r"^(\d{1,2})[/\-](\d{1,2})[/\-](\d{2,4})$", "$3~$2~$1"),
            (r"^(\d{1,2})\s+de\s+(\w+)\s+de\s+(\d{4})$", "$3~$2~$1"),
        ],
    )
    return or_blank(_packed_iso(packed))


def normalize_date(value: Column) -> Column:
    return normalize_date_text(value).try_cast("date")


def parse_date_loose(value: Column, as_of: dt.date | None = None) -> Column:
    """ISO passthrough, D/M/Y, and D/M with the year of `as_of` when one is given."""
    iso = F.when((F.length(value) == 10) & (F.substring(value, 5, 1) == "-"), value)
    shapes = [(r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4}).*$", "$3~$2~$1")]
    if as_of is not None:
        shapes.append((r"^(\d{1,2})[/-](\d{1,2}).*$", f"{as_of.year}~$2~$1"))
    return F.coalesce(iso, _packed_iso(first_shape(value, shapes)))


def dotnet_date(value: Column) -> Column:
    """'/Date(ms)/' as a UTC date."""
    ms = grab(value, r"/Date\((\d+)\)/").try_cast("long")
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86400000).cast("int"))


def weekday_es(day: Column) -> Column:
    return F.element_at(words(*WEEK), F.weekday(day) + 1)


def weekday_name(day: dt.date) -> str:
    return WEEK[day.weekday()]


def show_date(day: Column) -> Column:
    """D/M/Y label, 'N/A' when absent."""
    return F.coalesce(F.date_format(day, "dd/MM/yyyy"), F.lit("N/A"))


def show_range(start: Column, end: Column) -> Column:
    a, b = start.cast("string"), end.cast("string")
    return (
        F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit(" → "), b))
        .when(b.isNotNull(), F.concat(F.lit("hasta "), b))
        .when(a.isNotNull(), F.concat(F.lit("desde "), a))
        .otherwise("")
    )


# --- validity ranges ---------------------------------------------------------------------------------


def validity_from_terms(text: Column) -> Column:
    """struct<valid_from,valid_until> of a legal text, ordered patterns, first one wins."""
    packed = first_shape(
        text,
        [
            (TERMS_SAME_MONTH, "$1~$3~$4~$2~$3~$4"),
            (TERMS_UNTIL, "~~~$1~$2~$3"),
            (TERMS_UNTIL_WORDS, "~~~$1~$2~$3"),
            (TERMS_WHOLE_MONTH, "1~$1~$2~L~$1~$2"),
        ],
    )
    return _read_range(packed, "")


def _coto(text: Column) -> Column:
    return F.coalesce(
        shape(text, COTO_DAYS_RANGE, "$3~$4~$5~$6~$7~$8"),
        shape(text, COTO_FROM_RANGE, "$1~$2~$3~$4~$5~$6"),
        bind(
            _named_month(shape(text, COTO_SPECIFIC, "$2~$4~$5~$3~$4~$5")),
            lambda x: F.regexp_replace(x, r"^(\d+)~(.*)~~(.*)$", "$1~$2~$1~$3"),
        ),
        _named_month(shape(text, COTO_SAME_MONTH, "$1~$3~$4~$2~$3~$4")),
    )


def validity_from_text(text: Column, profile: str, as_of: dt.date) -> Column:
    """struct<valid_from,valid_until> by source profile."""
    if profile == "base":
        start = F.coalesce(shape(text, BASE_FROM, "$1~$2~$3"), F.lit("~~"))
        packed = F.concat_ws("~", start, F.coalesce(shape(text, BASE_UNTIL, "$1~$2~$3"), F.lit("~~")))
    elif profile == "legal":
        packed = first_shape(
            text,
            [
                (LEGAL_UNTIL, "~~~$1~$2~$3"),
                (LEGAL_SAME_MONTH, "$1~$3~$4~$2~$3~$4"),
                (LEGAL_UNTIL_WORDS, "~~~$1~$2~$3"),
                (LEGAL_WHOLE_MONTH, "1~$1~$2~L~$1~$2"),
            ],
        )
    elif profile == "simple":
        packed = shape(text, SIMPLE_RANGE, "$1~$3~$4~$2~$3~$4")
    elif profile == "masonline":
        packed = F.coalesce(
            shape(text, MAS_WORDS, "$1~$2~$3~$4~$5~$6"),
            *[shape(text, p, "$1~$2~$3~$4~$5~$6") for p in MAS_NUMERIC],
            _named_month(shape(text, MAS_DAYS_OF_MONTH, "1~$1~~L~$1~")),
            _named_month(shape(text, MAS_MONTH, "1~$1~$2~L~$1~$2")),
        )
    elif profile == "coto":
        packed = _coto(text)
    elif profile == "cencosud":
        packed = first_shape(text, [(p, "$1~$2~$3~$4~$5~$6") for p in (CENCOSUD_RANGE, CENCOSUD_WORDS)])
    elif profile == "shell":
        start = F.coalesce(shape(text, SHELL_FROM, "$1~$2~$3"), F.lit("~~"))
        ends = F.concat_ws("~", start, F.coalesce(shape(text, SHELL_UNTIL, "$1~$2~$3"), F.lit("~~")))
        packed = F.coalesce(shape(text, SHELL_RANGE, "$1~$2~$3~$4~$5~$6"), ends)
    elif profile == "page":
        packed = shape(text, PAGE_UNTIL, "~~~$1~$2~$3")
    else:
        raise ValueError(f"unknown validity profile {profile}")
    return _read_range(packed, str(as_of.year))


# --- weekdays ---------------------------------------------------------------------------------------


def canonical_day(word: Column) -> Column:
    """'sabados' -> 'Sábado'; NULL for a word that is no weekday."""
    short = words("lun", "mar", "mie", "jue", "vie", "sab", "dom")
    # Positions start at 1; 0 (not found) reads the NULL put in front.
    week = words(None, *WEEK)
    return F.get(week, F.array_position(short, F.substring(norm(word), 1, 3)).cast("int"))


def day_index(word: Column) -> Column:
    return F.array_position(words(*WEEK), word).cast("int")


def week_order(days: Column) -> Column:
    """Sort day names Monday to Sunday; unknown names go last."""
    keyed = F.transform(
        days, lambda d: F.struct(F.when(day_index(d) > 0, day_index(d)).otherwise(99).alias("at"), d.alias("day"))
    )
    return F.transform(F.array_sort(keyed), lambda x: x["day"])


def named_days(text: Column, pattern: str = DAYS) -> Column:
    return F.array_distinct(F.transform(grab_all(text, f"({pattern})"), canonical_day))


def _day_parts(packed: Column) -> Column:
    return F.transform(shape_parts(packed), canonical_day)


def _masonline_days(text: Column, default_day: Column) -> Column:
    none = F.array().cast("array<string>")
    pair = F.coalesce(bind(shape(text, DAY_PAIR, "$1~$2"), _day_parts), none)
    listed = F.coalesce(bind(grab(text, DAY_LIST, 0), lambda x: named_days(x)), none)

    def span(packed: Column) -> Column:
        ends = F.transform(_day_parts(packed), day_index)
        start, stop = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
        return F.filter(words(*WEEK), lambda d: day_index(d).between(start, stop))

    spanned = F.coalesce(bind(shape(text, DAY_RANGE, "$1~$2"), span), none)

    def shown(days: Column) -> Column:
        return (
            F.when(F.size(days) == 7, F.lit(EVERY_DAY))
            .when(F.size(days) > 0, F.array_join(days, ", "))
        )

    days = week_order(F.array_distinct(F.array_compact(F.concat(pair, listed, spanned))))
    return F.when(found(text, ALL_WEEK), F.lit(EVERY_DAY)).otherwise(F.coalesce(bind(days, shown), default_day))


def _coto_days(text: Column) -> Column:
    packed = first_shape(
        text,
        [
            (COTO_DAYS_RANGE, "$1~$2"),
            (COTO_FROM_RANGE, "~"),
            (COTO_OF_MONTH, "$1~"),
            (COTO_DAYS, "$1~$2"),
            (COTO_DAY_TO_DAY, "$1~$2"),
        ],
    )
    named = bind(
        packed, lambda x: F.array_join(F.filter(F.transform(shape_parts(x), lambda d: F.initcap(d)), lambda d: d != ""), " y ")
    )
    mentions = bind(
        grab(text, COTO_SPECIFIC, 0),
        lambda x: F.array_join(F.array_distinct(F.transform(grab_all(x, f"({DAY})"), lambda d: F.initcap(d))), ", "),
    )
    return or_blank(F.coalesce(not_blank(named), mentions))


def extract_valid_days(text: Column, profile: str = "terms", default_day: Column | None = None) -> Column:
    """Valid weekdays by source profile: an array for 'terms', display text for the others."""
    if profile == "terms":
        every = found(text, r"TODOS\s+LOS\s+D[ÍI]AS", False)
        return F.when(every, F.array(F.lit(EVERY_DAY))).otherwise(named_days(text, DAY))
    if profile == "masonline":
        return _masonline_days(text, default_day if default_day is not None else F.lit(""))
    if profile == "coto":
        return _coto_days(text)
    if profile == "dia":

        def few(days: Column) -> Column:
            return F.when(F.size(days).between(1, 5), F.array_join(days, ", ")).otherwise("")

        named = bind(
            norm(or_blank(text)),
            lambda t: F.filter(words(*WEEK), lambda d: t.contains(fold_accents(F.lower(d)))),
        )
        return bind(named, few)
    if profile == "puma":
        return or_blank(squeeze(first_grab(text, [(p, 0) for p in DAYS_PUMA])))
    if profile == "legal":
        return or_blank(squeeze(grab(text, DAYS_LEGAL, 0)))
    if profile == "simple":
        return or_blank(squeeze(grab(text, DAYS_SIMPLE, 0)))
    if profile == "page":
        return or_blank(grab(text, DAYS_PAGE, 0))
    if profile == "wallet":
        first = bind(
            F.lower(grab(text, DAYS_WALLET, 0)), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 100))
        )
        return F.coalesce(first, F.lit(EVERY_DAY))
    raise ValueError(f"unknown day profile {profile}")


def fill_tab_day(days: Column, tab_day: Column) -> Column:
    """Days of the tab the card was seen under, when the card itself names none."""
    return F.when(or_blank(days) == "", F.initcap(tab_day)).otherwise(days)


def day_badges(days: Column) -> Column:
    """Short labels of the weekdays a text names."""
    short = words("Lun", "Mar", "Mié", "Jue", "Vie", "Sáb", "Dom")
    return F.transform(named_days(days), lambda d: F.element_at(short, F.greatest(day_index(d), F.lit(1))))
