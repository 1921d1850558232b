"""Text helpers as column expressions: cleaning, folding, regex shorthands, HTML to text, small projections."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

Pattern = str | tuple[str, int]

# Unicode classes and Unix line ends give the usual meaning of \w, \s, \b, '.' and '$' for Spanish text.
IGNORE_CASE = "(?iUd)"
EXACT_CASE = "(?Ud)"
MARK, CLOSE = "\u0001", "\u0002"


def rx(pattern: str, ci: bool = True) -> str:
    return (IGNORE_CASE if ci else EXACT_CASE) + pattern


def found(text: Column, pattern: str, ci: bool = True) -> Column:
    return F.coalesce(text, F.lit("")).rlike(rx(pattern, ci))


def words(*items: str | None) -> Column:
    """Constant array of texts, as one SQL expression (cheap to build)."""
    return F.expr("array(" + ", ".join("cast(null as string)" if w is None else f"'{w}'" for w in items) + ")")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` evaluated once, however often `use` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def not_blank(value: Column) -> Column:
    """NULL for '', for costly expressions (see `blank_to_null` for plain columns)."""
    return bind(value, lambda x: F.when(x != "", x))


def grab(text: Column, pattern: str, group: int = 1, ci: bool = True) -> Column:
    """The group of the first match; NULL when nothing (or an empty group) matched."""
    return not_blank(F.regexp_extract(text, rx(pattern, ci), group))


def shape(text: Column, pattern: str, template: str, ci: bool = True) -> Column:
    """The first match rewritten by a template of its groups ('$1~$2'); NULL when nothing matched.

    One scan finds the match; the template is then applied to the short matched text only.
    """
    p = rx(pattern, ci)
    return not_blank(F.regexp_replace(F.regexp_extract(text, p, 0), p, template))


def first_shape(text: Column, shapes: Iterable[tuple[str, str]], ci: bool = True) -> Column:
    return F.coalesce(*[shape(text, pattern, template, ci) for pattern, template in shapes])


def shape_parts(shaped: Column) -> Column:
    return F.split(shaped, "~", -1)


def grab_all(text: Column, pattern: str, group: int = 1, ci: bool = True) -> Column:
    return F.coalesce(
        F.regexp_extract_all(text, F.lit(rx(pattern, ci)), F.lit(group)), F.array().cast("array<string>")
    )


def first_grab(text: Column, patterns: Iterable[Pattern], ci: bool = True) -> Column:
    """Ordered patterns, first one that yields a value wins. A pattern may carry its group number."""
    picks = []
    for item in patterns:
        pattern, group = item if isinstance(item, tuple) else (item, 1)
        picks.append(grab(text, pattern, group, ci))
    return F.coalesce(*picks)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


# White space characters trimmed at the ends of a text.
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2002\u2003\u2009\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rx(r"\s+"), " "))


def clean_text(c: Column) -> Column:
    """Collapse white space, trim, NULL becomes ''."""
    return squeeze(or_blank(c))


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    # Rule: every BMP character that decomposes to one base character plus combining marks.
    source, target = [], []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        base = [c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and base[0] != char:
            source.append(char)
            target.append(base[0])
    return "".join(source), "".join(target)


def fold_accents(c: Column) -> Column:
    """Drop diacritics (ñ becomes n). Pure ASCII text skips the translation."""
    source, target = _fold_table()
    folded = F.regexp_replace(F.translate(c, source, target), r"\p{Mn}+", "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c)


def norm(c: Column) -> Column:
    """Comparison form: lower case without accents, NULL stays NULL."""
    return fold_accents(F.lower(c))


def spaced_name(c: Column) -> Column:
    """Image or file name prepared for word matching: folded, '_' and '-' become spaces, upper case."""
    return F.upper(F.regexp_replace(fold_accents(or_blank(c)), "[_-]", " "))


def html_to_text(html: Column) -> Column:
    """Visible text: script, style, template and noscript go with their content, other tags become spaces."""
    out = or_blank(html)
    for tag in ("script", "style", "template", "noscript"):
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return squeeze(F.regexp_replace(out, r"<[^>]+>", " "))


def is_json(text: Column) -> Column:
    """One JSON value and nothing after it (the parser alone accepts trailing text)."""
    boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return bind(boxed, lambda v: v.isNotNull() & F.try_variant_get(v, "$[1]", "variant").isNull())


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Literal substring test; `text` must already be in the form of the words."""
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return F.coalesce(out, F.lit(False))


def split_csv(c: Column, also_y: bool = False) -> Column:
    """Trimmed, non-empty items; `also_y` lets ' y ' separate items as well."""
    text = F.regexp_replace(or_blank(c), " y ", ",") if also_y else or_blank(c)
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def absolutize(url: Column, base: str) -> Column:
    return F.when(blank_to_null(url).isNull(), F.lit("")).when(url.startswith("http"), url).otherwise(
        F.concat(F.lit(base), url)
    )


def first_link(html: Column) -> Column:
    return grab(html, r"<a\s[^>]*href=[\"']([^\"']+)[\"']")


def path_category(href: Column) -> Column:
    """`/beneficios/<slug>/…` gives the slug in title case."""
    return or_blank(F.initcap(F.translate(F.regexp_extract(href, r"^/beneficios/([^/]+)", 1), "-", " ")))


def prefix(c: Column, size: int) -> Column:
    return F.substring(c, 1, size)


def ellipsis(c: Column, size: int, mark: str = "...", absent: str | None = "N/A") -> Column:
    """Shorten to `size` characters including the mark; absent text gets a fixed label."""
    cut = F.concat(F.substring(c, 1, size - len(mark)), F.lit(mark))
    short = F.when(F.length(c) <= size, c).otherwise(cut)
    return F.when(blank_to_null(c).isNull(), F.lit(absent)).otherwise(short)


def clip_method(c: Column, size: int = 40) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("…"))).otherwise(c)


def undouble_title(title: Column, discount: Column) -> Column:
    """A title repeated around its discount label keeps one copy."""
    parts = F.split(title, F.concat(F.lit(r"\Q"), discount, F.lit(r"\E")), -1)
    doubled = (F.coalesce(discount, F.lit("")) != "") & (F.size(parts) > 2)
    return squeeze(F.when(doubled, F.concat(discount, F.element_at(parts, -1))).otherwise(title))


def strip_benefit_label(full: Column, label: Column) -> Column:
    """Merchant text left when the benefit label, outer spaces and bars are removed."""
    bare = F.trim(F.replace(full, label, F.lit("")))
    return F.trim(F.regexp_replace(F.when(or_blank(label) == "", F.trim(full)).otherwise(bare), r"^\|+|\|+$", ""))


def drop_links(html: Column) -> Column:
    """Fragment text without the text of its links."""
    return html_to_text(F.regexp_replace(html, r"(?is)<a\b[^>]*>.*?</a>", " "))


def match_spans(text: Column, pattern: str, ci: bool = True) -> Column:
    """All matches as array<struct<start,stop,hit>>; offsets are 0-based characters of the whole text.

    The pattern runs once over a text: pieces are bound, and offsets are running sums over them.
    """
    marks = F.contains(text, F.lit(MARK)) | F.contains(text, F.lit(CLOSE))
    clear = F.when(marks, F.translate(text, MARK + CLOSE, "  ")).otherwise(text)
    marked = F.regexp_replace(clear, "(" + rx(pattern, ci) + ")", f"{MARK}$1{CLOSE}")
    empty = F.array().cast("array<struct<start:int,stop:int,hit:string>>")

    def step(acc: Column, piece: Column) -> Column:
        hit = F.substring_index(piece, CLOSE, 1)
        start = acc["at"]
        span = F.struct(
            start.alias("start"), (start + F.length(hit)).alias("stop"), hit.alias("hit")
        )
        return F.struct(
            (start + F.length(piece) - 1).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans")
        )

    def spans(pieces: Column) -> Column:
        tails = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
        init = F.struct(F.length(F.element_at(pieces, 1)).alias("at"), empty.alias("spans"))
        return F.aggregate(tails, init, step, lambda acc: acc["spans"])

    return bind(F.split(marked, MARK, -1), spans)


def title_from_text(text: Column, discount: Column) -> Column:
    """A describing sentence around the discount, in order of preference, else a fixed label."""
    sentence = first_grab(
        text,
        [
            r"(\d+%\s*de\s*descuento[^.!?\n]{10,200})",
            r"([^.!?\n]{10,100}\d+%\s*de\s*descuento)",
        ],
    )
    return F.coalesce(squeeze(sentence), F.concat(F.lit("Promoción "), or_blank(discount)))


def first_line(text: Column, size: int = 200) -> Column:
    lines = F.filter(F.transform(F.split(or_blank(text), "\n"), strip), lambda x: x != "")
    return F.substring(or_blank(F.get(lines, F.lit(0))), 1, size)


def alt_offers(html: Column) -> Column:
    """Images whose alt text names a discount: array of struct(title, discount, image_url)."""
    pattern = r'<img[^>]+alt="([^"]*(?:descuento|%)[^"]*)"[^>]+src="([^"]+)"'
    alts, sources = grab_all(html, pattern, 1), grab_all(html, pattern, 2)
    return F.transform(
        F.arrays_zip(alts.alias("alt"), sources.alias("src")),
        lambda x: F.struct(
            x["alt"].alias("title"),
            F.regexp_extract(x["alt"], r"(\d+)\s*%", 0).alias("discount"),
            x["src"].alias("image_url"),
        ),
    )


# SQL names for expressions users want in plain SQL. Bodies are SQL expressions over the argument `x`.
SQL_FUNCTIONS = {
    "offer_clean_text": ("x STRING", "STRING", r"trim(regexp_replace(coalesce(x, ''), '(?U)\\s+', ' '))"),
    "offer_amount": (
        "x STRING",
        "DOUBLE",
        r"try_cast(replace(replace(regexp_extract(x, '(\\d[\\d.,]*)', 1), '.', ''), ',', '.') AS DOUBLE)",
    ),
    "offer_discount_kind": (
        "x STRING",
        "STRING",
        "CASE WHEN lower(x) LIKE '%cuota%' OR lower(x) LIKE '%csi%' THEN 'cuotas' "
        "WHEN lower(x) LIKE '%cashback%' OR lower(x) LIKE '%reintegro%' THEN 'cashback' "
        "WHEN contains(x, '%') THEN 'percent' WHEN contains(lower(x), 'x2') OR contains(lower(x), 'x3') "
        "OR contains(lower(x), '2x1') THEN 'bundle' ELSE 'other' END",
    ),
    "offer_weekday": (
        "d DATE",
        "STRING",
        "element_at(array('Lunes','Martes','Miércoles','Jueves','Viernes','Sábado','Domingo'), weekday(d) + 1)",
    ),
}


def register_sql_functions(spark) -> list[str]:
    for name, (args, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(SQL_FUNCTIONS)
