"""Jobs over pages and long texts: legal spans, match contexts, page profiles, nested HTML blocks."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from html.parser import HTMLParser
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import grab_all, html_to_text, match_spans, or_blank, rx, strip
from ..functions.terms import capital_blocks

# ---------------------------------------------------------------------------------------------
# Fixed values.

LEGAL_OPENERS = (
    r"\*?\s*(?:DESCUENTO\s+EXCLUSIVO|BENEFICIO\s+V[AÁ]LID|PROMOCI[OÓ]N\s+V[AÁ]LIDA|FINANCIACI[OÓ]N\s+EXCLUSIV)"
)
CARD_MARKERS = r"(?:Ver\s+legal|Comprando\s+en|Todos\s+los\s+\w)"
OFFER_OPENER = r"\d+%\s+DE\s+DESCUENTO\s*-\s*[A-ZÁÉÍÓÚÑ\s]+"
BADGE = r"(?:(?:hasta\s+)?\d+\s*cuotas?\s*sin\s*inter[eé]s|\d+\s*%)"
DISCOUNT_MENTION = r"\d+\s*%\s*(?:de\s*)?descuento"
PROFILE_WORDS = ["descuento", "cuenta dni", "banco", "tarjeta", "mercado pago", "miércoles", "promoción"]
OFFER_CLASSES = ["promo", "promocion", "descuento", "banco", "tarjeta", "card", "item", "offer", "deal", "discount"]
API_LINKS = [
    r"https?://[^\"'\s<>]+/api/[^\"'\s<>]+",
    r"https?://[^\"'\s<>]+graphql[^\"'\s<>]*",
    r"[\"'](/api/[^\"'\s<>]+)",
]

# End of fixed values.
# ---------------------------------------------------------------------------------------------


def _cut(text: Column, start: Column, stop: Column) -> Column:
    """Python-like slice [start, stop) of a text."""
    return F.substring(text, start + 1, F.greatest(stop - start, F.lit(0)))


def _spans(df: DataFrame, text: Column, pattern: str, keep: list[str], ci: bool = True) -> DataFrame:
    """One row per match with its neighbours: pos, start, stop, hit, prev_start, prev_stop, next_start."""
    marked = df.select(*keep, text.alias("_text")).withColumn("_spans", match_spans(F.col("_text"), pattern, ci))
    at = F.col("_spans")
    # A plain explode would have the plan find all spans twice: once more to drop texts without any beforehand.
    rows = marked.select("*", F.posexplode_outer("_spans").alias("pos", "span")).filter(F.col("pos").isNotNull())
    return rows.select(
        *keep,
        "_text",
        "pos",
        F.col("span.start").alias("start"),
        F.col("span.stop").alias("stop"),
        F.col("span.hit").alias("hit"),
        F.get(at, F.col("pos") - 1)["start"].alias("prev_start"),
        F.get(at, F.col("pos") - 1)["stop"].alias("prev_stop"),
        F.get(at, F.col("pos") + 1)["start"].alias("next_start"),
    )


def legal_spans(pages: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """Legal blocks of a page with the card text before each: keep, pos, card_text, legal_text.

    A block runs from its opener to the next one, or to the end of the page, and ends at the next card marker
    after 150 characters, if there is one. Card text is what lies between the legal end of the previous block
    and the opener.
    """
    rows = _spans(pages, text, LEGAL_OPENERS, keep)
    t = F.col("_text")

    def block(start: Column, after: Column) -> Column:
        return _cut(t, start, F.coalesce(after, F.length(t)))

    def legal(b: Column) -> tuple[Column, Column]:
        """Legal text of a block, and how far from its start the next card text may begin."""
        hit = F.regexp_instr(F.substring(b, F.lit(151), F.length(b)), F.lit(rx(CARD_MARKERS, ci=False)))
        return (
            F.when(hit > 0, strip(F.substring(b, F.lit(1), hit + 149))).otherwise(strip(b)),
            F.when(hit > 0, hit + 149).otherwise(F.length(b)),
        )

    own, _ = legal(block(F.col("start"), F.col("next_start")))
    _, reach = legal(block(F.col("prev_start"), F.col("start")))
    card_start = F.coalesce(F.col("prev_start") + reach, F.lit(0))
    return rows.select(
        *keep, "pos", strip(_cut(t, card_start, F.col("start"))).alias("card_text"), own.alias("legal_text")
    )


def offer_sections(pages: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """Text from one 'N% DE DESCUENTO - …' heading to the next or the end, longer than 100."""
    rows = _spans(pages, text, OFFER_OPENER, keep, ci=False)
    t = F.col("_text")
    stop = F.coalesce(F.col("next_start"), F.length(t))
    return rows.select(*keep, "pos", _cut(t, F.col("start"), stop).alias("text")).filter(F.length("text") > 100)


def match_contexts(
    docs: DataFrame, text: Column, keep: list[str], pattern: str = BADGE, before: int = 300, after: int = 600
) -> DataFrame:
    """Fixed window around every match: keep, pos, start, hit, context."""
    rows = _spans(docs, text, pattern, keep)
    t = F.col("_text")
    context = _cut(t, F.greatest(F.col("start") - before, F.lit(0)), F.least(F.col("stop") + after, F.length(t)))
    return rows.select(*keep, "pos", "start", "hit", context.alias("context"))


def badge_cards(docs: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """Card text around every badge: from half way to the previous badge to the start of the next one."""
    rows = _spans(docs, text, BADGE, keep)
    t = F.col("_text")
    middle = F.floor((F.col("prev_stop") + F.col("start")) / 2)
    start = F.coalesce(middle, F.lit(0)).cast("int")
    stop = F.coalesce(F.col("next_start"), F.length(t))
    return rows.select(*keep, "pos", "hit", _cut(t, start, stop).alias("card_text"))


def page_profile(pages: DataFrame, html: str = "html", id_col: str = "page_id") -> DataFrame:
    """Per page: keyword, percent, tag and attribute counts, offer classes, capital blocks, API links."""
    raw, lower = or_blank(F.col(html)), F.lower(or_blank(F.col(html)))
    text = html_to_text(F.col(html))
    classes = F.flatten(F.transform(grab_all(raw, r"<[^>]+\sclass=\"([^\"]*)\""), lambda c: F.split(F.trim(c), r"\s+")))
    offer_class = F.filter(
        F.array_distinct(classes),
        lambda c: reduce(lambda a, b: a | b, [F.lower(c).contains(w) for w in OFFER_CLASSES]),
    )

    def tags(name: str) -> Column:
        return F.regexp_count(raw, F.lit(rf"(?i)<{name}[\s>]"))

    words = [
        F.regexp_count(lower, F.lit(word)).alias("n_" + word.replace(" ", "_").replace("é", "e").replace("ó", "o"))
        for word in PROFILE_WORDS
    ]
    return pages.select(
        id_col,
        F.length(raw).alias("n_html"),
        F.length(text).alias("n_text"),
        *words,
        F.regexp_count(raw, F.lit(r"\d+\s*%")).alias("n_percent"),
        *[tags(name).alias(f"n_{name}") for name in ("script", "img", "div", "section", "article", "p", "a")],
        F.regexp_count(raw, F.lit(r"(?i)\sdata-testid=")).alias("n_testid"),
        F.regexp_count(lower, F.lit(r"ver\s+legal")).alias("n_legal_buttons"),
        F.array_join(F.array_sort(offer_class), " ").alias("offer_classes"),
        F.size(F.array_distinct(classes)).alias("n_classes"),
        F.size(capital_blocks(text, 100)).alias("n_capital_blocks"),
        F.size(F.array_distinct(F.concat(*[grab_all(raw, f"({p})" if "(" not in p else p) for p in API_LINKS]))).alias("n_api_links"),
    )


def class_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """How many elements carry each class, over all pages."""
    classes = F.explode(
        F.flatten(F.transform(grab_all(or_blank(F.col(html)), r"<[^>]+\sclass=\"([^\"]*)\""), lambda c: F.split(F.trim(c), r"\s+")))
    )
    return pages.select(classes.alias("class_name")).groupBy("class_name").agg(F.count("*").alias("elements"))


def list_items(pages: DataFrame, html: str = "html", id_col: str = "page_id") -> DataFrame:
    """Items of the flat lists of a page: page_id, list_pos, item_pos, text."""
    lists = grab_all(F.col(html), r"(?s)<(?:ol|ul)\b[^>]*>(.*?)</(?:ol|ul)>")
    rows = pages.select(F.col(id_col).alias("page_id"), F.posexplode(lists).alias("list_pos", "body"))
    items = grab_all(F.col("body"), r"(?s)<li\b[^>]*>(.*?)(?=<li\b|</li>|$)")
    return rows.select("page_id", "list_pos", F.posexplode(items).alias("item_pos", "raw")).select(
        "page_id", "list_pos", "item_pos", html_to_text(F.col("raw")).alias("text")
    )


# --- nested HTML ---------------------------------------------------------------------------------------

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "svg", "template", "noscript"}


@dataclass(frozen=True)
class Field:
    """A value of a block: the text or an attribute of the elements that match."""

    name: str
    tags: tuple[str, ...] = ()
    class_pattern: str = ""
    attribute: str = ""
    every: bool = False
    own: bool = False


@dataclass(frozen=True)
class BlockRule:
    """Which elements are blocks: by tag, class and attribute patterns, text length and text pattern.

    `climb` widens a hit to the highest ancestor (that many levels at most) whose text stays below
    `max_chars`. Blocks nested in another block of the rule are dropped when `outermost` is set.
    """

    tags: tuple[str, ...] = ()
    class_pattern: str = ""
    attribute: tuple[str, str] | None = None
    text_pattern: str = ""
    min_chars: int = 0
    max_chars: int | None = None
    climb: int = 0
    outermost: bool = False
    fields: tuple[Field, ...] = field(default_factory=tuple)


class _Numbered(HTMLParser):
    """A page as numbered elements, in document order: what an element holds are the numbers up to its `leave`.

    The visible text is kept once; an element's text is the slice between its first and its last piece.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.attrs, self.parent, self.leave = [], [], [], []
        self.first, self.last = [], []  # pieces of text before and up to the end of an element
        self.starts, self.ends, self.pieces, self.size = [], [], [], 0
        self.open: list[int] = []
        self.places: dict[str, list[int]] = {}
        self.silent = 0

    def read(self, html: str) -> _Numbered:
        self.feed(html)
        self.close()
        self._cut(0)
        self.text = " ".join(self.pieces)
        return self

    def handle_starttag(self, tag, attrs):
        self._add(tag, attrs)
        if tag in VOID:
            self.leave[-1], self.last[-1] = len(self.tags), len(self.pieces)
            return
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(len(self.tags) - 1)
        self.silent += tag in SILENT

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs)

    def handle_endtag(self, tag):
        if self.places.get(tag):
            self._cut(self.places[tag][-1])

    def handle_data(self, data):
        piece = re.sub(r"\s+", " ", data).strip()
        if piece and not self.silent:
            self.starts.append(self.size)
            self.size += len(piece) + 1
            self.ends.append(self.size - 1)
            self.pieces.append(piece)

    def _add(self, tag, attrs) -> None:
        self.tags.append(tag)
        self.attrs.append(dict(attrs))
        self.parent.append(self.open[-1] if self.open else -1)
        self.leave.append(len(self.tags))
        self.first.append(len(self.pieces))
        self.last.append(len(self.pieces))

    def _cut(self, place: int) -> None:
        for node in self.open[place:]:
            self.leave[node], self.last[node] = len(self.tags), len(self.pieces)
            self.places[self.tags[node]].pop()
            self.silent -= self.tags[node] in SILENT
        del self.open[place:]

    def span(self, node: int) -> tuple[int, int]:
        """Where the text of an element starts and stops."""
        first, last = self.first[node], self.last[node]
        return (self.starts[first], self.ends[last - 1]) if last > first else (0, 0)

    def content(self, node: int) -> str:
        start, stop = self.span(node)
        return self.text[start:stop]

    def fits(self, node: int, tags: tuple[str, ...], class_pattern: str) -> bool:
        if tags and self.tags[node] not in tags:
            return False
        return not class_pattern or re.search(class_pattern, self.attrs[node].get("class") or "") is not None


def _chosen(page: _Numbered, rule: BlockRule) -> list[int]:
    """The elements that a rule takes for blocks, in the order they are met."""
    hits = [m.span() for m in re.finditer(rule.text_pattern, page.text, re.I)] if rule.text_pattern else []
    begins = [start for start, _ in hits]

    def holds_text(node: int) -> bool:
        start, stop = page.span(node)
        at = bisect_left(begins, start)
        return at < len(hits) and hits[at][1] <= stop

    def size(node: int) -> int:
        start, stop = page.span(node)
        return stop - start

    chosen: dict[int, None] = {}
    for node in range(len(page.tags)):
        if not page.fits(node, rule.tags, rule.class_pattern):
            continue
        if rule.attribute and not re.search(rule.attribute[1], page.attrs[node].get(rule.attribute[0]) or "\0"):
            continue
        if rule.text_pattern and not holds_text(node):
            continue
        own = node
        for _ in range(rule.climb):
            above = page.parent[own]
            if above < 0 or (rule.max_chars is not None and size(above) >= rule.max_chars):
                break
            own = above
        too_long = rule.max_chars is not None and size(own) > rule.max_chars
        if size(own) < rule.min_chars or too_long or own in chosen:
            continue
        if rule.outermost:
            above = page.parent[own]
            while above >= 0 and above not in chosen:
                above = page.parent[above]
            if above >= 0:
                continue
        chosen[own] = None
    return list(chosen)


def _blocks(html: str, rule: BlockRule) -> Iterator[tuple[int, str, str]]:
    """(block_pos, field, value) of one page."""
    page = _Numbered().read(html or "")
    for pos, block in enumerate(_chosen(page, rule)):
        yield pos, "text", page.content(block)
        for f in rule.fields:
            for node in [block] if f.own else range(block + 1, page.leave[block]):
                if not f.own and not page.fits(node, f.tags, f.class_pattern):
                    continue
                value = page.attrs[node].get(f.attribute) if f.attribute else page.content(node)
                if f.attribute and value is None and f.attribute == "src":
                    value = page.attrs[node].get("data-src")
                if value is None:
                    continue
                yield pos, f.name, value
                if not f.every:
                    break


def select_blocks(pages: DataFrame, rule: BlockRule, html: str = "html", id_col: str = "page_id") -> DataFrame:
    """Nested blocks of the pages: (id, block_pos, seq, field, value), read partition by partition."""
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (page_id, pos, seq, name, value)
                for page_id, body in zip(batch[id_col], batch[html])
                for seq, (pos, name, value) in enumerate(_blocks(body, rule))
            ]
            yield pd.DataFrame(rows, columns=[id_col, "block_pos", "seq", "field", "value"])

    return pages.select(id_col, html).mapInPandas(
        run, f"{id_col} {kind}, block_pos int, seq int, field string, value string"
    )


def block_table(blocks: DataFrame, fields: list[str], id_col: str = "page_id") -> DataFrame:
    """One row per block with its fields as columns; repeated fields are joined by ' | '."""
    grouped = blocks.groupBy(id_col, "block_pos")
    columns = []
    for name in fields:
        items = F.array_sort(F.collect_list(F.when(F.col("field") == name, F.struct("seq", "value"))))
        columns.append(F.array_join(F.transform(items, lambda x: x["value"]), " | ").alias(name))
    return grouped.agg(*columns)


# Block rules of the sources, as data.
BLOCK_RULES = {
    "tab_cards": BlockRule(
        tags=("div",),
        class_pattern=r"bank-promotions.*cardBox",
        fields=(
            Field("days", ("span",), "dateText"),
            Field("icons", ("div",), "logoIcon", "class", every=True),
            Field("percent", ("span",), "ColLeftPercentage"),
            Field("image", ("img",), "bank-promotions.*Image", "src", every=True),
            Field("title", ("span",), "ColRightTittle"),
            Field("detail", ("span",), "ColRightText"),
            Field("footer", ("p",), "", every=True),
        ),
    ),
    "benefit_cards": BlockRule(
        tags=("div",),
        class_pattern=r"special-card-carousel.*card-promo-dark|card-promo-dark.*special-card-carousel",
        fields=(Field("benefit", ("strong",)), Field("title", ("h4",), "titulo-promo"), Field("conditions", ("p",), "parrafo-promo")),
    ),
    "club_cards": BlockRule(
        tags=("a",),
        attribute=("href", r"^/beneficios/"),
        fields=(Field("merchant", ("h4",), "text-16"), Field("percent", ("span",), "text-32"), Field("href", attribute="href", own=True)),
    ),
    "detail_cards": BlockRule(
        tags=("div",),
        class_pattern=r"callModalCDNI.*BEN_filterDiv|BEN_filterDiv.*callModalCDNI",
        fields=(
            Field("element_id", attribute="id", own=True),
            Field("title", ("div",), "tituloBeneficio"),
            Field("days", ("div",), "BEN_CON_dias"),
            Field("percent", ("div",), "BEN_CON_nro"),
            Field("image", ("img",), "logo_recuadro", "src"),
        ),
    ),
    "detail_page": BlockRule(
        tags=("div",),
        class_pattern="light-bg",
        fields=(
            Field("title", ("p",), "heading"),
            Field("details", ("p",), "details"),
            Field("image", ("img",), "img-fluid", "src"),
            Field("terms_url", ("a",), "stations", "href"),
        ),
    ),
    "tab_panel_cards": BlockRule(
        attribute=("data-name", "^PromoSimple$"),
        fields=(Field("title", ("h3",)), Field("image", ("img",), "", "src"), Field("alt", ("img",), "", "alt"), Field("note", ("sup",))),
    ),
    "modal": BlockRule(
        class_pattern=r"vtex__modal|Modal__|modal--|overlay--|overlayMask|modalLayout",
        text_pattern=r"descuento|promo|beneficio|tope|cuota|%|v[aá]lido",
        min_chars=81,
    ),
    "image_cards": BlockRule(
        tags=("div",),
        text_pattern=r"\d+\s*%|\d+\s*cuotas",
        min_chars=31,
        max_chars=3500,
        fields=(Field("image", ("img",), "", "src"), Field("alt", ("img",), "", "alt")),
    ),
    "percent_cards": BlockRule(
        tags=("div", "article", "li", "section"), text_pattern=r"\d+\s*%", min_chars=10, max_chars=500, climb=3
    ),
    "generic_cards": BlockRule(
        tags=("div", "article", "section"),
        class_pattern=r"promo|oferta|banco-promo|tarjeta-promo",
        fields=(
            Field("title", ("h1", "h2", "h3", "h4", "h5")),
            Field("discount", (), r"discount|descuento|porcentaje|off|percentage|rebate"),
            Field("bank", (), r"bank|banco|payment"),
            Field("terms", (), r"terms|terminos|condiciones|legal|disclaimer"),
            Field("image", ("img",), "", "src"),
            Field("link", ("a",), "", "href"),
        ),
    ),
    "articles": BlockRule(
        tags=("article",),
        outermost=True,
        fields=(Field("title", ("h1",)), Field("paragraphs", ("p",), every=True), Field("bold", ("b",))),
    ),
    "menus": BlockRule(tags=("nav",), fields=(Field("links", ("a",), "", "href", every=True),)),
    "ads": BlockRule(tags=("div",), class_pattern=r"\bad\b"),
}
