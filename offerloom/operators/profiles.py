"""Source profiles: what a source's pages look like, as data, and one plan from pages to offers for any of them.

A profile names the block rule of the source's cards, a test that a block has to pass, the expression of each offer column
over the fields of a block, and the key by which repeated cards of a page are dropped. `offers_from_pages` turns it into
a plan: blocks by the page reader, everything after as column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, money, rules, terms
from ..functions.text import absolutize, blank_to_null, first_grab, grab, or_blank, path_category, rx
from ..sources.tables import id_suffix
from . import filters
from .blocks import BLOCK_RULES, BlockRule, Field, block_table, select_blocks
from .dedup import keep_best
from .unify import unify_offer

Read = Callable[[str], Column]


@dataclass(frozen=True)
class SourceProfile:
    """`read(name)` gives a field of the block, `text` its whole text; keys see the offer columns by name."""

    source: str
    rule: BlockRule
    columns: Mapping[str, Callable[[Read], Column]]
    test: Callable[[Read], Column] | None = None
    keep: Callable[[], Column] | None = None
    key: tuple[str, ...] = ()
    fixed: Mapping[str, str] = field(default_factory=dict)


def offers_from_pages(pages: DataFrame, profile: SourceProfile, html: str = "html", id_col: str = "page_id") -> DataFrame:
    """Unified offers of the pages: page id, pos (of the card in its page) and the columns of the offer schema.

    Cards that fail the test go, then those without what the profile asks for; of cards of a page with the same key the
    first stays.
    """
    names = ["text", *(f.name for f in profile.rule.fields)]
    cards = block_table(select_blocks(pages, profile.rule, html, id_col), names, id_col)
    read: Read = lambda name: F.col(name)
    if profile.test is not None:
        cards = cards.filter(profile.test(read))
    values = [make(read).alias(name) for name, make in profile.columns.items()]
    values += [F.lit(text).alias(name) for name, text in profile.fixed.items()]
    rows = cards.select(id_col, F.col("block_pos").alias("pos"), *values)
    if profile.keep is not None:
        rows = rows.filter(profile.keep())
    if profile.key:
        rows = keep_best(rows, {"page": F.col(id_col), **{k: or_blank(F.col(k)) for k in profile.key}}, [F.col("pos")])
    return unify_offer(rows, profile.source)


def _percent(text: Column) -> Column:
    return F.concat(grab(text, r"(\d+)\s*%"), F.lit("%"))


def _entity(text: Column) -> Column:
    return F.coalesce(rules.bank_folded(text), rules.wallet_folded(text))


TEXT_BLOCKS = BlockRule(tags=("div", "p", "section", "article"), min_chars=201, max_chars=9999)
DAY_CARDS = BlockRule(tags=("div",), text_pattern=r"\d+\s*%|cuotas?\s*sin\s*inter|reintegro", min_chars=51, max_chars=1999)
IMAGE_CARDS = BlockRule(
    tags=("div",),
    text_pattern=r"\d+\s*%|\d+\s*cuotas",
    min_chars=31,
    max_chars=3499,
    fields=(Field("images", ("img",), "", "src", every=True), Field("alt", ("img",), "", "alt")),
)
MATERIAL_CARDS = BlockRule(
    tags=("mat-card",), fields=(Field("title", ("mat-card-title", "h2", "h3", "h4")), Field("image", ("img",), "", "src"))
)

PROFILES = {
    "carrefour": SourceProfile(
        "carrefour",
        BLOCK_RULES["tab_cards"],
        {
            "discount": lambda b: _percent(b("percent")),
            "title": lambda b: F.concat_ws(" ", blank_to_null(b("title")), blank_to_null(b("detail"))),
            "valid_days": lambda b: b("days"),
            "store_types": lambda b: F.array_join(terms.store_types_from_icons(b("icons")), ", "),
            "image_url": lambda b: b("image"),
            "bank": lambda b: rules.classify(b("title"), "bank"),
            "legal_text": lambda b: terms.terms_text(F.array(b("footer")), b("text")),
        },
        key=("bank", "discount", "valid_days", "store_types"),
        keep=lambda: filters.required_fields("title_or_discount"),
    ),
    "brubank": SourceProfile(
        "brubank",
        BLOCK_RULES["benefit_cards"],
        {
            "title": lambda b: b("title"),
            "discount": lambda b: F.coalesce(_percent(b("benefit")), b("benefit")),
            "tope": lambda b: money.extract_cap(F.upper(b("conditions")), "terms"),
            "legal_text": lambda b: b("conditions"),
        },
        key=("title", "discount"),
        keep=lambda: filters.required_fields("title_and_discount"),
        fixed={"bank": "Brubank"},
    ),
    "clublanacion": SourceProfile(
        "clublanacion",
        BLOCK_RULES["club_cards"],
        {
            "title": lambda b: b("merchant"),
            "discount": lambda b: b("percent"),
            "url": lambda b: absolutize(b("href"), "https://club.lanacion.com.ar"),
            "categories": lambda b: path_category(b("href")),
        },
        key=("title", "discount"),
        keep=lambda: filters.required_fields("title_and_discount"),
        fixed={"bank": "Club La Nación"},
    ),
    "cuentadni": SourceProfile(
        "cuentadni",
        BLOCK_RULES["detail_cards"],
        {
            "title": lambda b: b("title"),
            "discount": lambda b: _percent(b("percent")),
            "valid_days": lambda b: b("days"),
            "image_url": lambda b: b("image"),
            "detail_id": lambda b: id_suffix(b("element_id")),
        },
        key=("detail_id",),
        keep=lambda: filters.required_fields("title_or_discount"),
        fixed={"wallet": "Cuenta DNI"},
    ),
    "puma": SourceProfile(
        "puma",
        BLOCK_RULES["detail_page"],
        {
            "title": lambda b: b("title"),
            "discount": lambda b: _percent(b("details")),
            "legal_text": lambda b: b("details"),
            "tope": lambda b: money.extract_cap(F.upper(b("details")), "terms"),
            "image_url": lambda b: b("image"),
            "terms_url": lambda b: b("terms_url"),
            "bank": lambda b: _entity(b("details")),
        },
        keep=lambda: filters.required_fields("discount"),
    ),
    "shell": SourceProfile(
        "shell",
        BLOCK_RULES["tab_panel_cards"],
        {
            "title": lambda b: b("title"),
            "discount": lambda b: _percent(b("title")),
            "bank": lambda b: rules.classify(F.concat_ws(" ", b("title"), b("alt")), "shell_bank"),
            "wallet": lambda b: rules.combined_wallet(F.concat_ws(" ", b("title"), b("alt"))),
            "image_url": lambda b: b("image"),
            "footnote_num": lambda b: grab(b("note"), r"\((\d+)\)").try_cast("int"),
        },
        key=("bank", "wallet", "discount", "title"),
        keep=lambda: filters.required_fields("discount"),
    ),
    "coto": SourceProfile(
        "coto",
        TEXT_BLOCKS,
        {
            "bank": lambda b: rules.classify(b("text"), "coto"),
            "discount": lambda b: money.extract_discount(b("text"), "coto"),
            "tope": lambda b: money.extract_cap(b("text"), "coto"),
            "aplica_en": lambda b: terms.extract_branches(b("text")),
            "legal_text": lambda b: b("text"),
            "head": lambda b: F.substring(b("text"), 1, 150),
        },
        test=lambda b: filters.is_offer_block(b("text"), "coto"),
        key=("head",),
        keep=lambda: filters.required_fields("bank"),
    ),
    "masonline": SourceProfile(
        "masonline",
        DAY_CARDS,
        {
            "bank": lambda b: rules.bank_and_wallet(b("text"), F.lit(""))["bank"],
            "billetera_virtual": lambda b: rules.bank_and_wallet(b("text"), F.lit(""))["wallet"],
            "discount": lambda b: money.extract_discount(b("text"), "masonline"),
            "tope": lambda b: money.extract_cap(b("text"), "masonline"),
            "legal_text": lambda b: b("text"),
            "head": lambda b: F.regexp_replace(F.substring(b("text"), 1, 120), rx(r"\s+"), " "),
        },
        test=lambda b: filters.is_offer_block(b("text"), "masonline") & ~filters.is_partial_fragment(b("text")),
        key=("head",),
        keep=lambda: filters.required_fields("discount"),
    ),
    "cencosud": SourceProfile(
        "cencosud",
        IMAGE_CARDS,
        {
            "bank": lambda b: F.coalesce(rules.classify(b("images"), "cencosud_image"), blank_to_null(rules.bank_in_context(b("text")))),
            "discount": lambda b: F.coalesce(_percent(b("text")), first_grab(b("text"), [r"(\d+\s*cuotas)"])),
            "image_url": lambda b: b("images"),
            "legal_text": lambda b: b("text"),
        },
        test=lambda b: filters.is_offer_block(b("text"), "cencosud", F.size(F.split(b("images"), r" \| ", -1)) * (b("images") != "").cast("int")),
        key=("bank", "discount"),
        keep=lambda: filters.required_fields("bank"),
    ),
    "personalpay": SourceProfile(
        "personalpay",
        BLOCK_RULES["percent_cards"],
        {
            "title": lambda b: F.trim(b("text")),
            "discount": lambda b: _percent(b("text")),
            "tope": lambda b: F.concat(F.lit("$"), grab(b("text"), r"tope\b[^.$\n]{0,30}\$\s*(\d[\d.,]*)")),
            "valid_days": lambda b: F.array_join(dates.named_days(b("text")), ", "),
        },
        key=("discount", "title"),
        keep=lambda: filters.required_fields("discount"),
        fixed={"wallet": "Personal Pay"},
    ),
    "buepp": SourceProfile(
        "buepp",
        MATERIAL_CARDS,
        {
            "title": lambda b: F.coalesce(blank_to_null(b("title")), b("text")),
            "discount": lambda b: _percent(b("text")),
            "image_url": lambda b: b("image"),
        },
        key=("title", "discount"),
        keep=lambda: filters.required_fields("discount"),
        fixed={"wallet": "Buepp"},
    ),
    "generic": SourceProfile(
        "generic",
        BLOCK_RULES["generic_cards"],
        {
            "title": lambda b: b("title"),
            "discount": lambda b: b("discount"),
            "bank": lambda b: b("bank"),
            "legal_text": lambda b: b("terms"),
            "image_url": lambda b: b("image"),
            "url": lambda b: b("link"),
        },
        key=("title", "discount", "bank"),
        keep=lambda: filters.required_fields("title_length"),
    ),
}
