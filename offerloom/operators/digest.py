"""Digest rows: per user a header, per merchant the ordered offer lines in messages of bounded length."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.terms import entity_label
from ..functions.text import blank_to_null, or_blank
from . import filters
from .match import all_slices, match_sets, method_sets, slices, valid_offers
from .ordering import chunked, row_numbers
from .relational import with_merchant

LINES_PER_MESSAGE = 40


def offer_line(html: bool = False) -> Column:
    """'*discount* — entity' with days, stores, cap and minimum on a second line."""
    bold = ("<b>", "</b>") if html else ("*", "*")

    def shown(c: Column) -> Column:
        if not html:
            return c
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    head = F.concat(
        F.lit(bold[0]), shown(or_blank(F.col("discount"))), F.lit(bold[1] + " — "), shown(entity_label(F.col("bank"), F.col("wallet")))
    )
    details = F.concat_ws(
        " | ",
        *[
            F.concat(F.lit(label), shown(blank_to_null(F.col(name))))
            for label, name in (("📅 ", "valid_days"), ("🏪 ", "store_types"), ("⚠️ Tope ", "cap"), ("🛍️ Mínimo ", "min_purchase"))
        ],
    )
    return F.when(details == "", head).otherwise(F.concat(head, F.lit("\n   "), details))


def _total(n: Column, suffix: str = "") -> Column:
    return F.concat(F.lit("_Total: "), n.cast("string"), F.when(n == 1, " promoción").otherwise(" promociones"), F.lit(f"{suffix}_"))


def _messages(lines: DataFrame, group: list[str], suffix: str = "") -> DataFrame:
    """Messages of at most LINES_PER_MESSAGE lines per group; the last one carries the total."""
    chunks = chunked(lines, group, ["-discount", "id"], ["line"], LINES_PER_MESSAGE)
    totals = lines.groupBy(*group).agg(F.count("*").alias("total"))
    joined = chunks.join(totals, group)
    body = F.array_join(F.transform("items", lambda x: x["line"]), "\n\n")
    last = F.col("chunk_no") == F.floor((F.col("total") - 1) / LINES_PER_MESSAGE)
    title = F.concat(F.lit("*"), F.col("merchant_name"), F.lit("*"))
    text = F.concat_ws("\n", F.when(F.col("chunk_no") == 0, title), body, F.when(last, _total(F.col("total"), suffix)))
    return joined.select(*group, "chunk_no", "total", text.alias("text"))


def method_summary(methods: DataFrame, shown: int = 4) -> DataFrame:
    """First method names of each user, with '+N más' for the rest."""
    unique = methods.select("user_id", "entity_name").distinct()
    counts = unique.groupBy("user_id").agg(F.count("*").alias("n_methods"))
    first = (
        row_numbers(unique, ["user_id"], ["entity_name"])
        .filter(F.col("row_no") <= shown)
        .groupBy("user_id")
        .agg(F.array_join(F.array_sort(F.collect_list("entity_name")), ", ").alias("names"))
    )
    more = F.when(F.col("n_methods") > shown, F.concat(F.lit(" +"), (F.col("n_methods") - shown).cast("string"), F.lit(" más")))
    return first.join(counts, "user_id").select("user_id", "n_methods", F.concat("names", or_blank(more)).alias("methods"))


def build_digests(
    users: DataFrame, methods: DataFrame, offers: DataFrame, merchants: DataFrame, as_of: dt.date | str
) -> DataFrame:
    """Messages of the day for every user who wants them.

    Rows: user_id, telegram_chat_id, kind ('header', 'merchant', 'notice'), merchant_name, chunk_no, text.
    Users without payment methods get nothing; users without matching offers get a notice. Messages are made
    once for each distinct set of method names, and users join last, so that no message is shuffled once it is a user's. Users of
    a set are cut into slices, as a set may be held by very many.
    """
    day = dates.weekday_name(as_of if isinstance(as_of, dt.date) else dt.date.fromisoformat(as_of)).lower()
    wanted = users.filter(filters.users_to_notify()).select(F.col("id").alias("user_id"), "telegram_chat_id")
    own = methods.join(wanted.select("user_id"), "user_id", "left_semi")
    holders, set_names = method_sets(own)
    joined = with_merchant(valid_offers(offers, as_of, today_only=True), merchants)
    named, pairs = match_sets(_with_details(joined), set_names)
    lines = pairs.join(named.select("combo", "id", "merchant_name", "discount", offer_line().alias("line")), "combo").drop("combo")
    messages = _messages(lines, ["set_id", "merchant_name"])
    summary = method_summary(own).join(holders, "user_id", "left")
    greeting = F.lit(f"👋 ¡Buen {day}!\n")
    has_offers = pairs.select("set_id").distinct().withColumn("_found", F.lit(True))
    found = F.col("_found").isNotNull()
    heads = summary.join(has_offers, "set_id", "left").select(
        "user_id",
        F.when(found, "header").otherwise("notice").alias("kind"),
        F.lit("").alias("merchant_name"),
        F.lit(0).alias("chunk_no"),
        F.concat(
            greeting,
            F.when(found, F.concat(F.lit("🎯 *Tus promos de hoy* ("), F.col("methods"), F.lit(")"))).otherwise(
                "\nℹ️ Hoy no hay promociones activas para tus tarjetas y billeteras."
            ),
        ).alias("text"),
    )
    n_users = holders.groupBy("set_id").agg(slices(F.count("*")).alias("n_slices"))
    receivers = holders.join(wanted, "user_id").join(n_users, "set_id")
    receivers = receivers.withColumn("slice", F.pmod(F.xxhash64("user_id"), "n_slices"))
    spread = messages.join(n_users, "set_id").withColumn("slice", all_slices(F.col("n_slices"))).drop("n_slices")
    # Each message goes to its receivers in a row, which keeps files of the digests small.
    body = spread.join(receivers, ["set_id", "slice"]).select(
        "user_id", F.lit("merchant").alias("kind"), "merchant_name", "chunk_no", "text", "telegram_chat_id"
    )
    return heads.join(wanted, "user_id").unionByName(body)


def _with_details(offers: DataFrame) -> DataFrame:
    """The columns that a line shows, absent ones as null."""
    for name in ("cap", "min_purchase"):
        if name not in offers.columns:
            offers = offers.withColumn(name, F.lit(None).cast("string"))
    return offers


def merchant_digests(
    offers: DataFrame, merchants: DataFrame, as_of: dt.date | str, today_only: bool = True, merchant: str | None = None
) -> DataFrame:
    """Broadcast messages per merchant, for today's or all valid offers."""
    test = filters.valid_on(as_of)
    if today_only:
        test = test & filters.valid_on_weekday(as_of)
    joined = with_merchant(offers.filter(test), merchants)
    if merchant:
        joined = joined.filter(filters.merchant_is(merchant, "contains"))
    lines = _with_details(joined).select("id", "merchant_name", "discount", offer_line().alias("line"))
    return _messages(lines, ["merchant_name"], "  de hoy" if today_only else " activas")


def bot_page(rows: DataFrame, header: str, page: int = 1, size: int = 8) -> DataFrame:
    """One page of a bot answer, rendered as text rows with the page counter."""
    from .ordering import page_count, paginate

    order = ["merchant_name", "-scraped_at", "-id"]
    counts = page_count(rows, size)
    shown = paginate(rows, order, page, size)
    return shown.select(
        "id",
        "merchant_name",
        F.concat(F.lit("<b>"), F.col("merchant_name"), F.lit("</b>\n"), offer_line(html=True)).alias("text"),
        counts.select("total").scalar().alias("total"),
        counts.select("pages").scalar().alias("pages"),
    ).withColumn("header", F.lit(header))
