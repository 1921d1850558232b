"""Duplicate removal as aggregations: a hot key collapses on the map side before any shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, or_blank, rx
from . import filters


def keep_best(df: DataFrame, keys: dict[str, Column], order: list[Column], largest: bool = False) -> DataFrame:
    """One row per key: the smallest (or largest) by `order`, which must be unique inside a key."""
    row = F.struct(*[F.col(c) for c in df.columns])
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    pick = F.max_by(row, rank) if largest else F.min_by(row, rank)
    named = [c.alias(f"_k_{name}") for name, c in keys.items()]
    return df.groupBy(*named).agg(pick.alias("_row")).select("_row.*")


def entity() -> Column:
    return F.coalesce(
        blank_to_null(F.lower(F.trim(F.col("bank")))), blank_to_null(F.lower(F.trim(F.col("wallet"))))
    )


def has_online(strict: bool = False) -> Column:
    stores = F.lower(or_blank(F.col("store_types")))
    if strict:
        return stores.contains("carrefour.com") | stores.contains("online")
    return stores.contains(".com") | stores.contains("online")


def dedup_keep_richest(offers: DataFrame, scope: list[str] | None = None, source_variant: bool = False) -> DataFrame:
    """Per (scope, entity, discount, days, online): the offer with the longest terms, first one on ties.

    Rows without bank and wallet are dropped. The page-source variant compares discounts as written and
    keeps entity-less offers whose title says something.
    """
    scope = scope or []
    kept = offers.filter(filters.not_generic_title() if source_variant else filters.identified())
    discount = or_blank(F.col("discount")) if source_variant else F.lower(F.trim(or_blank(F.col("discount"))))
    days = F.lower(or_blank(F.col("valid_days")))
    keys = {
        **{s: F.col(s) for s in scope},
        "entity": or_blank(entity()),
        "discount": discount,
        "days": days if source_variant else F.trim(days),
        "online": has_online(strict=source_variant),
    }
    order = [-F.length(or_blank(F.col("terms_raw"))), F.col("pos")]
    return keep_best(kept, keys, order)


def _low(name: str) -> Column:
    return F.lower(F.trim(or_blank(F.col(name))))


def _raw(name: str) -> Column:
    return or_blank(F.col(name))


# Key sets of the sources; each value builds the key columns of one offer or text block.
KEY_SETS = {
    "entity_discount_days_stores": lambda: {
        "entity": F.lower(F.coalesce(blank_to_null(F.col("bank")), blank_to_null(F.col("wallet")), blank_to_null(F.col("card_type")), F.lit(""))),
        "discount": _raw("discount"),
        "days": F.lower(_raw("valid_days")),
        "stores": F.lower(_raw("store_types")),
    },
    "bank_discount_cap": lambda: {
        "bank": _raw("bank"),
        "discount": _raw("discount"),
        "cap": _raw("cap"),
        "qr": or_blank(F.col("store_types")) == "QR",
    },
    "bank_discount_categories": lambda: {
        "bank": _raw("bank"),
        "discount": _raw("discount"),
        "categories": _raw("categories"),
    },
    "squeezed": lambda: {
        "all": F.lower(
            F.regexp_replace(
                F.concat(_raw("bank"), _raw("wallet"), _raw("discount"), _raw("valid_days")), rx(r"\s+"), ""
            )
        )
    },
    "bank_wallet_discount_days": lambda: {n: _low(n) for n in ("bank", "wallet", "discount", "valid_days")},
    "title_discount": lambda: {"title": F.lower(_raw("title")), "discount": _raw("discount")},
    "title": lambda: {"title": _raw("title")},
    "title_bank_discount": lambda: {n: F.col(n) for n in ("title", "bank", "discount")},
}


def dedup_keep_first(offers: DataFrame, key_set: str, order: list[str], scope: list[str] | None = None) -> DataFrame:
    """First row per key set in (tab, position) order."""
    keys = {**{s: F.col(s) for s in scope or []}, **KEY_SETS[key_set]()}
    return keep_best(offers, keys, [F.col(c) for c in order])


def dedup_text_prefix(blocks: DataFrame, size: int, order: list[str], scope: list[str], text: str = "text") -> DataFrame:
    """First block per text prefix (40, 80, 120, 150 … characters)."""
    keys = {**{s: F.col(s) for s in scope}, "prefix": F.substring(F.regexp_replace(text, rx(r"\s+"), " "), 1, size)}
    return keep_best(blocks, keys, [F.col(c) for c in order])


def dedup_id(offers: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    return keep_best(offers, {"id": F.col(id_col)}, [F.col(c) for c in order])


def first_strategy(rows: DataFrame, page: str = "page_id", rank: str = "strategy") -> DataFrame:
    """Rows of the first extraction strategy that found anything on each page."""
    best = rows.groupBy(page).agg(F.min(rank).alias(rank))
    return rows.join(best, [page, rank], "left_semi")


# Levels of nested texts: shortest length, characters of a gram, grams of a window. A window fits into the shortest text.
LEVELS = ((32, 8, 25), (16, 8, 9), (8, 4, 5), (4, 2, 3), (2, 2, 1), (1, 1, 1))


def _grams(text: str, level: int) -> np.ndarray:
    """Hashes of the grams of a text at a level."""
    size = LEVELS[level][1]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = np.full(len(codes) - size + 1, level, np.uint64)
    for k in range(size):
        out = (out ^ codes[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def wanted_key(text: str, level: int) -> int:
    """The least gram of the first window of a text."""
    return int(_grams(text, level)[: LEVELS[level][2]].min().view(np.int64))


def offered_keys(text: str, levels: list[int]) -> np.ndarray:
    """The different least grams of all windows of a text: what it holds has its wanted key among them."""
    found = [np.zeros(0, np.int64)]
    for level in levels:
        least, _, width = LEVELS[level]
        if len(text) >= least:
            windows = np.lib.stride_tricks.sliding_window_view(_grams(text, level), width)
            found.append(np.unique(windows.min(axis=1)).view(np.int64))
    return np.concatenate(found)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_page, _pos, _key) of each text: its wanted key, or all that it offers if the page's levels come with it."""
    for batch in batches:
        texts, levels = batch.column("_text").to_pylist(), batch.column("_level").to_pylist()
        if "_levels" in batch.schema.names:
            keys = [offered_keys(t, held) for t, held in zip(texts, batch.column("_levels").to_pylist(), strict=True)]
        else:
            keys = [np.array([wanted_key(t, level)]) for t, level in zip(texts, levels, strict=True)]
        if not keys:
            continue
        at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
        columns = [batch.column("_page").take(at), batch.column("_pos").take(at), pa.array(np.concatenate(keys), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["_page", "_pos", "_key"])


def nested_text_dedup(blocks: DataFrame, page: str = "page_id", pos: str = "block_pos", text: str = "text") -> DataFrame:
    """Drop a block whose text lies inside that of another block of the page.

    Blocks meet by the least gram of a window: the nested block names that of its first window, the container those of all
    its windows, few of which differ (one in about 13 characters), so the text of the first window is among them wherever
    it lies. Whole texts are compared for these candidates only. Equal texts keep the first position.
    """
    whole = blocks.select(F.col(page).alias("_page"), F.col(pos).alias("_pos"), F.trim(F.col(text)).alias("_text"))
    # Equal texts: first position only, so that what follows compares distinct texts.
    whole = whole.groupBy("_page", "_text").agg(F.min("_pos").alias("_pos"))
    filled = whole.filter(F.length("_text") > 0)
    level = F.lit(len(LEVELS) - 1)
    for number in reversed(range(len(LEVELS) - 1)):
        level = F.when(F.length("_text") >= LEVELS[number][0], F.lit(number)).otherwise(level)
    leveled = filled.filter(F.col("_page").isNotNull() & F.col("_pos").isNotNull()).withColumn("_level", level)
    kinds = dict(filled.dtypes)
    schema = f"_page {kinds['_page']}, _pos {kinds['_pos']}, _key long"
    wanted = leveled.mapInArrow(_keys, schema)
    levels = leveled.groupBy("_page").agg(F.collect_set("_level").alias("_levels"))
    offered = leveled.join(levels, "_page").mapInArrow(_keys, schema).withColumnRenamed("_pos", "_big")
    met = wanted.join(offered, ["_page", "_key"]).filter(F.col("_pos") != F.col("_big")).select("_page", "_pos", "_big").distinct()
    containers = filled.select("_page", F.col("_pos").alias("_big"), F.col("_text").alias("_container"))
    nested = (
        met.join(filled, ["_page", "_pos"])
        .join(containers, ["_page", "_big"])
        .filter(F.col("_container").contains(F.col("_text")))
        .select("_page", "_pos")
        .distinct()
    )
    kept = whole.select("_page", "_pos").join(nested, ["_page", "_pos"], "left_anti")
    return blocks.join(
        kept.select(F.col("_page").alias(page), F.col("_pos").alias(pos)), [page, pos], "left_semi"
    )


def ordinal_in_list(items: DataFrame, least_items: int = 5, least_chars: int = 40) -> DataFrame:
    """1-based numbering of the first list per page with enough items and a substantial first item.

    `items` has page_id, list_pos, item_pos, text. Lists are bounded by their page.
    """
    lists = items.groupBy("page_id", "list_pos").agg(
        F.count("*").alias("n_items"), F.min_by(F.length("text"), "item_pos").alias("first_chars")
    )
    good = lists.filter((F.col("n_items") >= least_items) & (F.col("first_chars") >= least_chars))
    first = good.groupBy("page_id").agg(F.min("list_pos").alias("list_pos"))
    w = Window.partitionBy("page_id", "list_pos").orderBy("item_pos")
    return (
        items.join(first, ["page_id", "list_pos"], "left_semi")
        .withColumn("n", F.row_number().over(w))
        .filter(F.length("text") > 0)
        .select("page_id", "n", "text")
    )
