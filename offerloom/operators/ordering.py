"""Orders, pages and positions that hold for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows whose keys cut an order into ranges; drawn by hash, so each range holds about the same share.
CUTS = 64
# Largest offset + page the driver-side top-k may carry; deeper pages go through row numbers.
TOP_K_BOUND = 10_000


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("scraped_at"), F.desc("id"))


def by_merchant_then_discount(df: DataFrame, typed: bool = False) -> DataFrame:
    """Merchant name, then discount descending as text, or by its number when `typed`."""
    from ..functions.money import discount_value

    key = F.desc_nulls_last(discount_value(F.col("discount"))) if typed else F.desc("discount")
    return df.orderBy("merchant_name", key, "id")


def by_merchant_then_newest(df: DataFrame, limit: int = 200) -> DataFrame:
    return df.orderBy("merchant_name", F.desc("scraped_at"), F.desc("id")).limit(limit)


def top_k_by_count(counts: DataFrame, k: int, name: str = "name", count: str = "n") -> DataFrame:
    return counts.orderBy(F.desc(count), name).limit(k)


def recent(df: DataFrame, limit: int = 50) -> DataFrame:
    """Newest rows, limit held to 1-500."""
    return df.orderBy(F.desc("scraped_at"), F.desc("id")).limit(max(1, min(int(limit), 500)))


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.coalesce(F.col(column), F.lit("")) != "").distinct().orderBy(column)


def sorted_by(order: list[str]) -> list[Column]:
    """Sort columns of names; a leading '-' means falling."""
    return [F.desc(name[1:]) if name.startswith("-") else F.asc(name) for name in order]


def _comes_before(row: dict[str, Column], cut: Column, keys: list[str]) -> Column:
    """Whether a row sorts before a cut, with Spark's places for nulls: first if rising, last if falling."""
    before, same = F.lit(False), F.lit(True)
    for key in keys:
        name = key.removeprefix("-")
        low, high = (cut[name], row[name]) if key.startswith("-") else (row[name], cut[name])
        less = F.coalesce(low < high, low.isNull() & high.isNotNull())
        before = before | (same & less)
        same = same & low.eqNullSafe(high)
    return before


def running_totals(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The sum of `value` over the rows of the group up to each row, without one task per group.

    A few rows drawn by hash cut the order of (group, order) into ranges. The range of a row is an expression over the row,
    so a total is the sum within its range plus the sums of the ranges before, and a hot group spreads over many tasks.
    `order` names columns ('-' in front: falling) and ends in a unique one. Nothing runs before the result is asked for;
    the input is planned three times, and its exchanges are reused.
    """
    keys = [*group, *order]
    names = list(dict.fromkeys(k.removeprefix("-") for k in keys))
    drawn = df.select(*names).orderBy(F.xxhash64(*names)).limit(CUTS)
    cuts = drawn.agg(F.collect_list(F.struct(*names)).alias("cuts")).scalar()
    row = {n: F.col(n) for n in names}
    ranged = df.withColumn("_cuts", cuts).withColumn("_range", F.size(F.filter("_cuts", lambda cut: ~_comes_before(row, cut, keys))))
    ranged = ranged.drop("_cuts").withColumn("_value", value)
    inside = Window.partitionBy("_range", *group).orderBy(*sorted_by(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_local", F.sum("_value").over(inside))
    sizes = ranged.groupBy("_range", *group).agg(F.sum("_value").alias("_size"))
    before = Window.partitionBy(*[F.col(g) for g in group]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("_range").alias("_r"),
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
    )
    same = local["_range"] == offsets["_r"]
    for i, g in enumerate(group):
        same = same & local[g].eqNullSafe(offsets[f"_g{i}"])
    placed = local.join(offsets, same).withColumn(name, F.col("_local") + F.col("_before"))
    return placed.select(*df.columns, name)


def row_numbers(df: DataFrame, group: list[str], order: list[str], name: str = "row_no") -> DataFrame:
    """Exact 1-based position inside each group, for groups of any size (see running_totals)."""
    return running_totals(df, group, order, F.lit(1).cast("long"), name)


def paginate(df: DataFrame, order: list[str], page: int = 1, size: int = 20) -> DataFrame:
    """One page of an ordered result; size is held to 1-100.

    Pages near the start are a top-k; for one further on, asked for by its number, positions are counted.
    """
    size, page = max(1, min(int(size), 100)), max(1, int(page))
    start = (page - 1) * size
    if start + size <= TOP_K_BOUND:
        return df.orderBy(*sorted_by(order)).offset(start).limit(size)
    numbered = row_numbers(df, [], order)
    return numbered.filter(F.col("row_no").between(start + 1, start + size)).drop("row_no").orderBy(*sorted_by(order))


def page_count(df: DataFrame, size: int = 20) -> DataFrame:
    """Total rows and number of pages (at least one)."""
    return df.agg(F.count("*").alias("total")).withColumn(
        "pages", F.greatest(F.ceil(F.col("total") / F.lit(size)), F.lit(1)).cast("long")
    )


def clamp_page(page: int, total: int, size: int = 8) -> int:
    return max(1, min(page, max(1, -(-total // size))))


def chunked(df: DataFrame, group: list[str], order: list[str], payload: list[str], size: int = 500) -> DataFrame:
    """Ordered lists per group in chunks of at most `size` rows: (group, chunk_no, n, items)."""
    numbered = row_numbers(df, group, order)
    item = F.struct("row_no", *[F.col(c) for c in payload])
    return (
        numbered.withColumn("chunk_no", F.floor((F.col("row_no") - 1) / size).cast("int"))
        .groupBy(*group, "chunk_no")
        .agg(F.count("*").alias("n"), F.array_sort(F.collect_list(item)).alias("items"))
    )
