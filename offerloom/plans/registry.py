"""Registry of named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as terms_fn
from ..session import tune
from .fixtures import fixture, oracle, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, fixtures: str | None = None, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` is its counterpart over the fixtures named (and the base tables)."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(tune(spark), sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(fixtures, sql) if fixtures else sql
        return fn

    return add


def promos(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "fx_promos").withColumnRenamed("supermarket_id", "merchant_id")


def merchants(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "fx_merchants")


def raw_terms(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "fx_terms")


def cards(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "fx_cards")


def methods(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "fx_payment_methods")


def history(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "fx_history").withColumnRenamed("supermarket_id", "merchant_id")


def base(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, name)


def store_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed terms in the shape of the terms table."""
    raw = fixture(spark, sf, "fx_terms").withColumnRenamed("promotion_id", "offer_id")
    return terms_fn.parse_terms(raw, "raw_text").select(
        "offer_id",
        "raw_text",
        terms_fn.listed(F.col("exclusions")).alias("exclusions"),
        terms_fn.listed(F.col("requirements")).alias("requirements"),
        F.col("cap").alias("max_discount"),
        F.lit(None).cast("string").alias("min_purchase"),
        "valid_days",
        F.array().cast("array<string>").alias("payment_methods"),
    )


def show(df: DataFrame, *columns: str) -> DataFrame:
    """Columns for comparison: dates as ISO text, arrays joined by '|'."""
    out = []
    kinds = dict(df.dtypes)
    for name in columns or df.columns:
        kind = kinds[name]
        if kind == "date":
            out.append(F.col(name).cast("string").alias(name))
        elif kind.startswith("array<string"):
            out.append(F.array_join(name, "|").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)
