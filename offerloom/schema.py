"""Explicit schemas of the offer store, and additive schema evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _B, _TS, _A = T.StringType(), T.DateType(), T.BooleanType(), T.TimestampType(), T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


MERCHANTS = _struct(
    id=_S, name=_S, url=_S, category=_S, last_scraped=_TS, scrape_count=T.LongType(), enabled=_B, created_at=_TS
)

OFFERS = _struct(
    id=_S,
    merchant_id=_S,
    source=_S,
    title=_S,
    discount=_S,
    bank=_S,
    wallet=_S,
    card_type=_S,
    payment_method=_S,
    store_types=_S,
    valid_days=_S,
    valid_from=_D,
    valid_until=_D,
    url=_S,
    image_url=_S,
    terms_raw=_S,
    exclusions=_A,
    requirements=_A,
    cap=_S,
    stackable=_B,
    min_purchase=_S,
    is_active=_B,
    scraped_at=_TS,
)

# Columns single sources add; the unified output keeps them.
OFFER_EXTRAS = _struct(
    instalments=_S,
    discount_type=_S,
    card_types=_S,
    payment_type=_S,
    branches=_S,
    excluded_branches=_S,
    categories=_S,
    refund_form=_S,
    stacks_not_with=_S,
    participating_banks=_S,
    tna=_S,
    tea=_S,
    cft=_S,
    channel=_S,
    credit_delay=_S,
    month=_S,
    terms_url=_S,
    footnote_num=T.IntegerType(),
    merchant_brands=_A,
    extracted_by=_S,
    extracted_at=_TS,
)

TERMS = _struct(
    offer_id=_S,
    raw_text=_S,
    exclusions=_A,
    requirements=_A,
    max_discount=_S,
    min_purchase=_S,
    valid_days=_A,
    payment_methods=_A,
)

HISTORY = _struct(merchant_id=_S, status=_S, promotions_found=T.LongType(), error_message=_S, scraped_at=_TS)
USERS = _struct(
    id=T.LongType(), email=_S, telegram_chat_id=_S, notify_daily=_B, notify_hour=T.IntegerType(), updated_at=_TS
)
USER_METHODS = _struct(user_id=T.LongType(), entity_name=_S, entity_type=_S)

VISION_OFFER = _struct(
    title=_S,
    discount=_S,
    bank=_S,
    wallet=_S,
    card_type=_S,
    payment_method=_S,
    store_types=_S,
    valid_days=_S,
    valid_from=_S,
    valid_until=_S,
    terms_raw=_S,
    tope=_S,
    min_purchase=_S,
    exclusions=_A,
    requirements=_A,
    merchant_brands=_A,
)
VISION_ENVELOPE = T.StructType(
    [T.StructField("promotions", T.ArrayType(VISION_OFFER)), T.StructField("extraction_notes", _S)]
)

BENEFIT_DETAIL = T.StructType(
    [
        T.StructField(
            "Entity",
            T.StructType(
                [
                    T.StructField("Beneficio", _struct(bajada=_S, fecha_desde=_S, fecha_hasta=_S, legal=_S)),
                    T.StructField("Condiciones", T.ArrayType(_struct(texto=_S))),
                    T.StructField("Rubros", T.ArrayType(_struct(nombre=_S))),
                    T.StructField("Botones", T.ArrayType(_struct(link=_S))),
                ]
            ),
        )
    ]
)


def evolve_schema(df: DataFrame, target: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Add the missing columns with their defaults, fill defaults into NULLs, order as the target."""
    defaults = defaults or {}
    have = set(df.columns)
    out = []
    for field in target.fields:
        fallback = F.lit(defaults.get(field.name)).cast(field.dataType)
        if field.name not in have:
            out.append(fallback.alias(field.name))
        elif field.name in defaults:
            out.append(F.coalesce(F.col(field.name).cast(field.dataType), fallback).alias(field.name))
        else:
            out.append(F.col(field.name).cast(field.dataType).alias(field.name))
    extra = [F.col(c) for c in df.columns if c not in set(target.fieldNames())]
    return df.select(*out, *extra)


def category_or_default(df: DataFrame, default: str = "supermarket") -> DataFrame:
    """Tables written before the category column existed read as all-default."""
    if "category" in df.columns:
        return df.withColumn("category", F.coalesce("category", F.lit(default)))
    return df.withColumn("category", F.lit(default))
