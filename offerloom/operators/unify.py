"""Unify what single sources produce into the common offer schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import dates, terms
from ..functions.text import blank_to_null, or_blank, split_csv

# Column names of single sources -> names of the common schema.
ALIASES = {
    "aplica_en": "store_types",
    "monto_minimo": "min_purchase",
    "tope": "cap",
    "acumulable": "stackable",
    "billetera_virtual": "wallet",
    "raw_text": "terms_raw",
    "legal_text": "terms_raw",
    "cuotas": "instalments",
    "sucursales": "branches",
    "sucursales_excluidas": "excluded_branches",
    "forma_reembolso": "refund_form",
    "no_acumula_con": "stacks_not_with",
    "bancos_participantes": "participating_banks",
    "validez": "channel",
    "plazo_acreditacion": "credit_delay",
    "mes": "month",
}


def _merge_aliases(df: DataFrame) -> DataFrame:
    for alias, name in ALIASES.items():
        if alias not in df.columns or alias == name:
            continue
        if name in df.columns:
            df = df.withColumn(name, F.coalesce(blank_to_null(F.col(name)), F.col(alias))).drop(alias)
        else:
            df = df.withColumnRenamed(alias, name)
    return df


def _as_list(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes).get(name)
    if kind is None:
        return F.array().cast("array<string>")
    if kind.startswith("array"):
        return F.coalesce(F.col(name), F.array().cast("array<string>"))
    return terms.json_text_to_array(F.col(name))


def unify_offer(df: DataFrame, source: str | None = None) -> DataFrame:
    """Common schema: aliases merged, blanks filled, dates typed, lists as arrays."""
    df = _merge_aliases(df)
    have = dict(df.dtypes)
    out = []
    for field in schema.OFFERS.fields:
        name = field.name
        if name in ("exclusions", "requirements"):
            value = _as_list(df, name)
        elif name == "source":
            value = F.lit(source) if source is not None else (F.col(name) if name in have else F.lit(None).cast("string"))
        elif name not in have:
            value = F.lit("") if field.dataType.simpleString() == "string" and name not in ("id", "merchant_id") else F.lit(None)
        elif name == "title":
            value = or_blank(F.col(name))
        elif name == "stackable":
            value = terms.normalize_flag(F.col(name))
        elif name in ("valid_from", "valid_until"):
            value = dates.normalize_date(F.col(name).cast("string"))
        elif field.dataType.simpleString() == "string" and name not in ("id", "merchant_id"):
            value = or_blank(F.col(name).cast("string"))
        else:
            value = F.col(name)
        out.append(value.cast(field.dataType).alias(name))
    known = set(schema.OFFERS.fieldNames())
    if "merchant_brands" in have:
        brands = F.col("merchant_brands")
        as_list = brands if have["merchant_brands"].startswith("array") else split_csv(brands, also_y=True)
        out.append(as_list.alias("merchant_brands"))
    rest = [F.col(c) for c in df.columns if c not in known and c != "merchant_brands"]
    return df.select(*out, *rest)


def offer_key() -> list[Column]:
    """Natural key of a stored offer: merchant, title, bank with missing as ''."""
    return [
        F.col("merchant_id"),
        or_blank(F.col("title")),
        or_blank(F.col("bank")),
    ]


def offer_id() -> Column:
    """Stable 128-bit id of the natural key."""
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in offer_key()]))


def fanout_offers(cards: DataFrame, wallets: Column, days: Column) -> DataFrame:
    """One offer per wallet of a multi-wallet card, sold by QR; other cards stay as they are."""
    exploded = cards.withColumn("_wallet", F.explode_outer(wallets))
    multi = F.col("_wallet").isNotNull()
    title = F.concat(F.col("_wallet"), F.lit(" "), F.col("discount"), F.lit(" - "), or_blank(days))
    return (
        exploded.withColumn("bank", F.when(multi, F.col("_wallet")).otherwise(F.col("bank")))
        .withColumn("wallet", F.when(multi, F.lit(None).cast("string")).otherwise(F.col("wallet")))
        .withColumn("store_types", F.when(multi, F.lit("QR")).otherwise(F.col("store_types")))
        .withColumn("title", F.when(multi, title).otherwise(F.col("title")))
        .drop("_wallet")
    )
