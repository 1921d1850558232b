"""Registry of sources and the catalog of payment methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Key, name, url, category, aggregator, default brand.

SOURCES = [
    ("carrefour", "Carrefour", "https://www.carrefour.com.ar/descuentos-bancarios", None, False, None),
    ("dia", "Supermercados Día", "https://diaonline.supermercadosdia.com.ar/medios-de-pago-y-promociones", None, False, None),
    ("coto", "Coto Digital", "https://www.cotodigital.com.ar/sitios/cdigi/terminos-descuentos", None, False, None),
    ("cencosud", "Jumbo (Cencosud)", "https://www.jumbo.com.ar/descuentos-del-dia", None, False, None),
    ("masonline", "Más Online (ChangoMás)", "https://www.masonline.com.ar/promociones-bancarias", None, False, None),
    ("brubank", "Brubank", "https://www.brubank.com/beneficios", "benefits", False, None),
    ("personalpay", "Personal Pay", "https://www.personal.com.ar/pay/beneficios", "benefits", False, None),
    ("clublanacion", "Club La Nación", "https://club.lanacion.com.ar/beneficios", "benefits", False, None),
    ("buepp", "Buepp", "https://www.buepp.com.ar/beneficios", "benefits", False, None),
    ("cuentadni", "Cuenta DNI", "https://www.bancoprovincia.com.ar/cuentadni/contenidos/cdniBeneficios/", "benefits", False, None),
    ("shell", "Shell", "https://www.shell.com.ar/conductores/descuentos-vigentes.html", "fuel", False, None),
    ("axion", "Axion", "https://www.axionenergy.com/Paginas/beneficios/beneficiosypromociones.aspx", "fuel", False, None),
    ("puma", "Puma Energy", "https://pumaenergyarg.com.ar/promociones", "fuel", False, None),
    ("modo", "MODO", "https://www.modo.com.ar/promos/combustibles", "fuel", True, None),
    ("macro", "Banco Macro", "https://www.macro.com.ar/selecta/combustible", "fuel", True, None),
    ("galicia", "Banco Galicia", "https://www.galicia.ar/personas/promociones/promocion-combustible", "fuel", True, None),
    ("bna", "Banco Nación", "https://www.bna.com.ar/Personas/DescuentosYPromociones/4486/ypf/", "fuel", True, "YPF"),
]

PAYMENT_METHODS = {
    "bank": [
        "Banco Nación",
        "Banco Galicia",
        "Santander",
        "BBVA",
        "Macro",
        "ICBC",
        "HSBC",
        "Banco Ciudad",
        "Banco Patagonia",
        "Credicoop",
        "Supervielle",
        "Banco Francés",
        "Itaú",
        "Comafi",
        "Carrefour Banco",
        "Banco Provincia",
    ],
    "wallet": [
        "Mercado Pago",
        "Ualá",
        "Naranja X",
        "MODO",
        "Personal Pay",
        "Cuenta DNI",
        "Claro Pay",
        "Brubank",
        "Buepp",
    ],
    "club": [
        "ANSES / Jubilados",
        "PAMI",
        "Tarjeta Soy Tigre",
        "Tarjeta Cencosud",
        "Tarjeta Carrefour",
        "Tarjeta Naranja",
        "Club La Nación",
        "Club Personal",
        "Clarín 365",
        "Club Cencosud",
        "Socios River Plate",
        "Socios Boca Juniors",
        "Socios Racing",
        "Socios San Lorenzo",
        "Socios Independiente",
        "Socios Vélez",
        "Socios Huracán",
        "Socios Estudiantes LP",
        "Estudiantes Universitarios",
    ],
}

# Weekday (folded) of a page tab, as the sources spell it in their URLs.
TAB_DAYS = {
    "lunes": "Lunes",
    "martes": "Martes",
    "miercoles": "Miércoles",
    "jueves": "Jueves",
    "viernes": "Viernes",
    "sabado": "Sábado",
    "domingo": "Domingo",
}

# Display labels of known entities: key -> (label, initials).
ENTITY_LABELS = {
    "galicia": ("Galicia", "GA"),
    "santander": ("Santander", "SA"),
    "bbva": ("BBVA", "BB"),
    "macro": ("Macro", "MA"),
    "icbc": ("ICBC", "IC"),
    "hsbc": ("HSBC", "HS"),
    "ciudad": ("Ciudad", "CI"),
    "nacion": ("Nación", "BN"),
    "patagonia": ("Patagonia", "PA"),
    "credicoop": ("Credicoop", "CC"),
    "supervielle": ("Supervielle", "SU"),
    "frances": ("Francés", "FR"),
    "itau": ("Itaú", "IT"),
    "comafi": ("Comafi", "CO"),
    "piano": ("Piano", "PI"),
    "bind": ("BIND", "BI"),
    "mercado pago": ("Mercado Pago", "MP"),
    "mercadopago": ("Mercado Pago", "MP"),
    "uala": ("Ualá", "UA"),
    "naranja x": ("Naranja X", "NX"),
    "naranjax": ("Naranja X", "NX"),
    "modo": ("MODO", "MO"),
    "personal pay": ("Personal Pay", "PP"),
    "cuenta dni": ("Cuenta DNI", "DN"),
    "claro pay": ("Claro Pay", "CP"),
}

# End of fixed values.
# ---------------------------------------------------------------------------------------------


def merchant_registry(spark: SparkSession, key: str | None = None, enabled: bool | None = True) -> DataFrame:
    rows = [(*source, True) for source in SOURCES]
    df = spark.createDataFrame(
        rows,
        "source_key string, name string, url string, category string, aggregator boolean, "
        "default_brand string, enabled boolean",
    ).withColumn("category", F.coalesce("category", F.lit("supermarket")))
    if key is not None:
        df = df.filter(F.col("source_key") == key)
    if enabled is not None:
        df = df.filter(F.col("enabled") == F.lit(enabled))
    return df


def payment_catalog(spark: SparkSession) -> DataFrame:
    rows = [(kind, name) for kind, names in PAYMENT_METHODS.items() for name in names]
    return spark.createDataFrame(rows, "type string, name string")
