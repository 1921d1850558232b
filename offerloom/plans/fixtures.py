"""Offer relations derived from the star-schema tables, in SQL both Spark and the oracle understand.

Tables are written as @name@. `o_orderkey` identifies an offer; nothing here depends on row order.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

AS_OF = "1998-06-01"
NOW_EVENTS = "2024-01-30 00:00:00"

MERCHANTS = """
select s_suppkey as id, s_name as name, concat('http://m', cast(s_suppkey as varchar(10)), '.example') as url,
  case when s_suppkey % 11 = 0 then null when s_suppkey % 3 = 0 then 'supermarket'
       when s_suppkey % 3 = 1 then 'fuel' else 'benefits' end as category,
  case when s_suppkey % 13 = 0 then 0 else 1 end as enabled
from @supplier@
"""

PROMOS = """
select o_orderkey as id, o_custkey % 100 as supermarket_id,
  concat(p_name, ' ', o_orderpriority) as title,
  case when o_orderkey % 5 = 0 then concat(cast(1 + o_orderkey % 12 as varchar(10)), ' cuotas sin interes')
       when o_orderkey % 7 = 0 then concat(cast(5 * (1 + o_orderkey % 8) as varchar(10)), '% reintegro')
       else concat(cast(5 * (1 + o_orderkey % 8) as varchar(10)), '%') end as discount,
  case when o_orderkey % 4 = 0 then '' when o_orderkey % 31 = 0 then 'Visa' else n_name end as bank,
  case when o_orderkey % 3 = 0 then c_mktsegment else '' end as wallet,
  case o_orderkey % 6 when 0 then null when 1 then '' when 2 then 'Hipermercado, Online' when 3 then 'Market'
       when 4 then 'www.tienda.com' else 'Express, App' end as store_types,
  case o_orderkey % 9 when 0 then 'Lunes' when 1 then 'Martes' when 2 then 'Miércoles' when 3 then 'Miercoles'
       when 4 then 'Todos los días' when 5 then null when 6 then '' when 7 then 'Sábado, Domingo'
       else 'Jueves y Viernes' end as valid_days,
  cast(o_orderdate as date) as valid_from,
  case when o_orderkey % 10 = 0 then null else cast(o_orderdate + interval '60' day as date) end as valid_until,
  case when o_orderstatus = 'F' then 0 else 1 end as is_active,
  o_orderdate as scraped_at
from (select *, o_orderkey % (select count(*) from @part@) as part_number from @orders@)
  join @customer@ on o_custkey = c_custkey join @nation@ on c_nationkey = n_nationkey
  join @part@ on p_partkey = part_number
"""

TERMS = """
select o_orderkey as promotion_id,
  concat(case o_orderkey % 5 when 0 then 'PROMOCIÓN VÁLIDA DESDE EL 01 AL 30 DE NOVIEMBRE DE 2025. '
              when 1 then 'VÁLIDO HASTA EL 28/02/2026. ' when 2 then 'HASTA EL 5 DE MARZO DE 2026. '
              when 3 then 'TODOS LOS LUNES DE FEBRERO DE 2024. ' else '' end,
    cast(5 * (1 + o_orderkey % 8) as varchar(10)), '% DE DESCUENTO LOS DÍAS MARTES Y JUEVES. ',
    case o_orderkey % 3 when 0 then 'SIN TOPE. '
         when 1 then concat('TOPE DE REINTEGRO: $ ', cast(1 + o_orderkey % 30 as varchar(10)), '.000. ') else '' end,
    case when o_orderkey % 2 = 0 then 'COMPRA MÍNIMA DE $ 15.000. ' else '' end,
    case when o_orderkey % 4 = 0 then 'QUEDAN EXCLUIDOS DEL DESCUENTO: CARNES, VINOS Y LECHES. ' else '' end,
    case o_orderkey % 3 when 0 then 'NO ACUMULABLE CON OTRAS PROMOCIONES.' when 1 then 'ACUMULABLE.' else '' end
  ) as raw_text
from @orders@
"""

HISTORY = """
select event_id as id, user_id % 100 as supermarket_id,
  case when event_type = 'error' then 'error' else 'success' end as status,
  case when event_type = 'error' then 0 else cast(floor(value) as int) end as promotions_found,
  case when event_type = 'error' then props else null end as error_message, ts as scraped_at
from @events@
"""

METHODS = """
select c_custkey as user_id, n_name as entity_name, 'bank' as entity_type
from @customer@ join @nation@ on c_nationkey = n_nationkey
union all
select c_custkey, c_mktsegment, 'wallet' from @customer@ where c_custkey % 2 = 0
"""

USERS = """
select c_custkey as id, concat(' User', cast(c_custkey as varchar(10)), '@Mail.Example ') as email,
  case when c_custkey % 3 = 0 then null when c_custkey % 7 = 0 then '' else cast(1000 + c_custkey as varchar(10)) end
    as telegram_chat_id,
  case when c_custkey % 5 = 0 then 0 else 1 end as notify_daily, cast(7 + c_custkey % 5 as int) as notify_hour
from @customer@
"""

CRAWL = """
select 1 as batch, p.id * 2 as pos, p.supermarket_id, p.title, nullif(p.bank, '') as bank, nullif(p.wallet, '') as wallet,
  p.discount, p.valid_days, p.store_types, t.raw_text as terms_raw, '' as brands
from fx_promos p join fx_terms t on t.promotion_id = p.id where p.id % 3 <> 0
union all
select 2, p.id * 2, p.supermarket_id, p.title, nullif(p.bank, ''), nullif(p.wallet, ''),
  concat('9', p.discount), p.valid_days, p.store_types, t.raw_text,
  case p.id % 4 when 0 then 'YPF, Shell' when 1 then 'Axion y Puma' else '' end
from fx_promos p join fx_terms t on t.promotion_id = p.id where p.id % 3 <> 1
union all
select 2, p.id * 2 + 1, p.supermarket_id, p.title, nullif(p.bank, ''), nullif(p.wallet, ''),
  concat('9', p.discount), p.valid_days, p.store_types, concat(t.raw_text, ' VER BASES.'), ''
from fx_promos p join fx_terms t on t.promotion_id = p.id where p.id % 3 <> 1 and p.id % 10 = 0
"""

# Card texts that put every extraction rule to work: one segment per kind of fact, mixed by prime periods.
_SEGMENTS = [
    (
        7,
        [
            "30% de descuento",
            "20% de reintegro",
            "3x2 en vinos",
            "6 cuotas sin interés",
            "Hasta 12 CSI",
            "$5.000 OFF en electro",
            "BENEFICIO DEL 15% Dto. en bebidas",
        ],
    ),
    (
        11,
        [
            " con Banco Galicia",
            " con tarjetas de crédito Visa y Mastercard de Banco Macro",
            " con MODO y clientes de BANCO HIPOTECARIO",
            " pagando con Mercado Pago",
            " con Cuenta DNI",
            " a clientes de Banco Ciudad o Supervielle",
            " con Naranja X y Tarjeta Nevada",
            " con Ualá y Personal Pay",
            " con débito de BANCO DE LA NACIÓN",
            " con BILLETERAS VIRTUALES: Mercado Pago, Personal Pay y Prex",
            " con MásClub o AMEX",
        ],
    ),
    (
        13,
        [
            " todos los lunes y jueves.",
            " de lunes a viernes.",
            " Todos los días.",
            " los días sábado y domingo.",
            " lunes, martes y miércoles.",
            " todos los miércoles de febrero.",
            ".",
            " DE LUNES A JUEVES.",
            " jueves.",
            " toda la semana.",
            " LOS DÍAS LUNES DESDE EL 01 DE ENERO HASTA EL 31 DE ENERO DE 2026.",
            " SÁBADO 16, DOMINGO 17 Y LUNES 18 DE MAYO DE 2026.",
            " viernes y sábados.",
        ],
    ),
    (
        17,
        [
            " VIGENCIA DESDE EL 01/10/2025 HASTA EL 31/03/2026.",
            " Desde 1 de diciembre de 2025 al 28 de febrero de 2026.",
            " Válido hasta 30/04.",
            " Desde 05/03/24 hasta 28/02/26.",
            " DESDE EL 18 HASTA EL 19 DE JULIO DE 2026.",
            " Hasta el 5 de marzo de 2026.",
            " Hasta el 31/02/2026.",
            " Del 1 al 15 de agosto.",
            " Válida en setiembre de 2025.",
            " Del 3/5 al 9/5.",
            "",
            "",
            "",
            "",
            "",
            "",
            "",
        ],
    ),
    (
        19,
        [
            " Tope: $20.000 por usuario.",
            " SIN TOPE.",
            " Tope de descuento de $4.500.",
            " Reintegro máximo: $ 8.000 mensual.",
            " TOPE DE REINTEGRO: $ 20.000 SEMANAL.",
            " Tope de $ 1.500,75.",
            " Máximo $ 3.000.",
            " Hasta $ 9.999 de reintegro.",
            " REEMBOLSO MÁXIMO: $ 7.000 POR CLIENTE.",
            "",
            "",
            "",
            "",
            "",
            "",
            "",
            "",
            "",
            "",
        ],
    ),
    (
        23,
        [
            " Mínimo de compra: $50.000.",
            " Compra mínima de $ 15.000.",
            " A partir de $ 7.500.",
            " Sin mínimo.",
            " TNA: 0,00% TEA: 0.00% CFT: 12,5%.",
            " El reintegro se acreditará dentro de los 10 días hábiles.",
            " Se verán reflejados en los 30 días posteriores a la compra.",
            " Pago mínimo de $ 2.000.",
            " Mínimo de compra $ 33.000.",
            "",
            "",
            "",
            "",
            "",
            "",
            "",
            "",
            "",
            "",
            "",
            "",
            "",
            "",
        ],
    ),
    (
        29,
        [
            " NO ACUMULABLE CON OTRAS PROMOCIONES.",
            " Acumulable con otras promos.",
            " Quedan excluidos vinos y carnes.",
            " NO INCLUYE ELECTRO NI CELULARES.",
            " No válido para compras web.",
            " Se excluyen lácteos, bebidas y yerba.",
            " Excepto carnes.",
            " Exclusivamente para clientes Black.",
            " Solo para clientes nivel 3.",
            " Excluye sucursal Luján.",
            " Válido para sucursales COTO DE SALTA, JUJUY Y COMPRAS web.",
            " Alcanza a la totalidad de los almacenes, bebidas. Reembolso se verá reflejado en el resumen.",
            " Comprando online en www.tienda.com.",
            " Pagando: Sucursal y MásOnline.",
            " Ver legal.",
            " Carrefour Market y hipermercados.",
            " NO VÁLIDO PARA CARREFOUR.COM.AR.",
            " Participan Banco Macro, Banco Galicia y ICBC.",
            " No aplica en sucursal Salta.",
            " EXCLUSIVO ONLINE.",
            "",
            "",
            "",
            "",
            "",
            "",
            "",
            "",
            "",
        ],
    ),
]


def _case(period: int, texts: list[str]) -> str:
    arms = " ".join(f"when {i} then '{t}'" for i, t in enumerate(texts))
    return f"case o_orderkey % {period} {arms} end"


CARDS = (
    "select o_orderkey as id, concat("
    + ", ".join(_case(period, texts) for period, texts in _SEGMENTS)
    + ") as card_text, "
    + _case(
        9,
        [
            "/img/banco-galicia.png",
            "/img/mercado_pago.svg",
            "https://cdn.example/visa_mastercard.png",
            "/img/bna+logo.png",
            "",
            "/img/cuenta_dni.png",
            "/img/carrefour-credito.png",
            "/img/banco_hipotecario.jpg",
            "/img/personal-pay.webp",
        ],
    )
    + " as image_url, "
    + _case(8, ["Modo", "Banco Columbia", "visa master", "tarjeta de prueba", ",", "BNA", "naranja plus", "x"])
    + " as card_class from @orders@"
)
# Fixtures whose rows cost much more to work on than to read, with the only column that they read.
COSTLY = {"fx_cards": ("orders", "o_orderkey")}

FIXTURES: dict[str, str] = {
    "fx_merchants": MERCHANTS,
    "fx_promos": PROMOS,
    "fx_terms": TERMS,
    "fx_history": HISTORY,
    "fx_payment_methods": METHODS,
    "fx_users": USERS,
    "fx_crawl": CRAWL,
    "fx_cards": CARDS,
}
NEEDS = {"fx_crawl": ["fx_promos", "fx_terms"]}


def with_clauses(names: list[str], table: Callable[[str], str]) -> str:
    """WITH clause that defines the fixtures named (and what they need); tables go through `table`."""
    ordered: list[str] = []
    for name in names:
        for dep in [*NEEDS.get(name, []), name]:
            if dep not in ordered:
                ordered.append(dep)
    parts = [f"{n} as ({re.sub('@([a-z]+)@', lambda m: table(m.group(1)), FIXTURES[n])})" for n in ordered]
    return "with " + ", ".join(parts)


def oracle(names: str, body: str) -> str:
    """Oracle text: fixtures as common table expressions in front of the body."""
    clause = with_clauses(names.split(), lambda t: t)
    return f"{clause}, {body[5:]}" if body.startswith("with ") else f"{clause} {body}"


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    def rows(table_name: str) -> str:
        path = f"parquet.`{sf_dir}/{table_name}.parquet`"
        if COSTLY.get(name, ("",))[0] != table_name:
            return path
        # A small file is one task, so its keys (no texts yet) are dealt to all cores.
        key, parts = COSTLY[name][1], max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        return f"(select /*+ REPARTITION({parts}, {key}) */ {key} from {path})"

    clause = with_clauses([name], rows).replace("varchar(10)", "string")
    return spark.sql(f"{clause} select * from {name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
