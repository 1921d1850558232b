"""A query for each source profile: offers out of pages that carry cards in the source's markup.

The values of a card follow from the page's number, so SQL knows them; each card comes twice, in a nest of other elements,
and the page's own markup goes around them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import blocks, profiles
from .page_queries import pages
from .registry import query

PERCENT = "cast(5 * (1 + page_id % 8) as varchar)"
DAY = "case page_id % 3 when 0 then 'Lunes' when 1 then 'Martes' else 'Jueves' end"
BANK = "case page_id % 3 when 0 then 'Banco Galicia' when 1 then 'Banco Macro' else 'Banco Provincia' end"
NAME = "'Comercio ' || page_id"


def values() -> dict[str, Column]:
    """The values of a page's card, by the name that stands for them in a template."""
    k = F.col("page_id")
    three = lambda *x: F.when(k % 3 == 0, x[0]).when(k % 3 == 1, x[1]).otherwise(x[2])
    return {
        "percent": (5 * (1 + k % 8)).cast("string"),
        "day": three("Lunes", "Martes", "Jueves"),
        "bank": three("Banco Galicia", "Banco Macro", "Banco Provincia"),
        "name": F.concat(F.lit("Comercio "), k.cast("string")),
        "id": k.cast("string"),
    }


def filled(template: str) -> Column:
    """A template with {names} as a column."""
    parts, known = [], values()
    for n, piece in enumerate(template.replace("}", "{").split("{")):
        parts.append(known[piece] if n % 2 else F.lit(piece))
    return F.concat(*parts)


def sourced(s, sf, template: str, around: bool = True):
    """The pages with two copies of a card between an opening and a closing part; `around`: of the page's own markup."""
    card = filled(template)
    own = F.col("html") if around else F.concat(F.lit("<script>"), F.replace("html", F.lit("</script"), F.lit("")), F.lit("</script>"))
    nest = F.concat(F.lit("<main><ul><li><b>x</b></li><li>"), card, F.lit("</li><li>"), card, F.lit("</ul></main>"))
    return pages(s, sf).select("page_id", F.concat(nest, own).alias("html"))


def registered(source: str, template: str, columns: dict[str, str], around: bool = True) -> None:
    """A query of a profile: the columns named, with their SQL over the page number."""
    listed = ", ".join(f"{sql} as {name}" for name, sql in columns.items())

    @query(f"u1_profile_{source}", None, f"select page_id, {listed} from pages")
    def _(s, sf):
        found = profiles.offers_from_pages(sourced(s, sf, template, around), profiles.PROFILES[source])
        return found.select("page_id", *columns)


registered(
    "carrefour",
    '<div class="x-bank-promotions-0-cardBox"><span class="v--dateText">{day}</span><div class="q logoIcon logoMain"></div><div class="logoIcon logoOnline"></div>'
    '<span class="t-ColLeftPercentage">{percent} %</span><img class="bank-promotions-a-Image" src="/img/{id}.png"><span class="ColRightTittle">Con {bank}</span>'
    '<span class="ColRightText">{name}</span><p>Legal de {name} con {bank}, hasta agotar existencias</p></div>',
    {
        "title": f"'Con ' || {BANK} || ' ' || {NAME}",
        "discount": f"{PERCENT} || '%'",
        "valid_days": DAY,
        "store_types": "'Hipermercado, Online'",
        "image_url": "'/img/' || page_id || '.png'",
        "terms_raw": f"'Legal de ' || {NAME} || ' con ' || {BANK} || ', hasta agotar existencias'",
    },
)
registered(
    "brubank",
    '<div class="special-card-carousel a card-promo-dark"><strong>{percent}% de reintegro</strong><h4 class="titulo-promo">{name}</h4><p class="parrafo-promo">Tope de reintegro: $ 5.000.</p></div>',
    {"title": NAME, "discount": f"{PERCENT} || '%'", "cap": "'$5.000'", "bank": "'Brubank'", "terms_raw": "'Tope de reintegro: $ 5.000.'"},
)
registered(
    "clublanacion",
    '<a href="/beneficios/aire-libre/{id}"><div><h4 class="text-16 b">{name}</h4><span class="text-32">{percent}%</span></div></a>',
    {
        "title": NAME,
        "discount": f"{PERCENT} || '%'",
        "url": "'https://club.lanacion.com.ar/beneficios/aire-libre/' || page_id",
        "categories": "'Aire Libre'",
    },
)
registered(
    "cuentadni",
    '<div class="callModalCDNI c BEN_filterDiv" id="beneficio-a-{id}"><div class="tituloBeneficio">{name}</div><div class="BEN_CON_dias">{day}</div><div class="BEN_CON_nro">{percent}%</div><img class="logo_recuadro" data-src="/l/{id}.svg"></div>',
    {"title": NAME, "discount": f"{PERCENT} || '%'", "valid_days": DAY, "image_url": "'/l/' || page_id || '.svg'", "detail_id": "cast(page_id as varchar)", "wallet": "'Cuenta DNI'"},
)
registered(
    "shell",
    '<div data-name="PromoSimple"><h3>{percent}% con {name}</h3><img src="/s/{id}.png" alt="logo"><p>ver<sup>(4)</sup></p></div>',
    {"title": f"{PERCENT} || '% con ' || {NAME}", "discount": f"{PERCENT} || '%'", "image_url": "'/s/' || page_id || '.png'", "footnote_num": "4"},
)
COTO_TEXT = "{percent}% DE DESCUENTO CON TARJETAS DE CRÉDITO DE {bank} LOS DÍAS {day}. TOPE DE REINTEGRO: $ 20.000 SEMANAL. " + "VÁLIDO EN TODAS LAS SUCURSALES DEL PAÍS, SIN ACUMULAR CON OTRAS PROMOCIONES VIGENTES EN EL LOCAL. " * 2
registered(
    "coto",
    "<p>" + COTO_TEXT + "</p>",
    {"discount": f"{PERCENT} || '%'", "cap": "'$20.000 semanal'", "terms_raw": "'" + COTO_TEXT.strip().replace("{percent}", f"' || {PERCENT} || '").replace("{bank}", f"' || {BANK} || '").replace("{day}", f"' || {DAY} || '") + "'"},
    around=False,
)
registered(
    "masonline",
    "<div>{percent}% de reintegro con {bank} los días {day}. Tope: $20.000 por usuario. Ver legal. Pagando en sucursal y online con la tarjeta.</div>",
    {"discount": f"{PERCENT} || '% reintegro'", "cap": "'$20.000 por usuario'"},
    around=False,
)
registered(
    "personalpay",
    "<article><h3>{name}</h3><p>{percent}% los {day}, con tope de $ 3.000 por mes</p></article>",
    {"discount": f"{PERCENT} || '%'", "cap": "'$3.000'", "valid_days": DAY, "wallet": "'Personal Pay'"},
    around=False,
)
registered(
    "buepp",
    '<mat-card><mat-card-title>{name}</mat-card-title><img src="/b/{id}.png"><span>{percent}% de ahorro</span></mat-card>',
    {"title": NAME, "discount": f"{PERCENT} || '%'", "image_url": "'/b/' || page_id || '.png'"},
)
registered(
    "generic",
    '<div class="promo-box"><h2>{name}</h2><span class="porcentaje">{percent}%</span><i class="bank-name">{bank}</i><small class="condiciones">Bases en el local</small><img src="/g/{id}.png"><a href="/g/{id}">ver</a></div>',
    {"title": NAME, "discount": f"{PERCENT} || '%'", "bank": BANK, "terms_raw": "'Bases en el local'", "image_url": "'/g/' || page_id || '.png'", "url": "'/g/' || page_id"},
)


@query(
    "u1_profile_puma",
    None,
    f"""select page_id, n as pos, {NAME} as title, {PERCENT} || '%' as discount, '$9.000' as cap, 'bases.pdf' as terms_url from pages, (select unnest([0, 1]) as n)""",
)
def _(s, sf):
    """A page of one offer has no key: what it shows twice stays twice."""
    template = (
        '<div class="a light-bg"><p class="heading">{name}</p><p class="details">{percent}% de descuento. Tope de reintegro: $ 9.000.</p>'
        '<img class="img-fluid" src="/p.png"><a class="stations" href="bases.pdf">bases</a></div>'
    )
    found = profiles.offers_from_pages(sourced(s, sf, template), profiles.PROFILES["puma"])
    return found.select("page_id", "pos", "title", "discount", "cap", "terms_url")


@query(
    "u1_profile_cencosud",
    None,
    f"""select page_id, {PERCENT} || '%' as discount, '/i/' || page_id || '-visa.png' as image_url from pages""",
)
def _(s, sf):
    """Cards hold one or two images; a block with more is a container."""
    template = '<div><img src="/i/{id}-visa.png" alt="visa"><span>{percent}% de descuento con Visa en la compra del día</span></div>'
    many = '<div><img src="a"><img src="b"><img src="c"><span>55% de descuento en bloques de tres imágenes</span></div>'
    found = profiles.offers_from_pages(sourced(s, sf, template + many, around=False), profiles.PROFILES["cencosud"])
    return found.select("page_id", "discount", "image_url")


@query("u2_select_blocks_modal", None, f"select page_id, 0 as block_pos, 'Beneficio de ' || {NAME} || ' ' || repeat('con tope y cuotas ', 5) || 'fin' as text from pages")
def _(s, sf):
    """The dialog of a card: elements inside and around it that say too little or nothing of an offer are no blocks."""
    template = '<div class="outer"><div class="vtex__modal a"><b>Beneficio de</b> {name} <i class="modal--x">' + "con tope y cuotas " * 5 + "</i>fin</div></div>"
    single = pages(s, sf).select("page_id", F.concat(filled(template), "html").alias("html"))
    found = blocks.select_blocks(single, blocks.BLOCK_RULES["modal"]).filter("block_pos = 0")
    return blocks.block_table(found, ["text"])


@query("u2_select_blocks_ads", None, f"select page_id, n as block_pos, 'Aviso ' || {NAME} as text from pages, (select unnest([0, 1]) as n)")
def _(s, sf):
    template = '<div class="box ad">Aviso {name}</div><div class="shade">no</div>'
    found = blocks.select_blocks(sourced(s, sf, template, around=False), blocks.BLOCK_RULES["ads"])
    return blocks.block_table(found, ["text"])
