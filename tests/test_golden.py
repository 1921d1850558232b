"""Golden rows: one text in, one expected value out."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from offerloom.functions import dates, money, rules, terms, text
from offerloom.operators import filters
from offerloom.sources import tables

AS_OF = dt.date(2026, 5, 20)


def value(spark, inputs, build):
    """Evaluate an expression over a one-row table of text inputs."""
    inputs = inputs if isinstance(inputs, tuple) else (inputs,)
    schema = ", ".join(f"c{i} string" for i in range(len(inputs)))
    row = spark.createDataFrame([inputs], schema).select(build(*[F.col(f"c{i}") for i in range(len(inputs))]).alias("v")).first()
    return row["v"]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("2026/2/3", "2026-02-03"),
        ("28/02/26", "2026-02-28"),
        ("28 de febrero de 2026", "2026-02-28"),
        ("1 de SETIEMBRE de 2026", "2026-09-01"),
        ("31/02/2026", "2026-02-31"),
        ("mañana", ""),
        (None, ""),
    ],
)
def test_date_text(spark, raw, expected):
    assert value(spark, raw, dates.normalize_date_text) == expected


def test_impossible_date_is_null(spark):
    assert value(spark, "31/02/2026", dates.normalize_date) is None


@pytest.mark.parametrize(
    "raw, profile, since, until",
    [
        ("SÁBADO 16, DOMINGO 17 Y LUNES 18 DE MAYO DE 2026", "coto", (2026, 5, 16), (2026, 5, 18)),
        ("SÁBADO 16 DE MAYO", "coto", (2026, 5, 16), (2026, 5, 16)),
        ("DESDE EL 18 HASTA EL 19 DE JULIO DE 2026", "coto", (2026, 7, 18), (2026, 7, 19)),
        ("VIGENCIA DESDE EL 01/10/2025 HASTA EL 31/03/2026", "masonline", (2025, 10, 1), (2026, 3, 31)),
        ("1 de diciembre de 2025 al 28 de febrero de 2026", "masonline", (2025, 12, 1), (2026, 2, 28)),
        ("válida durante febrero", "masonline", (2026, 2, 1), (2026, 2, 28)),
        ("todos los lunes de abril", "masonline", (2026, 4, 1), (2026, 4, 30)),
        ("del 3/5 al 9/5", "shell", (2026, 5, 3), (2026, 5, 9)),
        ("de febrero de 2028", "legal", (2028, 2, 1), (2028, 2, 29)),
        ("hasta 30/04", "base", None, (2026, 4, 30)),
    ],
)
def test_validity(spark, raw, profile, since, until):
    v = value(spark, raw, lambda c: dates.validity_from_text(c, profile, AS_OF))
    assert v["valid_from"] == (dt.date(*since) if since else None)
    assert v["valid_until"] == (dt.date(*until) if until else None)


def test_whole_month_of_leap_year(spark):
    v = value(spark, "TODOS LOS LUNES DE FEBRERO DE 2024", dates.validity_from_terms)
    assert (v["valid_from"], v["valid_until"]) == (dt.date(2024, 2, 1), dt.date(2024, 2, 29))


@pytest.mark.parametrize(
    "raw, profile, expected",
    [
        ("todos los lunes y jueves", "masonline", "Lunes, Jueves"),
        ("de lunes a domingo", "masonline", "Todos los días"),
        ("sábados, domingos y lunes", "masonline", "Lunes, Sábado, Domingo"),
        ("de jueves a martes", "masonline", "pestaña"),
        ("SÁBADO 16, DOMINGO 17 Y LUNES 18 DE MAYO DE 2026", "coto", "Sábado, Domingo, Lunes"),
        ("DE LUNES A JUEVES", "coto", "Lunes y Jueves"),
        ("lunes martes miercoles jueves viernes sabado", "dia", ""),
        ("los sábados y domingos", "puma", "los sábados y domingos"),
        ("LUNES A VIERNES", "wallet", "Lunes a viernes"),
        ("sin días", "wallet", "Todos los días"),
    ],
)
def test_days(spark, raw, profile, expected):
    assert value(spark, raw, lambda c: dates.extract_valid_days(c, profile, F.lit("pestaña"))) == expected


@pytest.mark.parametrize(
    "raw, profile, expected",
    [
        ("20% de reintegro", "masonline", "20% reintegro"),
        ("0% interés y 15% OFF", "masonline", "15%"),
        ("3x2", "base", "3x2"),
        ("$500 OFF", "base", "$500"),
        ("40% OFF", "base", "40%"),
        ("3, 6 y 12 cuotas sin interés", "cencosud", "3, 6 y 12 cuotas sin interés"),
        ("12 CSI", "cencosud", "12 cuotas sin interés"),
        ("6 cuotas sin interés", "dia", "6 CSI"),
        ("BENEFICIO DEL 30% Y 10% MÁS", "legal", "30%"),
        ("nada", "card", ""),
    ],
)
def test_discount(spark, raw, profile, expected):
    assert value(spark, raw, lambda c: money.extract_discount(c, profile)) == expected


@pytest.mark.parametrize(
    "raw, profile, expected",
    [
        ("tope de descuento de $4.500", "shell", "$4.500"),
        ("TOPE DE REINTEGRO: $ 20.000", "terms", "$20.000"),
        ("SIN TOPE DE REINTEGRO", "terms", "SIN TOPE"),
        ("Tope: $0. Máximo $3.000 por mes", "masonline", "$3.000 mensual"),
        ("Sin tope por usuario", "masonline", "Sin tope por usuario"),
        ("TOPE DE REINTEGRO $20.000 SEMANAL", "coto", "$20.000 semanal"),
        ("REEMBOLSO MÁXIMO: $ 7.000 POR CLIENTE", "coto", "$7.000 por cliente"),
        ("Tope $ 1.500,50", "wallet", "$1.500"),
    ],
)
def test_cap(spark, raw, profile, expected):
    assert value(spark, raw, lambda c: money.extract_cap(c, profile)) == expected


def test_partial_fragment(spark):
    assert value(spark, "+5% adicional", filters.is_partial_fragment) is True
    assert value(spark, "20% de descuento con MODO", filters.is_partial_fragment) is False


def test_dotnet_date(spark):
    assert value(spark, "/Date(1767225600000)/", dates.dotnet_date) == dt.date(2026, 1, 1)


@pytest.mark.parametrize(
    "raw, expected", [('["a"]', ["a"]), ('"a"', ["a"]), ("x", ["x"]), ("", []), (None, []), ("17", [])]
)
def test_json_text(spark, raw, expected):
    assert value(spark, raw, terms.json_text_to_array) == expected


@pytest.mark.parametrize(
    "raw, alt, bank, wallet",
    [
        ("20% con MODO y Galicia", "", "Banco Galicia", "MODO"),
        ("20% con MODO", "", "MODO", None),
        ("20% con BNA+ ", "", "", None),
        ("20% BNA", "", "Banco Nación", None),
        ("MásClub y Galicia", "", "Banco Galicia", None),
        ("Mas Club y Galicia", "", "MásClub", None),
        ("20% para jubilados", "mercado_pago.png", "Jubilados", None),
        ("20% off", "mercado_pago.png", "Mercado Pago", None),
        ("VISA y MASTERCARD", "", "Visa/Mastercard", None),
    ],
)
def test_bank_and_wallet(spark, raw, alt, bank, wallet):
    v = value(spark, (raw, alt), rules.bank_and_wallet)
    assert (v["bank"], v["wallet"]) == (bank, wallet)


def test_fanout_and_its_exclusion(spark):
    assert value(spark, "Billeteras virtuales: Mercado Pago y Prex", rules.fanout_wallets) == ["Mercado Pago", "Prex"]
    assert len(value(spark, "20% con billeteras virtuales", rules.fanout_wallets)) == 7
    assert value(spark, "No aplica con billeteras virtuales", rules.fanout_wallets) == []


def test_fuel_wallets(spark):
    assert value(spark, "Con Shell Box y Mercado Pago", rules.combined_wallet) == "Shell Box + Mercado Pago"


SAMPLE = """
    PROMOCIÓN VÁLIDA DESDE EL 01 AL 30 DE NOVIEMBRE DE 2025.
    15% DE DESCUENTO EXCLUSIVO TODOS LOS LUNES Y MARTES DE NOVIEMBRE DE 2025.
    SIN TOPE. QUEDAN EXCLUIDOS DEL DESCUENTO: ELECTRODOMÉSTICOS, TELEFONÍA, 
    CARNICERÍA (CARNE VACUNA, POLLO, CERDO Y EMBUTIDOS).
    NO ACUMULABLE CON OTRAS PROMOCIONES VIGENTES.
    EXCLUSIVO SOLO PARA CONSUMO FAMILIAR.
"""
LONG = (
    "PROMOCIÓN VÁLIDA TODOS LOS MIÉRCOLES DESDE EL 01 AL 30 DE NOVIEMBRE DE 2025 INCLUSIVE. BONIFICACIÓN DEL 10%. SIN TOPE DE "
    "REINTEGRO. VÁLIDA ÚNICAMENTE PARA VENTA MINORISTA, SE EXCLUYEN DE LA PROMOCIÓN ELECTRODOMÉSTICOS Y PRODUCTOS FRESCOS "
    "(QUESOS Y FIAMBRES). ACUMULABLE CON PRODUCTOS EN OFERTA."
)


def parsed(spark, raw):
    return terms.parse_terms(spark.createDataFrame([(raw,)], "raw string"), "raw").first()


def test_sample_terms(spark):
    row = parsed(spark, SAMPLE)
    assert row["exclusions"].startswith("ELECTRODOMÉSTICOS, TELEFONÍA") and row["exclusions"].endswith("EMBUTIDOS)")
    assert row["requirements"] == "CONSUMO FAMILIAR"
    assert row["valid_days"] == ["Lunes", "Martes"]
    assert row["cap"] == "SIN TOPE" and row["stackable"] is False
    assert (row["valid_from"], row["valid_until"]) == (dt.date(2025, 11, 1), dt.date(2025, 11, 30))


def test_long_terms(spark):
    row = parsed(spark, LONG)
    assert "ELECTRODOMÉSTICOS Y PRODUCTOS FRESCOS" in row["exclusions"]
    assert row["exclusions"] not in row["requirements"] and "TOPE" not in row["requirements"]
    assert row["requirements"].startswith("VENTA MINORISTA")
    assert row["stackable"] is True and row["cap"] == "SIN TOPE"


def test_empty_terms(spark):
    row = parsed(spark, None)
    assert (row["exclusions"], row["requirements"], row["valid_days"], row["cap"], row["stackable"]) == ("", "", [], "", None)


def test_fold_accents_decomposed_text(spark):
    assert value(spark, "Miércoles ñandú Ú ế", text.fold_accents) == "Miercoles nandu U e"


def test_match_spans_offsets(spark):
    spans = value(spark, "a 10% bb 20 % c", lambda c: text.match_spans(c, r"\d+\s*%"))
    assert [(s["start"], s["stop"], s["hit"]) for s in spans] == [(2, 5, "10%"), (9, 13, "20 %")]


def test_tab_day(spark):
    assert value(spark, "https://x.example/promos?dia=S%C3%A1bado", tables.tab_day) == "Sábado"


def test_result_files(spark, tmp_path):
    (tmp_path / "test_result_coto.json").write_text('[{"title": "a"}, {"title": "b"}]', encoding="utf-8")
    (tmp_path / "test_result_dia.json").write_text('[{"title": "c"}]', encoding="utf-8")
    rows = tables.read_result_files(spark, f"{tmp_path}/*.json").collect()
    assert sorted((r["source"], r["title"]) for r in rows) == [("Coto", "a"), ("Coto", "b"), ("Dia", "c")]


def test_detail_page_blocks(spark):
    from offerloom.operators import blocks

    html = (
        '<div class="light-bg"><p class="heading">20% <b>off</b></p><div><p class="details">Con MODO<br>hoy</p></div>'
        '<img class="img-fluid" data-src="/i.png"><a class="stations" href="/t.pdf">T&amp;C</a></div>'
    )
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    found = blocks.select_blocks(pages, blocks.BLOCK_RULES["detail_page"])
    row = blocks.block_table(found, ["title", "details", "image", "terms_url"]).collect()
    assert [tuple(r) for r in row] == [(1, 0, "20% off", "Con MODO hoy", "/i.png", "/t.pdf")]
