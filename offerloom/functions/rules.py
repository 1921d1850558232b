"""Entity rules: ordered (pattern, name) lists, and the expressions that apply them.

Modes of a rule set:
  word   literal substring of the lower-case text
  fold   literal substring of the lower-case text without accents
  upper  regular expression over the upper-case text
  lower  regular expression over the lower-case text
  any    regular expression, case ignored, over the text as it is
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import bind, contains_any, fold_accents, found, grab, or_blank, rx, spaced_name

# ---------------------------------------------------------------------------------------------
# Canonical names and the patterns that stand for them, in order of preference.

BANK = [
    ("carrefour banco", "Carrefour Banco"),
    ("carrefour crédito", "Carrefour Banco"),
    ("carrefour credito", "Carrefour Banco"),
    ("mi carrefour", "Carrefour Banco"),
    ("cuenta digital", "Carrefour Banco"),
    ("club la naci", "Club La Nación"),
    ("galicia", "Banco Galicia"),
    ("santander", "Santander"),
    ("bbva", "BBVA"),
    ("macro", "Macro"),
    ("icbc", "ICBC"),
    ("hsbc", "HSBC"),
    ("ciudad", "Banco Ciudad"),
    ("nacion", "Banco Nación"),
    ("patagonia", "Banco Patagonia"),
    ("credicoop", "Credicoop"),
    ("supervielle", "Supervielle"),
    ("frances", "Banco Francés"),
    ("itau", "Itaú"),
    ("comafi", "Comafi"),
    ("piano", "Piano"),
    ("bind", "Bind"),
]

WALLET = [
    ("mercado pago", "Mercado Pago"),
    ("ualá", "Ualá"),
    ("uala", "Ualá"),
    ("naranjax", "Naranja X"),
    ("naranja x", "Naranja X"),
    ("modo", "MODO"),
    ("personal pay", "Personal Pay"),
    ("cuenta dni", "Cuenta DNI"),
    ("claro pay", "Claro Pay"),
    ("tap", "Tap"),
    ("bimo", "Bimo"),
    ("prex", "Prex"),
]

BANK_FOLDED = [
    ("galicia", "Banco Galicia"),
    ("santander", "Santander"),
    ("bbva", "BBVA"),
    ("macro", "Macro"),
    ("icbc", "ICBC"),
    ("hsbc", "HSBC"),
    ("ciudad", "Banco Ciudad"),
    ("nacion", "Banco Nación"),
    ("provincia", "Banco Provincia"),
    ("patagonia", "Banco Patagonia"),
    ("credicoop", "Credicoop"),
    ("supervielle", "Supervielle"),
    ("frances", "Banco Francés"),
    ("itau", "Itaú"),
    ("comafi", "Banco Comafi"),
    ("carrefour banco", "Carrefour Banco"),
]

BANK_ABBREVIATION = [
    (r"\bbna\b", "Banco Nación"),
    (r"\bbbva\b", "BBVA"),
    (r"\bicbc\b", "ICBC"),
    (r"\bhsbc\b", "HSBC"),
]

WALLET_FOLDED = [
    ("cuenta dni", "Cuenta DNI"),
    ("mercado pago", "Mercado Pago"),
    ("uala", "Ualá"),
    ("naranja x", "Naranja X"),
    ("modo", "MODO"),
    ("personal pay", "Personal Pay"),
    ("club la nacion", "Club La Nación"),
    ("mi carrefour", "Mi Carrefour"),
]

BANK_SHORT = [
    ("galicia", "Banco Galicia"),
    ("santander", "Santander"),
    ("bbva", "BBVA"),
    ("macro", "Macro"),
    ("icbc", "ICBC"),
    ("hsbc", "HSBC"),
    ("ciudad", "Banco Ciudad"),
    ("nacion", "Banco Nación"),
    ("provincia", "Banco Provincia"),
    ("patagonia", "Banco Patagonia"),
    ("credicoop", "Credicoop"),
    ("supervielle", "Supervielle"),
    ("frances", "Banco Francés"),
    ("itau", "Itaú"),
]

WALLET_SHORT = [
    ("cuenta dni", "Cuenta DNI"),
    ("mercado pago", "Mercado Pago"),
    ("ualá", "Ualá"),
    ("uala", "Ualá"),
    ("naranja x", "Naranja X"),
    ("modo", "MODO"),
    ("personal pay", "Personal Pay"),
]

BANK_COTO = [
    (r"BANCO\s+MACRO|MACRO\s+SELECTA?", "Banco Macro"),
    (r"BANCO\s+(?:DE\s+LA\s+)?NACI[OÓ]N|BNA\b", "Banco Nación"),
    (r"BANCO\s+CIUDAD", "Banco Ciudad"),
    (r"BANCO\s+(?:DE\s+LA\s+)?PROVINCIA|BAPRO", "Banco Provincia"),
    (r"GALICIA", "Banco Galicia"),
    (r"SANTANDER", "Banco Santander"),
    (r"\bHSBC\b", "HSBC"),
    (r"\bBBVA\b|BANCO\s+FRANC[EÉ]S", "BBVA"),
    (r"\bICBC\b", "ICBC"),
    (r"PATAGONIA", "Banco Patagonia"),
    (r"SUPERVIELLE", "Banco Supervielle"),
    (r"CREDICOOP", "Banco Credicoop"),
    (r"HIPOTECARIO", "Banco Hipotecario"),
    (r"COMAFI", "Banco Comafi"),
    (r"COLUMBIA", "Banco Columbia"),
    (r"BANCO\s+C[OÓ]RDOBA|BANCOR", "Bancor"),
    (r"\bNARANJA\s*X\b|\bPLAN\s*Z\b|\bTARJETA\s+NARANJA\b", "Naranja X"),
    (r"MERCADO\s*PAGO", "Mercado Pago"),
    (r"\bMODO\b", "MODO"),
    (r"\bANSES\b", "ANSES"),
    (r"\bPAMI\b", "PAMI"),
    (r"\bJUBILADOS?\b", "Jubilados"),
]

BANK_DIA_CLASS = [
    (r"^Modo$", "MODO"),
    (r"^Prex$", "Prex"),
    (r"^Personal\s*Pay", "Personal Pay"),
    (r"^Mercado\s*Pago", "Mercado Pago"),
    (r"^Banco\s*Columbia", "Banco Columbia"),
    (r"^Banco\s*del\s*Sol", "Banco del Sol"),
    (r"Visa.*Master|Master.*Visa", "Visa/Mastercard"),
    (r"^Naranja", "Naranja X"),
    (r"^Cuenta\s*DNI", "Cuenta DNI"),
    (r"^Anses", "Beneficios ANSES"),
    (r"^Sidecreer", "Sidecreer"),
    (r"^Tarjeta\s*BA", "Tarjeta BA"),
    (r"^BNA$|^Banco\s*Naci", "Banco Nación"),
    (r"^Modo.*BNA|^BNA.*Modo", "MODO + BNA"),
    (r"^Galicia", "Banco Galicia"),
]

BANK_DIA_IMAGE = [
    (r"modo", "MODO"),
    (r"prex", "Prex"),
    (r"personal.?pay", "Personal Pay"),
    (r"mercado.?pago", "Mercado Pago"),
    (r"naranja", "Naranja X"),
    (r"cuenta.?dni", "Cuenta DNI"),
    (r"anses", "Beneficios ANSES"),
    (r"galicia", "Banco Galicia"),
    (r"macro", "Banco Macro"),
    (r"nacion|bna", "Banco Nación"),
    (r"ciudad", "Banco Ciudad"),
    (r"santander", "Banco Santander"),
    (r"patagonia", "Banco Patagonia"),
    (r"comafi", "Banco Comafi"),
    (r"hsbc", "HSBC"),
    (r"bbva|franc[eé]s", "BBVA"),
    (r"icbc", "ICBC"),
    (r"credicoop", "Banco Credicoop"),
    (r"supervielle", "Supervielle"),
    (r"columbia", "Banco Columbia"),
]

BANK_CENCOSUD_IMAGE = [
    (r"hipotecario", "Banco Hipotecario"),
    (r"supervielle", "Supervielle"),
    (r"galicia", "Banco Galicia"),
    (r"macro", "Banco Macro"),
    (r"nacion|bna[^c]|banco.?nacion", "Banco Nación"),
    (r"ciudad", "Banco Ciudad"),
    (r"provincia|bapro", "Banco Provincia"),
    (r"santander", "Banco Santander"),
    (r"patagonia", "Banco Patagonia"),
    (r"comafi", "Banco Comafi"),
    (r"c[oó]rdoba|bancor", "Bancor"),
    (r"columbia", "Banco Columbia"),
    (r"hsbc", "HSBC"),
    (r"bbva|franc[eé]s", "BBVA"),
    (r"icbc", "ICBC"),
    (r"credicoop", "Banco Credicoop"),
    (r"modo", "MODO"),
    (r"mercado[-_]?pago|mp[-_]logo", "Mercado Pago"),
    (r"prex", "Prex"),
    (r"personal[-_]?pay", "Personal Pay"),
    (r"cuenta[-_]?dni", "Cuenta DNI"),
    (r"ual[aá]", "Ualá"),
    (r"cencopay|cencosud|cencop", "CencoPay"),
    (r"naranja", "Naranja X"),
    (r"clarin|365", "Clarín 365"),
    (r"tarjeta.?sol|sol.?tarjeta", "Tarjeta Sol"),
    (r"amex|american", "American Express"),
    (r"visa[-_]?master|master[-_]?visa", "Visa/Mastercard"),
    (r"visa", "Visa"),
    (r"mastercard|master", "Mastercard"),
]

BANK_CENCOSUD_TEXT = [
    (r"BANCO\s+HIPOTECARIO", "Banco Hipotecario"),
    (r"SUPERVIELLE", "Supervielle"),
    (r"BANCO\s+(?:DE\s+)?GALICIA", "Banco Galicia"),
    (r"BANCO\s+MACRO", "Banco Macro"),
    (r"BANCO\s+(?:DE\s+LA\s+)?NACI[OÓ]N", "Banco Nación"),
    (r"BANCO\s+CIUDAD", "Banco Ciudad"),
    (r"BANCO\s+(?:DE\s+LA\s+)?PROVINCIA", "Banco Provincia"),
    (r"BANCO\s+SANTANDER", "Banco Santander"),
    (r"BANCO\s+PATAGONIA", "Banco Patagonia"),
    (r"BANCO\s+COMAFI", "Banco Comafi"),
    (r"BANCOR|BANCO\s+(?:DE\s+)?C[OÓ]RDOBA", "Banco Córdoba"),
    (r"\bHSBC\b", "HSBC"),
    (r"\bBBVA\b", "BBVA"),
    (r"\bICBC\b", "ICBC"),
]

WALLET_CENCOSUD_TEXT = [
    (r"\bMODO\b", "MODO"),
    (r"MERCADO\s*PAGO", "Mercado Pago"),
    (r"\bPREX\b", "Prex"),
    (r"PERSONAL\s+PAY", "Personal Pay"),
    (r"CUENTA\s+DNI", "Cuenta DNI"),
    (r"\bUAL[AÁ]\b", "Ualá"),
    (r"\bCENCOPAY\b", "CencoPay"),
    (r"NARANJA\s*X?|TARJETA\s+NARANJA", "Naranja X"),
    (r"CLAR[IÍ]N\s*365", "Clarín 365"),
    (r"TARJETA\s+SOL", "Tarjeta Sol"),
]

# Short or long issuer name (upper case) -> canonical name.
ISSUER_NAME = {
    "GALICIA": "Banco Galicia",
    "BANCO GALICIA": "Banco Galicia",
    "BANCO DE GALICIA": "Banco Galicia",
    "MACRO": "Banco Macro",
    "BANCO MACRO": "Banco Macro",
    "NACION": "Banco Nación",
    "BANCO NACION": "Banco Nación",
    "BANCO DE LA NACION": "Banco Nación",
    "CIUDAD": "Banco Ciudad",
    "BANCO CIUDAD": "Banco Ciudad",
    "PROVINCIA": "Banco Provincia",
    "BANCO PROVINCIA": "Banco Provincia",
    "BANCO DE LA PROVINCIA": "Banco Provincia",
    "SANTANDER": "Banco Santander",
    "BANCO SANTANDER": "Banco Santander",
    "PATAGONIA": "Banco Patagonia",
    "BANCO PATAGONIA": "Banco Patagonia",
    "SUPERVIELLE": "Supervielle",
    "BANCO SUPERVIELLE": "Supervielle",
    "COMAFI": "Banco Comafi",
    "BANCO COMAFI": "Banco Comafi",
    "HIPOTECARIO": "Banco Hipotecario",
    "BANCO HIPOTECARIO": "Banco Hipotecario",
    "HSBC": "HSBC",
    "BBVA": "BBVA",
    "ICBC": "ICBC",
    "BANCOR": "Banco Córdoba",
    "BANCO CORDOBA": "Banco Córdoba",
}

LOYALTY = [
    (r"M[AÂ]S\s*CLUB|MASCLUB", "MásClub"),
    (r"CLUB\s*DIA|CLUB\s*D[IÍ]A", "Club Día"),
    (r"CLUB\s*CARREFOUR", "Club Carrefour"),
    (r"COMUNIDAD\s*COTO", "Comunidad Coto"),
]

BENEFICIARY = [
    (r"EMPLEADOS?\s+MUNICIPALES?", "Empleados Municipales"),
    (r"EMPLEADOS?\s+PROVINCIALES?", "Empleados Provinciales"),
    (r"EMPLEADOS?\s+P[UÚ]BLICOS?", "Empleados Públicos"),
    (r"JUBILADOS?\s+Y\s+PENSIONADOS?", "Jubilados y Pensionados"),
    (r"JUBILADOS?", "Jubilados"),
    (r"PENSIONADOS?", "Pensionados"),
    (r"ANSES", "ANSES"),
]

BANK_LAYERED = [
    (r"COMAFI", "Banco Comafi"),
    (r"GALICIA", "Banco Galicia"),
    (r"MACRO", "Banco Macro"),
    (r"NACI[OÓ]N|(?<!\+)BNA(?!\+)", "Banco Nación"),
    (r"BANCO\s*CIUDAD|\bCIUDAD\s+BANCO\b", "Banco Ciudad"),
    (r"BANCO\s*PROVINCIA|\bPROVINCIA\s+BANCO\b|BAPRO\b", "Banco Provincia"),
    (r"SANTANDER", "Banco Santander"),
    (r"BANCO\s*PATAGONIA|\bPATAGONIA\s+BANCO\b", "Banco Patagonia"),
    (r"SUPERVIELLE", "Supervielle"),
    (r"HIPOTECARIO", "Banco Hipotecario"),
    (r"CREDICOOP", "Banco Credicoop"),
    (r"\bHSBC\b", "HSBC"),
    (r"\bBBVA\b", "BBVA"),
    (r"\bICBC\b", "ICBC"),
    (r"BRUBANK", "Brubank"),
    (r"WILOBANK", "Wilobank"),
    (r"BIND|INDUSTRIAL", "Banco Industrial"),
    (r"FRANCES", "Banco Francés"),
    (r"ITAU|ITA[UÚ]", "Itaú"),
    (r"BANCO\s*COLUMBIA", "Banco Columbia"),
    (r"PIANO", "Banco Piano"),
    (r"BICA", "Banco BICA"),
    (r"ROELA", "Banco Roela"),
    (r"SAN JUAN", "Banco San Juan"),
    (r"SANTA FE", "Banco Santa Fe"),
    (r"ENTRE R[IÍ]OS", "Banco Entre Ríos"),
    (r"CHUBUT", "Banco Chubut"),
    (r"NEUQU[EÉ]N", "Banco Neuquén"),
    (r"TIERRA DEL FUEGO", "Banco Tierra del Fuego"),
    (r"BANCO\s*(?:DE\s+)?CORRIENTES", "Banco Corrientes"),
    (r"FORMOSA", "Banco Formosa"),
    (
        r"TARJETA\s+SOL|(?:TARJETA|CR[EÉ]DITO|D[EÉ]BITO)\s+(?:DE\s+)?SOL|\bSOL\b\s*(?:CR[EÉ]DITO|D[EÉ]BITO)|\(SL\)",
        "Tarjeta Sol",
    ),
    (r"NEVADA", "Tarjeta Nevada"),
    (r"GRUPAR", "Tarjeta Grupar"),
    (r"CORDOBESA", "Tarjeta Cordobesa"),
    (r"TARJETA\s+SHOPPING", "Tarjeta Shopping"),
    (r"NATIVA", "Tarjeta Nativa"),
    (r"CMR", "CMR Falabella"),
    (r"CENCOSUD", "Tarjeta Cencosud"),
    (r"BANCO\s+NARANJA", "Naranja X"),
    (r"YOY", "YOY"),
    (r"CREDICUOTAS?", "Credicuotas"),
    (r"TARJETA\s+TUYA|\bTUYA\b", "Tarjeta Tuya"),
]

WALLET_LAYERED = [
    (r"\bMODO\b", "MODO"),
    (r"MERCADO\s*PAGO", "Mercado Pago"),
    (r"\bPREX\b", "Prex"),
    (r"PERSONAL\s*PAY", "Personal Pay"),
    (r"CUENTA\s*DNI", "Cuenta DNI"),
    (r"\bUAL[AÁ]\b", "Ualá"),
    (r"NARANJA\s*X", "Naranja X"),
    (r"\bYAPE\b", "Yape"),
    (r"\bBNA\+\b|\bBNA\s*MAS\b", "BNA+"),
]

WALLET_AS_ISSUER = ["Mercado Pago", "Ualá", "Naranja X", "Prex", "Personal Pay", "Cuenta DNI", "MODO"]

NETWORK = [
    (r"VISA.*MASTERCARD|MASTERCARD.*VISA", "Visa/Mastercard"),
    (r"\bVISA\b", "Visa"),
    (r"\bMASTERCARD\b|\bMASTER\b", "Mastercard"),
]

WALLET_FANOUT = [
    (r"MERCADO\s*PAGO", "Mercado Pago"),
    (r"CUENTA\s*DNI", "Cuenta DNI"),
    (r"PERSONAL\s*PAY", "Personal Pay"),
    (r"NARANJA\s*X", "Naranja X"),
    (r"\bUAL[AÁ]\b", "Ualá"),
    (r"\bPREX\b", "Prex"),
    (r"\bMODO\b", "MODO"),
    (r"\bYAPE\b", "Yape"),
    (r"\bBNA\+\b|\bBNA\s*MAS\b", "BNA+"),
]

WALLET_FANOUT_DEFAULT = ["Mercado Pago", "MODO", "Naranja X", "Ualá", "Personal Pay", "Prex", "Cuenta DNI"]

BANK_SHELL = [
    (r"BANCO\s+CIUDAD|CIUDAD\s+DE\s+BUENOS\s+AIRES", "Banco Ciudad"),
    (r"GALICIA\b", "Banco Galicia"),
    (r"COMAFI\b", "Banco Comafi"),
    (r"SUPERVIELLE\b", "Banco Supervielle"),
    (r"PATAGONIA\b", "Banco Patagonia"),
    (r"MACRO\b", "Banco Macro"),
    (r"SANTANDER", "Banco Santander"),
    (r"BBVA|FRANC[EÉ]S", "BBVA"),
    (r"ICBC", "ICBC"),
    (r"HSBC", "HSBC"),
    (r"CREDICOOP", "Banco Credicoop"),
    (r"HIPOTECARIO", "Banco Hipotecario"),
    (r"COLUMBIA", "Banco Columbia"),
    (r"PROVINCIA|BAPRO", "Banco Provincia"),
    (r"NACI[OÓ]N|BNA\b", "Banco Nación"),
    (r"NARANJA", "Naranja X"),
    (r"SERVICIOS\s+DE\s+CUOTAS\s*SA|TARSHOP", "Tarshop/Servicios"),
]

WALLET_SHELL = [
    (r"SHELL\s*BOX", "Shell Box"),
    (r"TARJETA\s*365|CLUB\s*CLAR[IÍ]N", "Club Clarín/365"),
    (r"CLUB\s+EASY", "Club Easy"),
    (r"JUMBO\+|VEA\s+AHORRO", "Jumbo+/Vea Ahorro"),
    (r"MERCADO\s*PAGO", "Mercado Pago"),
    (r"PERSONAL\s*PAY", "Personal Pay"),
    (r"CUENTA\s*DNI", "Cuenta DNI"),
    (r"\bUAL[AÁ]\b", "Ualá"),
    (r"\bMODO\b", "MODO"),
    (r"\bPREX\b", "Prex"),
]

CARD_TYPES = [
    (r"\bVISA\b", "Visa"),
    (r"\bMASTERCARD\b|\bMASTER\s*CARD\b|\bMASTER\b", "Mastercard"),
    (r"\bCABAL\b", "Cabal"),
    (r"\bAMERICAN\s*EXPRESS\b|\bAMEX\b", "American Express"),
    (r"\bNARANJA(?!\s*X)\b", "Naranja"),
    (r"\bMAESTRO\b", "Maestro"),
    (r"\bDINERS\b", "Diners"),
]

CARD_TYPES_COTO = [
    (r"\bVISA\b", "Visa"),
    (r"\bMASTERCARD\b|\bMASTER\s*CARD\b", "Mastercard"),
    (r"\bCABAL\b", "Cabal"),
    (r"\bAMEX\b|\bAMERICAN\s*EXPRESS\b", "American Express"),
    (r"\bNARANJA\b", "Naranja"),
]

CARD_TYPES_CENCOSUD = [
    (r"VISA", "Visa"),
    (r"MASTERCARD", "Mastercard"),
    (r"CABAL", "Cabal"),
    (r"AMERICAN EXPRESS|AMEX", "American Express"),
    (r"NARANJA", "Naranja"),
]

# Image-name cascade: all words of one alternative must be present -> (bank, wallet, card type).
IMAGE_CASCADE = [
    ([["cuenta_dni"], ["cuentadni"]], ("Banco Provincia", "Cuenta DNI", None)),
    ([["mercadopago"], ["mercado_pago"], ["mercado-pago"]], (None, "Mercado Pago", None)),
    ([["modo"]], (None, "MODO", None)),
    ([["carrefour", "credito"]], ("Carrefour Banco", None, "Tarjeta Mi Carrefour Crédito")),
    ([["carrefour", "prepaga"]], ("Carrefour Banco", None, "Tarjeta Mi Carrefour Prepaga")),
    ([["carrefour", "digital"]], ("Carrefour Banco", None, "Cuenta Digital Carrefour")),
    ([["bna"], ["banco-nacion"], ["banconacion"]], ("Banco Nación", None, None)),
    ([["anses"]], ("ANSES", None, None)),
    ([["clublanacion"], ["club-la-nacion"], ["club_la_nacion"]], ("Club La Nación", None, None)),
    ([["naranja"]], (None, None, "Naranja")),
    ([["galicia"]], ("Banco Galicia", None, None)),
    ([["santander"]], ("Santander", None, None)),
    ([["patagonia"]], ("Banco Patagonia", None, None)),
    ([["provincia"]], ("Banco Provincia", None, None)),
    ([["supervielle"]], ("Supervielle", None, None)),
    ([["macro"]], ("Macro", None, None)),
    ([["hsbc"]], ("HSBC", None, None)),
    ([["icbc"]], ("ICBC", None, None)),
    ([["ciudad"]], ("Banco Ciudad", None, None)),
    ([["carrefour"]], ("Carrefour Banco", None, None)),
]

# Older image cascade -> (bank, wallet, card type, payment method).
IMAGE_CASCADE_TITLE = [
    ([["cuenta_dni"], ["cuentadni"]], ("Banco Provincia", None, None, "Cuenta DNI")),
    ([["mercadopago"], ["mercado_pago"], ["mercado-pago"]], (None, "Mercado Pago", None, None)),
    ([["carrefour", "credito"]], ("Banco de Servicios Financieros", None, "Tarjeta Mi Carrefour Crédito", None)),
    ([["carrefour", "prepaga"]], ("Banco de Servicios Financieros", None, "Tarjeta Mi Carrefour Prepaga", None)),
    ([["visa", "mc"]], (None, None, "Visa, Mastercard", None)),
    ([["visa"]], (None, None, "Visa", None)),
    ([["mastercard"], ["_mc"], ["mc."]], (None, None, "Mastercard", None)),
    ([["bna"], ["nacion"]], ("Banco Nación", None, None, None)),
    ([["club", "nacion"]], ("Club La Nación", None, None, None)),
    ([["naranja"]], (None, None, "Naranja", None)),
]

# Text cascade used when the image said nothing -> (bank, wallet, card type, payment method).
TEXT_CASCADE = [
    ([["cuenta dni"], ["cuentadni"]], ("Banco Provincia", None, None, "Cuenta DNI")),
    ([["mercado pago"]], (None, "Mercado Pago", None, None)),
    (
        [["mi carrefour", "crédito"], ["mi carrefour", "credito"], ["micarrefour", "crédito"], ["micarrefour", "credito"]],
        ("Banco de Servicios Financieros", None, "Tarjeta Mi Carrefour Crédito", None),
    ),
    (
        [["mi carrefour", "prepaga"], ["micarrefour", "prepaga"]],
        ("Banco de Servicios Financieros", None, "Tarjeta Mi Carrefour Prepaga", None),
    ),
    (
        [["mi carrefour", "digital"], ["micarrefour", "digital"]],
        ("Banco de Servicios Financieros", None, "Cuenta Digital Mi Carrefour", None),
    ),
    ([["mi carrefour"], ["micarrefour"]], ("Banco de Servicios Financieros", None, None, None)),
    ([["banco nación"], ["banco nacion"], ["bna"]], ("Banco Nación", None, None, None)),
    ([["club la nación"], ["club la nacion"]], ("Club La Nación", None, None, None)),
    ([["visa", "mastercard"]], (None, None, "Visa, Mastercard", None)),
    ([["mastercard"]], (None, None, "Mastercard", None)),
    ([["visa"]], (None, None, "Visa", None)),
    ([["naranja"]], (None, None, "Naranja", None)),
    ([["modo"]], (None, None, None, "MODO")),
]

# Words that make a text an offer text for the embedded-JSON reader.
OFFER_WORDS = ["descuento", "promoción", "oferta"]

# End of fixed values.
# ---------------------------------------------------------------------------------------------

RULE_SETS: dict[str, tuple[str, str, list[tuple[str, str]]]] = {
    # rule set: (mode, kind, rules)
    "bank": ("word", "bank", BANK),
    "wallet": ("word", "wallet", WALLET),
    "bank_folded": ("fold", "bank", BANK_FOLDED),
    "bank_abbreviation": ("lower", "bank", BANK_ABBREVIATION),
    "wallet_folded": ("fold", "wallet", WALLET_FOLDED),
    "bank_short": ("word", "bank", BANK_SHORT),
    "wallet_short": ("word", "wallet", WALLET_SHORT),
    "coto": ("upper", "bank", BANK_COTO),
    "dia_class": ("any", "bank", BANK_DIA_CLASS),
    "dia_image": ("lower", "bank", BANK_DIA_IMAGE),
    "cencosud_image": ("lower", "bank", BANK_CENCOSUD_IMAGE),
    "cencosud_text": ("upper", "bank", BANK_CENCOSUD_TEXT),
    "cencosud_wallet": ("upper", "wallet", WALLET_CENCOSUD_TEXT),
    "loyalty": ("upper", "club", LOYALTY),
    "beneficiary": ("upper", "club", BENEFICIARY),
    "layered_bank": ("upper", "bank", BANK_LAYERED),
    "layered_wallet": ("upper", "wallet", WALLET_LAYERED),
    "network": ("upper", "network", NETWORK),
    "wallet_fanout": ("upper", "wallet", WALLET_FANOUT),
    "shell_bank": ("upper", "bank", BANK_SHELL),
    "shell_wallet": ("upper", "wallet", WALLET_SHELL),
}


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern that no group encloses."""
    parts, depth, last = [""], 0, ""
    for char in pattern:
        if last != "\\":
            depth += (char in "([") - (char in ")]")
            if char == "|" and depth == 0:
                parts.append("")
                last = char
                continue
        parts[-1] += char
        last = "" if last == "\\" else char
    return parts


def literal_runs(pattern: str, literal: bool) -> list[list[str]]:
    """Per alternative the lower-case texts that a match of it holds; none at all where an alternative does not tell."""
    if literal:
        return [[pattern.lower()]]
    found = []
    for part in _alternatives(pattern):
        # Classes, groups and escapes end a run of letters; so does a letter that may be missing.
        plain = re.sub(r"\[[^\]]*\][?*+]?|\\[A-Za-z][?*+]?|\\.", "\0", part)
        while (inner := re.sub(r"\([^()]*\)[?*+]?", "\0", plain)) != plain:
            plain = inner
        runs = re.findall(r"[^\W_]+", re.sub(r".[?*]|.\{[^}]*\}", "\0", plain))
        if not runs or len(max(runs, key=len)) < 2:
            return []
        found.append([run.lower() for run in runs])
    return found


def literal_factors(pattern: str, literal: bool) -> list[str]:
    """Lower-case texts of which every match holds at least one; none where the pattern does not tell."""
    return [max(runs, key=len) for runs in literal_runs(pattern, literal)]


def plain_words(pattern: str, mode: str) -> list[str] | None:
    """The texts that a pattern stands for, if it is a list of plain words."""
    if mode in ("word", "fold"):
        return [pattern]
    alternatives = pattern.split("|")
    return alternatives if mode != "any" and all(re.fullmatch(r"[\w ]+", a) for a in alternatives) else None


def rule_sets(spark: SparkSession) -> DataFrame:
    """All rule sets as rows: rule_set, priority, mode, kind, pattern, name, regex and words (null for those of the other kind), factors and runs.

    Every match holds one of the factors, and all texts of one of the lists in runs.
    """
    rows = []
    for rule_set, (mode, kind, rules) in RULE_SETS.items():
        literal = mode in ("word", "fold")
        for priority, (pattern, name) in enumerate(rules):
            regex = None if literal else rx(pattern, ci=mode == "any")
            words = plain_words(pattern, mode)
            rows.append((rule_set, priority, mode, kind, pattern, name, regex, words, literal_factors(pattern, literal), literal_runs(pattern, literal)))
    return spark.createDataFrame(
        rows,
        "rule_set string, priority int, mode string, kind string, pattern string, name string, regex string, words array<string>, factors array<string>, runs array<array<string>>",
    )


def shaped(text: Column, mode: str) -> Column:
    text = or_blank(text)
    if mode == "upper":
        return F.upper(text)
    if mode in ("word", "lower"):
        return F.lower(text)
    if mode == "fold":
        return fold_accents(F.lower(text))
    return text


def required_literal(pattern: str) -> str | None:
    """Leading letters every match must hold, or None: a cheap test before the regular expression."""
    body = pattern.removeprefix(r"\b")
    depth = 0
    for char in body:
        depth += (char in "([") - (char in ")]")
        if char == "|" and depth == 0:
            return None
    lead = re.match(r"[^\W\d_]+", body)
    if lead is None:
        return None
    word = lead.group()
    if body[len(word) : len(word) + 1] in ("?", "*", "{"):
        word = word[:-1]
    return word if len(word) >= 3 else None


def hit(prepared: Column, mode: str, pattern: str) -> Column:
    """Does the rule match? Plain words are searched as substrings, which is far cheaper than a regex."""
    if mode in ("word", "fold"):
        return prepared.contains(pattern)
    alternatives = pattern.split("|")
    if mode != "any" and all(re.fullmatch(r"[\w ]+", a) for a in alternatives):
        test = prepared.contains(alternatives[0])
        for word in alternatives[1:]:
            test = test | prepared.contains(word)
        return test
    test = prepared.rlike(rx(pattern, ci=mode == "any"))
    word = required_literal(pattern) if mode != "any" else None
    return prepared.contains(word) & test if word else test


def classify(text: Column, rule_set: str, prepared: bool = False) -> Column:
    """Name of the first rule that matches; NULL when none does."""
    mode, _, rules = RULE_SETS[rule_set]

    def chain(form: Column) -> Column:
        first, *rest = rules
        out = F.when(hit(form, mode, first[0]), F.lit(first[1]))
        for pattern, name in rest:
            out = out.when(hit(form, mode, pattern), F.lit(name))
        return out

    return chain(text) if prepared else bind(shaped(text, mode), chain)


def all_hits(text: Column, rules: list[tuple[str, str]], mode: str = "upper") -> Column:
    """Names of every matching rule, in rule order."""
    return bind(
        shaped(text, mode),
        lambda form: F.array_compact(F.array(*[F.when(hit(form, mode, p), F.lit(n)) for p, n in rules])),
    )


def cascade(text: Column, rules: list) -> dict[str, Column]:
    """First rule whose words are all present decides every target column at once."""
    width = len(rules[0][1])
    names = ("bank", "wallet", "card_type", "payment_method")[:width]
    out = {}
    for position, name in enumerate(names):
        chain = None
        for alternatives, targets in rules:
            test = F.lit(False)
            for words in alternatives:
                both = F.lit(True)
                for word in words:
                    both = both & text.contains(word)
                test = test | both
            value = F.lit(targets[position]).cast("string")
            chain = F.when(test, value) if chain is None else chain.when(test, value)
        out[name] = chain
    return out


def first_label(text: Column, pairs: list[tuple[str, str]], ci: bool = True) -> Column:
    out = None
    for pattern, label in pairs:
        test = found(text, pattern, ci)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out


# --- entities -----------------------------------------------------------------------------------


def bank_folded(text: Column) -> Column:
    return bind(
        fold_accents(F.lower(or_blank(text))),
        lambda form: F.coalesce(
            classify(form, "bank_folded", prepared=True), classify(form, "bank_abbreviation", prepared=True)
        ),
    )


def wallet_folded(text: Column) -> Column:
    return classify(text, "wallet_folded")


def bank_from_class(raw: Column) -> Column:
    """Issuer from a CSS class label; unknown labels become capitalised words."""
    label = F.trim(or_blank(raw))
    words = F.array_join(
        F.transform(
            F.filter(F.split(label, r"\s+"), lambda w: w != ""),
            lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))),
        ),
        " ",
    )
    return F.when(label.isin("", ","), F.lit("")).otherwise(
        F.coalesce(classify(label, "dia_class"), F.when((F.length(label) > 1), words).otherwise(F.lit("")))
    )


def issuer_name(raw: Column) -> Column:
    keys = F.create_map(*[F.lit(x) for pair in ISSUER_NAME.items() for x in pair])
    return F.coalesce(F.try_element_at(keys, F.upper(F.trim(raw))), F.initcap(raw))


def bank_mentions(text: Column, rule_set: str = "cencosud_text") -> Column:
    """How often each issuer pattern occurs: array<struct<name,n>> of the issuers present."""
    mode, _, rules = RULE_SETS[rule_set]

    def counts(form: Column) -> Column:
        return F.array(
            *[
                F.struct(F.lit(name).alias("name"), F.regexp_count(form, F.lit(rx(pattern, False))).alias("n"))
                for pattern, name in rules
            ]
        )

    return F.filter(bind(shaped(text, mode), counts), lambda x: x["n"] > 0)


CLIENTS_OF = r"(?:CLIENTES?\s+(?:DE\s+)?|TARJETAS?\s+(?:DE\s+)?)"
ISSUED_BY = (
    r"(?:CLIENTES?\s+(?:DE\s+)?|TARJETAS?\s+(?:DE\s+)?|EMITIDAS?\s+POR\s+)"
    r"(BANCO\s+\w+|SUPERVIELLE|HIPOTECARIO|GALICIA|MACRO|SANTANDER)"
)


def bank_in_context(text: Column) -> Column:
    """Issuer of a text that may name several: wallet route first, then the single or contextual mention."""
    return bind(F.upper(or_blank(text)), _bank_in_context)


def _bank_in_context(upper: Column) -> Column:
    _, _, rules = RULE_SETS["cencosud_text"]
    present = bank_mentions(upper)
    via_modo = upper.contains("TRAVÉS DE MODO") | upper.contains("CON MODO")
    issuer = bind(grab(upper, ISSUED_BY, 1, ci=False), issuer_name)
    modo_list = found(upper, r"PAGANDO\s+CON\s+MODO", False) & found(upper, r"PARTICIPAN\s+BANCO", False)
    contextual = None
    for pattern, name in rules:
        test = found(upper, f"{CLIENTS_OF}(?:{pattern})", False)
        contextual = F.when(test, F.lit(name)) if contextual is None else contextual.when(test, F.lit(name))
    by_mention = bind(
        present,
        lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0))["name"]).when(F.size(x) > 1, contextual),
    )
    return or_blank(
        F.coalesce(
            F.when(via_modo, issuer),
            F.when(via_modo & modo_list, F.lit("MODO")),
            by_mention,
            classify(upper, "cencosud_wallet", prepared=True),
        )
    )


def bank_and_wallet(text: Column, image_alt: Column) -> Column:
    """struct<bank,wallet> by layers: loyalty, beneficiary, image, text, wallet promoted to issuer, card network."""
    forms = F.struct(
        spaced_name(image_alt).alias("alt"),
        F.upper(F.concat_ws(" ", or_blank(text), or_blank(image_alt))).alias("upper"),
    )
    return bind(forms, lambda x: _layers(x["upper"], x["alt"]))


def _layers(upper: Column, alt: Column) -> Column:
    club = F.coalesce(
        classify(upper, "loyalty", prepared=True),
        classify(upper, "beneficiary", prepared=True),
        classify(alt, "loyalty", prepared=True),
        classify(alt, "beneficiary", prepared=True),
    )
    bank = F.coalesce(classify(alt, "layered_bank", prepared=True), classify(upper, "layered_bank", prepared=True))
    wallet = F.coalesce(
        classify(alt, "layered_wallet", prepared=True), classify(upper, "layered_wallet", prepared=True)
    )
    network = classify(upper, "network", prepared=True)
    facts = F.struct(club.alias("club"), bank.alias("bank"), wallet.alias("wallet"), network.alias("network"))

    def decide(x: Column) -> Column:
        promoted = F.coalesce(x["bank"].isNull() & x["wallet"].isin(*WALLET_AS_ISSUER), F.lit(False))
        issuer = F.coalesce(x["club"], x["bank"], F.when(promoted, x["wallet"]), x["network"], F.lit(""))
        rest = F.when(~(x["club"].isNotNull() | promoted), x["wallet"])
        return F.struct(issuer.alias("bank"), rest.alias("wallet"))

    return bind(facts, decide)


EXCLUDED_WALLETS = (
    r"(?:EXCLU[IÍ]D[AO]S?|NO\s+APLICA|QUEDAN?\s+EXCLUIDOS?|NO\s+V[AÁ]LID)[^.]{0,100}BILLETERAS?\s+VIRTUALES?"
)


def fanout_wallets(text: Column) -> Column:
    """Wallets a multi-wallet card stands for; empty when the card is not one."""
    return bind(F.upper(or_blank(text)), _fanout)


def _fanout(upper: Column) -> Column:
    names = all_hits(upper, WALLET_FANOUT)
    multi = found(upper, r"BILLETERAS?\s+VIRTUALES?", False) & ~found(upper, EXCLUDED_WALLETS, False)
    default = F.array(*[F.lit(n) for n in WALLET_FANOUT_DEFAULT])
    none = F.array().cast("array<string>")
    chosen = bind(names, lambda x: F.when(F.size(x) >= 2, x).when(F.size(x) == 0, default).otherwise(none))
    return F.when(multi, chosen).otherwise(none)


def combined_wallet(text: Column) -> Column:
    """Fuel-app wallet combined with the others it is used with, else the first wallet."""
    names = all_hits(text, WALLET_SHELL)

    def join(x: Column) -> Column:
        others = F.array_remove(x, "Shell Box")
        both = F.array_contains(x, "Shell Box") & (F.size(others) > 0)
        return F.when(both, F.concat(F.lit("Shell Box + "), F.array_join(others, " + "))).otherwise(F.get(x, F.lit(0)))

    return or_blank(bind(names, join))


def entity_from_image(image: Column, text: Column) -> dict[str, Column]:
    """Image name decides bank, wallet and card type; the base text rules fill in when it says nothing."""
    got = cascade(F.lower(or_blank(image)), IMAGE_CASCADE)
    silent = got["bank"].isNull() & got["wallet"].isNull() & got["card_type"].isNull()
    return {
        "bank": F.coalesce(got["bank"], F.when(silent, classify(text, "bank"))),
        "wallet": F.coalesce(got["wallet"], F.when(silent, classify(text, "wallet"))),
        "card_type": got["card_type"],
    }


def entity_from_title(image: Column, title: Column, terms: Column) -> dict[str, Column]:
    """Image cascade, then text cascade, then the card named in the title."""
    got = cascade(F.lower(or_blank(image)), IMAGE_CASCADE_TITLE)
    silent = got["bank"].isNull() & got["wallet"].isNull() & got["card_type"].isNull()
    said = cascade(F.lower(F.concat_ws(" ", or_blank(title), or_blank(terms))), TEXT_CASCADE)
    out = {name: F.coalesce(got[name], F.when(silent, said[name])) for name in got}
    out["card_type"] = F.coalesce(out["card_type"], card_from_title(title))
    return out


def card_from_title(title: Column) -> Column:
    by_card = grab(
        title,
        r"con\s+tarjeta[s]?\s+(?:de\s+)?(?:crédito|débito|prepaga)?\s+([A-Za-záéíóúñÁ-Ú\s]+?)(?:\s|$|crédito|débito)",
    )
    by_paying = grab(title, r"pagando\s+con\s+([A-Za-záéíóúñÁ-Ú\s]+?)(?:\s+(?:en|$|tope|sin))")
    picks = [F.when(F.length(F.trim(c)) > 2, F.initcap(F.trim(c))) for c in (by_card, by_paying)]
    return F.coalesce(*picks)


def card_types(text: Column, profile: str = "masonline") -> Column:
    rules = {"masonline": CARD_TYPES, "coto": CARD_TYPES_COTO, "cencosud": CARD_TYPES_CENCOSUD}[profile]
    names = all_hits(text, rules, mode="any")
    if profile == "masonline":
        # "tarjetas de crédito …" may write a network inside another word.
        tail = F.lower(or_blank(grab(text, r"tarjetas?\s+(?:de\s+)?(?:cr[eé]dito|d[eé]bito)\s+([^.]+?)(?:\.|$)")))
        extra = F.array_compact(
            F.array(
                F.when(tail.contains("visa"), F.lit("Visa")),
                F.when(tail.contains("master"), F.lit("Mastercard")),
            )
        )
        names = F.array_distinct(F.concat(names, extra))
    return F.array_join(names, ", ")


def card_network(text: Column) -> Column:
    return first_label(
        text,
        [("mastercard", "Mastercard"), ("visa", "Visa"), (r"american\s*express|amex", "American Express")],
    )


PAYMENT_TYPES = {
    # profile: (labels with their pattern, separator)
    "masonline": ([(r"cr[eé]dito", "Crédito"), (r"d[eé]bito", "Débito")], ", "),
    "coto": ([(r"TARJETAS?\s+DE\s+CR[EÉ]DITO", "Crédito"), (r"TARJETAS?\s+DE\s+D[EÉ]BITO", "Débito")], ", "),
    "cencosud": ([(r"CR[EÉ]DITO", "Crédito"), (r"D[EÉ]BITO", "Débito")], ", "),
    "puma": ([(r"cr[eé]dito", "Crédito"), (r"d[eé]bito", "Débito")], " y "),
    "shell": (
        [
            (r"tarjeta[s]?\s+(?:de\s+)?cr[eé]dito|cr[eé]dito\s+(?:visa|master)", "Crédito"),
            (r"tarjeta[s]?\s+(?:de\s+)?d[eé]bito|d[eé]bito\s+(?:visa|master)", "Débito"),
            (r"tarjeta\s+prepaga|prepag", "Prepaga"),
        ],
        "/",
    ),
}


def payment_type(text: Column, profile: str) -> Column:
    labels, sep = PAYMENT_TYPES[profile]
    return F.array_join(all_hits(text, labels, mode="any"), sep)


PAYMENT_PHRASE = (
    r"(?:con|mediante|usando|través de|a través)\s+"
    r"([^\n.]{5,80}(?:dni|pago|tarjeta|visa|master|amex|cuenta)[^\n.]{0,30})"
)
PAYMENT_PHRASES_SIMPLE = [
    r"(?:con|mediante|usando)\s+([^.!\n]{5,80}(?:dni|tarjeta|cuenta|visa|master|banco)[^.!\n]{0,50})",
    r"(cuenta\s+dni[^.!\n]{0,50})",
    r"(tarjeta[^.!\n]{5,80})",
]


def payment_method(text: Column, simple: bool = False) -> Column:
    from .text import first_grab, squeeze

    return squeeze(first_grab(text, PAYMENT_PHRASES_SIMPLE) if simple else grab(text, PAYMENT_PHRASE))


def participating_banks(text: Column, profile: str = "cencosud") -> Column:
    """Issuers listed after 'participan' or 'bancos'."""
    from .text import grab_all

    if profile == "cencosud":
        listed = grab(text, r"[Pp]articipan\s+(.+?)(?:\.\s*[A-Z]|$)", ci=False)
        names = grab_all(listed, r"(Banco\s+[\w\s]+|Billetera\s+\w+|\bICBC\b|\bBBVA\b|\bHSBC\b)")
        tidy = F.filter(
            F.transform(names, lambda b: F.trim(F.regexp_replace(F.trim(b), r"[,y]+$", ""))), lambda b: F.length(b) > 3
        )
        return F.array_join(tidy, ", ")
    listed = grab(text, r"(?:[Pp]articipan|[Bb]ancos)[:\s]+(.+?)(?:\.|$)", ci=False)
    names = grab_all(listed, r"(Banco\s+[\w\s]+|\bICBC\b|\bBBVA\b|\bHSBC\b)")
    chosen = F.when(found(text, r"bancos\s+seleccionados"), F.transform(names, F.trim))
    return or_blank(F.array_join(chosen, ", "))


def is_offer_text(text: Column) -> Column:
    lower = F.lower(or_blank(text))
    words = [p for p, _ in BANK_FOLDED] + [p for p, _ in WALLET_FOLDED] + ["ualá"] + OFFER_WORDS
    return contains_any(lower, words)


def names_by_rules(texts: DataFrame, text_col: str, rules: DataFrame) -> DataFrame:
    """texts with `names`: the first matching rule of each set, as array<struct<rule_set,name>>; `classify` by rules as data.

    The rules, a list of bounded size, reach each row as one value, by the literal factors of which their matches must
    contain one. Each factor is searched once, whatever the number of its rules, and rules with one pattern are one test,
    verified once if all its literal texts are there; plain words need no regular expression. No text is copied or shuffled.
    """
    # Rules without these columns are plain words.
    plain_word = F.when(F.col("regex").isNull(), F.array("pattern")) if "regex" in rules.columns else F.array("pattern")
    absent = {
        "mode": F.lit("word"),
        "regex": F.lit(None).cast("string"),
        "words": plain_word,
        "factors": F.array(F.lower("pattern")),
        "runs": F.array().cast("array<array<string>>"),
    }
    rules = rules.withColumns({c: v for c, v in absent.items() if c not in rules.columns}).filter(F.length("pattern") > 0)
    test = ["mode", "regex", "words", "factors", "runs"]
    tests = rules.groupBy(*test).agg(F.collect_list(F.struct("rule_set", "priority", "name")).alias("rules"))
    factors = F.when(F.size("factors") == 0, F.array(F.lit(""))).otherwise(F.array_distinct("factors"))
    by_factor = tests.select(F.explode(factors).alias("factor"), F.struct("mode", "regex", "words", "runs", "rules").alias("test"))
    by_factor = by_factor.groupBy("factor").agg(F.collect_list("test").alias("tests"))
    listed = by_factor.agg(F.collect_list(F.struct("factor", "tests")).alias("groups")).scalar()
    held = F.col("_rules")

    def found_in(forms: Column) -> Column:
        searched = forms["searched"]

        def complete(test: Column) -> Column:
            whole = F.exists(test["runs"], lambda runs: F.forall(runs, lambda run: F.contains(searched, run)))
            return (F.size(test["runs"]) == 0) | whole

        groups = F.filter(held, lambda g: F.contains(searched, g["factor"]))
        candidates = F.flatten(F.transform(groups, lambda g: F.filter(g["tests"], complete)))

        def matches(test: Column) -> Column:
            mode = test["mode"]
            form = F.when(mode == "upper", forms["upper"]).when(mode == "fold", forms["folded"])
            form = form.when(mode == "any", forms["plain"]).otherwise(forms["low"])
            words = F.exists(test["words"], lambda w: F.contains(form, w))
            return F.when(test["words"].isNull(), F.regexp_like(form, test["regex"])).otherwise(words)

        hits = F.sort_array(F.flatten(F.transform(F.filter(F.array_distinct(candidates), matches), lambda t: t["rules"])))
        return bind(hits, lambda x: F.filter(x, lambda r, i: (i == 0) | (F.get(x, i - 1)["rule_set"] != r["rule_set"])))

    # Factors are searched with and without accents, as rules of folded sets are written without.
    def forms_of(plain: Column, low: Column, folded: Column) -> Column:
        searched = F.when(low == folded, low).otherwise(F.concat(low, F.lit("\n"), folded))
        return F.struct(
            low.alias("low"), folded.alias("folded"), F.upper(plain).alias("upper"), plain.alias("plain"), searched.alias("searched")
        )

    plain = or_blank(F.col(text_col))
    forms = bind(F.lower(plain), lambda low: bind(fold_accents(low), lambda folded: forms_of(plain, low, folded)))
    names = F.transform(bind(forms, found_in), lambda r: F.struct(r["rule_set"].alias("rule_set"), r["name"].alias("name")))
    return texts.withColumn("_rules", listed).withColumn("names", names).drop("_rules")


def best_by_rules(texts: DataFrame, text_col: str, rules: DataFrame, rule_set: str) -> DataFrame:
    """The rows whose text matches a rule of the set, with the name of the first one."""
    found = names_by_rules(texts, text_col, rules.filter(F.col("rule_set") == rule_set))
    return found.withColumn("name", F.get("names", F.lit(0))["name"]).filter(F.col("name").isNotNull()).drop("names")
