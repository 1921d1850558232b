"""Readers and writers of tables, pages, JSON payloads and result files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schema
from ..functions import dates, money, terms
from ..functions.rules import is_offer_text
from ..functions.text import blank_to_null, clean_text, fold_accents, found, grab, grab_all, is_json, or_blank, squeeze
from .catalog import TAB_DAYS


def read_table(spark: SparkSession, path: str, expected: StructType | None = None) -> DataFrame:
    """One store table; an explicit schema spares the footer scan and checks the columns."""
    reader = spark.read.schema(expected) if expected is not None else spark.read
    return reader.parquet(path)


def read_store(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    kinds = {
        "offers": schema.OFFERS,
        "merchants": schema.MERCHANTS,
        "terms": schema.TERMS,
        "history": schema.HISTORY,
        "users": schema.USERS,
        "user_methods": schema.USER_METHODS,
    }
    return {name: read_table(spark, f"{root}/{name}", kind) for name, kind in kinds.items()}


def tab_day(url: Column) -> Column:
    """Weekday of a page tab, read from the URL path or query; NULL when the URL names none."""
    folded = fold_accents(F.lower(F.coalesce(F.try_url_decode(url), url)))
    out = None
    for key, name in TAB_DAYS.items():
        test = folded.rlike(rf"(?:^|[^a-z]){key}(?:$|[^a-z])")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawled pages: page_id, url, html, host, query page number and tab weekday."""
    pages = spark.read.parquet(path)
    url = F.col("url")
    return pages.select(
        "page_id",
        "url",
        "html",
        F.try_parse_url(url, F.lit("HOST")).alias("host"),
        F.try_parse_url(url, F.lit("PATH")).alias("path"),
        F.try_parse_url(url, F.lit("QUERY"), F.lit("page")).try_cast("int").alias("page_no"),
        tab_day(url).alias("tab_day"),
    )


def read_json_envelope(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Offers inside a `{"promotions": […]}` envelope; broken JSON gives no rows."""
    body = F.regexp_extract(F.col(text_col), r"(?s)(\{.*\})", 1)
    # Real JSON only: the permissive reader would return half-filled rows for cut-off text.
    valid = F.when(is_json(body), body)
    parsed = F.from_json(valid, schema.VISION_ENVELOPE)
    offers = df.select(*keep, F.posexplode(parsed["promotions"]).alias("pos", "offer"))
    named = offers.filter(
        (or_blank(F.col("offer.title")) != "") | (or_blank(F.col("offer.discount")) != "")
    )
    text_fields = [
        f for f in schema.VISION_OFFER.fieldNames() if f not in ("title", "discount", "valid_from", "valid_until", "tope")
    ]
    return named.select(
        *keep,
        "pos",
        F.trim(or_blank(F.col("offer.title"))).alias("title"),
        F.trim(or_blank(F.col("offer.discount"))).alias("discount"),
        *[F.col(f"offer.{f}").alias(f) for f in text_fields],
        dates.parse_date_loose(F.col("offer.valid_from")).alias("valid_from"),
        dates.parse_date_loose(F.col("offer.valid_until")).alias("valid_until"),
        F.col("offer.tope").alias("cap"),
    )


EMBEDDED_JSON = [
    r'(?is)<script\s+id="__NEXT_DATA__"[^>]*>(.*?)</script>',
    r'(?is)<template\s+[^>]*data-varname="__RUNTIME__"[^>]*>\s*<script[^>]*>(.*?)</script>\s*</template>',
]


def embedded_blobs(html: Column) -> Column:
    """Valid JSON texts a page embeds for its own scripts."""
    blobs = F.concat(*[F.regexp_extract_all(or_blank(html), F.lit(p), F.lit(1)) for p in EMBEDDED_JSON])
    return F.filter(blobs, lambda b: is_json(b))


def read_embedded_json(pages: DataFrame, html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """Offer-like string values of the embedded JSON, distinct per page."""
    blobs = pages.select(id_col, F.explode(embedded_blobs(F.col(html_col))).alias("blob"))
    # Quoted strings followed by a colon are keys; the others are values at any depth.
    quoted = F.regexp_extract_all("blob", F.lit(r'("(?:[^"\\]|\\.)*")\s*(?!\s*:)(?=[,\]}\s]|$)'), F.lit(1))
    values = blobs.select(id_col, F.explode(quoted).alias("raw")).filter(F.length("raw") > 42)
    text = F.get_json_object(F.concat(F.lit('{"v":'), F.col("raw"), F.lit("}")), "$.v")
    offers = values.select(id_col, text.alias("text")).filter(
        (F.length("text") > 40) & found(F.col("text"), r"\d+\s*%|cuotas?\s*sin\s*inter") & is_offer_text(F.col("text"))
    )
    return offers.select(id_col, "text").distinct()


def runtime_fields(pages: DataFrame, html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """Embedded runtime blobs with the data-field each belongs to."""
    pattern = r'(?is)(<template\s+[^>]*data-varname="__RUNTIME__"[^>]*>)\s*<script[^>]*>(.*?)</script>\s*</template>'
    both = F.arrays_zip(
        F.regexp_extract_all(or_blank(F.col(html_col)), F.lit(pattern), F.lit(1)).alias("tag"),
        F.regexp_extract_all(or_blank(F.col(html_col)), F.lit(pattern), F.lit(2)).alias("blob"),
    )
    rows = pages.select(id_col, F.explode(both).alias("x"))
    field = F.coalesce(grab(F.col("x.tag"), 'data-field="([^"]*)"'), F.lit("main"))
    return rows.select(
        id_col,
        field.alias("field"),
        F.col("x.blob").alias("blob"),
        is_json(F.col("x.blob")).alias("valid"),
        F.regexp_count(F.lower("x.blob"), F.lit("descuento")).alias("discount_mentions"),
    )


def read_detail_json(details: DataFrame, payload_col: str, id_col: str) -> DataFrame:
    """Benefit detail records as columns: cap, dates, conditions, categories, link."""
    parsed = details.select(id_col, F.from_json(payload_col, schema.BENEFIT_DETAIL)["Entity"].alias("e"))
    lines = F.transform(
        F.coalesce(F.col("e.Condiciones"), F.array().cast("array<struct<texto:string>>")), lambda c: clean_text(c["texto"])
    )
    lead = or_blank(F.col("e.Beneficio.bajada"))
    categories = F.transform(
        F.filter(F.col("e.Rubros"), lambda r: or_blank(r["nombre"]) != ""), lambda r: r["nombre"]
    )
    links = F.transform(F.filter(F.col("e.Botones"), lambda b: or_blank(b["link"]) != ""), lambda b: b["link"])
    return parsed.select(
        id_col,
        blank_to_null(money.extract_cap(lead, "detail")).alias("cap"),
        dates.dotnet_date(F.col("e.Beneficio.fecha_desde")).alias("valid_from"),
        dates.dotnet_date(F.col("e.Beneficio.fecha_hasta")).alias("valid_until"),
        terms.exclusion_lines(lines).alias("exclusions"),
        terms.requirement_lines(lines).alias("requirements"),
        squeeze(or_blank(F.col("e.Beneficio.legal"))).alias("terms_raw"),
        blank_to_null(F.array_join(categories, ", ")).alias("store_types"),
        F.get(links, F.lit(0)).alias("url"),
    )


def extract_detail_ids(pages: DataFrame, pattern: str = r"/promocion/(\d+)", html_col: str = "html") -> DataFrame:
    """Distinct numeric ids named by the links of listing pages."""
    ids = F.explode(F.array_distinct(grab_all(F.col(html_col), rf'href="[^"]*{pattern}'))).alias("id")
    return pages.select(ids).select(F.col("id").try_cast("long").alias("detail_id")).distinct()


def id_suffix(element_id: Column) -> Column:
    return grab(element_id, r"-(\d+)$")


def discover_next_pages(pages: DataFrame, visited: DataFrame) -> DataFrame:
    """Frontier of unvisited pagination links on the same host: url, host, found_on pages.

    Pagination links are those labelled with a page number from 2 on, or with the word for the next page.
    """
    anchors = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*href="([^"#]+)"[^>]*>(.*?)</a>'), F.lit(1)).alias("href"),
        F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*href="([^"#]+)"[^>]*>(.*?)</a>'), F.lit(2)).alias("label"),
    )
    root = F.concat(F.try_parse_url("url", F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url("url", F.lit("HOST")))
    links = pages.select(root.alias("root"), F.explode(anchors).alias("a")).select(
        "root", F.col("a.href").alias("href"), squeeze(F.regexp_replace("a.label", "<[^>]+>", " ")).alias("label")
    )
    paged = links.filter(F.col("label").rlike(r"^(?:[2-9]|[1-9][0-9]+)$") | found(F.col("label"), "Siguiente"))
    absolute = F.when(F.col("href").startswith("/"), F.concat("root", "href")).otherwise(F.col("href"))
    same_host = paged.select("root", absolute.alias("url")).filter(F.col("url").startswith(F.col("root")))
    fresh = same_host.groupBy("url").agg(F.count("*").alias("found_on"))
    fresh = fresh.withColumn("host", F.try_parse_url("url", F.lit("HOST")))
    return fresh.join(visited.select("url"), "url", "left_anti").select("host", "url", "found_on")


def read_result_files(spark: SparkSession, glob: str, prefix: str = "test_result_") -> DataFrame:
    """JSON result files; the source name comes from the file name."""
    df = spark.read.option("multiLine", True).json(glob)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return df.withColumn("source", F.initcap(F.replace(stem, F.lit(prefix), F.lit(""))))


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Active offers to CSV or JSON part files."""
    flat = df
    for name, kind in df.dtypes:
        if fmt == "csv" and kind.startswith("array"):
            flat = flat.withColumn(name, terms.list_to_csv(F.col(name)))
    writer = flat.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown export format {fmt}")


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Concatenate per-day, per-tab or per-page results; columns a source lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
