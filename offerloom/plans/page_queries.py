"""Queries over pages, documents, JSON payloads and catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, terms
from ..functions.text import html_to_text
from ..operators import blocks, dedup, filters, match, relational
from ..sources import catalog, tables
from . import sqltext as q
from .extraction_queries import HTML_TEXT
from .registry import base, cards, merchants, promos, query, show

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def pages(s, sf):
    return base(s, sf, "pages")


@query("a1_read_tables", None, " union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in TABLES))
def _(s, sf):
    out = None
    for name in TABLES:
        part = tables.read_table(s, f"{sf}/{name}.parquet").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "a2_read_pages",
    None,
    """select page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host, try_cast(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') as int) as page_no, length(html) as n from pages""",
)
def _(s, sf):
    return tables.read_pages(s, f"{sf}/pages.parquet").select("page_id", "host", "page_no", F.length("html").alias("n"))


@query(
    "a2_tab_days",
    None,
    "select o_orderkey as id, case o_orderkey % 4 when 0 then 'Miércoles' when 1 then 'Sábado' when 2 then 'Lunes' end as tab_day from orders",
)
def _(s, sf):
    k = F.col("o_orderkey") % 4
    url = (
        F.when(k == 0, "https://shop.example/promos?dia=mi%C3%A9rcoles").when(k == 1, "https://shop.example/sabado")
        .when(k == 2, "https://shop.example/x#tab-lunes").otherwise("https://shop.example/lunesx")
    )
    return base(s, sf, "orders").select(F.col("o_orderkey").alias("id"), tables.tab_day(url).alias("tab_day"))


@query(
    "a3_read_json_envelope",
    "fx_promos",
    """select id, cast(n as int) as pos, case n when 0 then title else 'B ' || title end as title, case n when 0 then discount else '' end as discount, case n when 0 then bank end as bank,
    case n when 0 then strftime(valid_from, '%Y-%m-%d') else '2026-03-02' end as valid_from from fx_promos, (select unnest([0, 1]) as n) where id % 5 <> 0""",
)
def _(s, sf):
    one = F.struct("title", "discount", "bank", F.col("valid_from").cast("string").alias("valid_from"))
    two = F.struct(F.concat(F.lit(" B "), "title", F.lit(" ")).alias("title"), F.lit("2/3/2026").alias("valid_from"))
    empty = F.struct(F.lit("").alias("title"), F.lit("x").alias("bank"))
    body = F.concat(
        F.lit('Respuesta:\n{"promotions":['), F.to_json(one), F.lit(","), F.to_json(two), F.lit(","), F.to_json(empty), F.lit('],"extraction_notes":"ok"}\nfin')
    )
    # Every fifth answer is cut off and gives no rows.
    cut = F.when(F.col("id") % 5 == 0, F.concat(F.substring(body, 1, 60), F.lit("}"))).otherwise(body)
    answers = promos(s, sf).select("id", cut.alias("answer"))
    return tables.read_json_envelope(answers, "answer", ["id"]).select("id", "pos", "title", "discount", "bank", "valid_from")


IS_OFFER = "(" + " or ".join(
    f"contains(lower(card_text), {q.lit(w)})"
    for w in [p for p, _ in rules.BANK_FOLDED] + [p for p, _ in rules.WALLET_FOLDED] + ["ualá"] + rules.OFFER_WORDS
) + ")"


@query(
    "a4_read_embedded_json",
    "fx_cards",
    f"""select id, card_text as text from fx_cards where length(card_text) > 40 and regexp_matches(card_text, '\\d+\\s*%|cuotas?\\s*sin\\s*inter', 'i') and {IS_OFFER}""",
)
def _(s, sf):
    blob = F.to_json(F.struct(F.struct(F.array("card_text", F.lit("x")).alias("items"), F.lit(7).alias("n"), F.col("card_text").alias("t")).alias("page")))
    runtime = F.concat(
        F.lit('<template data-type="json" data-varname="__RUNTIME__"><script>'), blob, F.lit("</script></template>")
    )
    nxt = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), blob, F.lit("</script>"))
    html = F.concat(F.lit("<html><body>"), F.when(F.col("id") % 2 == 0, runtime).otherwise(nxt), F.lit("</body></html>"))
    pages_df = cards(s, sf).select("id", html.alias("html"))
    return tables.read_embedded_json(pages_df, "html", "id")


@query(
    "a4_runtime_fields",
    "fx_cards",
    """select id, case when id % 3 = 0 then 'extensions' else 'main' end as field, id % 4 <> 0 as valid, cast(len(regexp_extract_all(lower(card_text), 'descuento')) as int) as discount_mentions from fx_cards""",
)
def _(s, sf):
    field = F.when(F.col("id") % 3 == 0, ' data-field="extensions"').otherwise("")
    blob = F.concat(F.to_json(F.struct("card_text")), F.when(F.col("id") % 4 == 0, ",").otherwise(""))
    html = F.concat(F.lit('<template data-varname="__RUNTIME__"'), field, F.lit("><script>"), blob, F.lit("</script></template>"))
    return tables.runtime_fields(cards(s, sf).select("id", html.alias("html")), "html", "id").select(
        "id", "field", "valid", "discount_mentions"
    )


@query(
    "a5_read_detail_json",
    "fx_promos",
    """select id, case id % 3 when 0 then '$5.000' when 1 then 'Tope ' || title end as cap, cast(valid_from as varchar) as valid_from, cast(valid_until as varchar) as valid_until,
    trim('No aplica a ' || bank) || '|Salvo feriados' as exclusions, 'Solo ' || title as requirements, 'Legal ' || title as terms_raw, 'Rubro A, Rubro B' as store_types, 'https://x/' || id as url from fx_promos""",
)
def _(s, sf):
    def stamp(c: str):
        ms = F.unix_date(c) * F.lit(86400000).cast("long")
        return F.concat(F.lit("/Date("), ms.cast("string"), F.lit(")/"))

    k = F.col("id") % 3
    lead = F.when(k == 0, "Tope $ 5.000 por mes").when(k == 1, F.concat(F.lit("Tope  "), "title")).otherwise("Sin tope")
    entity = F.struct(
        F.struct(
            lead.alias("bajada"),
            stamp("valid_from").alias("fecha_desde"),
            stamp("valid_until").alias("fecha_hasta"),
            F.concat(F.lit(" Legal  "), "title").alias("legal"),
        ).alias("Beneficio"),
        F.array(
            *[
                F.struct(t.alias("texto"))
                for t in (F.concat(F.lit("No aplica a "), "bank"), F.lit("  "), F.concat(F.lit("Solo "), "title"), F.lit("Salvo feriados"))
            ]
        ).alias("Condiciones"),
        F.array(F.struct(F.lit("Rubro A").alias("nombre")), F.struct(F.lit("").alias("nombre")), F.struct(F.lit("Rubro B").alias("nombre"))).alias("Rubros"),
        F.array(F.struct(F.lit("").alias("link")), F.struct(F.concat(F.lit("https://x/"), F.col("id").cast("string")).alias("link"))).alias("Botones"),
    )
    payload = F.to_json(F.struct(entity.alias("Entity")))
    return show(tables.read_detail_json(promos(s, sf).select("id", payload.alias("payload")), "payload", "id"))


@query(
    "a6_extract_detail_ids",
    None,
    "select distinct o_orderkey // 3 as detail_id from orders union select o_orderkey from orders where o_orderkey % 2 = 0",
)
def _(s, sf):
    key = F.col("o_orderkey")
    even = F.when(key % 2 == 0, F.concat(F.lit('<a class="b" href="https://x/promocion/'), key.cast("string"), F.lit('?a=1">y</a>'))).otherwise("")
    html = F.concat(
        F.lit('<a href="/promocion/'), F.floor(key / 3).cast("string"), F.lit('">x</a><a href="/otra/9">z</a>'), even
    )
    return tables.extract_detail_ids(base(s, sf, "orders").select(html.alias("html")))


ROOT = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"
VISITED = "page_id % 3 = 0"


@query(
    "a7_discover_next_pages",
    None,
    f"""with links as (select {ROOT} || '/p/' || (page_id % 40 + 2) as url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host from pages
    union all select {ROOT} || '/p/99', regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) from pages
    union all select {ROOT} || '/siguiente', regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) from pages where page_id % 2 = 0)
    select host, url, count(*) as found_on from links group by 1, 2 having url not in (select {ROOT} || '/p/3' from pages where {VISITED})""",
)
def _(s, sf):
    p = pages(s, sf)
    k = (F.col("page_id") % 40 + 2).cast("string")
    extra = F.concat(
        F.lit('<a href="/p/'), k, F.lit('">'), k, F.lit('</a><a href="/p/99">99</a><a href="/p/1">1</a>'),
        F.when(F.col("page_id") % 2 == 0, '<a rel="next" href="/siguiente"><b>Siguiente</b> »</a>').otherwise(""),
    )
    crawled = p.filter(F.col("page_id") % 3 == 0)
    root = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    seen = crawled.select("url").unionByName(crawled.select(F.concat(root, F.lit("/p/3")).alias("url")))
    return tables.discover_next_pages(p.withColumn("html", F.concat("html", extra)), seen)


@query(
    "a8_result_source",
    None,
    "select 'Nation' as source, count(*) as n from nation union all select 'Region', count(*) from region union all select 'Supplier', count(*) from supplier",
)
def _(s, sf):
    """Source named by the file a row was read from."""
    out = None
    for name, key in (("nation", "n_name"), ("region", "r_name"), ("supplier", "s_name")):
        part = base(s, sf, name).select(F.initcap(F.regexp_extract(F.input_file_name(), r"([^/]+)\.parquet$", 1)).alias("source"), F.col(key).alias("name"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("source").agg(F.count("name").alias("n"))


REGISTRY = ", ".join(f"({q.lit(r[1])}, {q.lit(r[3] or 'supermarket')})" for r in catalog.SOURCES)


@query(
    "a9_merchant_registry",
    "fx_merchants",
    f"""select r.category, count(distinct r.name) as sources, count(m.id) as merchants from (values {REGISTRY}) r(name, category)
    join fx_merchants m on coalesce(m.category, 'supermarket') = r.category group by 1""",
)
def _(s, sf):
    per = merchants(s, sf).groupBy(F.coalesce("category", F.lit("supermarket")).alias("category")).agg(F.count("*").alias("per"))
    counts = catalog.merchant_registry(s).groupBy("category").agg(F.count_distinct("name").alias("sources"))
    return counts.join(per, "category").select("category", "sources", (F.col("sources") * F.col("per")).alias("merchants"))


METHOD_ROWS = ", ".join(f"({q.lit(k)}, {q.lit(n)})" for k, names in catalog.PAYMENT_METHODS.items() for n in names)


@query(
    "a10_payment_catalog",
    "fx_cards",
    f"""select c.type, c.name, count(*) as offers from (values {METHOD_ROWS}) c(type, name) join fx_cards on contains(strip_accents(lower(card_text)), strip_accents(lower(c.name))) group by 1, 2""",
)
def _(s, sf):
    names = catalog.payment_catalog(s)
    texts = cards(s, sf).select("id", F.col("card_text").alias("title"))
    hits = match.name_hits(texts, match.method_names(names.withColumnRenamed("name", "entity_name")))
    counts = hits.groupBy("name").agg(F.count("*").alias("offers"))
    from ..functions.text import norm

    return names.withColumn("_key", norm(F.col("name"))).join(counts.withColumnRenamed("name", "_key"), "_key").select("type", "name", "offers")


def _set_sql(rule_set: str) -> str:
    mode, _, listed = rules.RULE_SETS[rule_set]
    form = {"upper": "upper(card_text)", "any": "card_text", "fold": "strip_accents(lower(card_text))"}.get(mode, "lower(card_text)")
    return q.words(form, listed) if mode in ("word", "fold") else q.chain(form, listed, ci=mode == "any")


# Sets whose patterns the SQL engine can read (it has no look-around); the tests hold all of them against the expressions.
PLAIN_SETS = [n for n, (_, _, listed) in rules.RULE_SETS.items() if not any("(?<" in p or "(?!" in p for p, _ in listed)]


@query(
    "a11_rule_sets",
    "fx_cards",
    "select rule_set, name, count(*) as n from ("
    + " union all ".join(f"select {q.lit(n)} as rule_set, {_set_sql(n)} as name from fx_cards" for n in PLAIN_SETS)
    + ") where name is not null group by 1, 2",
)
def _(s, sf):
    """Rule sets read as data and applied in one pass over the texts, instead of as expressions."""
    used = rules.rule_sets(s).filter(F.col("rule_set").isin(PLAIN_SETS))
    # A plain explode would have the plan apply all rules twice: once more to drop texts without any name beforehand.
    named = rules.names_by_rules(cards(s, sf).select("card_text"), "card_text", used).select(F.explode_outer("names").alias("x"))
    return named.filter(F.col("x").isNotNull()).groupBy("x.rule_set", "x.name").agg(F.count("*").alias("n"))


# --- page jobs ---------------------------------------------------------------------------------------


@query(
    "b19_rendered_page",
    None,
    f"""select page_id, (contains(lower(html), '<html') or contains(lower(html), '<body')) and length(html) > 3000 and length({HTML_TEXT}) > 500 as usable from pages""",
)
def _(s, sf):
    return pages(s, sf).select("page_id", filters.is_rendered_page(F.col("html"), 3000, 500).alias("usable"))


# Each third of a page's text becomes a card, with a legal block after it.
OPENERS = ["PROMOCIÓN VÁLIDA", "BENEFICIO VÁLIDO", "DESCUENTO EXCLUSIVO"]


def legal_text(s, sf):
    """One text per page: card, legal block, marker, three times; the cards hold the whole page."""
    body, n = F.col("body"), F.length("body")
    parts = []
    for i, opener in enumerate(OPENERS):
        start, stop = F.floor(n * i / 3).cast("int"), F.floor(n * (i + 1) / 3).cast("int")
        parts.append(F.concat(F.lit(f"Tarjeta {i} "), F.substring(body, start + 1, stop - start), F.lit(" ")))
        parts.append(F.concat(F.lit(f"{opener} PARA TODOS {i} "), F.repeat(F.lit("A"), 170), F.lit(" Ver legal ")))
    return pages(s, sf).select("page_id", html_to_text(F.col("html")).alias("body")).select("page_id", F.concat(*parts).alias("text"))


@query(
    "e4_legal_spans",
    None,
    f"""with p as (select page_id, {HTML_TEXT} as t from pages), i as (select unnest([0, 1, 2]) as i)
    select page_id, i as pos, trim(case when i > 0 then 'Ver legal ' else '' end || 'Tarjeta ' || i || ' ' || substr(t, cast(length(t) * i // 3 + 1 as int), cast(length(t) * (i + 1) // 3 - length(t) * i // 3 as int))) as card_text,
    (['{OPENERS[0]}', '{OPENERS[1]}', '{OPENERS[2]}'])[i + 1] || ' PARA TODOS ' || i || ' ' || repeat('A', 170) as legal_text from p, i""",
)
def _(s, sf):
    return blocks.legal_spans(legal_text(s, sf), F.col("text"), ["page_id"])


@query(
    "e4_offer_sections",
    "fx_cards",
    """select * from (select id, n - 1 as pos, (10 * n) || '% DE DESCUENTO - BANCO ' || chr(64 + cast(n as int)) || ': ' || card_text || case when n < 3 then chr(10) else '' end as text
    from fx_cards, (select unnest([1, 2, 3]) as n)) where length(text) > 100""",
)
def _(s, sf):
    parts = [
        F.concat(F.lit(f"{10 * n}% DE DESCUENTO - BANCO {chr(64 + n)}: "), "card_text", F.lit("\n" if n < 3 else "")) for n in (1, 2, 3)
    ]
    return blocks.offer_sections(cards(s, sf).select("id", F.concat(*parts).alias("t")), F.col("t"), ["id"])


WORD = r"\bthe\b"


@query(
    "e5_match_contexts",
    None,
    """with h as (select doc_id, text, unnest(regexp_extract_all(text, 'ing[^a-z]', 0, 'c')) as hit from documents)
    select doc_id, count(*) as n, cast(sum(length(hit)) as bigint) as chars from h group by 1""",
)
def _(s, sf):
    docs = base(s, sf, "documents")
    found = blocks.match_contexts(docs, F.col("text"), ["doc_id"], r"(?-i)ing[^a-z]", 30, 60)
    ok = F.substring("context", F.least(F.col("start"), F.lit(30)) + 1, F.length("hit")) == F.col("hit")
    return found.filter(ok).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("hit")).alias("chars"))


BADGE_SQL = q.lit("(?i)" + q.re2(blocks.BADGE))


@query(
    "e5_badge_cards",
    "fx_cards",
    f"""with t as (select id, 'Antes ' || card_text || ' 5% medio con Banco ' || id || ' 7% final ' || card_text as t from fx_cards),
    p as (select id, t, regexp_extract_all(t, {BADGE_SQL}) as h, regexp_split_to_array(t, {BADGE_SQL}) as g from t),
    r as (select id, t, h[i] as hit, i, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) as bigint) as a
      from (select id, t, h, g, unnest(range(1, len(h) + 1)) as i from p)),
    s as (select *, a + length(hit) as b, lead(a) over (partition by id order by i) as nxt, lag(a + length(hit)) over (partition by id order by i) as prv from r),
    c as (select *, coalesce((prv + a) // 2, 0) as low, coalesce(nxt, length(t)) as high from s)
    select id, cast(i - 1 as int) as pos, hit, substr(t, cast(low + 1 as int), cast(high - low as int)) as card_text from c""",
)
def _(s, sf):
    t = F.concat(F.lit("Antes "), "card_text", F.lit(" 5% medio con Banco "), F.col("id").cast("string"), F.lit(" 7% final "), "card_text")
    return blocks.badge_cards(cards(s, sf).select("id", t.alias("t")), F.col("t"), ["id"])


@query(
    "e6_ordinal_in_list",
    None,
    """with notes as (select page_id, unnest([1, 2, 3, 4, 5, 6]) as n from pages) select page_id, n, 'Nota ' || n || ' ' || repeat('x', 40) || ' ' || page_id as text from notes""",
)
def _(s, sf):
    items = [
        F.concat(F.lit(f"<li>Nota {n} {'x' * 40} "), F.col("page_id").cast("string"), F.lit("</li>")) for n in range(1, 7)
    ]
    html = F.concat("html", F.lit("<ol>"), *items, F.lit("</ol>"))
    found = blocks.list_items(pages(s, sf).withColumn("html", html))
    return dedup.ordinal_in_list(found)


@query(
    "c6_attach_footnotes",
    None,
    """select page_id, n as card, case when n = 3 then '' else 'Nota ' || n || ' ' || repeat('x', 40) || ' ' || page_id end as legal_text from pages, (select unnest([1, 2, 3]) as n)""",
)
def _(s, sf):
    items = [
        F.concat(F.lit(f"<li>Nota {n} {'x' * 40} "), F.col("page_id").cast("string"), F.lit("</li>")) for n in range(1, 7)
    ]
    p = pages(s, sf)
    notes = dedup.ordinal_in_list(blocks.list_items(p.withColumn("html", F.concat("html", F.lit("<ol>"), *items, F.lit("</ol>")))))
    n = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    shown = p.select("page_id", n.alias("card"))
    shown = shown.withColumn("card_text", F.when(F.col("card") == 3, "sin nota").otherwise(F.concat(F.lit("20% ("), F.col("card").cast("string"), F.lit(")"))))
    return relational.attach_footnotes(shown, notes).select("page_id", "card", "legal_text")


PARAGRAPHS = "regexp_extract_all(html, '<p>(.*?)</p>', 1, 's')"


@query(
    "e3_nested_text_dedup",
    None,
    f"""with raw as (select page_id, unnest(range(1, len({PARAGRAPHS}) + 1)) as i, {PARAGRAPHS} as ps from pages),
    b as (select page_id, cast(i * 2 as int) as block_pos, trim(ps[i]) as body from raw union all select page_id, cast(i * 2 + 1 as int), trim(substr(ps[i], 11, 60)) from raw),
    f as (select page_id, body, min(block_pos) as block_pos from b group by 1, 2)
    select page_id, block_pos from f where not exists (select 1 from f o where o.page_id = f.page_id and o.block_pos <> f.block_pos and contains(o.body, f.body)) and body <> ''""",
)
def _(s, sf):
    ps = F.regexp_extract_all("html", F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1))
    raw = pages(s, sf).select("page_id", F.posexplode(ps).alias("i", "p"))
    whole = raw.select("page_id", ((F.col("i") + 1) * 2).alias("block_pos"), F.col("p").alias("text"))
    part = raw.select("page_id", ((F.col("i") + 1) * 2 + 1).alias("block_pos"), F.substring("p", 11, 60).alias("text"))
    b = whole.unionByName(part).withColumn("text", F.trim("text")).filter(F.col("text") != "")
    return dedup.nested_text_dedup(b).select("page_id", "block_pos")


@query(
    "d16_longest_uppercase_block",
    None,
    """select doc_id, n, block from (select doc_id, length(b) as n, md5(b) as block, row_number() over (partition by doc_id order by length(b) desc, i) as rn from
    (select doc_id, unnest(bs) as b, unnest(range(len(bs))) as i from (select doc_id, regexp_extract_all(upper(replace(text, 'ß', 'SS')), '([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ\\s\\d.,;:/()$%\\-]{100,})', 1, 'c') as bs from documents))) where rn = 1""",
)
def _(s, sf):
    """Upper-cased documents, so that long runs exist in every language."""
    docs = base(s, sf, "documents").select("doc_id", F.upper(F.replace("text", F.lit("ß"), F.lit("SS"))).alias("t"))
    found = docs.select("doc_id", terms.longest_uppercase_block(F.col("t"), 100).alias("block")).filter(F.col("block") != "")
    return found.select("doc_id", F.length("block").alias("n"), F.md5("block").alias("block"))


def _count(pattern: str, text: str = "html", option: str = "'c'") -> str:
    return f"cast(len(regexp_extract_all({text}, {q.lit(pattern)}, 0, {option})) as int)"


@query(
    "d17_page_profile",
    None,
    f"""select page_id, cast(length(html) as int) as n_html, cast(length({HTML_TEXT}) as int) as n_text, {_count('banco', 'lower(html)')} as n_banco, {_count('[0-9]+ *%')} as n_percent,
    {_count('<script[ >]', 'html', "'i'")} as n_script, {_count('<div[ >]', 'html', "'i'")} as n_div, {_count('<p[ >]', 'html', "'i'")} as n_p, {_count('<a[ >]', 'html', "'i'")} as n_a,
    {_count('<article[ >]', 'html', "'i'")} as n_article from pages""",
)
def _(s, sf):
    profile = blocks.page_profile(pages(s, sf))
    return profile.select("page_id", "n_html", "n_text", "n_banco", "n_percent", "n_script", "n_div", "n_p", "n_a", "n_article")


@query(
    "d17_class_counts",
    None,
    """select class_name, count(*) as elements from (select unnest(regexp_extract_all(html, '<[^>]+\\sclass="([^"]*)"', 1)) as class_name from pages) group by 1""",
)
def _(s, sf):
    return blocks.class_counts(pages(s, sf))


@query("h5_select_blocks")
def _(s, sf):
    """Articles of the pages with title, paragraphs and first bold text. Tag nesting is beyond SQL."""
    found = blocks.select_blocks(pages(s, sf), blocks.BLOCK_RULES["articles"])
    return blocks.block_table(found, ["text", "title", "paragraphs", "bold"])


@query(
    "u2_select_blocks_menu_links",
    None,
    """select page_id, 0 as block_pos, array_to_string(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<a href="([^"]*)"', 1), ' | ') as links from pages where contains(html, '<nav>')""",
)
def _(s, sf):
    found = blocks.select_blocks(pages(s, sf), blocks.BLOCK_RULES["menus"])
    return blocks.block_table(found, ["links"]).select("page_id", "block_pos", "links")
