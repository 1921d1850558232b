"""Properties: idempotence, uniqueness, agreement of two ways, large groups, plan shapes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from offerloom.functions import rules
from offerloom.operators import blocks, dedup, filters, lifecycle, match, ordering, profiles, relational
from offerloom.plans import entry_points as ask
from offerloom.plans import lifecycle_queries as lq
from offerloom.plans.all_queries import QUERIES
from offerloom.plans.fixtures import AS_OF, fixture
from offerloom.plans.registry import merchants, methods, promos, store_terms
from offerloom.plans.serving_queries import Q1


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_merge_twice_is_merge_once(spark, sf):
    batch = lq.as_batch(lq.crawl(spark, sf, 1))
    once = lifecycle.apply_crawl(lq.start_state(spark, sf), batch, lq.runs_of(batch), lq.NOW)
    twice = lifecycle.apply_crawl(once, batch, lq.runs_of(batch), lq.NOW)
    a = {tuple(r) for r in once["offers"].select("id", "title", "bank", "discount", "is_active").collect()}
    b = {tuple(r) for r in twice["offers"].select("id", "title", "bank", "discount", "is_active").collect()}
    assert a == b


def test_offer_keys_are_unique(spark, sf):
    offers = lq.after_batches(spark, sf)["offers"]
    assert offers.count() == offers.select("merchant_id", "title", "bank").distinct().count() == offers.select("id").distinct().count()


def test_wallet_only_offer_survives_a_second_crawl(spark, sf):
    long_title = "x" * 250
    rows = [("m", 1, long_title, None, "MODO", "10%", "", "", "t"), ("m", 2, "corta", None, "MODO", "20%", "", "", "t")]
    raw = spark.createDataFrame(
        rows, "merchant_id string, pos long, title string, bank string, wallet string, discount string, valid_days string, store_types string, terms_raw string"
    )
    batch = lq.as_batch(raw)
    state = lq.start_state(spark, sf)
    for _ in range(2):
        state = lifecycle.apply_crawl(state, batch, lq.runs_of(batch), lq.NOW)
    got = state["offers"].collect()
    assert len(got) == 2 and all(r["is_active"] for r in got)
    assert sorted(len(r["title"]) for r in got) == [5, 250]


def test_missing_titles_and_empty_crawl(spark, sf):
    state = lq.start_state(spark, sf)
    first = lq.as_batch(lq.crawl(spark, sf, 1))
    state = lifecycle.apply_crawl(state, first, lq.runs_of(first), lq.NOW)
    before = state["offers"].filter("is_active").count()
    empty = first.limit(0)
    runs = first.select("merchant_id").distinct().withColumn("error", F.lit(None).cast("string"))
    after = lifecycle.apply_crawl(state, empty, runs, lq.NOW)
    assert after["offers"].filter("is_active").count() == before
    assert after["history"].filter("error_message = 'No promotions found'").count() == runs.count()


def test_two_sources_of_one_brand_keep_each_other(spark, sf):
    raw = "merchant_id string, source string, pos long, title string, bank string, wallet string, discount string, valid_days string, store_types string, terms_raw string"
    one = spark.createDataFrame([("ypf", "modo", 1, "a", "B1", None, "10%", "", "", "")], raw)
    two = spark.createDataFrame([("ypf", "macro", 1, "b", "B2", None, "20%", "", "", "")], raw)
    offers = lq.start_state(spark, sf)["offers"]
    for batch in (one, two):
        offers = lifecycle.upsert_offers(offers, batch, lq.NOW, deactivate_crawled=True)
    assert {(r["title"], r["is_active"]) for r in offers.collect()} == {("a", True), ("b", True)}


def test_richest_is_a_subset(spark, sf):
    rows = lq.crawl(spark, sf)
    kept = dedup.dedup_keep_richest(rows, ["batch", "merchant_id"])
    assert kept.join(rows, ["batch", "pos"], "left_anti").count() == 0


def test_states_are_disjoint(spark, sf):
    p = promos(spark, sf)
    ids = [{r["id"] for r in p.filter(filters.state_is(s, AS_OF)).select("id").collect()} for s in ("activa", "proxima", "finalizada")]
    assert not ids[0] & ids[1] and not ids[0] & ids[2] and not ids[1] & ids[2]


def test_row_numbers_of_a_hot_group(spark):
    """A third of all rows in one group: positions are exact and no partition holds the whole group."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"), F.col("id").alias("v"))
    got = ordering.row_numbers(df, ["g"], ["-v"])
    from pyspark.sql import Window

    want = df.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("v"))))
    assert got.join(want, ["g", "v"]).filter("row_no <> w").count() == 0 and got.count() == 30_000


def test_row_numbers_with_nulls_and_two_directions(spark):
    from pyspark.sql import Window

    rows = [(i % 3 or None, None if i % 5 == 0 else f"d{i % 7}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "g long, d string, id long")
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("d"), "id")))
    got = ordering.row_numbers(df, ["g"], ["-d", "id"])
    assert got.join(want.select("id", "w"), "id").filter("row_no = w").count() == 400


def test_positions_run_nothing_before_they_are_asked_for(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    ordering.row_numbers(spark.range(100), [], ["-id"])
    assert not tracker.getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_rules_as_data_equal_the_expressions(spark, sf):
    """All rule sets, by factors and verified patterns, against the expression of each on every card text."""
    from offerloom.functions import rules
    from offerloom.plans.registry import cards

    texts = cards(spark, sf).select("card_text").unionByName(cards(spark, sf).select(F.col("image_url").alias("card_text")))
    texts = texts.unionByName(cards(spark, sf).select(F.col("card_class").alias("card_text"))).distinct()
    want = [F.struct(F.lit(n).alias("rule_set"), rules.classify(F.col("card_text"), n).alias("name")) for n in sorted(rules.RULE_SETS)]
    both = rules.names_by_rules(texts, "card_text", rules.rule_sets(spark)).select(
        "card_text",
        F.col("names").alias("got"),
        F.filter(F.array(*want), lambda x: x["name"].isNotNull()).alias("want"),
    ).collect()
    assert len(both) > 100 and [r for r in both if r.got != r.want] == []
    assert {x.rule_set for r in both for x in r.got} >= set(rules.RULE_SETS) - {"loyalty", "beneficiary", "shell_wallet"}


def test_factors_are_in_every_match():
    from offerloom.functions.rules import literal_factors

    assert literal_factors(r"BANCO\s+MACRO|MACRO\s+SELECTA?", False) == ["banco", "select"]
    assert literal_factors(r"NACI[OÓ]N|(?<!\+)BNA(?!\+)", False) == ["naci", "bna"]
    assert literal_factors(r"^Modo$", False) == ["modo"] and literal_factors("x", True) == ["x"]
    assert literal_factors(r"\d+|abc", False) == [] == literal_factors("(?:uno|dos)", False)


def test_trailing_counts_of_a_busy_key(spark):
    """Half of all events in one key, most of them in a burst of one second, some at the same moment."""
    rows = [(i % 2 or i, 1_700_000_000 + (i % 40 if i % 3 else i * 37)) for i in range(3000)]
    events = spark.createDataFrame([(k, i, t) for i, (k, t) in enumerate(rows)], "k long, id long, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["id"]: r["trailing"] for r in relational.trailing_count_per_event(events, "k", "ts", 60).collect()}
    times: dict = {}
    for k, t in rows:
        times.setdefault(k, []).append(t)
    assert got == {i: sum(t - 60 < x <= t for x in times[k]) for i, (k, t) in enumerate(rows)}


def test_deep_and_shallow_pages_agree(spark, monkeypatch):
    df = spark.range(500).withColumn("v", F.col("id") % 7)
    order = ["-v", "id"]
    shallow = [r["id"] for r in ordering.paginate(df, order, 4, 30).collect()]
    monkeypatch.setattr(ordering, "TOP_K_BOUND", 0)
    assert [r["id"] for r in ordering.paginate(df, order, 4, 30).collect()] == shallow


def test_match_cells_do_not_change_the_result(spark, sf, monkeypatch):
    p, m = promos(spark, sf), methods(spark, sf)
    whole = {tuple(r) for r in match.match_users(p, m, AS_OF).collect()}
    monkeypatch.setattr(match, "CELL_ROWS", 3)
    assert {tuple(r) for r in match.match_users(p, m, AS_OF).collect()} == whole


def test_match_keys_cover_every_name_length(spark):
    texts = ["a", "uala", "banco de galicia", "x", "naranja x", "pagá con modo"]
    offers = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], "id long, bank string, wallet string, title string")
    names = spark.createDataFrame([(n,) for n in ["a", "la", "alicia", "naranja x", "zz", "modo", "o d"]], "name string")
    got = {tuple(r) for r in match.name_hits(offers, names).collect()}
    assert got == {(i, n) for i, t in enumerate(texts) for n in ["a", "la", "alicia", "naranja x", "zz", "modo", "o d"] if n in t.replace("á", "a")}


def test_nested_blocks_against_brute_force(spark):
    texts = ["uno dos tres cuatro cinco seis siete ocho nueve diez", "tres cuatro cinco", "ocho nueve diez", "uno dos tres cuatro cinco seis siete ocho", "zz", "uno dos tres cuatro cinco seis siete ocho", "otro"]
    blocks = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 0, "tres cuatro cinco")], "page_id long, block_pos int, text string")
    got = {(r["page_id"], r["block_pos"]) for r in dedup.nested_text_dedup(blocks).collect()}
    assert got == {(1, 0), (1, 4), (1, 6), (2, 0)}


def test_facet_equals_direct_count(spark, sf):
    p = promos(spark, sf).filter(filters.valid_on(AS_OF))
    facet = {r["name"]: r["n"] for r in relational.entity_facet(p).collect()}
    assert facet["NATION_3"] == p.filter("bank = 'NATION_3' or wallet = 'NATION_3'").count()


def test_unknown_filters_are_ignored(spark, sf):
    p = promos(spark, sf)
    assert p.filter(filters.modality_in("otra")).count() == p.filter(filters.discount_kind_is("otro")).count() == p.count()


# --- plans --------------------------------------------------------------------------------------------


def test_listing_plan(spark, sf):
    page, _ = ask.list_offers(promos(spark, sf), merchants(spark, sf), store_terms(spark, sf), Q1, dt.date.fromisoformat(AS_OF))
    text = plan(page)
    assert "TakeOrderedAndProject" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "Python" not in text
    assert "PushedFilters: [IsNotNull(" in text


def test_match_plan_has_no_cross_join(spark, sf):
    text = plan(match.match_users(promos(spark, sf), methods(spark, sf), AS_OF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "Python" not in text


def test_dedup_combines_before_the_shuffle(spark, sf):
    text = plan(dedup.dedup_keep_richest(fixture(spark, sf, "fx_crawl").withColumnRenamed("supermarket_id", "merchant_id"), ["merchant_id"]))
    assert "partial_min_by" in text and "Window" not in text


def test_short_literal_rules_match(spark):
    from offerloom.functions.rules import best_by_rules

    rules = spark.createDataFrame(
        [("r", "mp", "two", 2), ("r", "x", "one", 3), ("r", "banco x", "long", 1), ("s", "mp", "other", 0)],
        "rule_set string, pattern string, name string, priority int",
    )
    texts = spark.createDataFrame([(1, "Paga MP"), (2, "x"), (3, "Banco X mp"), (4, "nada"), (5, None), (6, "")], "id int, t string")
    got = {r.id: r.name for r in best_by_rules(texts, "t", rules, "r").select("id", F.col("name")).collect()}
    assert got == {1: "two", 2: "one", 3: "long"}


def test_a_missing_pointer_is_an_empty_store(spark, tmp_path):
    assert lifecycle.current_batch(spark, str(tmp_path / "none")) is None


def test_nested_blocks_compare_whole_texts(spark):
    head = "".join(f"palabra{i} " for i in range(150))
    rows = [(1, 1, head + "uno"), (1, 2, head + "dos"), (1, 3, "antes " + head + "uno y más"), (1, 4, "x" + head[600:1300] + "y"), (1, 5, head[700:1350])]
    blocks = spark.createDataFrame([*rows, (1, 6, head[:600])], "page_id long, block_pos int, text string")
    assert {r["block_pos"] for r in dedup.nested_text_dedup(blocks).collect()} == {2, 3, 4}


def test_reset_query_writes_the_empty_tables(spark, sf, monkeypatch):
    made = []
    empty = lifecycle.empty_tables
    monkeypatch.setattr(lifecycle, "empty_tables", lambda s, kinds: made.append(set(kinds)) or empty(s, kinds))
    states = {r["state"]: r["n"] for r in QUERIES["w15_reset"](spark, sf).collect()}
    assert states["filled"] > 0 == states["reset"]
    assert made == [{"offers"}]


def test_ingested_crawl_is_dealt_by_merchant(spark, sf, monkeypatch):
    dealt, frame = [], type(spark.range(0))
    repartition = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *by: dealt.append(by) or repartition(self, *by))
    assert QUERIES["s1_stream_crawl_ingest"](spark, sf).count() > 0
    assert ("merchant_id",) in dealt and (1,) not in dealt


# --- whole values ---------------------------------------------------------------------------------------


def test_long_terms_lose_nothing(spark):
    from offerloom.functions import terms

    items = [f"PRODUCTO NUMERO {i} DE UNA MARCA CON UN NOMBRE MUY LARGO QUE SIGUE Y SIGUE" for i in range(120)]
    excluded = "QUEDAN EXCLUIDOS DEL DESCUENTO: " + ", ".join(items) + "."
    asked = " ".join(f"EXCLUSIVO PARA CLIENTES DEL PLAN {chr(65 + i % 26)}{chr(65 + i // 26)}." for i in range(30))
    df = spark.createDataFrame([(1, excluded + " " + asked)], "id long, raw string")
    got = df.select(
        terms.extract_exclusions_terms(F.col("raw")).alias("out"),
        F.size(terms.requirement_items(F.col("raw"))).alias("n"),
    ).first()
    assert len(excluded) > 8000 and items[-1] in got.out and len(got.out) > 8000
    assert got.n >= 30


def test_pages_of_any_number_join_the_frontier(spark):
    from offerloom.sources import tables

    links = "".join(f'<a href="/p/{n}">{n}</a>' for n in (1, 2, 25, 40, 117))
    pages = spark.createDataFrame([(1, "http://h.example/a", links)], "page_id long, url string, html string")
    visited = spark.createDataFrame([(f"http://h.example/v{i}",) for i in range(40)], "url string")
    found = {r["url"].rsplit("/", 1)[1] for r in tables.discover_next_pages(pages, visited).collect()}
    assert found == {"2", "25", "40", "117"}


def test_legal_blocks_and_cards_are_whole(spark):
    from offerloom.operators import blocks

    text = "tarjeta " * 200 + "PROMOCIÓN VÁLIDA " + "B" * 9000 + " DESCUENTO EXCLUSIVO " + "C" * 7000
    rows = blocks.legal_spans(spark.createDataFrame([(1, text)], "id long, t string"), F.col("t"), ["id"]).orderBy("pos").collect()
    assert [len(r.legal_text) for r in rows] == [len("PROMOCIÓN VÁLIDA ") + 9000, len("DESCUENTO EXCLUSIVO ") + 7000]
    assert len(rows[0].card_text) == 200 * 8 - 1
    cards = blocks.badge_cards(spark.createDataFrame([(1, "a" * 3000 + " 20% " + "b" * 3000)], "id long, t string"), F.col("t"), ["id"]).collect()
    assert [len(r.card_text) for r in cards] == [6005]


@pytest.mark.parametrize("source", list(profiles.PROFILES))
def test_profiles_of_pages_without_cards(spark, source):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p>nada</p>")], "page_id long, html string")
    assert profiles.offers_from_pages(pages, profiles.PROFILES[source]).count() == 0


def test_few_and_many_names_match_alike(spark, sf, monkeypatch):
    """Few names are searched row by row, many by leading characters; long texts, equal texts and rows that repeat stay."""
    texts = ["Banco de Galicia " * 60 + "y MODO", "uala", "uala", "", None]
    offers = spark.createDataFrame([(i % 4, t, None) for i, t in enumerate([*texts, "uala"])], "id long, bank string, title string")
    names = spark.createDataFrame([(n,) for n in ["modo", "uala", "galicia", "a", "zz"]], "name string")
    p, m = promos(spark, sf), methods(spark, sf)

    def found():
        return sorted(tuple(r) for r in match.name_hits(offers, names).collect()), {tuple(r) for r in match.match_users(p, m, AS_OF).collect()}

    few = found()
    monkeypatch.setattr(match, "MOST_LISTED", 2)
    assert found() == few
    assert few[0] == sorted([(0, "modo"), (0, "galicia"), (0, "a"), *[(i, n) for i in (1, 1, 2) for n in ("uala", "a")]])


def test_digests_join_users_last(spark, sf):
    """No message is shuffled once it is a user's: the plan ends in the union of headers and messages."""
    found = ask.digests(fixture(spark, sf, "fx_users"), methods(spark, sf), promos(spark, sf), merchants(spark, sf), AS_OF)
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_each_message_goes_to_its_receivers_in_a_row(spark):
    """A task holds the receivers of a cell, which are bounded, not all messages of a set, and equal texts follow each other."""
    from itertools import groupby

    users = spark.createDataFrame([(i, str(i), 1) for i in range(5)], "id long, telegram_chat_id string, notify_daily int")
    own = spark.createDataFrame([(i, "Banco A") for i in range(5)], "user_id long, entity_name string")
    shops = spark.createDataFrame([(i, f"M{i}", "fuel") for i in range(3)], "id long, name string, category string")
    offers = spark.createDataFrame(
        [(i, i % 3, "T", "10%", "Banco A", "", None, None, None, None, 1) for i in range(6)],
        "id long, merchant_id long, title string, discount string, bank string, wallet string, store_types string, "
        "valid_days string, valid_from date, valid_until date, is_active int",
    )
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        rows = ask.digests(users, own, offers, shops, AS_OF).where("kind = 'merchant'").collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sorted((r.user_id, r.merchant_name) for r in rows) == [(i, f"M{n}") for i in range(5) for n in range(3)]
    assert [len([*same]) for _, same in groupby(rows, lambda r: r.text)] == [5, 5, 5]


def test_texts_are_searched_once(spark):
    """No second search only to drop texts without a match, and false candidates of rules go before their expressions."""
    texts = spark.createDataFrame([(1, "10% DE DESCUENTO - BANCO A: con Banco Macro " + "x" * 100), (2, "nada")], "id long, t string")
    for found in (blocks.offer_sections(texts, F.col("t"), ["id"]), blocks.badge_cards(texts, F.col("t"), ["id"])):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
        assert [(r["id"], r["pos"]) for r in found.collect()] == [(1, 0)]
    assert rules.literal_runs(r"BANCO\s+MACRO|CUENTAS?\s+DNI", False) == [["banco", "macro"], ["cuenta", "dni"]]
    counts = QUERIES["a11_rule_sets"](spark, "/root/testdata/sf0.001")
    assert "Filter (size(" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_nested_blocks_of_all_lengths_against_brute_force(spark):
    """Pieces of every length at any offset, none of them too short or too long to be found; keys grow slower than texts."""
    import random

    rng = random.Random(3)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzáé😀") for _ in range(3000))
    texts = [long, *[long[at : at + n] for n in (1, 2, 3, 4, 7, 8, 15, 16, 31, 32, 33, 60, 500) for at in (0, 17, 1400, 3000 - n)]]
    texts += [t[:-1] + "#" for t in texts if len(t) > 1]
    rows = [(1, i, t) for i, t in enumerate(texts)]
    blocks_ = spark.createDataFrame([*rows, (2, 0, long[5:50])], "page_id long, block_pos int, text string")
    first = {t: i for i, t in reversed([*enumerate(texts)])}
    want = {(1, i) for t, i in first.items() if not any(t != o and t in o for o in first)} | {(2, 0)}
    assert {(r["page_id"], r["block_pos"]) for r in dedup.nested_text_dedup(blocks_).collect()} == want
    assert len(dedup.offered_keys(long, [0])) < len(long) / 8


def test_rate_counts_keep_their_state_on_disk(spark, sf, monkeypatch):
    from offerloom.streaming import streams

    given, run = [], streams.run_to_files
    monkeypatch.setattr(streams, "run_to_files", lambda *a: (given.append(a[3]), run(*a))[1])
    before = {name: spark.conf.get(name, None) for name in streams.ON_DISK}
    assert QUERIES["s4_stream_rate_counts"](spark, sf).count() > 0
    assert given == [streams.ON_DISK]
    assert {name: spark.conf.get(name, None) for name in streams.ON_DISK} == before
