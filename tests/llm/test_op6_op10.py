"""SimHash links and benchmark windows against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from offerloom.llm import simhash
from offerloom.llm.components import components
from offerloom.llm.near_dedup import one_of_each
from offerloom.llm.simhash import near_duplicates
from offerloom.llm.winnowing import contamination

SCHEMA = "doc_id long, text string, bucket int, node string"
ITEMS = "item_id long, text string, n int"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def texts():
    rng = random.Random(6)
    base = [prose(rng, 60) for _ in range(20)]
    near = [" ".join(w if k != i else "Xyz" for k, w in enumerate(base[0].split())) for i in range(40)]
    return [None, "", " \t\n", "one", "ONE", "two words", *base, *near, base[3].upper(), base[3], prose(rng, 5000)]


def roots(prints, radius):
    parent = list(range(len(prints)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(prints))]


def brute_print(text, size):
    words = (text or "").encode().translate(simhash.LOWER).split()
    grams = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("block", [1024, 4])
def test_components_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr("offerloom.llm.components.BLOCK", block)
    data = texts()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(data)], SCHEMA)
    prints = [brute_print(t, 3) for t in data]
    want = {i: (f"{p:016x}", r) for i, (p, r) in enumerate(zip(prints, roots(prints, 3), strict=True))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()} == want


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_chain_keys_lose_no_pair(spark, radius):
    rng = np.random.default_rng(radius)
    for _ in range(300):
        x = int(rng.integers(0, 1 << 63))
        y = x
        for bit in rng.choice(64, radius, replace=False):
            y ^= 1 << int(bit)
        bits, budgets = simhash._chain(radius)
        turn = lambda v, t: (v >> t | v << (64 - t)) & ((1 << 64) - 1)
        starts = [
            t
            for t in range(0, 64, bits)
            if any(turn(x, t) & m == turn(y, t) & m for m in simhash._keys(radius))
            and simhash.near_in_chain(radius)(np.array([turn(x, t), turn(y, t)], np.uint64), None)[0, 1]
        ]
        assert starts


def test_long_paths_have_one_root(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 501), (501, 502)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500, 502: 500}


def test_one_of_each_keeps_clean_rows_and_columns(spark):
    rng = random.Random(9)
    base = [prose(rng, 200) for _ in range(6)]
    edited = base[0].split()
    edited[100] = "changed"
    line = prose(rng, 12)
    rows = [(i, t, i, "k") for i, t in enumerate(base)]
    rows += [(10, " ".join(edited), 0, None), (11, base[1], 0, None), (11, base[1], 0, None), (None, base[2], 0, None)]
    rows += [(20, line + " " + prose(rng, 100), 0, None), (21, line + " " + prose(rng, 100), 0, None)]
    rows += [(30, None, 0, None), (31, "", 0, None), (32, "a b", 0, None), (33, "A  b", 0, None)]
    got = one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "bucket", "node"]
    assert sorted(r.doc_id for r in got.collect()) == [0, 1, 2, 3, 4, 5, 20, 21, 30, 32]


def brute_contamination(data, items):
    words = lambda t: re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").encode().translate(simhash.LOWER))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for t in data:
        w = words(t)
        hit, found = set(), set()
        for n in range(1, 11):
            for s in range(len(w) - n + 1):
                own = windows.get(tuple(w[s : s + n]))
                if own:
                    hit |= set(range(s, s + n))
                    found |= own
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def test_contamination_matches_brute_force(spark):
    rng = random.Random(10)
    bench = [prose(rng, 30) for _ in range(8)]
    shared = prose(rng, 25)
    items = [(i, t) for i, t in enumerate([*bench, "Zweiß wörter", "solo", "", None, shared + " end", "x " + shared])]
    items += [(2, bench[2]), (None, bench[3]), (None, "alpha beta"), (40, "a b c d e f g h i")]
    data = [
        None,
        "",
        prose(rng, 50),
        prose(rng, 20) + " " + bench[0].upper() + "! " + prose(rng, 20),
        prose(rng, 9) + " " + " ".join(bench[1].split()[5:15]) + " " + prose(rng, 9),
        " ".join(bench[1].split()[5:14]),
        "zweiß, WÖRTER zweiß WörtER zweiß wörter",
        "solo solo duo",
        "alpha beta gamma",
        shared,
        bench[3],
        "a b c d e f g h i j a b c d e f g h i",
        " ".join(bench),
        prose(rng, 4000) + " " + bench[4],
    ]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(data)], SCHEMA)
    bench_rows = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    got = {r.doc_id: tuple(r)[1:] for r in contamination(docs, bench_rows).collect()}
    assert got == dict(enumerate(brute_contamination(data, items)))


def test_text_ids_and_long_texts(spark, monkeypatch):
    """Ids of any type; a text over many segments, with hits across their ends, has the words and hits of brute force."""
    monkeypatch.setattr("offerloom.llm.winnowing.SEGMENT_BYTES", 300)
    rng = random.Random(2)
    bench = [prose(rng, 40) for _ in range(5)] + ["short one", "x" * 900 + " tail"]
    data = [" ".join(prose(rng, rng.randrange(30, 90)) + " " + b for b in bench * 4), "y" * 2000 + " short one " + "z" * 700, bench[1]]
    items = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(bench)], "item_id string, text string")
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(data)], "doc_id string, text string")
    got = {r.doc_id: tuple(r)[1:] for r in contamination(docs, items).collect()}
    want = brute_contamination(data, [(f"q{i}", t) for i, t in enumerate(bench)])
    assert got == {f"d{i}": w for i, w in enumerate(want)}


def test_a_text_of_very_many_words():
    from offerloom.llm.winnowing import WINDOW, _listed_windows, _window_prints, _words

    words = [f"w{i % 9973}{i % 7919}" for i in range(3_000_000)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    last = np.frombuffer(" ".join(words[-WINDOW:]).encode(), np.uint8)
    row, _, _, hashes = _words(last, np.array([0, len(last)]))
    print_ = _window_prints(hashes, row, WINDOW)[1][0]
    table_ = np.zeros(1 << 16, np.uint64)
    slot = int(print_ >> np.uint64(20)) & (64 * len(table_) - 1)
    table_[slot >> 6] = np.uint64(1) << np.uint64(slot & 63)
    counts, found = _listed_windows(data, np.array([0, len(data)]), [WINDOW], table_, False)
    assert counts[0] == len(words)
    assert (len(words) - WINDOW, " ".join(words[-WINDOW:])) in {(w["start"], w["words"]) for w in found[0]}


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b", 1, "x")], SCHEMA)
    assert near_duplicates(none).count() == one_of_each(none).count() == contamination(none, items).count() == 0
    assert [r.contaminated for r in contamination(some, items).collect()] == [False]


@pytest.mark.parametrize("most_broadcast", [200_000, 0])
def test_few_links_are_contracted_in_few_partitions(spark, monkeypatch, most_broadcast):
    from offerloom.llm import components as module

    counts, save = [], module.saved
    monkeypatch.setattr(module, "saved", lambda df: (counts.append((out := save(df)).rdd.getNumPartitions()), out)[1])
    monkeypatch.setattr(module, "MOST_BROADCAST", most_broadcast)
    monkeypatch.setattr(module, "PART_LINKS", 60)
    rng = random.Random(11)
    links = [(i + 1, i) for i in range(0, 40)] + [(500, rng.randrange(300, 400)) for _ in range(50)] + [(7, 7), (90, 80), (80, 90)]
    parent = {x: x for ab in links for x in ab}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 30)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = components(spark.createDataFrame(links, "a long, b long"))
        got = {r.node: r.root for r in found.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {x: top(x) for x in parent}
    assert len(counts) > 4 and max(counts[1:]) <= 2
