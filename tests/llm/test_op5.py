"""Substring dedup against a comparison of all windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from offerloom.llm.suffix_dedup import removal_report, without_repeats

SCHEMA = "doc_id long, text string, lang string, run int, text_key string"


def brute(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for raw in raws:
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeñü ") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, long_shared = prose(60), prose(3000)
    whole = prose(80)
    return [
        None,
        "",
        "short",
        prose(50) + shared + prose(50),
        shared[3:] + prose(20),
        prose(10) + shared[:-5],
        whole,
        whole,
        "a" * 450,
        prose(30) + "ab" * 300 + prose(30),
        prose(7) + long_shared + prose(7),
        long_shared[100:-100] + prose(1),
        prose(40) + shared[:199] + "#" + prose(4),
        (prose(30) + " ") * 3,
        *[prose(12) + shared[k : k + 250] + prose(12) for k in range(0, 40, 4)],
    ]


def test_matches_brute_force(spark):
    data = texts()
    docs = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in enumerate(data)], SCHEMA)
    got = {r.doc_id: tuple(r)[1:] for r in removal_report(docs).collect()}
    assert got == dict(enumerate(brute(data)))


def test_large_buckets_give_the_same(spark, monkeypatch):
    monkeypatch.setattr("offerloom.llm.suffix_dedup.BUCKET_ROWS", 2)
    data = texts()
    docs = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in enumerate(data)], SCHEMA)
    got = {r.doc_id: tuple(r)[1:] for r in removal_report(docs).collect()}
    assert got == dict(enumerate(brute(data)))


def test_texts_longer_than_a_segment(spark, monkeypatch):
    monkeypatch.setattr("offerloom.llm.suffix_dedup.PIECE_BYTES", 3000)
    data = texts()
    docs = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in enumerate(data)], SCHEMA)
    got = {r.doc_id: tuple(r)[1:] for r in removal_report(docs).collect()}
    assert got == dict(enumerate(brute(data)))


def test_columns_stay_and_repeated_ids_are_rows(spark):
    text = "".join(random.Random(1).choice("xyz ") for _ in range(300))
    docs = spark.createDataFrame([(1, text, None, 3, None), (1, text, "de", 4, "k"), (None, "clean", None, 5, "k")], SCHEMA)
    rows = without_repeats(docs)
    assert rows.columns == docs.columns
    assert sorted((r.text, r.run) for r in rows.collect()) == [("", 3), ("", 4), ("clean", 5)]


@pytest.mark.parametrize("function", [removal_report, without_repeats])
def test_empty_table(spark, function):
    assert function(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_stage_has_one_python_step(spark, monkeypatch):
    """Steps in a row have workers of their own for each task, which stay in an executor's memory."""
    from offerloom.llm import suffix_dedup

    plans, save = [], suffix_dedup.saved
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", 2)
    monkeypatch.setattr(suffix_dedup, "saved", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), save(df))[1])
    docs = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in enumerate(texts())], SCHEMA)
    removal_report(docs).collect()
    assert sum("MapInArrow" in p for p in plans) > 3
    for plan in plans:
        steps = 0
        for line in plan.splitlines():
            steps = 0 if "Exchange" in line or "Scan" in line else steps + ("MapInArrow" in line)
            assert steps <= 1, plan


def test_gathered_batches_hold_the_same_rows(monkeypatch):
    import pyarrow as pa

    from offerloom.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "BATCH_ROWS", 5)
    sizes = [0, 1, 3, 2, 12, 0, 4, 5, 1]
    given = [pa.record_batch({"x": pa.array(range(100 * i, 100 * i + n), pa.int64())}) for i, n in enumerate(sizes)]
    got = list(suffix_dedup._gathered(iter(given)))
    assert [x for b in got for x in b.column(0).to_pylist()] == [x for b in given for x in b.column(0).to_pylist()]
    assert all(0 < len(b) <= 5 for b in got)
    assert list(suffix_dedup._gathered(iter([]))) == []
