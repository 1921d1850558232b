"""Hard negatives against brute force and against SQL."""

from __future__ import annotations

import math
import struct

import numpy as np
import pytest
from compare import difference

from offerloom.llm.hard_negatives import KEY, OFFSET, hard_negatives, negatives_of
from offerloom.llm.queries import ORACLES, QUERIES

VECTORS = "vec_id long, label int, embedding array<float>, chunk int, score string"


def brute(rows, step=50):
    whole = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            x = tuple(math.floor(256 * float(np.float32(c))) for c in v)
            whole[i] = min(whole.get(i, (label, x)), (label, x))
    out = set()
    for a in (i for i in whole if i % step == 0):
        score = {i: sum(p * q for p, q in zip(whole[a][1], x, strict=False)) for i, (_, x) in whole.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if whole[i][0] == whole[a][0]][:5]:
            fit = [i for i in order if whole[i][0] != whole[a][0] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out |= {(a, p, n, i, score[p], score[i]) for n, i in enumerate(fit[:3], 1)}
    return out


def result(spark, rows, **how):
    got = [tuple(r) for r in hard_negatives(spark.createDataFrame([(*r, 1, "a") for r in rows], VECTORS), **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize(("block", "chunk", "cell"), [(2048, 8192, 65_536), (16, 3, 40), (1, 1, 1)])
def test_equals_brute_force(spark, monkeypatch, block, chunk, cell):
    for name, size in (("BLOCK_ROWS", block), ("CHUNK_ANCHORS", chunk), ("CELL_ROWS", cell)):
        monkeypatch.setattr(f"offerloom.llm.hard_negatives.{name}", size)
    rng = np.random.default_rng(5)
    count = 60 if block == 1 else 400
    data = np.round(rng.normal(size=(count, 6)), 1)
    rows = [(i - 100, int(rng.integers(3)), [float(v) for v in x]) for i, x in enumerate(data)]
    rows[3], rows[4], rows[5] = (-97, None, [1.0] * 6), (-96, 1, None), (-95, 1, [1.0, None])
    rows[50], rows[51], rows[52] = (-50, 1, [math.nan] * 6), (None, 1, [1.0] * 6), (-48, 1, [2.0, 2.0])
    # Ties, repeated ids (of an anchor too), long numbers and a row of zeros.
    rows += [(1000 + i, i % 3, rows[9][2]) for i in range(20)] + [(1000, 2, rows[8][2]), (0, 0, rows[7][2])]
    rows += [(2000, 1, [0.0] * 6), (2001, 1, [1e6] * 6), (2050, 2, [9e6] * 6)]
    assert result(spark, rows) == brute(rows) != set()


def test_hot_label_and_equal_rows(spark):
    rows = [(i, 0 if i % 3 else 1, [1.0, 0.5 + (i % 5) / 4]) for i in range(600)]
    assert result(spark, rows) == brute(rows) != set()


def test_no_rows(spark):
    assert result(spark, []) == set() == result(spark, [(0, 1, None)]) == result(spark, [(0, 1, [1.0])])
    assert result(spark, [(0, 1, []), (1, 1, []), (2, 2, [])]) == {(0, 1, 1, 2, 0, 0)}
    assert result(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == set()


def test_stream_keeps_open_windows_only():
    def keys():
        for anchor in (0, 50):
            for score in (100, 80):
                yield struct.pack(KEY, anchor + OFFSET, OFFSET - 1 - score, 0, score + OFFSET)
            for score in range(79, 20, -1):
                yield struct.pack(KEY, anchor + OFFSET, OFFSET - 1 - score, 1, score + OFFSET)

    got = list(negatives_of(keys(), 5, 3, (50, 95)))
    assert got[:3] == [(0, 100, 1, 79, 100, 79), (0, 100, 2, 78, 100, 78), (0, 100, 3, 77, 100, 77)]
    assert [r[1:4] for r in got[3:6]] == [(80, 1, 76), (80, 2, 75), (80, 3, 74)] and len(got) == 12


@pytest.mark.parametrize("name", ["op4_pivot_search", "op10_winnowing", "op13_hard_negatives"])
def test_queries_equal_sql(name, spark, sf, oracle):
    assert difference(QUERIES[name](spark, sf), oracle, ORACLES[name]) is None
