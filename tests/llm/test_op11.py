"""Whitening against a plain eigenvalue solver and exact integer sums."""

from __future__ import annotations

import math

import numpy as np
import pytest

from offerloom.llm.queries import QUERIES
from offerloom.llm.whitening import Moments, eigenvectors, polar, whitened

VECTORS = "vec_id long, embedding array<float>, component int, x string"


def brute(rows, components=8):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in good], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [int(((n * row - sums) ** 2).sum()) for row in x]
    y = np.array(n * x - sums, float) / n
    values, found = np.linalg.eigh(y.T @ y / n)
    values, found = values[::-1][:components], found[:, ::-1][:, :components]
    return [i for i, _ in good], deviation, y @ found / np.sqrt(values), values / (y**2).sum() * n


def check(got, rows):
    ids, deviation, want, explained = brute(rows)
    at = {i: k for k, i in enumerate(ids)}
    assert len(got) == want.size
    signs = {}
    for r in got:
        k, c = at[r.vec_id], r.component - 1
        assert r.n == len(ids) and int(r.deviation) == deviation[k] and r.identity_error < 1e-9
        assert r.explained == pytest.approx(explained[c], rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs(want[k, c]), abs=1e-7)
        if abs(want[k, c]) > 1e-3:
            signs.setdefault(c, set()).add(r.whitened * want[k, c] > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_equals_a_plain_solver(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(300, 12)) * np.linspace(0.1, 1, 12)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(data)]
    rows += [(1000, None), (1001, [1.0] * 11 + [None]), (1002, [math.nan] * 12), (1003, [math.inf] * 12), (1004, rows[0][1])]
    got = whitened(spark.createDataFrame([(*r, 1, "a") for r in rows], VECTORS)).collect()
    check(got, rows)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(QUERIES["op11_whitening"](spark, sf).collect(), rows)


@pytest.mark.parametrize("kind", ["random", "clustered", "repeated", "graded", "diagonal", "wide"])
def test_divide_and_conquer(kind):
    rng = np.random.default_rng(7)
    n = {"wide": 200}.get(kind, 40)
    values = {
        "random": rng.uniform(0, 1, n),
        "clustered": np.r_[1 + 1e-9 * rng.uniform(size=20), rng.uniform(size=20)],
        "repeated": np.r_[np.ones(20), np.full(20, 3.0)],
        "graded": 10.0 ** -np.arange(n) / 1.0,
        "diagonal": np.arange(n, dtype=float),
        "wide": rng.uniform(0, 100, n),
    }[kind]
    turn = np.eye(n) if kind == "diagonal" else np.linalg.qr(rng.normal(size=(n, n)))[0]
    matrix = turn @ np.diag(values) @ turn.T
    got, found = eigenvectors(matrix)
    size = np.abs(values).max()
    assert np.allclose(got, np.sort(values)[::-1], atol=1e-13 * n * size)
    assert np.abs(found.T @ found - np.eye(n)).max() < 1e-13 * n
    assert np.abs(matrix @ found - found * got).max() < 1e-13 * n * size


def test_polar_factor_is_the_sign_function():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    values, vectors = np.linalg.eigh(a)
    assert np.allclose(polar(a), vectors @ np.diag(np.sign(values)) @ vectors.T, atol=1e-12)
    assert polar(np.zeros((3, 3))) is None and polar(np.diag([1.0, 0.0])) is None


def test_deviations_beyond_64_bits():
    means = Moments(10**9, [5 * 10**9 + 3, 7])
    assert means.deviations(np.array([[10**6, -4]])) == [(10**15 - 5 * 10**9 - 3) ** 2 + (-4 * 10**9 - 7) ** 2]


def test_no_rows_and_no_variance(spark):
    frame = lambda rows: spark.createDataFrame(rows, VECTORS)
    assert whitened(frame([])).count() == 0
    assert whitened(frame([(1, None, 1, "a"), (2, [None], 1, "a"), (3, [], 1, "a")])).count() == 0
    assert whitened(frame([(1, [1.0, 2.0], 1, "a"), (2, [1.0, 2.0], 1, "a")])).count() == 0
    flat = whitened(frame([(1, [1.0, 2.0], 1, "a"), (2, [3.0, 2.0], 1, "a"), (None, [2.0], 1, "a")])).collect()
    assert {r.vec_id for r in flat} == {1, 2, None} and {r.component for r in flat} == {1, 2}
