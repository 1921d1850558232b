"""The shingle join against every pair's exact similarity."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from offerloom.llm import shingle_join
from offerloom.llm.shingle_join import linked, part_keys, parts_of, similar_documents, size_classes

DOCS = "doc_id long, text string, node long, row int, bucket string, size int"


def shingles(text):
    raw = re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3)))


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(docs) if doc is not None)


def result(spark, docs):
    rows = similar_documents(spark.createDataFrame([(*d, 1, 1, "x", 1) for d in docs], DOCS)).collect()
    assert len(rows) == len(docs)
    return sorted(tuple(r) for r in rows if r.doc_id is not None)


def prose(rng, words, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(words)]


def corpus(rng):
    texts = []
    for size in (5, 9, 30, 60, 100, 100, 250, 700):
        for _ in range(4):
            base = prose(rng, size)
            texts += [" ".join(base), " ".join(base).upper()]
            for changes in (1, 1, 2, 3, 5):
                other = list(base)
                for _ in range(changes):
                    other[rng.randrange(size)] = f"x{rng.randrange(99)}"
                texts.append(" \t".join(other))
            texts += [" ".join(base[: -max(1, size // k)]) for k in (5, 6, 7, 8, 12, 30)]
    passage = " ".join(prose(rng, 60))
    texts += [passage + " " + " ".join(prose(rng, k)) for k in range(1, 30)]
    texts += [None, "", " \n ", "a", "A", "a b", "b a", "a b c", "a b c d", "a a a a a a a a", "a a a a", "Ü ü", "ü ü"]
    return texts


@pytest.mark.parametrize(("few", "leaf", "fanout"), [(16, 256, 32), (1, 3, 2), (0, 1, 1)])
def test_components_equal_brute_force(spark, monkeypatch, few, leaf, fanout):
    for name, size in (("FEW", few), ("LEAF", leaf), ("FANOUT", fanout)):
        monkeypatch.setattr(shingle_join, name, size)
    rng = random.Random(3)
    texts = corpus(rng)
    docs = [(i, t) for i, t in enumerate(rng.sample(texts, len(texts)))] + [(None, texts[0]), (None, "only here"), (7, texts[1])]
    docs += [(3, docs[3][1]), (-5, docs[3][1])]
    want = brute(docs)
    assert result(spark, docs) == want
    assert 20 < len({c for _, _, c in want}) < len(docs)


@pytest.mark.parametrize("dense", [4, 0])
def test_star_without_its_middle(spark, monkeypatch, dense):
    """One-word edits of a text that is missing: few pairs link, and every component is found."""
    monkeypatch.setattr(shingle_join, "LEAF", 16)
    monkeypatch.setattr(shingle_join, "DENSE", dense)
    rng = random.Random(8)
    base = prose(rng, 86)
    docs = []
    for i in range(150):
        other = list(base)
        other[rng.randrange(86)] = f"x{i}"
        docs.append((i, " ".join(other)))
    assert result(spark, docs) == brute(docs)


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(2)
    starts = size_classes(85)
    for size in (1, 2, 5, 6, 7, 12, 50, 333, 2000):
        hashes = np.unique(rng.integers(0, 1 << 63, size * 2, dtype=np.uint64))
        for _ in range(20):
            cut = int(rng.integers(0, size // 5 + 1))
            one = np.sort(rng.permutation(hashes[:size])[: size - cut])
            two = np.sort(np.r_[one[cut // 3 :], hashes[size : size + cut // 2]])
            if len(one) and len(two) and linked(one, two, 85):
                number = int(np.searchsorted(starts, min(len(one), len(two)), "right")) - 1
                assert int(np.searchsorted(starts, max(len(one), len(two)), "right")) - 1 in (number, number + 1)
                parts = parts_of(starts, 85, number)
                assert set(part_keys(one, number, parts).tolist()) & set(part_keys(two, number, parts).tolist())


def test_empty_table_and_long_text(spark):
    assert result(spark, []) == []
    rng = random.Random(1)
    long = prose(rng, 60_000, 10**6)
    docs = [(2, " ".join(long)), (1, " ".join([*long[:-3000], "end"])), (3, " ".join(long[:30_000]))]
    assert result(spark, docs) == brute(docs)
