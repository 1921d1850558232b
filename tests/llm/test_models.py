"""Learnt operators: held-out accuracy, and defined results for odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from offerloom.llm.common import held_out, table
from offerloom.llm.cross_parsing import automaton, languages
from offerloom.llm.string_kernel import DECAY, Machine, labelled_sample, subsequences, toxicity, train, word_scores, word_symbols
from offerloom.llm import weak_labels
from offerloom.llm.weak_labels import LABELLERS, estimate, quality

MIDDLE = "/root/testdata/sf0.1"
ODD = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "12 !!", None, "a"), (None, "Of the heathen and the onion, for in that thing the ends ered", "en", "a"), (5, "z" * 200_000, "en", "a")]
SCHEMA = "doc_id long, text string, lang string, score string"


def test_languages_held_out(spark):
    docs = table(spark, MIDDLE, "documents")
    rows = languages(docs).where(held_out(docs["doc_id"])).select("lang", "language.lang_pred").collect()
    assert len(rows) > 1500
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_languages_of_odd_rows(spark):
    learn = table(spark, "/root/testdata/sf0.001", "documents")
    got = {r.doc_id: r.language for r in languages(spark.createDataFrame(ODD, SCHEMA), learn).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[None].lang_pred == "en" and 0.5 <= got[None].score <= 1
    empty = spark.createDataFrame([], SCHEMA)
    assert languages(empty).count() == 0
    assert {r.language.lang_pred for r in languages(spark.createDataFrame(ODD, SCHEMA), empty).collect()} == {"und"}


def test_automaton_reads_exactly_the_substrings():
    text = [3, 4, 3, 3, 5, 4, 3, 4, 3]
    rows = automaton(text, 6)

    def reads(word):
        state = 0
        for s in word:
            state = rows[state, s]
            if state < 0:
                return False
        return True

    inside = {tuple(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    rng = np.random.default_rng(0)
    words = [*inside, *map(tuple, (rng.integers(3, 6, n) for n in rng.integers(1, 6, 300)))]
    assert all(reads(w) == (tuple(w) in inside) for w in words)


def test_toxicity_held_out(spark):
    docs, labels = table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "labels")
    scored = toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    toxic = [r.predicted for r in scored if r.toxic == 1]
    clean = [r.predicted for r in scored if r.toxic == 0]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.05


def test_inserted_and_dropped_letters_stay_close():
    clean = ["the weather is fine today and the garden grows well", "we walked along the river to the old mill"]
    toxic = ["you are a worthless person", "what a worthless idea this is", "worthless people again"]
    weights, _, _ = train(toxic * 5 + clean * 10, [1] * 15 + [0] * 20)
    score = lambda w: word_scores(word_symbols(w), weights).max()
    for word in ("worthless", "w-o-r-t-h-l-e-s-s", "worthxless", "worthles", "w o r t h l e s s"):
        assert score(word) > score("weather") and score(word) > score("walked")


def test_kernel_equals_brute_force():
    """Common subsequences of three letters, each skipped letter weighing DECAY and at most two skipped."""

    def features(word):
        out = {}
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, min(len(word), i + 5)):
                    # Edges of a word count as letters at its ends only.
                    key = (word[i], word[j], word[k])
                    out[key] = out.get(key, 0.0) + DECAY ** (k - i - 2)
        return out

    words = [b"\0" + bytes(w) + b"\0" for w in ([1, 2, 3, 4], [1, 9, 2, 3, 3, 4], [5, 5, 5, 5, 5], [2, 1], [7, 1, 2, 7, 3, 7, 4])]
    machine = Machine(words)
    norm = lambda f: sum(v * v for v in f.values()) ** 0.5
    for a, own in enumerate(words):
        for b, other in enumerate(words):
            one, two = features(own), features(other)
            want = sum(v * two.get(k, 0.0) for k, v in one.items()) / norm(one) / norm(two)
            assert (machine.matrix.T @ machine.matrix)[a, b] == pytest.approx(want)
    line = np.frombuffer(words[1], np.uint8)
    assert sum(len(at) * w for at, _, w in subsequences(line)) == pytest.approx(sum(features(words[1]).values()))


def test_machine_equals_a_plain_solver():
    """The weights minimise the squared hinge loss with the ridge: no step from them lowers it."""
    rng = np.random.default_rng(6)
    words = [b"\0" + bytes(rng.integers(1, 20, rng.integers(3, 9)).astype(np.uint8)) + b"\0" for _ in range(200)]
    labels, mass = (rng.random(200) < 0.4).astype(int), rng.integers(1, 4, 200).astype(float)
    machine = Machine(words[:40])
    weights = machine.fit(words, labels, mass, penalty=1e-3)
    x, y = machine.features(words), np.where(labels > 0, 1.0, -1.0)
    share = mass * np.where(y > 0, 0.5 / mass[y > 0].sum(), 0.5 / mass[y < 0].sum())
    target = machine.matrix[:-1] @ machine.root
    beta = np.linalg.lstsq(target, weights[machine.numbers], rcond=None)[0]
    biases = np.linspace(-2, 2, 4001)
    loss = lambda v: min((share * np.maximum(0, 1 - y * (x @ v + b)) ** 2).sum() for b in biases) + 1e-3 * (v @ v)
    best = loss(beta)
    assert all(loss(beta + 0.02 * rng.normal(size=len(beta))) > best - 1e-5 for _ in range(20))


def test_texts_without_blanks_are_not_toxic_for_it(spark):
    docs, labels = table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "labels")
    weights, slope, offset = train(*labelled_sample(docs, labels, "toxic"))

    def score(text):
        best = word_scores(word_symbols(text), weights).max(initial=-1.0)
        return 1 / (1 + np.exp(-np.clip(slope * best + offset, -30, 30)))

    clean = docs.join(labels.where("toxic = 0"), "doc_id").where(held_out(docs["doc_id"])).orderBy("doc_id").limit(300).collect()
    assert np.mean([score("".join((r.text or "").split())) >= 0.5 for r in clean]) < 0.05
    rng = np.random.default_rng(1)
    letters = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n)) for n in (30, 300, 3000)]
    assert all(score(t) < 0.5 for t in ["a" * n for n in (10, 100, 256, 1000, 100_000)] + letters)
    insult = max((r.text for r in docs.join(labels.where("toxic = 1"), "doc_id").limit(50).collect()), key=score)
    assert score(insult) >= 0.5


def test_toxicity_of_odd_rows(spark):
    docs, labels = table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "labels")
    rows = spark.createDataFrame([(i, t) for i, t, _, _ in ODD], "doc_id long, text string")
    got = toxicity(docs.select("doc_id", "text").unionByName(rows), labels).orderBy("doc_id").limit(3).collect()
    assert all(0 <= r.score <= 1 for r in got)
    assert toxicity(spark.createDataFrame([], SCHEMA), labels).count() == 0
    none = toxicity(rows, labels.limit(0)).collect()
    assert {r.predicted for r in none} == {0} and len(none) == len(ODD)


def test_quality_agrees_with_labels(spark):
    docs, labels = table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "labels")
    rows = quality(docs).join(labels, "doc_id").collect()
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.97
    assert np.mean([r.predicted for r in rows if r.quality == 0]) < 0.1


@pytest.mark.parametrize(
    ("wrong", "found"),
    [
        ([0.005] * 10, [0.6] * 10),
        ([0.6] + [0.02] * 9, [0.6] * 10),
        ([0.6, 0.3] + [0.02] * 8, [0.6] * 10),
        ([0.02] * 8 + [0.3, 0.6], [0.8] * 10),
        ([0.6] * 3 + [0.3] * 3 + [0.02] * 4, [0.9] * 10),
    ],
)
def test_estimate_finds_the_planted_accuracies(wrong, found):
    """Labellers that accuse good texts rarely, or often, and find some of the bad ones, vote independently."""
    rng = np.random.default_rng(3)
    good = rng.random(40_000) < 0.8
    votes = np.stack([np.where(good, rng.random(len(good)) > w, rng.random(len(good)) > f) for w, f in zip(wrong, found, strict=True)], axis=1)
    patterns, counts = np.unique((votes * 3 ** np.arange(len(LABELLERS))).sum(axis=1), return_counts=True)
    table_, share, posterior = estimate(patterns, counts.astype(float))
    assert share == pytest.approx(0.8, abs=0.02)
    assert table_[:, 1, weak_labels.BAD] == pytest.approx(wrong, abs=0.05)
    assert table_[:, 0, weak_labels.BAD] == pytest.approx(found, abs=0.05)
    assert posterior[patterns == sum(3**k for k in range(len(LABELLERS)))] > 0.99


def test_estimate_tells_types_of_bad_texts():
    """Two types, each accused by labellers of its own; some texts of a type are accused by one of them alone."""
    rng = np.random.default_rng(4)
    kind = rng.choice(3, 40_000, p=[0.86, 0.07, 0.07])
    votes = np.ones((len(kind), len(LABELLERS)), int)
    for own, accusers in ((1, {0: 1.0, 1: 0.5}), (2, {3: 0.98, 4: 0.6, 5: 0.6})):
        for k, often in accusers.items():
            votes[(kind == own) & (rng.random(len(kind)) < often), k] = 0
    codes = (votes * 3 ** np.arange(len(LABELLERS))).sum(axis=1)
    patterns, counts = np.unique(codes, return_counts=True)
    good = dict(zip(patterns, estimate(patterns, counts.astype(float))[2], strict=True))
    predicted = np.array([good[c] for c in codes]) >= 0.5
    assert predicted[kind == 0].mean() > 0.99 and predicted[kind > 0].mean() < 0.05


def test_quality_of_odd_rows(spark):
    rows = quality(spark.createDataFrame(ODD, SCHEMA)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in rows)
    assert quality(spark.createDataFrame([], SCHEMA)).count() == 0


def test_separators_count_over_the_whole_text():
    prose = "Plain words of a text that goes on. " * 50
    late, early = prose + "| -- " * 200, "| -- " * 30 + prose * 10
    vote = lambda t: weak_labels._separators(t, t.split())
    assert (vote(prose), vote(late), vote(early)) == (weak_labels.GOOD, weak_labels.BAD, weak_labels.GOOD)
