"""Text quality from overlapping heuristic labellers.

Each labeller votes good, bad or nothing on a text. Expectation-maximisation over the counts of all vote patterns (at most
3 ** labellers, whatever the size of the corpus) estimates how each labeller votes on good and on bad texts, without any
given label; the posterior of a pattern is its weak label. Bad texts are of several types, each accused by labellers of its
own, so labellers vote independently within a type, not within all bad texts. A type has to be accused by two labellers at
least: what a single labeller accuses, unlike any other, is its error on good texts. A linear scorer over hashed words and word shapes learns the
posteriors of a bounded sample and generalises beyond the votes.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import table

GOOD, BAD, NONE = 1, 0, 2
ROUNDS = 400
PRIOR = 1.0  # added to each count of a labeller's votes
TRUST = 0.04  # prior weight, in corpora, of labellers not accusing good texts: it settles what the votes leave open
TYPES = 4  # of bad texts, at most
LEAST_TYPE = 0.002  # share of texts that more than one labeller accuses, for a type to be looked for
LEAST_GOOD = 0.2  # share below which the class taken for good gives way to a larger one
CORROBORATED = 0.1  # more often than good texts, by two labellers, for a type to be one
SLOTS = 1 << 16
REPEATS = SLOTS - 1  # slot of the share of repeated runs of words
SAMPLE = 4000  # texts the scorer learns from
SAMPLE_CHARS = 20_000  # longer texts are not learnt from
SCALE = 10.0  # of mean word features
CACHE_WORDS = 200_000
SHAPES = [(re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "9")]


def _between(value: float, bad_below: float, good_from: float) -> int:
    return BAD if value < bad_below else GOOD if value >= good_from else NONE


def _length(text: str, words: list[str]) -> int:
    return _between(len(words), 3, 15)


def _word_length(text: str, words: list[str]) -> int:
    mean = sum(map(len, words)) / max(1, len(words))
    return GOOD if 2.5 <= mean <= 9 else BAD if mean < 2 or mean > 12 else NONE


def _symbols(text: str, words: list[str]) -> int:
    marks = sum(map(text.count, "#$%&*|<>{}[]\\^~_=+@"))
    return _between(-marks / max(1, len(words)), -0.25, -0.05)


def _sentences(text: str, words: list[str]) -> int:
    ends = text.count(".") + text.count("!") + text.count("?")
    return _between(ends / max(1, len(words)), 1 / 200, 1 / 60)


def _lines(text: str, words: list[str]) -> int:
    lines = [x for x in text.split("\n") if x.strip()]
    return _between(len(set(lines)) / len(lines), 0.6, 0.9) if len(lines) >= 4 else NONE


def repeated_share(words: list[str]) -> float:
    """Share of the runs of three words that were there before in the text."""
    return 1 - len(set(zip(words, words[1:], words[2:]))) / (len(words) - 2) if len(words) > 2 else 0.0  # noqa: B905


def _repeats(text: str, words: list[str]) -> int:
    return _between(-repeated_share(words), -0.5, -0.2) if len(words) >= 20 else NONE


def _digits(text: str, words: list[str]) -> int:
    return _between(-sum(map(text.count, "0123456789")) / max(1, len(text)), -0.1, -0.02)


def _separators(text: str, words: list[str]) -> int:
    alone = sum(not w.isalnum() and not any(map(str.isalnum, w)) for w in words) / max(1, len(words))
    return _between(-alone, -0.2, -0.03)


def _capitals(text: str, words: list[str]) -> int:
    large = sum(w.isupper() for w in words) / max(1, len(words))
    return _between(-large, -0.4, -0.15) if len(words) >= 15 else NONE


def _outcry(text: str, words: list[str]) -> int:
    return _between(-(text.count("!") + text.count("?")) / max(1, len(words)), -0.3, -0.05)


LABELLERS: list[Callable[[str, list[str]], int]] = [
    _length,
    _word_length,
    _symbols,
    _sentences,
    _lines,
    _repeats,
    _digits,
    _separators,
    _capitals,
    _outcry,
]


def vote_pattern(text: str | None) -> int:
    """The votes of all labellers, as digits of base 3."""
    words = (text or "").split()
    return sum(f(text or "", words) * 3**k for k, f in enumerate(LABELLERS))


def votes_of(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def _first_types(votes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Patterns of each type, to begin with: those accused by the labeller that most often accuses along with others."""
    bad, left, out = votes == BAD, counts.copy(), []
    together = bad & (bad.sum(axis=1) > 1)[:, None]
    for _ in range(TYPES):
        often = (together * left[:, None]).sum(axis=0)
        k = int(often.argmax())
        if often[k] <= LEAST_TYPE * counts.sum():
            break
        out.append(bad[:, k] & (left > 0))
        left = np.where(out[-1], 0, left)
    return out


def _maximised(votes: np.ndarray, counts: np.ndarray, belongs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(vote | class) as [class, labeller, vote], shares of the classes, and the classes of each pattern (the first: good)."""
    k = np.arange(votes.shape[1])
    for _ in range(ROUNDS):
        table_ = np.ones((belongs.shape[1], votes.shape[1], 3))
        for vote in (BAD, GOOD):
            table_[:, :, vote] = (belongs * counts[:, None]).T @ (votes == vote) + PRIOR
        table_[0, :, GOOD] += TRUST * counts.sum()
        table_[:, :, [BAD, GOOD]] /= table_[:, :, [BAD, GOOD]].sum(axis=2, keepdims=True)
        share = (belongs * counts[:, None]).sum(axis=0) + PRIOR
        share /= share.sum()
        odds = np.stack([np.log(t[k, votes]).sum(axis=1) for t in table_], axis=1) + np.log(share)
        new = np.exp(odds - odds.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        moved, belongs = np.abs(new - belongs).max(initial=0), new
        if moved < 1e-6:
            break
    return table_, share, belongs


def _merged(belongs: np.ndarray, number: int) -> np.ndarray:
    """The class of that number counted to the first one."""
    out = np.delete(belongs, number, axis=1)
    out[:, 0] += belongs[:, number]
    return out


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """P(vote | class, votes) as [labeller, class, vote], the share of good texts, and the posterior of good for each pattern.

    No vote is no evidence: it says that a labeller does not apply, not what the text is worth. Ties of the first guess go
    by the order of the labellers.
    """
    votes = votes_of(patterns)
    types = _first_types(votes, counts)
    belongs = np.full((len(patterns), 1 + len(types)), 1e-3)
    belongs[:, 0] = np.where((votes == BAD).any(axis=1), 0.3, 0.97)
    for number, own in enumerate(types, 1):
        belongs[own, number] = 0.7
    belongs /= belongs.sum(axis=1, keepdims=True)
    while True:
        table_, share, belongs = _maximised(votes, counts, belongs)
        large = [c for c in range(1, len(share)) if share[c] >= LEAST_GOOD]
        if share[0] < LEAST_GOOD and large:
            # Good is the class of some size that is accused least.
            belongs = _merged(belongs, min(large, key=lambda c: table_[c, :, BAD].sum()))
            continue
        more = table_[:, :, BAD] - table_[0, :, BAD] > CORROBORATED
        alone = [c for c in range(1, len(share)) if more[c].sum() < 2]
        if not alone:
            break
        belongs = _merged(belongs, alone[0])
    weights = share[1:] / max(share[1:].sum(), 1e-12)
    bad = np.tensordot(weights, table_[1:], 1) if len(weights) else np.full(table_[0].shape, 0.5)
    return np.stack([bad, table_[0]], axis=1), float(share[0]), belongs[:, 0]


def word_slots(word: str) -> tuple[int, int]:
    """The slots of a word and of its shape (letters a, digits 9, other characters as they are)."""
    shape = word
    for pattern, mark in SHAPES:
        shape = pattern.sub(mark, shape)
    return crc32(word.lower().encode()) % REPEATS, crc32(b"\0" + shape.encode()) % REPEATS


def train_scorer(texts: list[str], targets: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights of the slots and bias of a logistic scorer of mean word features, by gradient steps with AdaGrad."""
    known: dict[str, tuple[int, int]] = {}
    rows, columns, values = [], [], []
    for i, text in enumerate(texts):
        words = text.split()
        slots = np.array([known.get(w) or known.setdefault(w, word_slots(w)) for w in words], np.int64).ravel()
        own, n = np.unique(slots, return_counts=True)
        rows.append(np.full(len(own), i))
        columns.append(own)
        values.append(SCALE * n / max(1, len(words)))
        rows.append(np.array([i]))
        columns.append(np.array([REPEATS]))
        values.append(np.array([SCALE * repeated_share(words)]))
    weights, bias = np.zeros(SLOTS), 0.0
    if not rows:
        return weights, bias
    row, column, value = np.concatenate(rows), np.concatenate(columns), np.concatenate(values)
    squares, bias_squares = np.full(SLOTS, 1e-8), 1e-8
    for _ in range(rounds):
        margin = np.bincount(row, value * weights[column], len(texts)) + bias
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - targets) / len(texts)
        slope = np.bincount(column, value * error[row], SLOTS) + 1e-8 * weights
        squares += slope**2
        bias_squares += error.sum() ** 2
        weights -= slope / np.sqrt(squares)
        bias -= float(error.sum() / np.sqrt(bias_squares))
    return weights, bias


class _Weights(dict):
    """Weight of each word met so far; of bounded size."""

    def __init__(self, slots: np.ndarray):
        super().__init__()
        self.slots = slots.tolist()

    def __missing__(self, word: str) -> float:
        one, two = word_slots(word)
        value = self.slots[one] + self.slots[two]
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value


def _patterns() -> Column:
    @F.pandas_udf("int")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([vote_pattern(t) for t in texts], dtype="int32")

    return of(F.col("text"))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, posterior (of good, from the votes), score (0 to 1) and predicted (1 from 0.5 on) of each row.

    docs: doc_id, text; others are ignored. Nothing is learnt from labels. Null and empty texts get the votes of an empty
    text and the score of one without words. Whole texts are voted on and scored, however long. Repeated rows are scored
    alike; of rows that tie for the scorer's sample the smaller id, then the smaller text is taken. An empty table gives no
    rows.
    """
    patterns = docs.select(_patterns().alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    seen = sorted((r["pattern"], r["n"]) for r in patterns.collect())
    codes, counts = np.array([p for p, _ in seen], np.int64), np.array([n for _, n in seen], np.float64)
    good = dict(zip(codes.tolist(), estimate(codes, counts)[2].tolist(), strict=True)) if seen else {}
    total, scale = int(counts.sum()), 1 << 30
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(scale))
    drawn = (
        docs.select("doc_id", "text")
        .where(F.length("text").between(1, SAMPLE_CHARS) & (rank < min(scale, 2 * SAMPLE * scale // max(1, total) + 1)))
        .orderBy(rank, "doc_id", "text")
        .limit(SAMPLE)
        .select("text")
        .collect()
    )
    texts = [r["text"] for r in drawn]
    weights, bias = train_scorer(texts, np.array([good.get(vote_pattern(t), 0.5) for t in texts]))
    slots = weights.astype(np.float32)

    @F.pandas_udf("posterior double, score double")
    def scored(column: pd.Series) -> pd.DataFrame:
        known = _Weights(slots)
        posterior, score = [], []
        for text in column:
            words = (text or "").split()
            posterior.append(good.get(vote_pattern(text), 0.5))
            margin = sum(map(known.__getitem__, words)) / max(1, len(words)) + float(slots[REPEATS]) * repeated_share(words)
            margin = SCALE * margin + bias
            score.append(1 / (1 + np.exp(-min(30.0, max(-30.0, margin)))))
        return pd.DataFrame({"posterior": posterior, "score": score})

    rows = docs.select("doc_id", scored(F.col("text")).alias("q")).select("doc_id", "q.posterior", "q.score")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
