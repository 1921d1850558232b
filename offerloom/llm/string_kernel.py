"""Toxicity: a support vector machine over the gap-weighted subsequence kernel, with Nystroem landmarks.

The kernel compares words by their common subsequences of three letters (word edges count as letters), each weighted by
DECAY for every letter that it skips, up to two; so an insult with letters inserted, dropped or set apart stays close to
itself. Words are mapped onto their kernel values with LANDMARKS words, made orthonormal (Nystroem); a linear SVM with
squared hinge loss is trained there. A sentence, and a text, is as toxic as its most toxic word: in training, the witness
word of each toxic sentence is found in turns with the machine (multiple instances), and clean sentences give the
negatives, the hardest of them first.

The machine is linear in the landmarks' subsequences, so scoring a text takes one weight per subsequence: no kernel value
is computed for the words of the corpus.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import held_out, table

LANDMARKS = 256
SAMPLE = {1: 1500, 0: 2000}  # labelled texts to learn from, of each label
SAMPLE_CHARS = 20_000  # longer texts are not learnt from
NEGATIVES = 15_000
ROUNDS = 4
DECAY = 0.5
PENALTY = 1e-5
SYMBOLS = 64
EDGE = 0
LONG = 32  # letters of a word above which its windows are scored, as words run together are
WINDOW = 16  # letters of such a window
STEPS = [(1, 1, 1.0), (1, 2, DECAY), (2, 1, DECAY), (1, 3, DECAY**2), (2, 2, DECAY**2), (3, 1, DECAY**2)]
PIECE_CHARS = 1 << 18


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Symbol of each code of the basic plane: EDGE for white space, SYMBOLS for what is dropped, else a letter's."""

    def of(c: int) -> int:
        x = chr(c)
        if x.isspace():
            return EDGE
        if not x.isalpha():
            return SYMBOLS
        low = ord(x.lower()[0])
        return low - 96 if 97 <= low <= 122 else 27 + low * 7 % (SYMBOLS - 27)

    return np.array([of(c) for c in range(1 << 16)], np.uint8)


def word_symbols(text: str) -> np.ndarray:
    """The words of a text as symbols, an EDGE before, between and after them; letters set apart by spaces join."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = _symbols()[np.minimum(codes, 0xFFFF)]
    out = out[out < SYMBOLS]
    out = np.concatenate([np.zeros(1, np.uint8), out, np.zeros(1, np.uint8)])
    out = out[np.r_[True, (out[1:] != EDGE) | (out[:-1] != EDGE)]]
    edges = np.flatnonzero(out == EDGE)
    single = np.diff(edges) == 2
    apart = edges[1:-1][single[:-1] & single[1:]]
    return np.delete(out, apart) if len(apart) else out


def subsequences(line: np.ndarray):
    """For each step of STEPS: first positions, numbers and weight of the subsequences that stay within a word."""
    edge = line == EDGE
    wide = line.astype(np.int64)
    n = len(line)
    for one, two, weight in STEPS:
        span = one + two
        if n <= span:
            continue
        inside = ~edge[1 : n - span + 1]
        for k in range(2, span):
            inside = inside & ~edge[k : n - span + k]
        at = np.flatnonzero(inside)
        yield at, (wide[at] * SYMBOLS + wide[at + one]) * SYMBOLS + wide[at + span], weight


def _norms(letters: np.ndarray) -> np.ndarray:
    """Length of a word's feature vector, by its letters (all subsequences taken as different)."""
    lengths = np.asarray(letters) + 2
    return np.maximum(np.sqrt(sum(np.maximum(0, lengths - a - b) * w * w for a, b, w in STEPS)), 1e-9)


def _best_window(total: np.ndarray) -> float:
    """The highest score of WINDOW letters in a row; total has the sums of the subsequences that begin at each letter."""
    sums = np.r_[0.0, np.cumsum(total)]
    return float((sums[WINDOW:] - sums[:-WINDOW]).max() / _norms(WINDOW))


def word_scores(line: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted, length-normalised sum of each word's subsequences; of a word of over LONG letters its best window's."""
    total = np.zeros(len(line))
    for at, numbers, weight in subsequences(line):
        total[at] += weights[numbers] * weight
    edges = np.flatnonzero(line == EDGE)
    if len(edges) < 2:
        return np.zeros(0)
    letters = np.diff(edges) - 1
    out = np.add.reduceat(total, edges[:-1]) / _norms(letters)
    for k in np.flatnonzero(letters > LONG):
        out[k] = _best_window(total[edges[k] : edges[k + 1]])
    return out


class Machine:
    """Nystroem features of words and a linear SVM on them."""

    def __init__(self, landmarks: list[bytes]):
        columns, entries = {}, []
        for j, word in enumerate(landmarks):
            for _, numbers, weight in subsequences(np.frombuffer(word, np.uint8)):
                entries += [(columns.setdefault(int(t), len(columns)), j, weight) for t in numbers]
        self.numbers = np.array(list(columns), np.int64)
        self.compact = np.full(SYMBOLS**3, len(columns), np.int64)
        self.compact[self.numbers] = np.arange(len(columns))
        self.matrix = np.zeros((len(columns) + 1, len(landmarks)))
        for row, j, weight in entries:
            self.matrix[row, j] += weight
        self.matrix /= np.maximum(np.linalg.norm(self.matrix, axis=0), 1e-9)
        values, vectors = np.linalg.eigh(self.matrix.T @ self.matrix)
        good = values > 1e-6 * values.max()
        self.root = vectors[:, good] / np.sqrt(values[good])

    def features(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), self.matrix.shape[1]))
        for start in range(0, len(words), 2000):
            part = words[start : start + 2000]
            line = np.frombuffer(b"".join(w[:-1] for w in part) + b"\0", np.uint8)
            lengths = np.array([len(w) - 1 for w in part])
            owner = np.repeat(np.arange(len(part)), lengths)
            for at, numbers, weight in subsequences(line):
                used = self.compact[numbers]
                hit = used < len(self.numbers)
                if hit.any():
                    own = owner[at[hit]]
                    first = np.flatnonzero(np.r_[True, np.diff(own) != 0])
                    out[start + own[first]] += np.add.reduceat(self.matrix[used[hit]], first) * weight
            out[start : start + 2000] /= _norms(lengths - 1)[:, None]
        return out @ self.root

    def fit(self, words: list[bytes], labels: np.ndarray, mass: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
        """Weight of each subsequence number; both classes count alike in all, and their words by their mass."""
        x = np.c_[self.features(words), np.ones(len(words))]
        y = np.where(labels > 0, 1.0, -1.0)
        share = mass * np.where(y > 0, 0.5 / mass[y > 0].sum(), 0.5 / mass[y < 0].sum())
        ridge = np.full(x.shape[1], penalty)
        ridge[-1] = 1e-9
        beta = np.zeros(x.shape[1])
        for _ in range(30):
            open_ = y * (x @ beta) < 1
            xs, cs = x[open_], share[open_]
            new = np.linalg.solve(xs.T @ (xs * cs[:, None]) + np.diag(ridge), xs.T @ (cs * y[open_]))
            if np.abs(new - beta).max() < 1e-8:
                break
            beta = new
        weights = np.zeros(SYMBOLS**3)
        weights[self.numbers] = self.matrix[:-1] @ (self.root @ beta[:-1])
        return weights


def _words(text: str) -> set[bytes]:
    """The different words of a text, each with its edges."""
    return {b"\0" + w + b"\0" for w in word_symbols(text).tobytes().split(b"\0") if w}


def _first_witness(toxic: list[list[bytes]], clean: list[bytes]) -> list[bytes]:
    """A first guess at the most toxic word of each text: the one whose run of five symbols has the highest odds.

    The odds of a run are the toxic texts against the different clean words that hold it.
    """
    runs = lambda w: {w[i : i + 5] for i in range(max(1, len(w) - 4))}
    seen = Counter(r for bag in toxic for r in {r for w in bag for r in runs(w)})
    against = Counter(r for w in clean for r in runs(w) if r in seen)
    odds = {r: (n + 0.1) / (against[r] + 1) for r, n in seen.items()}
    return [max(bag, key=lambda w: (max(odds[r] for r in runs(w)), w)) for bag in toxic]


def train(texts: list[str], labels: list[int]) -> tuple[np.ndarray, float, float]:
    """Weights of subsequences, slope and offset of the score's logistic curve."""
    y = np.array(labels, np.int64)
    bags = [_words(t) for t in texts]
    if not (y == 1).any() or not (y == 0).any():
        return np.zeros(SYMBOLS**3), 0.0, 6.0 if (y == 1).any() else -6.0
    clean = sorted({w for b, label in zip(bags, y, strict=True) if label == 0 for w in b})
    rng = np.random.default_rng(1)
    negatives = [clean[i] for i in sorted(rng.permutation(len(clean))[:NEGATIVES])]
    # A word that clean texts hold is no insult, so it is no witness either.
    clean_set = set(clean)
    toxic = [sorted(b - clean_set) for b, label in zip(bags, y, strict=True) if label == 1 and b - clean_set]
    if not toxic:
        return np.zeros(SYMBOLS**3), 0.0, -6.0
    witnesses = _first_witness(toxic, clean)
    weights = np.zeros(SYMBOLS**3)
    for turn in range(ROUNDS):
        if turn:
            scored = lambda words: word_scores(
                np.frombuffer(b"".join(w[:-1] for w in words) + b"\0", np.uint8), weights
            )
            witnesses = [b[int(np.argmax(scored(b)))] for b in toxic]
            hardest = np.argsort(-scored(clean), kind="stable")[: NEGATIVES // 3]
            negatives = sorted({*negatives, *(clean[i] for i in hardest)})
        counts = pd.Series(witnesses).value_counts()
        ranked = sorted(counts.index, key=lambda w: (-counts[w], w))
        step = max(1, len(negatives) // (LANDMARKS // 3))
        machine = Machine([*ranked[: LANDMARKS - LANDMARKS // 3], *negatives[::step][: LANDMARKS // 3]])
        mass = np.r_[[counts[w] for w in ranked], np.ones(len(negatives))]
        weights = machine.fit([*ranked, *negatives], np.r_[np.ones(len(ranked)), np.zeros(len(negatives))], mass)
    best = np.array([word_scores(word_symbols(t), weights).max(initial=-1.0) for t in texts])
    slope, offset = _logistic(best, y)
    return weights, slope, offset


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a ridge-penalised logistic curve (Newton steps)."""
    a, theta = np.c_[x, np.ones(len(x))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        hessian = a.T @ (a * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hessian, a.T @ (p - y) + 1e-2 * theta), -5, 5)
    return float(theta[0]), float(theta[1])


def toxicity_score(weights: np.ndarray, slope: float, offset: float) -> Column:
    """A function of the text column: the score of its most toxic word on the logistic curve."""
    used = np.flatnonzero(weights)
    values = weights[used]

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        dense = np.zeros(SYMBOLS**3)
        dense[used] = values
        best = np.full(len(texts), -1.0)
        waiting: list[tuple[int, np.ndarray]] = []

        def settle() -> None:
            if waiting:
                line = np.concatenate([x[:-1] for _, x in waiting] + [np.zeros(1, np.uint8)])
                first = np.cumsum([0] + [int((x[:-1] == EDGE).sum()) for _, x in waiting[:-1]])
                best[[i for i, _ in waiting]] = np.maximum.reduceat(word_scores(line, dense), first)
                waiting.clear()

        total = 0
        for i, text in enumerate(texts):
            line = word_symbols(text) if text else np.zeros(1, np.uint8)
            if len(line) > 1:
                waiting.append((i, line))
                total += len(line)
                if total >= PIECE_CHARS:
                    settle()
                    total = 0
        settle()
        return pd.Series(1 / (1 + np.exp(-np.clip(slope * best + offset, -30, 30))))

    return score


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str) -> tuple[list[str], list[int]]:
    """At most SAMPLE texts of each label outside the held-out fold, those with the smallest hash of their id."""
    marks = labels.where(F.col(column).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id")
    marks = marks.agg(F.max(column).alias("label"))
    rows = docs.select("doc_id", "text").where(F.length("text").between(1, SAMPLE_CHARS)).join(marks, "doc_id")
    counts = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    scale = 1 << 30
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(scale))
    parts = [
        rows.where((F.col("label") == k) & (rank < min(scale, 2 * SAMPLE[k] * scale // n + 1))).orderBy(rank, "doc_id", "text").limit(SAMPLE[k])
        for k, n in sorted(counts.items())
    ]
    drawn = [r for part in parts for r in part.collect()]
    return [r["text"] for r in drawn], [int(r["label"]) for r in drawn]


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) of each row of docs.

    docs: doc_id, text; labels: doc_id, toxic (0 or 1; others are ignored, repeated ids count as toxic if one row says
    so). Null and empty texts have the score of a text without any toxic word. With no labels of one kind all rows get
    the other's score (without any: clean). Other columns play no part; repeated rows are scored alike. Texts are scored
    whole, however long; of words of over LONG letters, as texts without blanks are, every window of WINDOW letters is
    scored. Texts that tie for the sample are taken by id and text.
    """
    texts, marks = labelled_sample(docs, labels, "toxic")
    score = toxicity_score(*train(texts, marks))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
