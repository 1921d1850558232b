"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of its labelled text. A text is cut greedily into the longest
pieces that the automaton reads; the language with the fewest pieces per letter wins. Whole texts are parsed, in blocks of
BLOCK symbols so that the blocks of a batch advance together; a block's end ends its piece in every language alike.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import held_out, table

SAMPLE_DOCS = 64  # texts per language that are learnt from
SAMPLE_CHARS = 320  # characters of each, so that an automaton has at most 2 * 64 * 320 states
BLOCK = 256
PIECE_CHARS = 1 << 19
UNDETERMINED = "und"
PAD, SPACE, UNKNOWN, FIRST = 0, 1, 2, 3


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case letter of each code of the basic plane; 0 for what is no letter."""
    return np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(1 << 16)], np.uint32)


def letter_codes(text: str) -> np.ndarray:
    """The letters of a text in lower case as code points; runs of anything else become one 0."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = _letters()[np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        out[high] = [c if chr(c).isalpha() else 0 for c in codes[high]]
    keep = out != 0
    keep[1:] |= out[:-1] != 0
    return out[keep] if len(out) else out


def automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions of the suffix automaton, a row for each state, the start first; -1 where there is none."""
    link, length, moves = [-1], [0], [{}]
    last = 0
    for s in symbols:
        current = len(moves)
        link.append(0)
        length.append(length[last] + 1)
        moves.append({})
        p = last
        while p >= 0 and s not in moves[p]:
            moves[p][s] = current
            p = link[p]
        if p >= 0:
            q = moves[p][s]
            if length[q] == length[p] + 1:
                link[current] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(s) == q:
                    moves[p][s] = clone
                    p = link[p]
                link[q] = link[current] = clone
        last = current
    rows = np.full((len(moves), width), -1, np.int64)
    for state, own in enumerate(moves):
        for s, target in own.items():
            rows[state, s] = target
    return rows


def parsing_table(rows: np.ndarray, at: int) -> np.ndarray:
    """For each state and symbol, 4 * (position of the next state's row) + pieces begun, flat; positions start with `at`.

    Where the automaton can't go on, a piece begins at its start; a letter that the sample lacks is a piece of its own.
    """
    width = rows.shape[1]
    begin = np.where(rows[0] >= 0, rows[0], 0)
    cost = np.where(rows >= 0, 0, np.where(rows[0] >= 0, 1, 2))
    following = np.where(rows >= 0, rows, begin)
    following[:, PAD], cost[:, PAD] = 0, 0
    return ((following * width + at) * 4 + cost).ravel()


@lru_cache(maxsize=2)
def _model(samples: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol of each code, the automata below each other, and the start of each."""
    codes = [[c for t in texts.split("\0") for c in [*letter_codes(t).tolist(), 0]] for _, texts in samples]
    alphabet = sorted({c for own in codes for c in own} - {0})
    number = {0: SPACE} | {c: FIRST + i for i, c in enumerate(alphabet)}
    width = FIRST + len(alphabet)
    symbols = np.full(0x110000, UNKNOWN, np.uint16)
    symbols[0] = SPACE
    symbols[alphabet] = np.arange(FIRST, width)
    tables, starts, at = [], [], 0
    for own in codes:
        flat = parsing_table(automaton([number[c] for c in own], width), at)
        tables.append(flat)
        starts.append(at)
        at += flat.size
    kind = np.int32 if at < 1 << 29 else np.int64
    return symbols, np.concatenate(tables).astype(kind), np.array(starts, kind)


def phrases(texts: list[np.ndarray], samples: tuple[tuple[str, str], ...]) -> np.ndarray:
    """Pieces of each text (its letter codes) in each language."""
    symbols, moves, starts = _model(samples)
    blocks = np.array([-(-len(t) // BLOCK) for t in texts], np.int64)
    grid = np.zeros((int(blocks.sum()), BLOCK), np.uint16)
    at = 0
    for text, n in zip(texts, blocks, strict=True):
        grid[at : at + n].reshape(-1)[: len(text)] = symbols[text]
        at += n
    state = np.repeat(starts[:, None], len(grid), axis=1)
    counts = np.ones(state.shape, np.int32)
    for column in np.ascontiguousarray(grid.T).astype(moves.dtype):
        following = moves.take(state + column)
        counts += following & 3
        state = following >> 2
    ends = np.cumsum(blocks)
    sums = np.concatenate([np.zeros((len(starts), 1), np.int64), np.cumsum(counts, axis=1)], axis=1)
    return (sums[:, ends] - sums[:, ends - blocks]).T


def training_samples(docs: DataFrame) -> tuple[tuple[str, str], ...]:
    """(language, excerpts) from at most SAMPLE_DOCS texts of each language, those with the smallest hash of their id.

    Only rows with text and lang outside the held-out fold count. The languages are counted first, which gives each a hash
    limit that leaves a few times SAMPLE_DOCS rows to rank.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return ()
    scale = 1 << 30
    limits = F.create_map(
        *[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(scale, 4 * SAMPLE_DOCS * scale // n + 1)))]
    )
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(scale))
    drawn = (
        known.where(rank < limits[F.col("lang")])
        .select("lang", rank.alias("rank"), "doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("excerpt"))
        .withColumn("place", F.expr("row_number() over (partition by lang order by rank, doc_id, excerpt)"))
        .where(F.col("place") <= SAMPLE_DOCS)
        .groupBy("lang")
        .agg(F.array_join(F.sort_array(F.collect_list("excerpt")), "\0").alias("texts"))
    )
    return tuple(sorted((r["lang"], r["texts"]) for r in drawn.collect()))


def language_columns(samples: tuple[tuple[str, str], ...]) -> Column:
    """A function of the text column that gives the struct (lang_pred, score, phrase_rate).

    score is second / (best + second) of the two lowest rates: 0.5 for a tie, 1 if there is one language. Null texts and
    texts without a letter are `und` with score 0 and no rate; so is everything if nothing was learnt. Equal rates go to
    the language first in alphabet.
    """
    names = [k for k, _ in samples]

    @F.pandas_udf("lang_pred string, score double, phrase_rate double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        preds = np.full(len(texts), UNDETERMINED, object)
        score, rate = np.zeros(len(texts)), np.full(len(texts), np.nan)
        waiting: list[tuple[int, np.ndarray]] = []

        def settle() -> None:
            if waiting:
                lengths = np.array([max(1, len(c)) for _, c in waiting])
                rates = phrases([c for _, c in waiting], samples) / lengths[:, None]
                order = np.argsort(rates, axis=1, kind="stable")
                best = rates[np.arange(len(rates)), order[:, 0]]
                at = [i for i, _ in waiting]
                preds[at] = [names[k] for k in order[:, 0]]
                second = rates[np.arange(len(rates)), order[:, 1]] if len(names) > 1 else None
                score[at] = 1.0 if second is None else second / (best + second)
                rate[at] = best
                waiting.clear()

        total = 0
        for i, text in enumerate(texts):
            codes = letter_codes(text) if text and names else np.zeros(0, np.uint32)
            if codes.any():
                waiting.append((i, codes))
                total += len(codes)
                if total >= PIECE_CHARS:
                    settle()
                    total = 0
        settle()
        rates = pd.Series(rate, dtype="Float64").where(~np.isnan(rate), None)
        return pd.DataFrame({"lang_pred": preds, "score": score, "phrase_rate": rates})

    return predict


def languages(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """docs with the struct column `language` (lang_pred, score, phrase_rate); learnt from learn_from, or docs itself."""
    samples = training_samples(docs if learn_from is None else learn_from)
    return docs.withColumn("language", language_columns(samples)(F.col("text")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = languages(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language")
    return found.select("doc_id", "held_out", "language.lang_pred", "language.score", "language.phrase_rate")
