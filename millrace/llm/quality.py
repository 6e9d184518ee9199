"""Quality classifier from weak labels: heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer.

Each labeller looks at one figure of a text and votes good (1), bad (0) or not at all. Spark counts how often each
pattern of votes occurs over all documents; there are at most 3 to the number of labellers patterns, so the counts
stay small at any size. Expectation-maximisation on the counts finds the share of good texts and each labeller's
accuracy on good and on bad texts, and with them the posterior of each pattern. The posteriors, not any given
label, teach a logistic scorer on hashed byte trigrams and runs of character classes of a bounded sample of
documents (``MOST_TEXTS``, smallest hashes of ids); the scorer then sees every whole text.

Defined cases: a null or empty text has no figures: every labeller abstains, and its score is the intercept's.
Repeated rows count and are answered as often as they occur. Without rows there is no score. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import byte_chunks, give_back

BITS, MOST_TEXTS, STEPS = 18, 3000, 150

#: name -> (bad from this figure on, good up to this figure); between the two the labeller abstains.
LABELLERS = {
    "marks": (0.08, 0.035),  # ASCII marks other than . , in all bytes
    "capitals": (0.30, 0.08),  # A-Z in ASCII letters
    "digits": (0.10, 0.02),
    "bars": (0.01, 0.0005),
    "shouts": (0.01, 0.0005),  # exclamation marks
    "repeats": (0.45, 0.15),  # share of windows of 16 bytes, at every byte, that are repetitions
    "twins": (0.10, 0.02),  # share of words that equal the word before
    "marked": (0.35, 0.20),  # share of words with an ASCII mark other than . ,
    "short": (0.5, 0.02),  # 1 / words
}

_CLASS = np.zeros(256, np.uint8)  # 1 letter, 2 capital, 3 digit, 4 mark, 5 blank, 6 stop or comma, 7 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 7
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 5
_CLASS[[44, 46]] = 6
#: Weights of a word's bytes by their place; they come again after 65,536 bytes.
_POWERS = np.power(np.uint64(0x9E3779B97F4A7C15), np.arange(1 << 16, dtype=np.uint64))


def by_word(text: np.ndarray, kinds: np.ndarray, blanks: np.ndarray) -> tuple[float, float]:
    """Shares of the words that equal the word before and of those that hold a mark. Words are told apart by 64-bit hashes."""
    at = np.arange(len(text), dtype=np.int32)
    begins = ~blanks & np.append(True, blanks[:-1])
    starts = np.flatnonzero(begins)
    if not len(starts):
        return 0.0, 0.0
    place = at - np.maximum.accumulate(np.where(begins, at, np.int32(0)))
    worth = _POWERS[place & 0xFFFF] * text
    worth[blanks] = 0
    names = np.add.reduceat(worth, starts)
    holds = np.add.reduceat((kinds == 4).astype(np.int32), starts) > 0
    return float((names[1:] == names[:-1]).sum() / len(names)), float(holds.mean())


def figures(text: np.ndarray) -> np.ndarray | None:
    """The labellers' figures of a text's bytes."""
    n = len(text)
    if not n:
        return None
    own = _CLASS[text]
    kinds = np.bincount(own, minlength=8)
    blanks = own == 5
    words = max(1, int((blanks[1:] & ~blanks[:-1]).sum()) + 1)
    repeats = 0.0
    if n >= 64:
        parts = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, 8)).view(np.uint64)[:, 0]
        mixed = parts[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ parts[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
        repeats = 1 - len(np.unique(mixed)) / len(mixed)
        del parts, mixed
    twins, marked = by_word(text, own, blanks)
    bars, shouts = int((text == 124).sum()), int((text == 33).sum())
    return np.array([kinds[4] / n, kinds[2] / max(1, kinds[1] + kinds[2]), kinds[3] / n, bars / n, shouts / n, repeats, twins, marked, 1 / words])


_BAD, _GOOD = (np.array([LABELLERS[k][i] for k in LABELLERS]) for i in range(2))


def votes(text: np.ndarray) -> int:
    """The pattern of votes as a number of base 3: 0 abstains, 1 bad, 2 good."""
    own = figures(text)
    if own is None:
        return 0
    digits = np.where(own >= _BAD, 1, np.where(own <= _GOOD, 2, 0))
    return int((digits * 3 ** np.arange(len(digits))).sum())


def vote_counts(docs: DataFrame, text_col: str = "text") -> dict[int, int]:
    """How many documents vote by each pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [votes(data[offsets[k] : offsets[k + 1]]) for first, end, data, offsets in byte_chunks(batch.column(0)) for k in range(end - first)]
            names, counts = np.unique(np.array(found, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts.astype(np.int64))], names=["pattern", "n"])

    rows = docs.select(text_col).mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return {r["pattern"]: r["n"] for r in rows.collect()}


def expectation_maximisation(counts: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], np.ndarray, float]:
    """Posterior of good for each pattern, P(vote | class) of each labeller (class, labeller, vote) and the share of good."""
    names = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] for k in names.tolist()], float)
    m = len(LABELLERS)
    cast = names[:, None] // 3 ** np.arange(m) % 3  # 0 none, 1 bad, 2 good
    # At first a bad vote weighs as much as a good one of every labeller, for each knows some kinds of bad texts only.
    good = ((cast == 2).sum(1) + 1) / ((cast == 2).sum(1) + m * (cast == 1).sum(1) + 2)
    table, share = np.zeros((2, m, 3)), 0.5
    for _ in range(rounds):
        for k, weight in enumerate((n * (1 - good), n * good)):
            for v in range(3):
                table[k, :, v] = (weight[:, None] * (cast == v)).sum(0) + 1
            table[k] /= table[k].sum(1, keepdims=True)
        share = float(((n * good).sum() + 1) / (n.sum() + 2))
        logs = [np.log(p) + np.log(table[k][np.arange(m), cast]).sum(1) for k, p in enumerate((1 - share, share))]
        good = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    return dict(zip(names.tolist(), good.tolist(), strict=True)), table, share


def hashed(text: np.ndarray) -> np.ndarray:
    """Distinct buckets: byte trigrams, and runs of eight character classes."""
    out = []
    low = text.astype(np.uint32)
    if len(text) >= 3:
        out.append((low[:-2] | low[1:-1] << 8 | low[2:] << 16) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS))
    if len(text) >= 8:
        kinds, h = _CLASS[text].astype(np.uint32), np.zeros(len(text) - 7, np.uint32)
        for k in range(8):
            h = h << np.uint32(3) | kinds[k : len(text) - 7 + k]
        out.append((h ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def vector(text: np.ndarray, work: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their shares, scaled to length one. ``work`` counts and is left at zero."""
    own = hashed(text)
    if not len(own):
        return own, np.zeros(0)
    np.add.at(work, own, 1)
    names = np.flatnonzero(work) if len(own) > 1 << 15 else np.unique(own)
    value = np.sqrt(work[names])
    work[names] = 0
    return names, value / np.sqrt((value * value).sum())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_texts: int = MOST_TEXTS) -> tuple[np.ndarray, float]:
    """Weights of the hashed scorer and its intercept, taught by the posteriors of all documents' vote patterns."""
    posterior, _, share = expectation_maximisation(vote_counts(docs, text_col)) if not docs.isEmpty() else ({}, None, 0.5)
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null").orderBy(F.xxhash64("id"), "id").limit(most_texts).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = np.zeros(1 << BITS)
        for batch in batches:
            names, values, goods = [], [], []
            for first, end, data, offsets in byte_chunks(batch.column(0)):
                for k in range(end - first):
                    text = data[offsets[k] : offsets[k + 1]]
                    a, b = vector(text, work)
                    names.append(a.astype("<i4").tobytes())
                    values.append(b.astype("<f4").tobytes())
                    goods.append(posterior.get(votes(text), share))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(values, pa.binary()), pa.array(goods, pa.float64())], names=["names", "vals", "good"])

    # At most most_texts ids are broadcast, and that many texts' buckets come back.
    texts = docs.join(F.broadcast(ids), docs[id_col].cast("long") == ids["id"], "left_semi").select(text_col)
    names, values, goods = [], [], []
    for row in texts.mapInArrow(run, "names binary, vals binary, good double").toLocalIterator():
        names.append(np.frombuffer(row["names"], "<i4"))
        values.append(np.frombuffer(row["vals"], "<f4"))
        goods.append(row["good"])
    weights, bias = np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share)))
    if not names:
        return weights, bias
    owner, flat, x, y = np.repeat(np.arange(len(names)), [len(v) for v in names]), np.concatenate(names).astype(np.int64), np.concatenate(values).astype(float), np.array(goods)
    w, speed, speed_b = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0
    for _ in range(STEPS):
        z = bias + np.bincount(owner, weights=x * w[flat], minlength=len(y))
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        speed = 0.9 * speed - 20.0 * np.bincount(flat, weights=x * error[owner], minlength=1 << BITS) / len(y) - 1e-4 * w
        speed_b = 0.9 * speed_b - 1.0 * float(error.mean())
        w, bias = w + speed, bias + speed_b
    return w.astype(np.float32), bias


def score_table(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher: better) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            scores = []
            for first, end, data, offsets in byte_chunks(batch.column(1)):
                for k in range(end - first):
                    own = hashed(data[offsets[k] : offsets[k + 1]])
                    z = bias
                    if len(own):
                        counts = np.bincount(own, minlength=1 << BITS) if len(own) > 1 << 16 else None
                        names, n = (np.flatnonzero(counts), counts[counts > 0]) if counts is not None else np.unique(own, return_counts=True)
                        z += float((weights[names] * np.sqrt(n)).sum(dtype=float) / np.sqrt(n.sum()))
                    scores.append(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
