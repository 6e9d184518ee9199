"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Each text is the set of its hashed byte n-grams (ASCII letters lower-cased). From labelled texts come the document
counts of each n-gram in both classes and their log ratio r (none below ``LEAST_DOCS`` documents or ``LEAST_RATIO``);
logistic regression is then fitted on the features r, and a text's score is the logistic of the sum over its n-grams.
The fit sees a bounded sample of labelled rows (``MOST_TOXIC`` and ``MOST_CLEAN``, the smallest hashes of their ids; the
intercept is set back to the share of all labelled rows); scoring sees every whole text, one pass, with a table of fixed
size.

Defined cases: a null or empty text has no n-gram and gets the score of the intercept. Rows without label, or with a
label other than 0 and 1, teach nothing. Repeated label rows count once each; a document labelled both 0 and 1 counts as
toxic. Repeated documents are scored as often as they occur, and teach as often if they are labelled. Without labels of
both classes every score is the share of toxic labels (0 without any). Extra columns are ignored by scoring;
``filter_toxic`` returns all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import byte_chunks, give_back

BITS, SIZES = 20, (3, 4, 5)
#: N-grams of fewer documents, or whose log ratio is nearer to 0, have no weight.
LEAST_DOCS, LEAST_RATIO = 3, 0.8
MOST_TOXIC, MOST_CLEAN = 1200, 2400
THRESHOLD = 0.7

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def hashed(data: np.ndarray) -> list[np.ndarray]:
    """Buckets of the n-grams that start at each byte, one array for each size."""
    low = _LOWER[data].astype(np.uint32)
    out = []
    for size in SIZES:
        n = len(low) - size + 1
        if n <= 0:
            out.append(np.zeros(0, np.int32))
            continue
        h = np.full(n, size * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(size):
            h ^= low[k : k + n]
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        out.append((h >> np.uint32(32 - BITS)).astype(np.int32))
    return out


def features(batch_text: pa.Array, seen: np.ndarray) -> Iterator[np.ndarray]:
    """Distinct buckets of each text. ``seen`` is a work array of 2**BITS numbers."""
    for first, end, data, offsets in byte_chunks(batch_text):
        grams = hashed(data)
        for k in range(end - first):
            a, b = int(offsets[k]), int(offsets[k + 1])
            own = np.concatenate([g[a : max(a, b - size + 1)] for g, size in zip(grams, SIZES, strict=True)])
            place = np.arange(len(own), dtype=np.int32)
            seen[own] = place
            yield own[seen[own] == place]


@dataclass(frozen=True)
class Model:
    """Weights of the buckets (the fitted weight times the log ratio) and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, own: np.ndarray) -> float:
        z = self.intercept + float(self.weights[own].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, share: float, strength: float = 1.0, penalty: float = 1e-5, steps: int = 600) -> Model:
    """Log-count ratios of the rows' buckets, then logistic regression on them by gradient steps with momentum."""
    weights = np.zeros(1 << BITS, np.float32)
    toxic, clean = int(labels.sum()), int(len(labels) - labels.sum())
    if not toxic or not clean:
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model(weights, float(np.log(share / (1 - share))))
    p, q = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    for own, label in zip(rows, labels, strict=True):
        (p if label else q)[own] += 1
    part = toxic / (toxic + clean)
    # Smoothing in proportion to the classes, so that a rare n-gram leans to neither.
    ratio = np.log((p + strength * part) / (toxic + strength * part)) - np.log((q + strength * (1 - part)) / (clean + strength * (1 - part)))
    ratio[(p + q < LEAST_DOCS) | (np.abs(ratio) < LEAST_RATIO)] = 0
    names = np.flatnonzero(ratio)
    index = np.full(1 << BITS, -1, np.int32)
    index[names] = np.arange(len(names))
    used = [(k := index[own])[k >= 0] for own in rows]  # row by row: the sample's n-grams never stand in one array
    flat, owner = np.concatenate(used).astype(np.int64), np.repeat(np.arange(len(rows)), [len(k) for k in used])
    r = ratio[names].astype(np.float64)
    w, b = np.zeros(len(names)), float(np.log(toxic / clean))
    y = labels.astype(float)
    speed, speed_b = np.zeros(len(names)), 0.0
    values = r[flat]
    # Step size from the largest row, so that a step can't overshoot.
    rate = 4.0 / max(1.0, float(np.quantile(np.bincount(owner, weights=values**2, minlength=len(rows)), 0.9)))
    for _ in range(steps):
        z = b + np.bincount(owner, weights=values * w[flat], minlength=len(rows))
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        grad = np.bincount(flat, weights=values * error[owner], minlength=len(names)) / len(rows) + penalty * w
        speed = 0.9 * speed - rate * grad
        speed_b = 0.9 * speed_b - rate * error.mean()
        w, b = w + speed, b + speed_b
    weights[names] = w * r
    share = min(max(share, 1e-9), 1 - 1e-9)
    return Model(weights, b + float(np.log(share / (1 - share)) - np.log(toxic / clean)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Model:
    """A model from the labelled documents. ``labels`` holds one row for each labelled document that may teach."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    count, toxic = known.agg(F.count("*"), F.sum("label")).first()
    if not count:
        return Model(np.zeros(1 << BITS, np.float32), -500.0)
    order = F.xxhash64("id")
    chosen = known.where("label = 1").orderBy(order, "id").limit(most_toxic).union(known.where("label = 0").orderBy(order, "id").limit(most_clean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            made = [f.astype("<i4").tobytes() for f in features(batch.column(1), seen)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["label", "own"])

    # At most most_toxic + most_clean ids are broadcast.
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows, taught = [], []
    for row in texts.select("label", "text").mapInArrow(run, "label int, own binary").toLocalIterator():
        rows.append(np.frombuffer(row["own"], "<i4"))
        taught.append(row["label"])
    return fit_rows(rows, np.array(taught, np.int64), toxic / count)


def score_table(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shared.value, np.zeros(1 << BITS, np.int32)
        for batch in batches:
            scores = np.fromiter((known.score(f) for f in features(batch.column(1), seen)), np.float64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def filter_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shared.value, np.zeros(1 << BITS, np.int32)
        for batch in batches:
            clean = [known.score(f) < threshold for f in features(batch.column(at), seen)]
            yield batch.filter(pa.array(clean, pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
