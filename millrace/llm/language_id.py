"""Language ID by prediction by partial matching: byte context trees of each language, under frozen statistics.

From labelled texts come the counts of each byte after each context of up to ``DEPTH`` bytes, for each language:
an aggregate over the n-grams that the tasks of the sample send. A byte costs -log2 of its probability in the
longest context that has it; each longer context that is known but lacks it adds its escape (method C: the number
of distinct bytes seen there against that and the count). A text costs the sum over all its bytes, exactly, for
each language; the cheapest language is predicted. The trees are learned from a bounded sample, about
``MOST_DOCS`` whole texts a language chosen by hash; scoring sees every byte of every text.

Scoring looks all windows of DEPTH + 1 bytes up at once: the windows that some tree holds in a hash table with their
cost in each language, the others by the escape of their context and the window without its first byte, and so on. The
tables hold a row for each n-gram and context that some language has, so they grow with the sample and the number of
languages, and not with the alphabet.

Defined cases: null text or text without a letter is ``und`` with score 0, empty text too. Rows without a language
teach nothing. If nothing is learned, every text is ``und``. Ties go to the language first in alphabetical order.
Repeated rows are answered as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import byte_chunks, give_back

DEPTH = 3
MOST_DOCS = 1500
_tables: dict[str, "Coder"] = {}


def grams(data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """The n-grams of ``size`` bytes of each row, first byte highest, as 64-bit numbers."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    for k in range(size):
        out = out << 8 | data[k : k + n]
    inside = np.ones(n, bool)
    for edge in offsets[1:-1]:  # no n-gram spans two texts
        inside[max(0, edge - size + 1) : edge] = False
    return out[inside]


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", most_docs: int = MOST_DOCS, depth: int = DEPTH) -> DataFrame:
    """Counts: ``lang``, ``size``, ``gram`` and ``n`` of all n-grams of up to depth + 1 bytes in the sample's texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    # A share of each language's rows by the hash of their ids: about most_docs of them, without sorting or shuffling texts.
    shares = {r["lang"]: most_docs / r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return docs.sparkSession.createDataFrame([], "lang string, size int, gram long, n long")
    part = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(shares.items()) for x in pair]), F.col("lang"))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < part * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                own = batch.column(1).filter(pa.array(langs == lang))
                for _, _, data, offsets in byte_chunks(own):
                    for size in range(1, depth + 2):
                        names, counts = np.unique(grams(data, offsets, size), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array(np.full(len(names), size, np.int32)), pa.array(names), pa.array(counts.astype(np.int64))], names=["lang", "size", "gram", "n"])

    return sample.select("lang", "text").mapInArrow(run, "lang string, size int, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


class Lookup:
    """Rows of numbers by 64-bit names, in hash tables; a name that finds its slot taken goes to the next table."""

    def __init__(self, names: np.ndarray, values: np.ndarray) -> None:
        """``names``: distinct. A name that is not among them has the last row, zeros."""
        self.values = np.vstack([values, np.zeros((1, values.shape[1]), np.float32)]).astype(np.float32)
        self.names, self.slots, left = np.append(names, -1), [], np.arange(len(names))
        while len(left):
            bits = max(10, int(2 * len(left)).bit_length() + 1)
            slot = self._slot(names[left], len(self.slots), bits)
            table = np.full(1 << bits, len(names), np.int32)
            table[slot] = left
            self.slots.append((table, bits))
            left = left[table[slot] != left]

    @staticmethod
    def _slot(names: np.ndarray, turn: int, bits: int) -> np.ndarray:
        h = names.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * turn * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
        return (h >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, names: np.ndarray) -> np.ndarray:
        """The row of each name; the last one for names that are not there."""
        found, left = np.full(len(names), len(self.names) - 1, np.int64), np.arange(len(names))
        for turn, (table, bits) in enumerate(self.slots):
            slot = table[self._slot(names[left], turn, bits)]
            hit = self.names[slot] == names[left]
            found[left[hit]] = slot[hit]
            left = left[~hit]
            if not len(left):
                break
        return found


class Coder:
    """Code lengths from the counts, ready for lookups: only contexts and n-grams that some language has are held. Built once in a worker."""

    def __init__(self, langs: list[str], counts: list[list[tuple[np.ndarray, np.ndarray]]], depth: int) -> None:
        """``counts[language][size - 1]``: sorted n-grams and their counts."""
        self.langs, self.depth, n = langs, depth, len(langs)
        self.single = np.full((256, n), 8.0, np.float32)  # below all contexts every byte is alike
        self.grams: list[Lookup] = []  # by size from 2: what the last byte costs
        self.escapes: list[Lookup] = []  # by size of the context from 1: what it costs to leave it
        for size in range(1, depth + 2):
            names = np.unique(np.concatenate([c[size - 1][0] for c in counts]))
            contexts = np.unique(names >> 8)
            leave, direct = np.zeros((len(contexts), n), np.float32), []
            for k, own in enumerate(counts):
                grams, seen = own[size - 1][0], own[size - 1][1].astype(float)
                at = np.searchsorted(contexts, grams >> 8)
                total, kinds = np.bincount(at, weights=seen, minlength=len(contexts)), np.bincount(at, minlength=len(contexts))
                known = total > 0
                leave[known, k] = -np.log2(kinds[known] / (total[known] + kinds[known]))
                direct.append(-np.log2(seen / (total[at] + kinds[at])))
            if size == 1:
                cost = self.single + leave
                places = [own[0][0] for own in counts]
            else:
                self.escapes.append(Lookup(contexts, leave))
                cost = leave[np.searchsorted(contexts, names >> 8)] + self._bits(names, size - 1)
                places = [np.searchsorted(names, own[size - 1][0]) for own in counts]
            for k, bits in enumerate(direct):
                cost[places[k], k] = bits
            if size == 1:
                self.single = cost
            else:
                self.grams.append(Lookup(names, cost))

    def _bits(self, windows: np.ndarray, size: int) -> np.ndarray:
        """What the last byte of each window costs in each language, after the ``size`` - 1 bytes before it."""
        out, left = np.zeros((len(windows), len(self.langs)), np.float32), np.arange(len(windows))
        for now in range(size, 1, -1):
            names = windows[left] & ((1 << 8 * now) - 1)
            held = self.grams[now - 2]
            row = held.find(names)
            hit = row < len(held.names) - 1
            out[left[hit]] += held.values[row[hit]]
            left, names = left[~hit], names[~hit]
            if not len(left):
                return out
            escape = self.escapes[now - 2]
            out[left] += escape.values[escape.find(names >> 8)]
        out[left] += self.single[windows[left] & 255]
        return out

    def costs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each row in each language, in bits."""
        rows, depth = len(offsets) - 1, self.depth
        out = np.zeros((rows, len(self.langs)))
        if not len(data):
            return out
        # Each text begins after line ends, so that its first bytes have a context too.
        at = np.arange(len(data)) + depth * (1 + np.repeat(np.arange(rows), np.diff(offsets)))
        symbols = np.full(len(data) + depth * rows, 10, np.int64)
        symbols[at] = data
        windows = symbols[at]
        for k in range(1, depth + 1):
            windows |= symbols[at - k] << (8 * k)
        filled = np.flatnonzero(np.diff(offsets))
        out[filled] = np.add.reduceat(self._bits(windows, depth + 1), offsets[:-1][filled], axis=0, dtype=np.float64)
        return out


def predict(docs: DataFrame, counts: DataFrame, text_col: str = "text", id_col: str = "doc_id", depth: int = DEPTH) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score``, the weight of the predicted language among all when code lengths are odds."""
    found = counts.orderBy("lang", "size", "gram").toPandas()
    langs = sorted(found["lang"].unique())
    key = f"{hash(tuple(found['gram'])):x}-{len(found)}-{found['n'].sum()}"
    parts = [[(f["gram"].to_numpy(np.int64), f["n"].to_numpy(np.int64)) for size in range(1, depth + 2) for f in [found[(found["lang"] == lang) & (found["size"] == size)]]] for lang in langs]
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if langs and key not in _tables:
            _tables.clear()
            _tables[key] = Coder(langs, shared.value, depth)
        for batch in batches:
            known, sure = [], []
            letters = batch.column(2).to_pylist()
            for first, _, data, offsets in byte_chunks(batch.column(1), (1 << 22) // max(4, len(langs))) if langs else []:
                bits = _tables[key].costs(data, offsets)
                best = bits.argmin(axis=1)
                weight = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
                for k, (b, w) in enumerate(zip(best, weight, strict=True)):
                    known.append(langs[b] if letters[first + k] else "und")
                    sure.append(float(w) if letters[first + k] else 0.0)
            if not langs:
                known, sure = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(known, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "lang_pred", "score"])
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
