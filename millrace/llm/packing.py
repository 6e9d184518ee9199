"""Packing: concatenate all documents' ids and cut the stream into windows of one length.

Two passes. The first turns each text to ids within the partitions of the scan and writes them once, each with
its place in its partition. Then the partitions' totals, one number each, are summed in order, and that sum is
all that is joined to the ids: the second pass reads the table, adds the two offsets and cuts each document at
the multiples of the window. No id is shuffled and no task holds more than a document and an Arrow batch.

Defined cases: a null or empty text is the end id alone. Repeated rows are packed as often as they occur.
An empty table gives no piece. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace import scratch
from millrace.llm.common import give_back, texts_of

WINDOW = 2048
END_ID = 1
#: So many partitions' totals (16 bytes each) are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Words, and stems of words, whose ids a worker remembers; beyond that it starts anew. A stem costs more to make.
REMEMBERED, REMEMBERED_STEMS = 200_000, 450_000
#: The characters that byte-level vocabularies show for the 256 bytes: a printable one for itself, the others from 256 upwards.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_SHOWN = [chr(b) if b in _PRINTABLE else chr(256 + sum(x not in _PRINTABLE for x in range(b))) for b in range(256)]
#: ASCII marks that are cut from a word's end. The apostrophe is none: the pattern joins it with what follows.
MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'

_encoders: dict[str, "WordIds"] = {}


class WordIds(dict):
    """Ids of texts by a tokenizer that drops white space, word by word, with a bounded memory of words.

    Its normaliser and its splitting pattern never look past a blank or a line end, so a text's ids are the
    ids of the parts between them; tests hold this against whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.stems: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if len(self) > REMEMBERED:
            self.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))

    def __missing__(self, word: str) -> bytes:
        stem, tail = stem_and_tail(word)
        stems = self.stems
        made = stems.get(stem)
        if made is None:
            if len(stems) > REMEMBERED_STEMS:
                stems.clear()
            made = stems[stem] = self.ids(stem)
        if tail:
            made += stems.get(tail) or stems.setdefault(tail, self.ids(tail))
        self[word] = made
        return made

    def ids(self, part: str) -> bytes:
        if part.isalpha() and part.islower() and max(part) < "\u0300":
            # Latin letters in lower case are one unit to the pattern and as they are to the normaliser: straight to the merges.
            return pack_ids([t.id for t in self.merge(part if part.isascii() else "".join([BYTE_SHOWN[b] for b in part.encode()]))])
        return pack_ids(self.tokenizer.encode(part, add_special_tokens=False).ids)


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def stem_and_tail(word: str) -> tuple[str, str]:
    """A word without the ASCII marks at its end, and those marks.

    The splitting pattern always ends a run of letters before a mark, so their ids are those of the two parts.
    The stem is lower-cased where no combining mark could make that differ from the tokenizer's own order of steps.
    """
    stem = word.rstrip(MARKS)
    if not stem or not stem[-1].isalpha() or stem[-1] == "İ" or "<|" in word:  # that letter's lower case ends in a combining mark
        return word, ""
    return stem.lower() if stem.isascii() or max(stem) < "\u0300" else stem, word[len(stem) :]


def encoder(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def token_table(docs: DataFrame, make: Callable[[], Callable[[str], bytes]], end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass: ids of each document with the end id, its partition and the ids before it there. Written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, place, before = make(), TaskContext.get().partitionId(), 0
        tail = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            names, texts = batch.column(0), texts_of(batch, "text")
            first = 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and (last == first or size < 1 << 22):
                    size += len(texts[last])
                    last += 1
                ids = [encode(t) + tail for t in texts[first:last]]
                counts = np.fromiter((len(b) // 4 for b in ids), np.int64, len(ids))
                starts = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                packed = [np.frombuffer(b, "<u4").astype("<u2").tobytes() if narrow(b) else b for b in ids]
                yield pa.RecordBatch.from_arrays(
                    [names.slice(first, last - first).cast(pa.int64()), pa.array(np.full(len(ids), place, np.int64)), pa.array(starts), pa.array(counts), pa.array(packed, pa.binary())],
                    names=["doc_id", "part", "before", "n_ids", "ids"],
                )
                first = last
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return scratch.written(rows.mapInArrow(run, "doc_id long, part long, before long, n_ids long, ids binary"), "packing-ids")


def narrow(ids: bytes) -> bool:
    return int(np.frombuffer(ids, "<u4").max()) < 1 << 16


def with_offsets(tokens: DataFrame) -> DataFrame:
    """Each document's offset in the whole stream: the totals of the partitions before its own, and what stands before it there.

    The totals are one row a partition of the scan, so the ordered window over them sees some thousands of rows.
    """
    totals = tokens.groupBy("part").agg(F.sum("n_ids").alias("total"))
    bases = totals.select(F.col("part"), (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    if totals.count() <= MOST_BROADCAST:
        bases = F.broadcast(bases)
    return tokens.join(bases, "part").withColumn("offset", F.col("base") + F.col("before"))


def cut(tokens: DataFrame, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Second pass: one row for each piece of a document in a window. A document that crosses a window's end has a boundary there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, offset, count, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                ids = np.frombuffer(raw, "<u2" if len(raw) < 4 * count else "<u4").astype("<u4")
                start = 0
                while start < count:
                    at = offset + start
                    length = min(window - at % window, count - start)
                    piece = ids[start : start + length].tobytes()
                    for column, value in zip(out, (doc, start, length, zlib.crc32(piece), count, at // window, at % window, piece if with_ids else None), strict=True):
                        column.append(value)
                    start += length
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:7]), pa.array(out[7], pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    pieces = tokens.select("doc_id", "offset", "n_ids", "ids").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return pieces if with_ids else pieces.drop("ids")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of ``window`` ids. ``tokenizer`` is the path of the vocabulary file, the same on every machine.

    Only the last sequence is shorter than the window, so all padding there is stands at the end of one sequence.
    ``ids`` holds a piece's ids, 32 bits each, little-endian.
    """
    return cut(with_offsets(token_table(docs, lambda: encoder(tokenizer), end_id, id_col, text_col)), window, with_ids)
