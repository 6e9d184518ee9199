"""Spelling variants grouped around frequent words, by Bloom-guided edit neighbourhoods.

Words are counted over all texts. Two words are near if they differ by exactly one inserted, deleted or replaced code
point; a word's form is its most frequent near word, if that is ``TIMES`` times as frequent at least, and its root the
last of the chain of forms.

Near words are found without comparing words with each other. The vocabulary is put into blocked Bloom filters, a shard
for each length: a word sets eight bits of one block of 512. Spark makes the blocks by OR over its words. A task
generates each word's deletions, and its replacements by a larger letter (so each near pair comes up once, from its
longer or smaller word), as rolling hashes of whole batches, and probes the shards of these lengths. Only edits that the
filter knows are written out as words and shuffled; the join with the vocabulary removes those it knows wrongly.

What is broadcast is bounded: filters beyond ``MOST_FILTER_BYTES`` are cut into slices by hash, and the vocabulary is
probed once a slice; an edit belongs to one slice. The size follows from a count before anything is collected. A word
has at most some 90 near words a letter, so no key of the joins is hot; counts are added up before the shuffle.

Defined cases: a null or empty text has no words. A null id counts as empty in what decides the deletions. Repeated rows
count again. Equally frequent forms: the smallest in code-point order. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import scratch
from millrace.llm.common import give_back

RUNS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run loses a letter where this divides its hash.
NOISE = 31
SHORTEST, LEAST, TIMES = 7, 2, 10
#: Bits of filter a word; with eight set in a block about one edit in a thousand is let through wrongly.
BITS_A_WORD = 16
BLOCK_BITS, WORDS_A_BLOCK = 512, 8
#: Bytes of filters broadcast at a time.
MOST_FILTER_BYTES = 64 << 20
#: Edits that a task hashes at a time.
EDITS = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The hash of a letter: of its code point, for any that a Bloom filter may meet.
LETTERS = mix(np.arange(1, 0x1001, dtype=np.uint64) * BASE)


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, noise: int = NOISE) -> DataFrame:
    """A row ``word`` for each run of letters that is long enough after the deletion its hash may call for."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), F.lit(RUNS), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= shortest)
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(h % noise == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)


def vocabulary(words: DataFrame, least: int = LEAST) -> DataFrame:
    """``word`` and ``n``, how often it occurs, if at least ``least`` times."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def by_length(words: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows and code points (a matrix) of the words of each length."""
    texts = words.to_pylist()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield int(size), rows, np.frombuffer("".join(texts[i] for i in rows).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, size)


def hashed(points: np.ndarray) -> np.ndarray:
    """The polynomial of each row's letters."""
    h = np.zeros(len(points), np.uint64)
    for c in points.T:
        h = h * BASE + LETTERS[c & 0xFFF]
    return h


def place(h: np.ndarray, blocks: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """A word's block among ``blocks``, and the bit it sets in each long of the block, as eight numbers below 64."""
    x = mix(h)
    block = ((x >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    return block.astype(np.int64), mix(x + BASE)


def bit_of(y: np.ndarray, k: int) -> np.ndarray:
    return np.uint64(1) << ((y >> np.uint64(6 * k)) & np.uint64(63))


def filter_blocks(words: DataFrame, shards: dict[int, tuple[int, int]]) -> DataFrame:
    """``block``, numbered over all shards, and its longs ``m0`` to ``m7``. ``shards``: length to first block and number of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, _, points in by_length(batch.column(0)):
                first, count = shards[size]
                block, y = place(hashed(points), count)
                yield pa.RecordBatch.from_arrays([pa.array(block + first), *[pa.array(bit_of(y, k).view(np.int64)) for k in range(8)]], names=["block", *[f"m{k}" for k in range(8)]])

    bits = words.select("word").mapInArrow(run, "block long, " + ", ".join(f"m{k} long" for k in range(8)))
    return bits.groupBy("block").agg(*[F.bit_or(f"m{k}").alias(f"m{k}") for k in range(8)])


def probed(words: DataFrame, shards: dict[int, tuple[int, int]], low: int, held, letters: list[str]) -> DataFrame:
    """Edits of ``words`` (``word``, ``n``) that the slice of the filter knows: ``word``, ``n``, ``other``.

    ``held`` is the broadcast slice, a matrix of eight longs a block that begins with block ``low``.
    """
    alphabet = np.array(sorted(map(ord, letters)), np.uint32)

    def known(bits: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
        if size not in shards:
            return np.zeros(0, np.int64)
        first, count = shards[size]
        block, y = place(h, count)
        block += first - low
        at = np.flatnonzero((block >= 0) & (block < len(bits)))
        for k in range(8):  # most edits are gone after a long or two
            want = bit_of(y[at], k)
            at = at[bits[block[at], k] & want == want]
        return at

    def edits(points: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, list[str]]]:
        m, size = points.shape
        codes = LETTERS[points & 0xFFF]
        powers = np.array([pow(int(BASE), i, 1 << 64) for i in range(size + 1)], np.uint64)
        before = np.zeros((m, size + 1), np.uint64)  # the hash of the letters before i
        for i in range(size):
            before[:, i + 1] = before[:, i] * BASE + codes[:, i]
        whole = before[:, size]
        after = whole[:, None] - before * powers[size - np.arange(size + 1)]  # of those from i on
        spelled = lambda rows: [r.tobytes().decode("utf-32-le", "surrogatepass") for r in rows]
        shorter = before[:, :-1] * powers[size - 1 - np.arange(size)] + after[:, 1:]
        at = known(bits, shorter.ravel(), size - 1)
        row, i = at // size, at % size
        again = i > 0  # deleting either of two equal neighbours gives one word
        again[again] = points[row[again], i[again]] == points[row[again], i[again] - 1]
        row, i = row[~again], i[~again]
        if len(row):
            kept = np.arange(size) != i[:, None]
            yield row, spelled(np.ascontiguousarray(points[row][kept].reshape(-1, size - 1)))
        for i in range(size):
            changed = whole[:, None] + (LETTERS[alphabet & 0xFFF] - codes[:, i : i + 1]) * powers[size - 1 - i]
            row, c = np.nonzero(alphabet > points[:, i : i + 1])
            at = known(bits, changed[row, c], size)
            row, c = row[at], c[at]
            if len(row):
                made = points[row]
                made[:, i] = alphabet[c]
                yield row, spelled(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            for size, rows, points in by_length(batch.column(0)):
                step = max(1, EDITS // max(size, len(alphabet)))
                for k in range(0, len(points), step):
                    for row, others in edits(points[k : k + step], bits):
                        yield pa.RecordBatch.from_arrays([*[c.take(pa.array(rows[k : k + step][row])) for c in batch.columns], pa.array(others, pa.string())], names=["word", "n", "other"])
        give_back()

    return words.select("word", "n").mapInArrow(run, "word string, n long, other string")


def near_pairs(words: DataFrame, folder: str, most_bytes: int = MOST_FILTER_BYTES) -> DataFrame:
    """Each pair of near words once: ``word``, ``n``, ``other``, ``other_n``. ``words``: ``word`` and ``n``, a written table."""
    counts = {r["size"]: r["count"] for r in words.groupBy(F.length("word").alias("size")).count().collect()}  # a row a length
    shards, total = {}, 0
    for size, count in sorted(counts.items()):
        blocks = -(-count * BITS_A_WORD // BLOCK_BITS)
        shards[size] = (total, blocks)
        total += blocks
    letters = [r[0] for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().where("c <> ''").collect()]  # of some 90
    made = scratch.written(filter_blocks(words, shards), "filters", folder)
    step = max(1, most_bytes // (BLOCK_BITS // 8))
    found: list[DataFrame] = []
    for low in range(0, total, step):
        rows = made.where((F.col("block") >= low) & (F.col("block") < low + step)).toArrow()
        bits = np.zeros((min(step, total - low), 8), np.uint64)
        if rows.num_rows:
            bits[rows.column("block").to_numpy() - low] = np.column_stack([rows.column(f"m{k}").to_numpy().view(np.uint64) for k in range(8)])
        held = words.sparkSession.sparkContext.broadcast(bits)
        found.append(scratch.written(probed(words, shards, low, held, letters), "edits", folder))
        held.destroy()
    if not found:
        return words.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).where("false")
    edits = found[0]
    for more in found[1:]:
        edits = edits.union(more)
    return edits.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select("word", "n", "other", "other_n")


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """``word`` and ``root`` for each word with a ``form``: chains are halved in each round. Counts rise along a chain, so it ends."""
    now = scratch.written(forms.select("word", F.col("form").alias("root")), "roots", folder)
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        met = now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        met = scratch.written(met, "roots", folder)
        now = met.select("word", "root")
        if met.where("moved").isEmpty():
            return now


def best(other: Column, n: Column) -> Column:
    """The most frequent of a group's words, of equally frequent ones the smallest."""
    return F.min(F.struct((-n).alias("less"), other.alias("form")))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, times: int = TIMES, noise: int = NOISE, most_bytes: int = MOST_FILTER_BYTES) -> DataFrame:
    """Per word of the vocabulary: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``."""
    spark = docs.sparkSession
    folder, kept = scratch.new_path(spark, "spelling"), scratch.new_path(spark, "spelling-result")
    words = scratch.written(vocabulary(occurrences(docs, id_col, text_col, shortest, noise), least), "words", kept)
    pairs = scratch.written(near_pairs(words, folder, most_bytes), "pairs", folder)
    both = pairs.union(pairs.select("other", "other_n", "word", "n"))
    near = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), best(F.col("other"), F.col("other_n")).alias("b"))
    good = -F.col("b.less") >= times * F.col("n")
    near = scratch.written(near.select("word", "n_near", F.when(good, F.col("b.form")).alias("form"), F.when(good, -F.col("b.less")).alias("form_n")), "near", kept)
    ends = scratch.written(roots(near.where("form is not null"), folder), "ends", kept)
    scratch.remove(spark, folder)
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
