"""Chunk plans, order, overlap stitching and line clean-up of long texts."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from millrace import scratch


def chunk_plan(media: DataFrame, length: Column, chunk: Column, overlap: Column, tail: str = "all") -> DataFrame:
    """Overlapping windows over [0, length): ``media_id``, ``idx``, ``start_ms``, ``end_ms``.

    ``tail='all'`` starts a window at every step before the end; ``'stop'`` ends with the first that reaches it.
    """
    step = chunk - overlap
    rows = media.where(length > 0).select("media_id", length.cast("long").alias("_l"), overlap.cast("long").alias("_o"), chunk.cast("long").alias("_c"), F.posexplode(F.sequence(F.lit(0).cast("long"), length.cast("long") - 1, step.cast("long"))).alias("idx", "start_ms"))
    if tail == "stop":
        rows = rows.where((F.col("start_ms") == 0) | (F.col("start_ms") + F.col("_o") < F.col("_l")))
    return rows.select("media_id", "idx", "start_ms", F.least(F.col("start_ms") + F.col("_c"), "_l").alias("end_ms"))


def reassemble(chunks: DataFrame, group: str, idx: str, text: str, separator: str = "\n\n") -> DataFrame:
    """Parts joined in order, whatever order they arrived in."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(idx, text))), lambda x: x[text])
    return chunks.groupBy(group).agg(F.array_join(parts, separator).alias("text"), F.count("*").alias("n_parts"))


def in_order(chunks: DataFrame, group: str, idx: str, text: str) -> DataFrame:
    """Per group the array ``texts`` of its parts in order."""
    return chunks.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(idx, text))), lambda x: x[text]).alias("texts"))


def _alike(a: str, b: str) -> int:
    """How many characters both begin with."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        size = (low + high + 1) // 2
        low, high = (size, high) if a[:size] == b[:size] else (low, size - 1)
    return low


#: Sizes of the pieces by which common blocks are looked for, and extended places after which they are halved for instead.
SEEDS, MOST_PLACES = (64, 24, 6), 64


def longest_block(a: str, b: str, autojunk: bool = False, least: int = 0) -> tuple[int, int, int]:
    """Places in both and size of the longest common block: the first one in ``a``, and of its places in ``b`` the first.

    ``b`` is cut into pieces of q characters. A common block of 2q - 1 or more holds one of them, so if extending all
    their places in ``a`` gives such a block, it is the longest, and those of equal size have been seen too. Else
    smaller pieces are tried. Where pieces occur too often the size is found by halving, on the sets of parts of a size:
    a common block holds common ones of all smaller sizes. With ``least`` blocks up to that size may count as none.
    """
    if autojunk:
        m = difflib.SequenceMatcher(None, a, b, autojunk=True).find_longest_match(0, len(a), 0, len(b))
        return m.a, m.b, m.size
    for q in SEEDS:
        best, ends, places = (0, 0, 0), {}, 0
        for j in range(0, len(b) - q + 1, q):
            seed = b[j : j + q]
            i = a.find(seed)
            while i >= 0 and places <= MOST_PLACES:
                if ends.get(i - j, 0) < i + q:  # not within a block that is known
                    places += 1
                    back, on = _alike(a[:i][::-1], b[:j][::-1]), q + _alike(a[i + q :], b[j + q :])
                    ends[i - j] = i + on
                    best = min(best, (-back - on, i - back, j - back))
                i = a.find(seed, i + 1)
        if places > MOST_PLACES:
            break
        if -best[0] >= 2 * q - 1:
            return best[1], best[2], -best[0]
        if least >= 2 * q - 2:
            return 0, 0, 0

    def at(size: int) -> int:
        parts = {b[i : i + size] for i in range(len(b) - size + 1)}
        return next((i for i in range(len(a) - size + 1) if a[i : i + size] in parts), -1)

    low, high = 0, min(len(a), len(b))
    while low < high:
        size = (low + high + 1) // 2
        low, high = (size, high) if at(size) >= 0 else (low, size - 1)
    first = at(low) if low else 0
    return first, b.find(a[first : first + low]) if low else 0, low


def stitch_two(before: str, text: str, window: int, least: int, autojunk: bool = False) -> str:
    """Add a chunk: what stands after the longest block common to the end of ``before`` and the start of ``text``."""
    _, at, size = longest_block(before[-window:], text[:window], autojunk, least)
    return before + text[at + size :] if size > least else before + " " + text


def stitch_words_two(before: str, text: str, most: int) -> str:
    """Add a chunk: words at its start that repeat the words at the end go."""
    a, b = before.split(), text.split()
    for n in range(min(most, len(a), len(b)), 0, -1):
        if a[-n] == b[0] and a[-n:] == b[:n]:
            return " ".join(a + b[n:])
    return " ".join(a + b)


#: Chunks of a media item that one group folds, and those before them that it guesses the text's end from.
SEGMENT, LEAD = 64, 4


def stitch(chunks: DataFrame, window: int = 500, least: int = 10, cleanup: str = "collapse", words: int | None = None, autojunk: bool = False, segment: int = SEGMENT) -> DataFrame:
    """One text a media item from ``media_id``, ``idx``, ``text``: chunks folded in order, overlaps cut.

    A step needs the end of the text so far and nothing else, so a long item is folded in segments at once, each from
    the end that the few chunks before it give. Then ends are held against what the segment before has come to, and
    segments that started from another end are folded again, until all agree: the result is that of one fold from the
    first chunk. With ``words`` overlaps of up to so many whole words are cut, and texts are single-spaced. With
    ``autojunk`` characters that are frequent in a window of 200 or more begin no common block, as difflib does by default.
    A media item with blank chunks only has an empty text; of chunks with equal ``idx`` the smaller text comes first.
    """
    spark = chunks.sparkSession
    folder, kept = scratch.new_path(spark, "stitch"), scratch.new_path(spark, "stitch-pieces")

    def add(tail: str, part: str) -> tuple[str, str]:
        """What a chunk adds to a text that ends so, and the end then."""
        if words:
            part = " ".join(part.split())
            whole = stitch_words_two(tail, part, words)
            return whole[len(tail) :], " ".join(whole.split(" ")[-words:])
        whole = stitch_two(tail, part, window, least, autojunk) if tail else part
        return whole[len(tail) :], whole[-window:]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a segment, from the rows of whole segments in order."""
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["media_id", "seg", "start", "end", "piece"])

        now = None  # the open segment: media_id, seg, whether its start is a guess, the text's end, where it started, pieces
        for batch in batches:
            types = [batch.schema.field("media_id").type, pa.int64(), pa.string(), pa.string(), pa.string()]
            for media, seg, begins, lead, text, known in zip(*(batch.column(c).to_pylist() for c in ("media_id", "seg", "begins", "lead", "text", "tail")), strict=True):
                if begins:
                    if now and now[5]:
                        out.append(closed(now))
                        if len(out) >= 256:
                            yield made()
                    now = [media, seg, known is None, known or "", None, []]
                if lead and not now[2]:
                    continue
                if not lead and now[4] is None:
                    now[4] = now[3]
                part = text.strip()
                piece, now[3] = add(now[3], part) if part else ("", now[3])
                if not lead:
                    now[5].append(piece)
        if now and now[5]:  # a last segment may have leads only
            out.append(closed(now))
        if out:
            yield made()

    def closed(now: list) -> tuple:
        """A segment's row; one that is not full is its item's last, and nothing needs its end."""
        media, seg, _, end, start, added = now
        return media, seg, start, end if len(added) == segment else None, "".join(added)

    def folded(rows: DataFrame) -> DataFrame:
        kind = chunks.schema["media_id"].dataType.simpleString()
        return rows.repartition("media_id", "seg").sortWithinPartitions("media_id", "seg", "at").mapInArrow(fold, f"media_id {kind}, seg long, start string, end string, piece string")

    at = F.row_number().over(Window.partitionBy("media_id").orderBy("idx", "text")) - 1
    rows = chunks.select("media_id", "idx", F.coalesce("text", F.lit("")).alias("text")).withColumn("at", at)
    own = F.floor(F.col("at") / segment)
    # The last chunks of a segment lead the next one.
    into = F.when(F.pmod("at", F.lit(segment)) >= segment - LEAD, F.array(F.struct(own.alias("seg"), F.lit(False).alias("lead")), F.struct((own + 1).alias("seg"), F.lit(True).alias("lead")))).otherwise(F.array(F.struct(own.alias("seg"), F.lit(False).alias("lead"))))
    dealt = rows.select("media_id", "at", "text", F.explode(into).alias("x")).select("media_id", "at", "text", "x.seg", "x.lead")
    begins = F.col("at") == F.greatest(F.col("seg") * segment - min(LEAD, segment), F.lit(0))
    dealt = scratch.written(dealt.withColumn("begins", begins), "dealt", folder)
    now = scratch.written(folded(dealt.withColumn("tail", F.when(F.col("seg") == 0, F.lit("")))), "folded", kept)
    several = (F.col("seg") > 0) | F.col("end").isNotNull()  # of an item that may have several segments
    before = F.lag("end").over(Window.partitionBy("media_id").orderBy("seg"))
    while True:
        wrong = scratch.written(now.where(several).select("media_id", "seg", "start", before.alias("tail")).where("tail <> start").select("media_id", "seg", "tail"), "wrong", folder)
        if wrong.isEmpty():
            break
        wrong = wrong.withColumnsRenamed({"media_id": "_m", "seg": "_s"})
        same = F.col("media_id").eqNullSafe(F.col("_m")) & (F.col("seg") == F.col("_s"))
        again = folded(dealt.join(wrong, same).drop("_m", "_s"))
        now = scratch.written(now.join(wrong, same, "left_anti").unionByName(again), "folded", kept)
    scratch.remove(spark, folder)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "piece"))), lambda x: x["piece"]), "")
    clean = F.regexp_replace(F.regexp_replace(F.col("text"), r"(?U)\s+", " "), "^ | $", "") if cleanup == "collapse" else F.replace("text", F.lit("  "), F.lit(" "))
    whole = now.where(~several).select("media_id", F.col("piece").alias("text"))
    joined = now.where(several).groupBy("media_id").agg(text.alias("text"))
    return whole.unionByName(joined).select("media_id", clean.alias("text"))


#: What ``str.strip`` takes away.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def lookback_dedupe(text: Column, k: int = 5, ratio: float = 0.85, delimiter: str = "\n+") -> Column:
    """Lines whose similarity to one of the last k kept lines is over ``ratio`` go. Similarity: 1 - edits / longer length.

    Lines of any length are compared. A pair costs up to the product of its length and the edits that ``ratio`` allows.
    The fold carries the last k kept lines and the places of all kept ones.
    """
    lines = F.filter(F.transform(F.split(text, delimiter), lambda x: F.trim(x, F.lit(WHITE))), lambda x: x != "")

    def near(a: Column, b: Column) -> Column:
        longest = F.greatest(F.length(a), F.length(b))
        allowed = F.ceil(longest * (1 - ratio)).cast("int")
        # The function gives -1 beyond the allowed edits.
        exact = F.exists(F.array(F.call_function("levenshtein", a, b, allowed)), lambda n: (n >= 0) & (1 - n / longest > ratio))
        # Lengths first: edits are counted only where they can suffice, and exact copies need none.
        return (a == b) | ((F.abs(F.length(a) - F.length(b)) <= allowed) & exact)

    state = F.struct(F.slice(lines, 1, 0).alias("last"), F.array().cast("array<int>").alias("kept"), F.lit(0).alias("at"))

    def step(s: Column, line: Column) -> Column:
        following = (s["at"] + 1).alias("at")
        drop = F.struct(s["last"].alias("last"), s["kept"].alias("kept"), following)
        keep = F.struct(F.slice(F.concat(s["last"], F.array(line)), F.greatest(F.size(s["last"]) + 2 - k, F.lit(1)), F.lit(k)).alias("last"), F.concat(s["kept"], F.array(s["at"])).alias("kept"), following)
        return F.when(F.exists(s["last"], lambda x: near(x, line)), drop).otherwise(keep)

    return F.array_join(F.aggregate(lines, state, step, lambda s: F.transform(s["kept"], lambda i: F.get(lines, i))), "\n")


def lookback_dedupe_sequence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, ratio: float = 0.85, autojunk: bool = False, delimiter: str = "\n+") -> DataFrame:
    """``id_col`` and ``value``: as ``lookback_dedupe``, with difflib's ratio as the similarity, in Arrow batches.

    difflib's own upper bounds are asked first, so most pairs are never matched. A null text stays null.
    """

    def clean(text: str) -> str:
        kept: list[str] = []
        matcher = difflib.SequenceMatcher(None, autojunk=autojunk)
        for line in filter(None, map(str.strip, re.split(delimiter, text))):
            matcher.set_seq2(line)
            for before in kept[-k:] if k else []:
                matcher.set_seq1(before)
                if before == line or (matcher.real_quick_ratio() > ratio and matcher.quick_ratio() > ratio and matcher.ratio() > ratio):
                    break
            else:
                kept.append(line)
        return "\n".join(kept)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(value=[None if t is None else clean(t) for t in frame["value"]])

    rows = docs.select(F.col(id_col), F.col(text_col).alias("value"))
    return rows.mapInPandas(run, rows.schema)


def carry_context(chunks: DataFrame, group: str, idx: str, text: str, length: int = 300) -> DataFrame:
    """Each chunk with the last ``length`` characters of the chunk before it as ``context``."""
    before = F.lag(F.right(F.col(text), F.lit(length))).over(Window.partitionBy(group).orderBy(idx))
    return chunks.withColumn("context", F.coalesce(before, F.lit("")))


#: Texts that a task holds as Python's at a time, with what is made of them; Spark's batches hold thousands.
SLICE_ROWS = 64


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(i, SLICE_ROWS)


def split_recursive(text: str, size: int, marks: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most ``size``: cut at the coarsest mark that occurs, neighbours joined again while they fit."""
    if len(text) <= size:
        return [text] if text.strip() else []
    mark = next(m for m in marks if m in text)
    if not mark:
        return [text[i : i + size] for i in range(0, len(text), size)]
    out, now = [], ""
    for part in text.split(mark):
        joined = now + mark + part if now else part
        if len(joined) <= size:
            now = joined
            continue
        if now.strip():
            out.append(now)
        now = ""
        if len(part) > size:
            out += split_recursive(part, size, marks[marks.index(mark) + 1 :])
        else:
            now = part
    return out + [now] if now.strip() else out


def split_text(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``idx``, ``piece`` of every text, by the recursive rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [(i, k, p) for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, p in enumerate(split_recursive(t or "", size))]
            ids, places, pieces = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(pieces, pa.string())], names=["id", "idx", "piece"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, idx int, piece string")


def register_split_text(spark: SparkSession, name: str = "split_text") -> None:
    """``split_text(text, size)`` as a table function for SQL: a row ``idx``, ``piece`` for each piece, in lateral joins too.

    Rows come and go pickled, a hundred at a time. With Arrow a task would hold thousands of texts as Python's at once.
    """

    @udtf(returnType="idx int, piece string", useArrow=False)
    class SplitText:
        def eval(self, text: str, size: int) -> Iterator[tuple[int, str]]:
            yield from enumerate(split_recursive(text or "", size))

    spark.udtf.register(name, SplitText)
