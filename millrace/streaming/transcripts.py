"""Transcripts that arrive chunk by chunk, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace import scratch
from millrace.operators.chunks import stitch_two
from millrace.operators.resolve import cascade, overlay


def sliding_mentions(mentions: DataFrame, length: str = "45 seconds", slide: str = "30 seconds", late: str = "1 minute", begin: str | None = "1970-01-01 00:00:00") -> DataFrame:
    """Mentions per media item and window of event time ``ts``. Windows that start before ``begin``, where the media start, are left out."""
    w = mentions.withWatermark("ts", late).groupBy("media_id", F.window("ts", length, slide)).agg(F.count("*").alias("n_mentions"))
    w = w.select("media_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_mentions")
    return w.where(F.col("start") >= F.lit(begin).cast("timestamp")) if begin else w


def first_seen(mentions: DataFrame, late: str = "1 minute") -> DataFrame:
    return mentions.withWatermark("ts", late).dropDuplicatesWithinWatermark(["media_id", "mention"]).select("media_id", "mention")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started in here keep their state in RocksDB, on disk, so it may outgrow an executor's memory."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Kept:
    """A media item's states as one value, which comes and goes with its rows: no state is asked for over a socket."""

    SCHEMA = "tail string, length long, following int, timer long, waiting array<struct<idx:int,text:string,came:long>>"

    def __init__(self, state: GroupState) -> None:
        self.value, self.held = None, {}
        if state.exists:
            *value, waiting = state.get
            self.value, self.held = tuple(value), {i: (text, came) for i, text, came in waiting}

    def getValueState(self, *_) -> Kept:  # noqa: N802
        return self

    getMapState = getValueState  # noqa: N815

    def get(self) -> tuple | None:
        return self.value

    def update(self, value: tuple) -> None:
        self.value = value

    def iterator(self) -> Iterator[tuple]:
        return (((i,), v) for i, v in self.held.items())

    def removeKey(self, key: tuple) -> None:  # noqa: N802
        del self.held[key[0]]

    def updateValue(self, key: tuple, value: tuple) -> None:  # noqa: N802
        self.held[key[0]] = value

    def registerTimer(self, at: int) -> None:  # noqa: N802
        """The value's ``timer`` says when; ``put`` sets it."""

    deleteTimer = registerTimer  # noqa: N815

    def put(self, state: GroupState, now: int) -> None:
        state.update((*self.value, [(i, *v) for i, v in self.held.items()]))
        if self.value[3] >= 0:  # a call takes the one before it away
            state.setTimeoutDuration(max(self.value[3] - now, 1))


class Stitcher:
    """One media item's text so far and the chunks that wait for a gap before them.

    The value state has the text's last characters, its length, the next chunk's place, and the timer that is set. The
    map state has the waiting chunks and when each came. A gap is open since the first chunk beyond it came; chunks
    that come later don't put its end off.
    """

    def __init__(self, window: int, least: int, wait_ms: int | None) -> None:
        self.window, self.least, self.wait_ms = window, least, wait_ms

    def init(self, handle: Kept) -> None:
        self.handle = handle
        self.sofar = handle.getValueState("sofar", "tail string, length long, following int, timer long")
        self.waiting = handle.getMapState("waiting", "idx int", "text string, came long")

    def __call__(self, key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """A batch's rows of a media item, or the end of its wait."""
        kept, now = Kept(state), state.getCurrentProcessingTimeMs() if self.wait_ms else 0
        self.init(kept)
        if state.hasTimedOut:
            made = self.advance(key, {}, now, kept.value[3])
        else:
            made = self.advance(key, {int(i): t for frame in rows for i, t in zip(frame["idx"], frame["text"], strict=True)}, now)
        kept.put(state, now)
        yield made

    def advance(self, key: tuple, new: dict[int, str | None], now: int, expired: int = -1) -> pd.DataFrame:
        known = self.sofar.get()
        tail, length, following, timer = known or ("", 0, 0, -1)
        held = {k[0]: v for k, v in self.waiting.iterator()} if known and (timer >= 0 or not self.wait_ms) else {}
        start, added, kept = length, "", set(held)
        held |= {i: (t, now) for i, t in new.items() if i >= following}
        while held:
            if following not in held:
                if not self.wait_ms or min(came for _, came in held.values()) + self.wait_ms > now:
                    break
                following = min(held)  # the gap has been open for too long
            part = (held.pop(following)[0] or "").strip()
            if part:
                whole = stitch_two(tail, part, self.window, self.least) if length else part
                added, length = added + whole[len(tail) :], length + len(whole) - len(tail)
                tail = whole[-self.window :]
            following += 1
        for i in kept - set(held):
            self.waiting.removeKey((i,))
        for i in set(held) - kept | set(new) & set(held):
            self.waiting.updateValue((i,), held[i])
        due = min(came for _, came in held.values()) + self.wait_ms if held and self.wait_ms else -1
        if due != timer:
            if timer >= 0 and timer != expired:
                self.handle.deleteTimer(timer)
            if due >= 0:
                self.handle.registerTimer(due)
        self.sofar.update((tail, length, following, due))
        return pd.DataFrame({"media_id": [key[0]], "start": [start], "next_idx": [following], "piece": [added]})


def stream_stitch(chunks: DataFrame, window: int = 500, least: int = 10, wait_ms: int | None = None) -> DataFrame:
    """``media_id``, ``start``, ``next_idx``, ``piece`` after each batch: chunks are added in order of ``idx``; later ones wait for the gap.

    A piece is what the batch adds to the text; joined by ``start``, the characters before it, a media item's pieces are
    the text (``stitched`` does that). With ``wait_ms`` a gap that stays open for so long is left out, whatever comes
    meanwhile: the chunks behind it are added as if it were empty, and what comes for it later is dropped. Start the
    stream within ``rocksdb``.
    """
    stitcher = Stitcher(window, least, wait_ms)
    until = GroupStateTimeout.ProcessingTimeTimeout if wait_ms else GroupStateTimeout.NoTimeout
    return chunks.groupBy("media_id").applyInPandasWithState(lambda *x: stitcher(*x), "media_id long, start long, next_idx int, piece string", Kept.SCHEMA, "update", until)


def stitched(pieces: DataFrame) -> DataFrame:
    """The texts that ``stream_stitch`` has put out so far: ``media_id``, ``next_idx``, ``text``, with single blanks."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "next_idx", "piece"))), lambda x: x["piece"])
    whole = pieces.groupBy("media_id").agg(F.max("next_idx").alias("next_idx"), F.array_join(parts, "").alias("text"))
    return whole.withColumn("text", F.trim(F.regexp_replace("text", r"(?U)\s+", " ")))


def stream_resolve(mentions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Each mention with its ticker from a static dictionary."""
    d = dictionary.select(F.col("key").alias("_key"), "ticker")
    return mentions.join(d, F.col("mention") == F.col("_key"), "left").drop("_key")


def resolve_all(dictionary: DataFrame, tickers: DataFrame, cache_wins: bool = True, learn: tuple[str, ...] = ("fuzzy",)) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """For ``learner``: the whole cascade, with the cache laid over the dictionary for exact lookups and methods in ``learn`` to be put into it."""

    def run(mentions: DataFrame, cache: DataFrame) -> DataFrame:
        every = overlay(dictionary.select("key", "ticker"), cache.withColumnRenamed("mention", "key"), cache_wins)
        return cascade(mentions, every, tickers, fuzzy=dictionary).withColumn("learned", F.col("method").isin(*learn))

    return run


def replay(table: DataFrame, make: Callable[[DataFrame], DataFrame], mode: str = "append", name: str = "stream", each: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Run a streaming plan over a table's rows, written as files, until all are read; the rows it put out.

    ``each`` turns every batch, with its number, into the rows to be put out. A batch that Spark repeats is written anew.
    The files and the stream's log go when it has ended.
    """
    spark = table.sparkSession
    source, out, log = (scratch.new_path(spark, f"{name}-{k}") for k in ("in", "out", "log"))
    table.write.parquet(source, compression="zstd")
    made = make(spark.readStream.schema(table.schema).parquet(source))

    def write(df: DataFrame, n: int) -> None:
        (df if each is None else each(df, n)).write.mode("overwrite").parquet(f"{out}/batch={n}", compression="zstd")

    with rocksdb(spark):
        query = made.writeStream.outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    for done in (source, log):
        scratch.remove(spark, done)
    read = spark.read.option("recursiveFileLookup", "true")
    return (read.schema(made.schema) if each is None else read).parquet(out)
