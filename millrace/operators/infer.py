"""Calls of a caller's model over rows: bounded over all tasks, retried, logged, and chained from chunk to chunk."""

from __future__ import annotations

import asyncio
import hashlib
import random
import secrets
import socket
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import scratch
from millrace.functions.text import bracket_json, fence_json, strip_echo

#: Prompts whose responses a task logs at a time.
LOG_ROWS = 64


class CallLimits:
    """At most ``calls`` calls open at one time over all tasks of all executors, and ``per_second`` of them begun a second.

    The driver lends out permits over sockets: a task asks before each call and says when it is over. A permit of a task
    that is lost comes back with its connection. Tasks wait for permits, not for partitions, so the data may lie in as
    many partitions as they like. Close it, or leave its ``with`` block, after the last action.
    """

    def __init__(self, spark: SparkSession, calls: int, per_second: float | None = None) -> None:
        self.calls, self.per_second, self._next = calls, per_second, 0.0
        self.host, self._secret = spark.conf.get("spark.driver.host"), secrets.token_hex(16)
        self._loop, ready = asyncio.new_event_loop(), threading.Event()

        async def serve() -> None:
            self._free = asyncio.Semaphore(calls)
            self._server = await asyncio.start_server(self._lend, self.host, 0)
            self.port = self._server.sockets[0].getsockname()[1]
            ready.set()

        def run() -> None:
            self._loop.create_task(serve())
            self._loop.run_forever()

        threading.Thread(target=run, daemon=True).start()
        ready.wait()
        self.address = (self.host, self.port, self._secret)

    async def _lend(self, reader: asyncio.StreamReader, writer: asyncio.StreamWriter) -> None:
        try:
            if (await reader.readline()).strip() != self._secret.encode():
                return
            while await reader.read(1) == b"a":
                async with self._free:
                    if self.per_second:
                        now = self._loop.time()
                        begin = max(now, self._next)
                        self._next = begin + 1 / self.per_second
                        await asyncio.sleep(begin - now)
                    writer.write(b"g")
                    await writer.drain()
                    await reader.read(1)  # the call is over, or the task is gone
        except ConnectionError:
            pass
        finally:
            writer.close()

    def close(self) -> None:
        self._loop.call_soon_threadsafe(self._loop.stop)

    def __enter__(self) -> CallLimits:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class _Permit:
    """A thread's connection to the driver; used around each call."""

    def __init__(self, address: tuple[str, int, str]) -> None:
        self.socket = socket.create_connection(address[:2])
        # Else a request that follows a return waits until the driver's acknowledgement, which it puts off for want of data to send.
        self.socket.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        self.socket.sendall(f"{address[2]}\n".encode())

    def __enter__(self) -> None:
        self.socket.sendall(b"a")
        if self.socket.recv(1) != b"g":
            raise ConnectionError("the limits are closed")

    def __exit__(self, *_: object) -> None:
        self.socket.sendall(b"r")


class ResponseLog:
    """Responses by the digest of their prompts, in a folder that all executors share.

    A task adds what it gets as it goes, in files of its own (written aside, then renamed), and reads those of its
    partition when Spark runs it again. Later calls over any data look prompts up in the whole log first.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/") if "://" in path else f"file://{path.rstrip('/')}"

    def table(self) -> DataFrame:
        """``digest``, ``response``, ``attempts``: one row a prompt."""
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path)
        schema = "digest string, response string, attempts int"
        if not target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self.path)
        return rows.groupBy("digest").agg(F.min(F.struct("response", "attempts")).alias("x")).select("digest", "x.*")


class _TaskLog:
    """The part of a log that one partition of one call writes."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        self.files, self.folder = fs.FileSystem.from_uri(path)
        self.files.create_dir(self.folder, recursive=True)
        self.known: dict[str, tuple[str, int]] = {}
        for f in self.files.get_file_info(fs.FileSelector(self.folder)):
            if f.base_name.endswith(".parquet") and f.base_name[0] not in "._":
                import pyarrow.parquet as pq

                rows = pq.read_table(f.path, filesystem=self.files, partitioning=None).to_pydict()
                self.known |= {d: (r, n) for d, r, n in zip(rows["digest"], rows["response"], rows["attempts"], strict=True)}

    def add(self, new: dict[str, tuple[str, int]]) -> None:
        import pyarrow.parquet as pq

        if not new:
            return
        name = f"{uuid.uuid4().hex}.parquet"
        rows = pa.table({"digest": pa.array(list(new), pa.string()), "response": pa.array([r for r, _ in new.values()], pa.string()), "attempts": pa.array([n for _, n in new.values()], pa.int32())})
        pq.write_table(rows, f"{self.folder}/_{name}", filesystem=self.files)
        self.files.move(f"{self.folder}/_{name}", f"{self.folder}/{name}")


def batch_call(
    df: DataFrame, prompt: str, fn: Callable[[str], str], workers: int | CallLimits | None = None, attempts: int = 5, wait: float = 1.0, fallback: str = "input",
    retry_on: Callable[[Exception], bool] | None = None, threads: int = 4, log: ResponseLog | None = None,
) -> DataFrame:
    """``df`` with ``response``, ``attempts`` and ``status`` (ok, failed).

    ``fn`` gets one prompt; after an exception it is called again, up to ``attempts`` times, after wait * 2^n plus up
    to one wait of chance. With ``retry_on`` an exception that it says no to ends the tries at once. When all fail the
    prompt stands as the response, or nothing with ``fallback='empty'``. A null prompt is not asked and failed.

    Each task keeps up to ``threads`` calls open. ``workers`` bounds the calls open at one time over all tasks, as
    ``CallLimits`` that the caller closes, or as a number, whose limits last until the driver ends. Waiting between tries
    keeps no permit. Prompts of ``log`` are not asked again, nor are those that a lost task had logged: pass one where
    calls are dear, as Spark may run a task twice. Equal prompts of one block of rows are asked once.
    """
    limits = CallLimits(df.sparkSession, workers) if isinstance(workers, int) else workers
    address, run_id = limits.address if limits else None, uuid.uuid4().hex
    names = df.columns
    logged_at = f"{log.path}/{run_id}" if log else None
    if log:
        known = scratch.written(log.table(), "responses")
        known = known.select(F.col("digest").alias("_digest"), F.col("response").alias("_response"), F.col("attempts").alias("_attempts"))
        df = df.join(known, F.sha2(F.col(prompt).cast("binary"), 256) == F.col("_digest"), "left").drop("_digest")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = threading.local()
        task_log = _TaskLog(f"{logged_at}/{TaskContext.get().partitionId()}") if logged_at else None

        def call(text: str) -> str:
            if not address:
                return fn(text)
            if not hasattr(own, "permit"):
                own.permit = _Permit(address)
            with own.permit:
                return fn(text)

        def one(text: str) -> tuple[str, int, str]:
            n = 0
            while True:
                n += 1
                try:
                    return call(text), n, "ok"
                except Exception as failed:  # whatever the caller's model raises counts as a failed call
                    if n >= attempts or (retry_on is not None and not retry_on(failed)):
                        return text if fallback == "input" else "", n, "failed"
                    if wait:
                        time.sleep(wait * (2 ** (n - 1) + random.random()))

        with ThreadPoolExecutor(threads) as pool:
            for frame in frames:
                made: dict[str, tuple[str, int, str]] = {}
                if logged_at:
                    made |= {t: (r, int(n), "ok") for t, r, n in zip(frame[prompt], frame["_response"], frame["_attempts"], strict=True) if r is not None and t is not None}
                open_prompts = list(dict.fromkeys(t for t in frame[prompt] if t is not None and t not in made))
                for i in range(0, len(open_prompts), LOG_ROWS):
                    part = open_prompts[i : i + LOG_ROWS]
                    if task_log:
                        digests = {t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in part}
                        made |= {t: (*task_log.known[digests[t]], "ok") for t in part if digests[t] in task_log.known}
                        part = [t for t in part if t not in made]
                    new = dict(zip(part, pool.map(one, part), strict=True))
                    if task_log:
                        task_log.add({digests[t]: (r, n) for t, (r, n, status) in new.items() if status == "ok"})
                    made |= new
                none = ("" if fallback == "empty" else None, 0, "failed")
                rows = [made.get(t, none) if t is not None else none for t in frame[prompt]]
                yield frame[names].assign(response=[r[0] for r in rows], attempts=[r[1] for r in rows], status=[r[2] for r in rows])

    fields = ", ".join(f"`{n}` {t}" for n, t in df.select(*[f"`{n}`" for n in names]).dtypes)
    return df.mapInPandas(run, f"{fields}, response string, attempts int, status string")


def carry_output(chunks: DataFrame, group: str, idx: str, text: str, fn: Callable[[str], str], length: int = 300, marker: str = "[CONTEXT]", **options) -> DataFrame:
    """Each chunk's ``output``, where the model sees the last ``length`` characters of the output before it: with ``context``, ``status``.

    A wave: turn i asks for the i-th chunk of all groups at once and writes down the outputs; the next one takes their
    ends. So there are as many jobs as the longest group has chunks, each over all groups that are that long. A chunk
    whose calls fail is its own output. What a reply repeats of its context is cut off. ``options`` are ``batch_call``'s.
    A null chunk counts as empty; of chunks with equal ``idx`` the smaller text comes first.
    """
    spark = chunks.sparkSession
    if isinstance(options.get("workers"), int):
        options["workers"] = CallLimits(spark, options["workers"])
    folder, out = scratch.new_path(spark, "carry"), scratch.new_path(spark, "carry-out")
    wave = "wave"
    while wave in (group, idx, text):
        wave += "_"
    turn = F.row_number().over(Window.partitionBy(group).orderBy(idx, text)) - 1
    rows = chunks.select(group, idx, F.coalesce(text, F.lit("")).alias(text)).withColumn(wave, turn)
    rows.write.partitionBy(wave).parquet(folder)
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.drop(wave).dtypes)
    last = spark.read.schema(f"{kinds}, {wave} int").parquet(folder).agg(F.max(wave)).first()[0]
    done = f"{kinds}, context string, output string, status string"
    carried = spark.createDataFrame([], done).select(F.col(group).alias("_of"), F.col("output").alias("context"))
    for k in range(0 if last is None else last + 1):
        now = spark.read.schema(kinds).parquet(f"{folder}/{wave}={k}")
        met = now.join(carried, F.col(group).eqNullSafe(F.col("_of")), "left").drop("_of").withColumn("context", F.coalesce("context", F.lit("")))
        asked = F.when(F.col("context") != "", F.concat(F.lit(f"{marker} "), "context", F.lit("]\n"), text)).otherwise(F.col(text))
        made = batch_call(met.withColumn("prompt", asked), "prompt", fn, **options)
        output = F.when(F.col("status") == "ok", strip_echo(F.col("response"), marker)).otherwise(F.col(text))
        made.select(group, idx, text, "context", output.alias("output"), "status").write.parquet(f"{out}/{wave}={k}")
        carried = spark.read.schema(done).parquet(f"{out}/{wave}={k}").select(F.col(group).alias("_of"), F.right("output", F.lit(length)).alias("context"))
    scratch.remove(spark, folder)
    if last is None:
        return spark.createDataFrame([], done)
    return spark.read.schema(done).option("recursiveFileLookup", "true").parquet(out)


def structured(df: DataFrame, reply: Column, schema: str, fenced: bool = False) -> DataFrame:
    """``df`` with a row an element of the array that a reply holds, its fields as columns; a reply without one gives none."""
    read = fence_json if fenced else bracket_json
    return df.select("*", F.inline(read(reply, schema)))


def chain(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df
