"""A cache of resolved mentions as a table that streams and jobs change: versions, a commit for each, buckets by mention.

    data/<version>-<unique>/bucket=<k>/   entries, as Parquet
    commits/<version>                     JSON: the folder of each bucket, and the last batch of each stream

A change reads and writes the buckets that its mentions fall in and no others, and then commits: a file is written aside
and renamed to the next version's name, which fails if another writer was there first; then the change is made again on
what that one has left. Readers take the newest commit, so they see whole changes only. What a writer leaves behind that
dies before its commit belongs to no version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import scratch

SCHEMA = "mention string, ticker string, updated_at long"
TRIES = 5


class CacheTable:
    """Opens or makes the table at ``path``. ``buckets`` counts when it is made; ``keep`` is how many versions stay readable."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, keep: int = 3) -> None:
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.files = self._path("commits").getFileSystem(self.conf)
        if not self.versions():
            self._commit({"version": 0, "buckets": buckets, "folders": {}, "applied": {}})

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def versions(self) -> list[int]:
        """The versions that are there, the oldest first."""
        if not self.files.exists(self._path("commits")):
            return []
        return sorted(int(f.getPath().getName()) for f in self.files.listStatus(self._path("commits")) if f.getPath().getName().isdigit())

    def state(self, version: int | None = None) -> dict:
        """What a version's commit says; by default the newest one's."""
        name = f"{self.versions()[-1] if version is None else version:010d}"
        stream = self.files.open(self._path("commits", name))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _commit(self, state: dict) -> bool:
        """Whether the version could be made; not if there is one of that number."""
        aside, final = self._path("commits", f".{uuid.uuid4().hex}"), self._path("commits", f"{state['version']:010d}")
        out = self.files.create(aside, False)
        out.write(json.dumps(state, sort_keys=True).encode())
        out.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.conf).rename(aside, final, how)
            return True
        except Py4JJavaError as gone:
            if "FileAlreadyExists" not in gone.java_exception.getClass().getName():
                raise
            self.files.delete(aside, False)
            return False

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{f}" for f in folders])

    def table(self, version: int | None = None) -> DataFrame:
        """``mention``, ``ticker``, ``updated_at`` of a version, by default the newest."""
        return self._read(sorted(self.state(version)["folders"].values()))

    def merge(self, changes: DataFrame, stream: str | None = None, batch: int | None = None) -> bool:
        """Put in or replace entries (``mention``, ``ticker``, ``updated_at``): the newest of a mention stays, then the largest ticker.

        With ``stream`` and ``batch`` a batch that this stream has already brought changes nothing, nor does an older
        one. Returns whether a version was made. Null mentions are passed over.
        """
        folder = scratch.new_path(self.spark, "cache-changes")
        try:
            count = self.state()["buckets"]
            bucket = F.pmod(F.xxhash64("mention"), F.lit(count)).cast("int")
            rows = changes.select(F.lower("mention").alias("mention"), "ticker", F.col("updated_at").cast("long").alias("updated_at")).where("mention is not null")
            rows = scratch.written(rows.withColumn("bucket", bucket), "changes", folder)
            touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # as many as there are buckets
            for _ in range(TRIES):
                before = self.state()
                if stream is not None and before["applied"].get(stream, -1) >= batch:
                    return False
                after = before | {"version": before["version"] + 1, "applied": before["applied"] | ({} if stream is None else {stream: batch}), "folders": dict(before["folders"])}
                if touched:
                    old = self._read([before["folders"][str(k)] for k in touched if str(k) in before["folders"]]).withColumn("bucket", bucket)
                    newest = F.row_number().over(Window.partitionBy("bucket", "mention").orderBy(F.col("updated_at").desc(), F.col("ticker").desc()))
                    merged = old.unionByName(rows).repartition("bucket").withColumn("_n", newest).where("_n = 1").drop("_n")
                    place = f"data/{after['version']:010d}-{uuid.uuid4().hex}"
                    merged.write.partitionBy("bucket").parquet(f"{self.path}/{place}")
                    after["folders"] |= {str(k): f"{place}/bucket={k}" for k in touched}
                if self._commit(after):
                    self.clean()
                    return True
            raise RuntimeError(f"other writers were first {TRIES} times")
        finally:
            scratch.remove(self.spark, folder)

    def clean(self) -> None:
        """Drop the versions before the last ``keep`` and the folders that only they had."""
        versions = self.versions()
        gone, kept = versions[: -self.keep], versions[-self.keep :]
        needed = {f for v in kept for f in self.state(v)["folders"].values()}
        for v in gone:
            for f in set(self.state(v)["folders"].values()) - needed:
                self.files.delete(self._path(f), True)
            self.files.delete(self._path("commits", f"{v:010d}"), False)
        held = {f.split("/")[1] for f in needed}
        for f in self.files.listStatus(self._path("data")) if self.files.exists(self._path("data")) else []:
            name = f.getPath().getName()
            if name not in held and int(name[:10]) <= kept[0]:  # emptied, or left by a writer that never committed
                self.files.delete(f.getPath(), True)


def learner(table: CacheTable, stream: str, resolve: Callable[[DataFrame, DataFrame], DataFrame], at: str = "ts") -> Callable[[DataFrame, int], DataFrame]:
    """For ``foreachBatch``: resolves a batch's mentions and puts into the table what ``resolve`` marks as ``learned``.

    ``resolve`` gets the batch's distinct mentions and the table as it is, and returns ``mention``, ``ticker``,
    ``method``, ``learned``. The function returns the batch's rows with ticker and method. An entry's ``updated_at`` is
    the largest ``at`` of its mention in the batch. The resolved mentions are written down once, so that the rows and
    the table agree.
    """

    def run(batch: DataFrame, n: int) -> DataFrame:
        mentions = batch.groupBy("mention").agg(F.max(at).cast("long").alias("updated_at"))
        known = scratch.written(resolve(mentions.select("mention"), table.table()), "resolved")
        news = known.where("learned and ticker is not null").join(mentions, "mention").select("mention", "ticker", "updated_at")
        table.merge(news, stream, n)
        return batch.join(known.drop("learned"), "mention", "left")

    return run
