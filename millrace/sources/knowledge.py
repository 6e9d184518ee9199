"""Nested dictionaries, vocabularies and caches as tables, and back. Order is kept by ordinals.

Nested dictionaries and caches are written as JSON lines: one document an outer name, or a range of the cache's
entries, with the ordinals in it. So no task holds the whole dictionary, and readers split the file. Readers also take
one document that holds everything, as other tools write it; then positions follow the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import scratch

NESTED = "map<string,map<string,array<string>>>"
PLACED = "struct<outer:string,outer_pos:long,inner:array<struct<name:string,list:array<string>>>>"
ENTRIES = "struct<pos:long,mention:string,ticker:string>"
VOCABULARY = "struct<investment_prompt:string,vocab_list:array<struct<term:string,desc:string,hints:array<string>,logic:string>>>"


def _lines(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    """``value``: the file's documents; a missing path gives none, as does an unreadable one."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.globStatus(target):
        return spark.createDataFrame([], "value string")
    return spark.read.text(path, wholetext=whole)


def kb_rows(json: Column, df: DataFrame, names: tuple[str, str, str] = ("sector", "ticker", "alias")) -> DataFrame:
    """One row an alias of outer -> inner -> list of aliases, with the three positions. An inner name without alias keeps a row."""
    outer, inner, leaf = names
    flat = df.select(F.posexplode(F.from_json(json, NESTED)).alias(f"{outer}_pos", outer, "_in"))
    flat = flat.select(outer, f"{outer}_pos", F.posexplode("_in").alias(f"{inner}_pos", inner, "_list"))
    return flat.select(outer, f"{outer}_pos", inner, f"{inner}_pos", F.posexplode_outer("_list").alias(f"{leaf}_pos", leaf))


def read_kb(spark: SparkSession, path: str, names: tuple[str, str, str] = ("sector", "ticker", "alias"), whole: bool = False) -> DataFrame:
    """The table of ``kb_rows`` from what ``write_kb`` has written, or with ``whole`` from one nested document.

    A missing file gives no rows; a broken document gives none of its own.
    """
    text = _lines(spark, path, whole)
    if whole:
        return kb_rows(F.col("value"), text, names)
    outer, inner, leaf = names
    rows = text.select(F.from_json("value", PLACED).alias("d")).where("d.outer is not null")
    rows = rows.select(F.col("d.outer").alias(outer), F.col("d.outer_pos").alias(f"{outer}_pos"), F.posexplode("d.inner").alias(f"{inner}_pos", "_x"))
    return rows.select(outer, f"{outer}_pos", F.col("_x.name").alias(inner), f"{inner}_pos", F.posexplode_outer("_x.list").alias(f"{leaf}_pos", leaf))


def kb_json(rows: DataFrame, outer: str = "sector", inner: str = "ticker", leaf: str = "alias", order: str = "ord") -> DataFrame:
    """One row ``value`` an outer name: its position among all and its inner names in order, with their lists by ``order``."""
    lists = rows.groupBy(outer, inner).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, leaf))), lambda x: x[leaf]).alias("_list"))
    one = lists.groupBy(outer).agg(F.array_sort(F.collect_list(F.struct(F.col(inner).alias("name"), F.col("_list").alias("list")))).alias("inner"))
    # Names only are put in order in one place: as many as there are outer names.
    place = rows.select(outer).distinct().withColumn("outer_pos", F.row_number().over(Window.orderBy(outer)) - 1)
    return one.join(place, outer).select(F.to_json(F.struct(F.col(outer).alias("outer"), "outer_pos", "inner")).alias("value"))


def write_kb(rows: DataFrame, path: str, **names: str) -> None:
    kb_json(rows, **names).write.text(path)


def read_vocabulary(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """``term``, ``desc``, ``hints``, ``logic``, one document a line or, with ``whole``, one a file. A missing or broken file gives no rows."""
    return _lines(spark, path, whole).select(F.inline(F.from_json("value", VOCABULARY)["vocab_list"]))


def read_cache(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """``pos``, ``mention``, ``ticker`` of what ``write_cache`` has written, or with ``whole`` of one document. A missing or broken file gives no rows."""
    text = _lines(spark, path, whole)
    if whole:
        return text.select(F.posexplode(F.from_json("value", "map<string,string>")).alias("pos", "mention", "ticker"))
    return text.select(F.from_json("value", ENTRIES).alias("e")).where("e.mention is not null").select("e.*")


def write_cache(cache: DataFrame, path: str) -> None:
    """One entry a line (``mention``, ``ticker``), each with its place in the order of mentions."""
    ranked = _ranked(cache.select("mention", "ticker"), "mention")
    ranked.select(F.to_json(F.struct("pos", "mention", "ticker")).alias("value")).write.text(path)


def _ranked(df: DataFrame, by: str) -> DataFrame:
    """``df`` with ``pos``, the place of a row in the order of ``by``: counts of ranges first, then places within a range."""
    parted = df.repartitionByRange(F.col(by)).withColumn("_part", F.spark_partition_id())
    own = Window.partitionBy("_part").orderBy(by)
    parted = scratch.written(parted.withColumn("_in", F.row_number().over(own) - 1), "ranked")  # ranges are dealt once
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a range
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return parted.join(before, "_part").withColumn("pos", F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def media(df: DataFrame) -> DataFrame:
    """Defaults for what a media row lacks."""
    return df.select("media_id", F.coalesce("title", F.lit("Unknown_Video")).alias("title"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("channel", F.lit("")).alias("channel"), F.coalesce("duration_sec", F.lit(0.0)).alias("duration_sec"))


def chunk_text(turns: DataFrame, media_id: str = "conv_id", idx: str = "turn", text: str = "text") -> DataFrame:
    """Turns of a conversation as a media item's chunks: ``media_id``, ``idx``, ``text``, ``status``."""
    return turns.select(F.col(media_id).alias("media_id"), F.col(idx).alias("idx"), F.col(text).alias("text"), F.when(F.col(text).isNull(), "failed").otherwise("ok").alias("status"))


def upsert(cache: DataFrame, changes: DataFrame) -> DataFrame:
    """The newest row of each mention (``mention``, ``ticker``, ``updated_at``); among equally new ones the largest ticker."""
    every = cache.unionByName(changes).withColumn("mention", F.lower("mention"))
    newest = F.row_number().over(Window.partitionBy("mention").orderBy(F.col("updated_at").desc(), F.col("ticker").desc()))
    return every.withColumn("_n", newest).where("_n = 1").drop("_n")


def artifact_name(kind: Column, at: Column, prefix: Column) -> Column:
    """``prefix_KIND_yyyyMMdd_HHmm``."""
    return F.concat_ws("_", prefix, kind, F.date_format(at.cast("timestamp"), "yyyyMMdd_HHmm"))


def write_artifacts(df: DataFrame, path: str) -> None:
    """``media_id``, ``kind``, ``run_ts``, ``text``, one folder a kind."""
    df.write.partitionBy("kind").parquet(path)
