"""Line dedup: lines that several documents hold stay only in the document with the smallest id.

Native: explode the normalised lines to hashes, take the smallest and the largest document of each hash
(partial aggregates, so a line that a third of all documents hold costs one row a task), join the hashes that
more than one document holds back to the lines, and cut the marked positions out of each text. Only hashes and
positions are shuffled for the counting; texts move once, to meet their positions.

Defined cases: a null or empty text is one empty line and stays. A row that occurs twice under the same id is
one document, and both rows are answered. Rows with the same id and different texts are one document too.
Rows whose id is null are kept as they are and count for nothing. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import scratch
from millrace.llm.common import free_prefix

#: Fixed value: the white space that a key loses at both ends.
BLANKS = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without white space at its ends, with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text", prefix: str = "ld_") -> DataFrame:
    """Every row of ``docs``, its text without the dropped lines, and the counts ``n_lines`` and ``n_dropped``.

    The two counts are the last columns. They and the working columns are named with ``prefix``, which gets underscores
    in front of it while a column of ``docs`` begins with it, so that none is hidden.
    """
    prefix = free_prefix(docs.columns, prefix)
    doc, text = F.col(id_col), F.col(text_col)
    lines = (
        docs.select(doc.cast("long").alias("doc"), F.xxhash64(text).alias("version"), F.posexplode(split_lines(text)).alias("pos", "line"))
        .where(F.col("doc").isNotNull())
        .withColumn("key", line_key(F.col("line")))
        .where(F.length("key") >= min_chars)
        .select("doc", "version", "pos", F.unhex(F.md5(F.col("key").cast("binary"))).alias("key"))
    )
    lines = scratch.written(lines, "line-keys")  # read twice: once to count, once to mark
    if min_docs == 2:
        shared = lines.groupBy("key").agg(F.min("doc").alias("keeper"), F.max("doc").alias("last")).where("keeper < last")
    else:  # one row for each key and document first, so that no key's documents meet in one place
        shared = lines.groupBy("key", "doc").agg(F.lit(1).alias("one")).groupBy("key").agg(F.min("doc").alias("keeper"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    # A table of its own: both sides of the join are dealt plainly then, so Spark can split a line that very many hold.
    shared = scratch.written(shared.select("key", "keeper"), "shared-lines")
    cut = (
        lines.join(shared, "key")
        .where("doc <> keeper")
        .groupBy("doc", "version")
        .agg(F.sort_array(F.collect_set("pos")).alias(f"{prefix}cut"))
        .withColumnsRenamed({"doc": f"{prefix}doc", "version": f"{prefix}version"})
    )
    met = docs.join(cut, (doc.cast("long") == F.col(f"{prefix}doc")) & (F.xxhash64(text) == F.col(f"{prefix}version")), "left")
    met = met.withColumn(f"{prefix}lines", split_lines(text))
    all_lines, out = F.col(f"{prefix}lines"), F.coalesce(F.col(f"{prefix}cut"), F.array().cast("array<int>"))
    met = met.withColumn(f"{prefix}cut", out)
    out = F.col(f"{prefix}cut")
    # The runs between two cuts: run i goes from after cut i-1 to before cut i.
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(out, i - 1) + 1)
    end = lambda i: F.coalesce(F.get(out, i), F.size(all_lines))
    runs = F.transform(F.sequence(F.lit(0), F.size(out)), lambda i: F.slice(all_lines, begin(i) + 1, end(i) - begin(i)))
    kept = F.when(F.size(out) == 0, F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.flatten(runs), "\n"))
    return met.select(
        *[kept.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        F.size(all_lines).cast("long").alias(f"{prefix}n_lines"),
        F.size(out).cast("long").alias(f"{prefix}n_dropped"),
    )
