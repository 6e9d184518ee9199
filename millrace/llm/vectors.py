"""What the two vector searches share: valid vectors, one row for equal ones, and cells around bounded pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id`` and ``v`` (doubles) of vectors without null, NaN or infinite components; empty ones are out."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    out = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), finite.alias("ok"))
    return out.where("ok and vec_id is not null and size(v) > 0").select("vec_id", "v")


def most_own(asked: DataFrame) -> int:
    """The most different vectors that one id of ``asked`` has: so many entries of a list may be the query's own."""
    return asked.distinct().groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1


def distinct_vectors(rows: DataFrame, most_ids: int) -> DataFrame:
    """One row for equal vectors: ``rep``, a hash of the vector that names it, ``ids``, the ``most_ids`` smallest, and ``v``.

    The rank limit works before the shuffle too, so a vector that a third of all rows hold sends few rows a task.
    """
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.distinct().withColumn("place", first).where(F.col("place") <= most_ids)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.xxhash64("v").alias("rep"), "ids", "v")


def matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """A list column as a matrix; shorter rows are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    width = width or (int(sizes.max()) if len(sizes) else 0)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def cells(table: DataFrame, count: int, width: int, key: str = "rep") -> DataFrame:
    """``table`` with ``cell``, the nearest of ``count`` pivots: rows taken by the hash of their ids, a bounded sample."""
    taken = table.orderBy(F.xxhash64(key), key).select("v").limit(count).collect()
    pivots = np.zeros((len(taken), width))
    for k, row in enumerate(taken):
        pivots[k, : len(row["v"])] = row["v"]
    schema = f"{table.schema.simpleString()[7:-1]},cell:int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(batch.schema.get_field_index("v")), width).astype(float)
            cell = ((pivots**2).sum(1) - 2 * x @ pivots.T).argmin(1) if len(pivots) and len(x) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.asarray(cell, np.int32))], names=[*batch.schema.names, "cell"])

    return table.mapInArrow(run, schema)
