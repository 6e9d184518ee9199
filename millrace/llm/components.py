"""Connected components of a graph in tables: smallest labels pass along edges, with jumps to the label's own label."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import scratch

#: So many edges (16 bytes each) are joined in one task, on arrays; more pass labels in rounds.
MOST_LOCAL = 1_000_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a list of edges, and the smallest node of each one's component."""
    names, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    over = np.arange(len(names))
    while True:
        p, q = over[x], over[y]
        apart = p != q
        if not apart.any():
            return names, names[over]
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(over, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(further := over[over], over):
            over = further


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if held:
        names, labels = joined(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(labels, pa.int64())], names=["id", "label"])


def connected(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """``id`` and ``label``, the smallest id of its component, for each node that has an edge to another. ``edges`` holds a and b.

    Each round takes the smallest label among a node and its neighbours, partial sums first, and then follows
    labels once, so the rounds grow with the logarithm of a component's width.
    """
    edges = scratch.written(edges.select("a", "b").where("a <> b").distinct(), "components-edges", folder)
    if edges.count() <= MOST_LOCAL:
        return scratch.written(edges.coalesce(1).mapInArrow(_local, "id long, label long"), "components", folder)
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.written(both, "components-edges", folder)
    labels = scratch.written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), "components", folder)
    while True:
        near = both.join(labels.withColumnsRenamed({"id": "a", "label": "seen"}), "a").groupBy(F.col("b").alias("id")).agg(F.min("seen").alias("seen"))
        met = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        now = met.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        now = scratch.written(now, "components", folder)
        labels = now.select("id", "label")
        if now.where("old <> label").isEmpty():
            return labels
