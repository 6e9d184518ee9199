"""The dual-tree search: trees cover, bounds hold, pairs of nodes are left out where the data allow it, odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import topk
from millrace.llm.vectors import valid


def nodes(node):
    yield node
    for c in node.children:
        yield from nodes(c)


def clustered(rng, n, width, spread):
    return np.floor(64 * (rng.normal(size=(30, width))[rng.integers(0, 30, n)] * 3 + spread * rng.normal(size=(n, width)))).astype(np.int64)


@pytest.mark.parametrize("width,spread", [(3, 0.2), (64, 0.05), (64, 1.0)])
def test_cover_tree_splits_at_any_width(width, spread):
    x = clustered(np.random.default_rng(1), 900, width, spread).astype(float)
    root, seen = topk.cover_tree(x), []
    for node in nodes(root):
        assert (np.sqrt(((x[node.rows] - node.center) ** 2).sum(1)) <= node.radius + 1e-6).all()
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
        else:
            assert len(node.rows) <= topk.LEAF or node.radius == 0
            seen += node.rows.tolist()
    assert sorted(seen) == list(range(900)) and len(list(nodes(root))) > 20


@pytest.mark.parametrize("spread,least", [(0.02, 0.7), (0.2, 0.2), (1.0, 0.0)])
def test_dual_search_is_exact_and_prunes(spread, least):
    x = clustered(np.random.default_rng(5), 3000, 16, spread)
    reps, q, counts = np.arange(3000) * 7, x[::10], topk.Counts()
    best = topk.dual_search(q, x, reps, 21, np.full(len(q), -np.inf), counts)
    whole = q @ x.T
    for i in range(len(q)):
        order = np.lexsort((reps, -whole[i]))[:21]
        assert best.row[i].tolist() == order.tolist() and best.score[i].tolist() == whole[i][order].tolist()
    assert counts.scored + counts.pruned == len(q) * len(x)
    assert counts.pruned >= least * len(q) * len(x)


def test_counts_on_the_given_embeddings(spark):
    """These vectors have no near neighbours: trees split down to points, and next to no pair can be left out."""
    rows = valid(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), "vec_id", "embedding").orderBy("vec_id").collect()
    x = np.floor(64 * np.array([r["v"] for r in rows])).astype(np.int64)
    counts = topk.Counts()
    topk.dual_search(x[::20], x, np.arange(len(x)), 21, np.full(len(x[::20]), -np.inf), counts)
    assert len(list(nodes(topk.cover_tree(x.astype(float))))) > len(x) // 2
    assert counts.scored + counts.pruned == len(x[::20]) * len(x)


def test_blocks_are_left_out_before_vectors_move(spark, monkeypatch):
    monkeypatch.setattr(topk, "DATA_BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 40)
    monkeypatch.setattr(topk, "SLICE", 3)
    kept, real = [], topk.near_blocks

    def counted(asking, held, slices):
        pairs = real(asking, held, slices)
        kept.append((pairs.count(), asking.count() * held.count(), slices))
        return pairs

    monkeypatch.setattr(topk, "near_blocks", counted)
    x = clustered(np.random.default_rng(2), 900, 8, 0.02) / 64
    df = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(900)], "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_inner(df, F.col("vec_id") % 9 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    whole = np.floor(64 * x).astype(np.int64)
    for q in range(0, 900, 9):
        s = whole @ whole[q]
        order = [int(k) for k in np.lexsort((np.arange(900), -s)) if k != q][:20]
        assert [got[q][k + 1] for k in range(20)] == [(k, int(s[k])) for k in order]
    (left, every, slices), = kept
    assert slices > 1 and left < 0.7 * every


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0]), (2, [0.5, 0.5, 0.5]), (2, [2.0]), (3, None), (4, []), (5, [float("inf")]), (None, [1.0]), (6, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit("x")).withColumn("cell", F.lit(1))
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_inner(df, F.col("vec_id") == 0, scale=2.0).collect())
    assert found == [(0, 1, 2, 8), (0, 2, 1, 4), (0, 3, 2, 2), (0, 4, 6, 0)]
    assert topk.top_inner(df, F.col("vec_id") == 99).count() == 0
