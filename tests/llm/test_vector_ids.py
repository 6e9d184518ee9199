"""Vector searches where rows repeat, ids have several vectors, and widths differ, against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import nn_descent, topk


def table():
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(120)]
    rows += [(i, rng.normal(size=4).round(2).tolist()) for i in (0, 5, 7, 20)]  # a second vector
    rows += rows[3:6] * 3 + [rows[20]] * 2  # repeated rows, of queries too
    rows += [(i, [1.0, 1.0]) for i in range(200, 240)] + [(300, [1.0, 1.0, 0.0, 0.0]), (40, [1.0, 1.0])]
    return rows


def padded(v):
    return tuple([*v, *[0.0] * (4 - len(v))])


def brute(rows, k, of, score):
    """For each distinct vector of each query id the list over all distinct (id, vector) of other ids."""
    points = sorted({(i, padded(v)) for i, v in rows})
    out = []
    for q, x in points:
        if of(q):
            best = sorted((score(np.array(x), np.array(y)), i) for i, y in points if i != q)[:k]
            out += [(q, n + 1, i, s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("k", [3, 10])
def test_top_inner(spark, k):
    rows = table()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit("x")).repartition(5)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], -r["score"]) for r in topk.top_inner(df, F.col("vec_id") % 20 == 0, k=k).collect())
    assert got == brute(rows, k, lambda i: i % 20 == 0, lambda x, y: -int((np.floor(64 * x) * np.floor(64 * y)).sum()))


@pytest.mark.parametrize("k", [3, 10])
def test_nearest(spark, k):
    rows = table()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit("x")).repartition(5)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in nn_descent.nearest(df, F.col("vec_id") % 20 == 0, k=k).collect())
    assert got == brute(rows, k, lambda i: i % 20 == 0, lambda x, y: round(float(np.sqrt(((x - y) ** 2).sum())), 9))
