"""Approximate nearest neighbours: NN-descent builds a neighbour graph, queries walk it greedily.

Equal vectors are one point. Every point gets first neighbours from a few deals into bounded blocks around pivots.
Then, in rounds, Spark joins each point's neighbours (its own and those that have it) with each other: each pair of
them is measured, and each keeps what is nearer than its farthest neighbour, until the lists hardly get nearer. A query starts
from its own point and widens a list of the ``BEAM`` nearest by the neighbours of the nearest not yet opened, one
join a round for all queries, until all on the list are open. A round moves the lists and the vectors of what was
opened; a query measures them in one block. Scores are made anew from the original vectors.

The graph is the method's own approximation: lists of ``DEGREE`` neighbours, and as many of those that point back;
the recall against brute force is measured in the tests. All points are in the graph; nothing is sampled.

Defined cases: null, empty and zero vectors and those with null or non-finite components take no part. Shorter
vectors are filled up with zeros. Equal vectors are found at distance 0, smallest ids first, without the query's own
row. Up to BLOCK / 2 points are one block, so lists there hold all others or DEGREE of them, and fewer candidates than k
are all returned. An id with several vectors is searched for by each, and is found at each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import scratch
from millrace.llm.vectors import cells, distinct_vectors, matrix, most_own, valid

K, DEGREE, BEAM, OPENED = 10, 24, 256, 96
#: First deals: how many, points in a block at most, pivots at most.
DEALS, BLOCK, PIVOTS = 4, 768, 1024
ROUNDS, OFFERED = 5, 24
#: Rounds end when the mean distance in the lists falls by less than this share.
SETTLED = 0.002


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))) * (F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))), F.lit(0.0), lambda s, x: s + x))


def _pairs(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    n = (x * x).sum(1)
    d = n[:, None] - 2 * (x @ x.T) + n
    np.maximum(d, 0, out=d)
    np.fill_diagonal(d, np.inf)
    return d


def _block_pass(table: DataFrame, width: int, degree: int) -> DataFrame:
    """Each point's nearest within its block."""

    def run(block: pa.Table) -> pa.Table:
        reps, d = block.column("rep").to_numpy(), _pairs(matrix(block.column("v"), width))
        most = min(degree, len(reps) - 1)
        if most < 1:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        near = np.argpartition(d, most - 1, axis=1)[:, :most]
        return pa.table({"a": np.repeat(reps, most), "b": reps[near].ravel(), "d": np.take_along_axis(d, near, 1).ravel()})

    return table.groupBy("cell", "part").applyInArrow(run, "a long, b long, d double")


def _join_pass(around: DataFrame, held: DataFrame, width: int, degree: int) -> DataFrame:
    """Pairs of neighbours of one point, as far as they are nearer than the farthest that a member has.

    ``around``: block, mid, rep; ``held``: block, rep, v, worst. Points near each other share a block and most of
    their neighbours, so a vector travels once a block and not once a neighbour.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        reps, x = right.column("h_rep").to_numpy(), matrix(right.column("v"), width)
        worst = right.column("worst").to_numpy()
        order = np.argsort(reps)
        reps, x, worst = reps[order], x[order], worst[order]
        mids = left.column("mid").to_numpy()
        by = np.argsort(mids, kind="stable")
        local = np.searchsorted(reps, left.column("rep").to_numpy()[by])
        mids = mids[by]
        edges = np.flatnonzero(np.concatenate(([True], mids[1:] != mids[:-1], [True]))) if len(mids) else np.zeros(1, int)
        keys, far = [], []
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            if e - s < 2:
                continue
            own = local[s:e]
            d = _pairs(x[own])
            most = min(OFFERED, e - s - 1)
            near = np.argpartition(d, most - 1, axis=1)[:, :most] if most < e - s - 1 else np.tile(np.arange(e - s), (e - s, 1))
            d = np.take_along_axis(d, near, 1)
            i, j = np.nonzero(d < worst[own][:, None])
            keys.append(own[i] * len(reps) + own[near[i, j]])
            far.append(d[i, j])
        if not keys:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        keys, first = np.unique(np.concatenate(keys), return_index=True)
        d = np.concatenate(far)[first]
        i, j = keys // len(reps), keys % len(reps)
        rank = np.lexsort((d, i))
        i, j, d = i[rank], j[rank], d[rank]
        start = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
        place = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
        keep = place < degree
        return pa.table({"a": reps[i[keep]], "b": reps[j[keep]], "d": d[keep]})

    return around.groupBy("block").cogroup(held.groupBy("h_block")).applyInArrow(run, "a long, b long, d double")


def _best(edges: DataFrame, degree: int) -> DataFrame:
    """Each point's nearest as one row: ``a`` and ``near``, sorted (d, b)."""
    return edges.groupBy("a", "b").agg(F.min("d").alias("d")).groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "b"))), 1, degree).alias("near"))


def build_graph(points: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """``a`` and ``near``: for each point (``rep``, ``v``) its neighbours as (d, b), d the squared distance."""
    count, width = points.agg(F.count("*"), F.max(F.size("v"))).first()
    narrow = scratch.written(points.select("rep", F.col("v").cast("array<float>").alias("v")), "nn-points")
    edges, home = None, None
    for deal in range(DEALS):
        dealt = cells(narrow.withColumn("turn", F.xxhash64("rep", F.lit(deal))), max(1, min(PIVOTS, 2 * count // BLOCK)), width, "turn")
        sizes = dealt.groupBy("cell").agg(F.count("*").alias("n"))  # one row a pivot
        dealt = dealt.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("rep", F.lit(deal)), F.ceil(F.col("n") / BLOCK)).cast("int"))
        if not deal:
            home = scratch.written(dealt.select(F.col("rep").alias("mid"), (F.col("cell").cast("long") * (1 << 32) + F.col("part")).alias("block")), "nn-home")
        found = _block_pass(dealt.select("cell", "part", "rep", "v"), width, degree)
        edges = found if edges is None else edges.union(found)
    graph = scratch.written(_best(edges, degree), "nn-graph")
    # What all lists' distances add up to tells how much a round has gained.
    spread = lambda g: g.agg(F.sum(F.aggregate("near", F.lit(0.0), lambda s, x: s + F.sqrt(x["d"])) / F.size("near"))).first()[0] or 0.0
    total = spread(graph)
    for _ in range(rounds):
        flat = graph.select("a", F.explode("near").alias("x")).select("a", F.col("x.b").alias("b"), F.col("x.d").alias("d"))
        back = _best(flat.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"), degree).select("a", F.explode("near").alias("x")).select("a", F.col("x.b").alias("b"))
        around = flat.select(F.col("a").alias("mid"), F.col("b").alias("rep")).union(back.select(F.col("a").alias("mid"), F.col("b").alias("rep"))).distinct()
        worst = graph.select(F.col("a").alias("w_rep"), F.when(F.size("near") < degree, F.lit(float("inf"))).otherwise(F.element_at("near", -1)["d"]).alias("worst"))
        around = scratch.written(around.join(home, "mid").select("block", "mid", "rep"), "nn-around")
        wanted = around.select(F.col("block").alias("h_block"), F.col("rep").alias("h_rep")).distinct()
        held = wanted.join(narrow, F.col("h_rep") == F.col("rep")).join(worst, F.col("h_rep") == F.col("w_rep"), "left").select("h_block", "h_rep", "v", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
        offers = _join_pass(around, held, width, degree)
        now = scratch.written(_best(flat.union(offers), degree), "nn-graph")
        graph = now
        before, total = total, spread(graph)
        if before - total < SETTLED * before:
            break
    return graph


def _widened(state: DataFrame, fresh: DataFrame, width: int, beam: int) -> DataFrame:
    """``state`` with what its opened nodes lead to: each query measures its fresh nodes at once and keeps the ``beam`` nearest."""
    schema = "q long, qv array<float>, node array<long>, d array<double>, opened array<boolean>"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select(["q", "qv", "node", "d", "opened"])
        held = {c: left.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("node", "d", "opened", "next")}
        node, d, opened = held["node"], held["d"], held["opened"].astype(bool) | np.isin(held["node"], held["next"])
        if right.num_rows:
            new = ~np.isin(right.column("node").to_numpy(), node)
            x, q = matrix(right.column("v"), width)[new].astype(float), matrix(left.column("qv"), width)[0].astype(float)
            node = np.concatenate((node, right.column("node").to_numpy()[new]))
            d, opened = np.concatenate((d, np.sqrt(((x - q) ** 2).sum(1)))), np.concatenate((opened, np.zeros(len(x), bool)))
            order = np.lexsort((node, d))[:beam]
            node, d, opened = node[order], d[order], opened[order]
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        return pa.table({"q": left.column("q"), "qv": left.column("qv").cast(pa.list_(pa.float32())), "node": one(node, pa.int64()), "d": one(d, pa.float64()), "opened": one(opened, pa.bool_())})

    return state.groupBy("q").cogroup(fresh.groupBy("of")).applyInArrow(run, schema)


def nearest(rows: DataFrame, is_query: Column, k: int = K, degree: int = DEGREE, beam: int = BEAM, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` (Euclidean distance) of about the k nearest. ``is_query`` is a condition on ``vec_id``."""
    vectors = valid(rows, id_col, vec_col).where(F.exists("v", lambda x: x != 0.0))
    most = k + most_own(vectors.where(is_query))  # a list may hold the query's own vectors besides
    points = scratch.written(distinct_vectors(vectors, most), "nn-vectors")
    if points.isEmpty():
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    graph = build_graph(points.select("rep", "v"), degree)
    flat = graph.select("a", F.explode("near").alias("x")).select("a", F.col("x.b").alias("b"), F.col("x.d").alias("d"))
    back = _best(flat.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"), degree).select("a", F.explode("near.b").alias("b"))
    links = scratch.written(flat.select("a", "b").union(back).distinct().groupBy("a").agg(F.collect_list("b").alias("to")), "nn-links")
    asked = scratch.written(vectors.where(is_query).distinct().join(points.select("rep", "v"), "v").select(F.col("vec_id").alias("query_id"), "rep", "v"), "nn-asked")
    asking = scratch.written(asked.groupBy(F.col("rep").alias("q")).agg(F.first("v").alias("qv")), "nn-asking")
    narrow = scratch.written(points.select(F.col("rep").alias("node"), F.col("v").cast("array<float>").alias("v")), "nn-narrow")
    width = points.agg(F.max(F.size("v"))).first()[0]
    # One row a query: its ``beam`` nearest nodes so far, nearest first, and which of them have been opened.
    state = asking.select("q", F.col("qv").cast("array<float>").alias("qv"), F.array("q").alias("node"), F.array(F.lit(0.0)).alias("d"), F.array(F.lit(False)).alias("opened"))
    while True:
        closed = F.filter(F.arrays_zip("node", "opened"), lambda s: ~s["opened"])
        state = scratch.written(state.withColumn("next", F.transform(F.slice(closed, 1, OPENED), lambda s: s["node"])), "nn-state")
        if state.where(F.size("next") > 0).isEmpty():
            break
        fresh = state.select("q", F.explode("next").alias("a")).join(links, "a").select("q", F.explode("to").alias("node")).distinct()
        state = _widened(state, fresh.join(narrow, "node").select(F.col("q").alias("of"), "node", "v"), width, beam)
    # The nearest anew, from the original vectors; twice as many as are wanted, as the beam's distances are those of rounded ones.
    best = state.select("q", F.explode(F.slice("node", 1, 2 * most)).alias("node")).join(asking, "q").join(points.select(F.col("rep").alias("node"), "v"), "node").select("q", "node", distance(F.col("v"), F.col("qv")).alias("d"))
    best = best.join(points.select(F.col("rep").alias("node"), "ids"), "node").groupBy("q").agg(F.slice(F.sort_array(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("d").alias("s"), i.alias("i")))))), 1, most).alias("best"))
    rest = F.slice(F.filter("best", lambda x: x["i"] != F.col("query_id")), 1, k)
    out = asked.select("query_id", F.col("rep").alias("q")).join(best, "q").select("query_id", F.posexplode(rest).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.i").alias("vec_id"), F.col("x.s").alias("score"))
