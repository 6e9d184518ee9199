"""Exact top-k inner products by dual-tree search over cover trees.

Equal vectors are one point with their smallest ids. Data points and query points are dealt to cells around a bounded
number of pivots and cut into bounded blocks. Query blocks meet the data of their own cell first, and take the kth
scores that they find there along. Then each query block's ball is held against the balls of all data blocks, in slices:
a pair of blocks whose radii allow no score up to the block's worst kth score is left out before any vector moves. A
pair that is left is a task, which builds a cover tree over either side and walks both together: a pair of nodes is left
out when the largest inner product that their covering radii allow is below the worst kth score in the query node.

In a tree each node covers its points with a ball; its children are centres that lie more than a child's radius apart,
which is the node's radius divided by ``BASE``, however many that takes. A point that no other is near to is a leaf of
its own. The bounds of all children of two nodes are one matrix product, and for two single points the bound is the score.

Defined cases: invalid vectors (null, empty, or with null or non-finite components) take no part. Shorter vectors are
filled up with zeros. Rows repeated under one id count once if the vectors are equal; an id with several vectors is
searched for by each, and is found at each. Ties go to the smaller id; a query's own row is no candidate, an equal vector
under another id is. With fewer than k candidates all are returned; without queries or candidates there are no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import scratch
from millrace.llm.vectors import cells, distinct_vectors, matrix, most_own, valid

K, BASE, LEAF = 20, 2.0, 16
DATA_BLOCK, QUERY_BLOCK = 2048, 2048
#: Data blocks' balls that one task holds against query blocks.
SLICE = 4096
#: Pivots of cells at most (one vector each goes through the driver).
PIVOTS = 1024


@dataclass
class Node:
    center: np.ndarray
    radius: float
    rows: np.ndarray
    children: list["Node"] = field(default_factory=list)
    worst: float = -np.inf  # of a query node: the smallest kth score of its points
    #: Of the children: centres, their lengths, and radii.
    centers: np.ndarray | None = None
    norms: np.ndarray | None = None
    radii: np.ndarray | None = None


def _node(points: np.ndarray, rows: np.ndarray, center: np.ndarray) -> Node:
    return Node(center, float(np.sqrt(((points[rows] - center) ** 2).sum(1).max())), rows)


def cover_tree(points: np.ndarray) -> Node:
    """A tree over all rows of ``points``: children's centres are points, no two of them within the child's radius of each other."""
    root = _node(points, np.arange(len(points)), points.mean(0))
    # Distances of all pairs, rounded: they choose centres and owners only, radii are made from the points. Blocks are bounded.
    x = points.astype(np.float32)
    length = (x**2).sum(1)
    apart = length[:, None] - 2 * (x @ x.T) + length
    todo = [root]
    while todo:
        node = todo.pop()
        if len(node.rows) <= LEAF or node.radius == 0:
            continue
        own, reach = apart if node is root else apart[np.ix_(node.rows, node.rows)], np.float32((node.radius / BASE) ** 2)
        near, owner, left = np.full(len(own), np.inf, np.float32), np.zeros(len(own), np.int64), np.ones(len(own), bool)
        count = 0
        while left.any():  # the next centre is a point that no centre covers yet; points go to their nearest centre
            at = int(left.argmax())
            d = own[at]
            closer = d < near
            near[closer], owner[closer] = d[closer], count
            left &= d > reach
            left[at] = False
            count += 1
        order = np.argsort(owner, kind="stable")
        for part in np.split(node.rows[order], np.cumsum(np.bincount(owner, minlength=count))[:-1]):
            if len(part):
                node.children.append(_node(points, part, points[part].mean(0) if len(part) > 1 else points[part[0]]))
        if len(node.children) == 1:  # cannot happen with a radius above 0, but would not end
            node.children = [_node(points, node.rows[k : k + 1], points[node.rows[k]]) for k in range(len(node.rows))]
        node.centers = np.stack([c.center for c in node.children])
        node.norms, node.radii = np.sqrt((node.centers**2).sum(1)), np.array([c.radius for c in node.children])
        todo += [c for c in node.children if len(c.rows) > LEAF]
    return root


def bounds(q: np.ndarray, q_norm: np.ndarray, q_radius: np.ndarray, d: np.ndarray, d_norm: np.ndarray, d_radius: np.ndarray) -> np.ndarray:
    """No two points of a row's ball and a column's ball have a larger inner product."""
    most = q @ d.T + q_radius[:, None] * d_norm + q_norm[:, None] * d_radius + q_radius[:, None] * d_radius
    return most + 1e-9 * (1 + np.abs(most))


class Best:
    """The k best (score, row) of each query, kept sorted: larger score first, smaller rep among equals."""

    def __init__(self, count: int, k: int, floor: np.ndarray) -> None:
        self.k = k
        self.score = [np.zeros(0, np.int64)] * count
        self.row = [np.zeros(0, np.int64)] * count
        self.floor = floor.astype(float)  # what must be reached at least

    def offer(self, queries: np.ndarray, rows: np.ndarray, scores: np.ndarray, reps: np.ndarray) -> None:
        for i in np.flatnonzero((scores >= self.floor[queries][:, None]).any(1)):
            q = queries[i]
            take = np.flatnonzero(scores[i] >= self.floor[q])
            s, r = np.concatenate((self.score[q], scores[i][take])), np.concatenate((self.row[q], rows[take]))
            if len(s) > 4 * self.k:  # only what reaches the kth score needs sorting
                cut = np.partition(s, len(s) - self.k)[len(s) - self.k]
                s, r = s[s >= cut], r[s >= cut]
            order = np.lexsort((reps[r], -s))[: self.k]
            self.score[q], self.row[q] = s[order], r[order]
            if len(order) == self.k:
                self.floor[q] = max(self.floor[q], s[order[-1]])


@dataclass
class Counts:
    """What a search did: pairs of points scored, pairs of points in pairs of nodes that were left out."""

    scored: int = 0
    pruned: int = 0


def dual_search(queries: np.ndarray, data: np.ndarray, reps: np.ndarray, k: int, floor: np.ndarray, counts: Counts | None = None) -> Best:
    """The best k data rows of each query, as far as they reach the query's floor. Both are whole numbers."""
    best, counts = Best(len(queries), k, floor), counts or Counts()
    if not len(queries) or not len(data):
        return best
    big = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * queries.shape[1] >= 2**53
    exact_q, exact_d = (queries, data) if big else (queries.astype(float), data.astype(float))
    q_root, d_root = cover_tree(queries.astype(float)), cover_tree(data.astype(float))

    def parts(node: Node) -> tuple[list[Node], np.ndarray, np.ndarray, np.ndarray]:
        if node.children:
            return node.children, node.centers, node.norms, node.radii
        return [node], node.center[None], np.sqrt(node.center @ node.center)[None], np.array([node.radius])

    def score(q: np.ndarray, d: np.ndarray) -> None:
        counts.scored += len(q) * len(d)
        for a in range(0, len(d), 2048):
            rows = d[a : a + 2048]
            best.offer(q, rows, (exact_q[q] @ exact_d[rows].T).astype(np.int64), reps)

    def walk(q: Node, d: Node) -> None:
        if not q.children and not d.children:
            score(q.rows, d.rows)
            q.worst = float(best.floor[q.rows].min())
            return
        q_nodes, *q_balls = parts(q)
        d_nodes, *d_balls = parts(d)
        most = bounds(*q_balls, *d_balls)
        leaf_q, leaf_d = (np.flatnonzero([not n.children for n in side]) for side in (q_nodes, d_nodes))
        worst = np.array([n.worst for n in q_nodes])
        if len(leaf_q) and len(leaf_d):  # leaves of both sides: one product of what any of them can use
            used = (most[np.ix_(leaf_q, leaf_d)] >= worst[leaf_q][:, None]).any(0)
            q_rows = np.concatenate([q_nodes[i].rows for i in leaf_q])
            counts.pruned += len(q_rows) * sum(len(d_nodes[j].rows) for j in leaf_d[~used])
            if used.any():
                score(q_rows, np.concatenate([d_nodes[j].rows for j in leaf_d[used]]))
                for i in leaf_q:
                    q_nodes[i].worst = float(best.floor[q_nodes[i].rows].min())
        for i in np.argsort(-most.max(1)):
            below = q_nodes[i]
            for j in np.argsort(-most[i]):
                if not below.children and not d_nodes[j].children:
                    continue
                if most[i, j] < below.worst:
                    counts.pruned += len(below.rows) * len(d_nodes[j].rows)
                else:
                    walk(below, d_nodes[j])
        q.worst = min(n.worst for n in q_nodes)

    def settle(q: Node) -> float:
        q.worst = min(map(settle, q.children)) if q.children else float(best.floor[q.rows].min())
        return q.worst

    settle(q_root)
    first = bounds(*parts(Node(q_root.center, q_root.radius, q_root.rows))[1:], *parts(Node(d_root.center, d_root.radius, d_root.rows))[1:])[0, 0]
    if first < q_root.worst:
        counts.pruned += len(queries) * len(data)
    else:
        walk(q_root, d_root)
    return best


def in_blocks(table: DataFrame, size: int, folder: str, name: str) -> DataFrame:
    """``table`` (``cell``, ``rep`` and more) with ``block``: a cell, or one of as many parts of it as keep to about ``size`` rows. Written."""
    sizes = table.groupBy("cell").agg(F.count("*").alias("n"))  # a row a pivot
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / size)).cast("long")
    return scratch.written(table.join(F.broadcast(sizes), "cell").withColumn("block", F.col("cell").cast("long") * (1 << 32) + part).drop("n"), name, folder)


def balls(table: DataFrame, width: int, worst: str | None = None) -> DataFrame:
    """Each block's ``cell``, ball (``center``, ``radius``) and the smallest of ``worst`` in it."""

    def run(block: pa.Table) -> pa.Table:
        x = matrix(block.column("v"), width).astype(float)
        center = x.mean(0)
        found = {"block": block.column("block").slice(0, 1), "cell": block.column("cell").slice(0, 1), "center": pa.array([center], pa.list_(pa.float64())), "radius": pa.array([float(np.sqrt(((x - center) ** 2).sum(1).max()))])}
        return pa.table(found | {"worst": pa.array([float(block.column(worst).to_numpy().min()) if worst else -np.inf])})

    return table.select("block", "cell", "v", *([worst] if worst else [])).groupBy("block").applyInArrow(run, "block long, cell int, center array<double>, radius double, worst double")


def near_blocks(asking: DataFrame, held: DataFrame, slices: int) -> DataFrame:
    """``q_block`` and ``d_block`` of other cells whose balls allow a score up to the query block's worst. Both as ``balls`` gives them."""
    left = asking.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).toDF("q_block", "q_cell", "q_center", "q_radius", "worst", "slice")
    right = held.drop("worst").withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int")).toDF("d_block", "d_cell", "d_center", "d_radius", "at")

    def run(q: pa.Table, d: pa.Table) -> pa.Table:
        if not q.num_rows or not d.num_rows:
            return pa.table({"q_block": pa.array([], pa.int64()), "d_block": pa.array([], pa.int64())})
        x, y = matrix(q.column("q_center")), matrix(d.column("d_center"))
        most = bounds(x, np.sqrt((x**2).sum(1)), q.column("q_radius").to_numpy(), y, np.sqrt((y**2).sum(1)), d.column("d_radius").to_numpy())
        other = q.column("q_cell").to_numpy()[:, None] != d.column("d_cell").to_numpy()
        i, j = np.nonzero((most >= q.column("worst").to_numpy()[:, None]) & other)
        return pa.table({"q_block": q.column("q_block").to_numpy()[i], "d_block": d.column("d_block").to_numpy()[j]})

    return left.groupBy("slice").cogroup(right.groupBy("at")).applyInArrow(run, "q_block long, d_block long")


def top_inner(rows: DataFrame, is_query: Column, scale: float = 64.0, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k largest inner products of floor(scale * x) vectors.

    ``is_query`` is a condition on ``vec_id``.
    """
    spark = rows.sparkSession
    folder, kept = scratch.new_path(spark, "topk"), scratch.new_path(spark, "topk-result")
    whole = lambda x: F.floor(x * F.lit(scale)).cast("long")
    points = valid(rows, id_col, vec_col).select("vec_id", F.transform("v", whole).alias("v"))
    most = k + most_own(points.where(is_query))  # a list may hold the query's own vectors besides
    table = scratch.written(distinct_vectors(points, most), "vectors", folder)
    count, width = table.agg(F.count("*"), F.max(F.size("v"))).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    data = in_blocks(cells(table, min(PIVOTS, -(-count // DATA_BLOCK)), width), DATA_BLOCK, folder, "data")
    asked = scratch.written(points.where(is_query).distinct().join(data.select("rep", "v", "cell"), "v").select(F.col("vec_id").alias("query_id"), "rep", "cell", "v"), "asked", kept)
    queries = in_blocks(asked.groupBy("rep").agg(F.first("cell").alias("cell"), F.first("v").alias("v")), QUERY_BLOCK, folder, "queries")

    groups = -(-queries.count() // QUERY_BLOCK) or 1

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query": [], "score": [], "ids": []}
        if left.num_rows and right.num_rows:
            q, d = matrix(left.column("v"), width), matrix(right.column("d_v"), width)
            ids = right.column("d_ids").combine_chunks()
            smallest = ids.flatten().to_numpy()[(ids.offsets.to_numpy() - ids.offsets[0].as_py())[:-1]]  # breaks ties
            best = dual_search(q, d, smallest, most, left.column("floor").to_numpy())
            sizes = [len(r) for r in best.row]
            at = np.concatenate(best.row) if sizes else np.zeros(0, np.int64)
            out["query"] = np.repeat(left.column("rep").to_numpy(), sizes)
            out["score"] = np.concatenate(best.score) if sizes else at
            out["ids"] = ids.take(pa.array(at))
        return pa.table({"query": pa.array(out["query"], pa.int64()), "score": pa.array(out["score"], pa.int64()), "ids": pa.array(out["ids"], pa.list_(pa.int64()))})

    def meet(left: DataFrame, pairs: DataFrame) -> DataFrame:
        """The query blocks against the data blocks that ``pairs`` (q_block, d_block) names: small query blocks together, so that a data block's tree is made seldom."""
        pairs = pairs.withColumn("q_group", F.pmod(F.xxhash64("q_block"), F.lit(groups)).cast("int"))
        sent = left.join(pairs, F.col("block") == F.col("q_block")).select("rep", "v", "floor", "q_group", "d_block")
        there = data.join(pairs.select(F.col("q_group").alias("to_q"), F.col("d_block").alias("to_d")).distinct(), F.col("block") == F.col("to_d")).select("to_q", "to_d", F.col("ids").alias("d_ids"), F.col("v").alias("d_v"))
        return sent.groupBy("q_group", "d_block").cogroup(there.groupBy("to_q", "to_d")).applyInArrow(search, "query long, score long, ids array<long>")

    cell_of = lambda t, name: t.select("cell", F.col("block").alias(name)).distinct()
    own = cell_of(queries, "q_block").join(cell_of(data, "d_block"), "cell").select("q_block", "d_block")
    first = scratch.written(meet(queries.withColumn("floor", F.lit(float("-inf"))), own), "own", kept)
    kth = first.groupBy("query").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("query", F.get("s", F.lit(most - 1)).cast("double").alias("known"))
    more = scratch.written(queries.join(kth, F.col("rep") == F.col("query"), "left").withColumn("floor", F.coalesce("known", F.lit(float("-inf")))).drop("known", "query"), "more", folder)
    held = scratch.written(balls(data, width), "balls", folder)
    pairs = scratch.written(near_blocks(balls(more, width, "floor"), held, -(-held.count() // SLICE)), "pairs", folder)
    found = first.union(scratch.written(meet(more, pairs), "others", kept))
    # Of each query point the ``most`` best by score and smallest id; then each query leaves itself out.
    by_point = found.groupBy("query").agg(F.slice(F.sort_array(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("i")))))), 1, most).alias("best"))
    out = asked.select("query_id", "rep").join(by_point, F.col("rep") == F.col("query"))
    scratch.remove(spark, folder)
    rest = F.slice(F.filter("best", lambda x: x["i"] != F.col("query_id")), 1, k)
    return out.select("query_id", F.posexplode(rest).alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))
