"""Whitening of embeddings along their leading covariance directions, found by Jacobi-Davidson without the matrix.

Vectors are taken on a lattice, x = floor(256 c) as longs; the fit list holds each distinct x once. The covariance V of
the fit list is never made: a product of V with a few vectors is one Spark job, in which each task centres its rows,
multiplies them twice and sends sums of width times the number of vectors; Spark adds these up.

The leading eigenpairs come from a subspace that grows. Rayleigh-Ritz on it gives approximate pairs. For those not yet
found, the correction equation (I - ZZ')(V - theta I)(I - ZZ') t = -r is solved roughly by a few steps of MINRES, all
pairs in step, so an inner step is one job too; Z holds the found vectors and the pair's own. The solutions extend the
subspace; beyond ``MOST_BASIS`` it starts again from its best vectors. A pair is locked, in the order of eigenvalues,
once its residual is at rounding level: ``TOLERANCE`` times the trace, or where it no longer falls below 1e-12 of it.

The driver holds some dozens of vectors of the embedding's width, never rows. The fit list is a written table, so a lost
executor costs the tasks it ran.

Defined cases: rows whose vector is null, empty, or holds null or a non-finite entry are dropped. Shorter vectors are
filled with zeros to the longest's width. Repeated rows are answered each; an id may be null or repeated. Directions
without variance (up to 1e-12 of the trace) have no whitened value and are left out, so one distinct vector, or equal
ones only, give no rows, as does an empty table. A deviation beyond a long is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import scratch
from millrace.llm.vectors import matrix

COMPONENTS, SCALE = 4, 256
#: Vectors beyond the wanted ones that the subspace starts with.
SPARE = 8
#: Inner steps of a correction equation, and the share of its right side at which it ends early.
INNER, INNER_TOLERANCE = 8, 1e-3
#: Vectors in the subspace before it starts again, and those it keeps then.
MOST_BASIS, KEPT_BASIS = 64, 20
#: A residual of this share of the trace is rounding.
TOLERANCE = 4 * np.finfo(float).eps
#: Rounds of the outer loop in which a residual that small may fail to fall before it counts as rounding.
PATIENCE, NEARLY = 3, 1e-12
MOST_ROUNDS = 500


def lattice(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> tuple[DataFrame, int]:
    """``vec_id`` and ``x``, the lattice vector as packed longs, of the valid rows; and the width."""
    v = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    good = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(finite & (F.size("v") > 0))
    width = good.agg(F.max(F.size("v"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scaled = np.clip(np.floor(scale * matrix(batch.column(1), width)), -(2.0**62), 2.0**62)
            x = np.ascontiguousarray(scaled.astype("<i8"))
            ends = np.arange(len(x) + 1, dtype=np.int32) * 8 * width
            packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["vec_id", "x"])

    return good.mapInArrow(run, "vec_id long, x binary"), width


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """Packed longs as a matrix."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], "<i8", (ends[-1] - ends[0]) // 8, ends[0]).reshape(-1, width) if len(column) else np.zeros((0, width), np.int64)


def summed(fit: DataFrame, width: int, length: int, part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> list:
    """The sum over all rows of what ``part`` makes of a block of them, an array of ``length``. Tasks add up their blocks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, float if kind == "double" else np.int64)
        for batch in batches:
            total += part(unpacked(batch.column(0), width))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length, dtype=np.int32)), pa.array(total)], names=["pos", "value"])

    value = F.sum("value" if kind == "double" else F.col("value").cast("decimal(38,0)"))
    rows = fit.mapInArrow(run, f"pos int, value {kind}").groupBy("pos").agg(value.alias("value")).collect()  # ``length`` rows
    out: list = [0] * length
    for r in rows:
        out[r["pos"]] = r["value"]
    return out


def orthonormal(v: np.ndarray, against: list[np.ndarray]) -> np.ndarray:
    """Columns that extend orthonormal ones; those that depend on the others go."""
    out = np.zeros((len(v), 0))
    for c in v.T:
        size = np.linalg.norm(c)
        for _ in range(3):
            for b in (*against, out):
                c = c - b @ (b.T @ c)
        left = np.linalg.norm(c)
        if size > 0 and left > 1e-10 * size:
            out = np.column_stack((out, c / left))
    return out


def minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int = INNER, tolerance: float = INNER_TOLERANCE) -> np.ndarray:
    """Approximate solutions of symmetric systems, one a column, each with the smallest residual over its Krylov space."""
    x, r = np.zeros_like(right), right.copy()
    aim = tolerance * np.linalg.norm(right, axis=0)
    ways: list[tuple[np.ndarray, np.ndarray]] = []  # the last directions and their images, the newest first
    way = right
    for step in range(steps):
        image = apply(way)
        for way_before, image_before in ways[:2]:
            length = (image_before**2).sum(0)
            share = np.divide((image * image_before).sum(0), length, out=np.zeros(len(length)), where=length > 0)
            way, image = way - share * way_before, image - share * image_before
        length = (image**2).sum(0)
        go = np.divide((r * image).sum(0), length, out=np.zeros(len(length)), where=length > 0)
        x, r = x + go * way, r - go * image
        if step + 1 == steps or (np.linalg.norm(r, axis=0) <= aim).all():
            break
        size = np.sqrt(length)
        size[size == 0] = 1
        ways = [(way / size, image / size), *ways]
        way = image / size
    return x


def leading(multiply: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, trace: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit vectors, of a symmetric operator known by its products."""
    wanted = min(wanted, width)
    found = np.zeros((width, 0))
    basis = orthonormal(np.random.default_rng(1).standard_normal((width, min(width, wanted + SPARE))), [])
    image = multiply(basis)
    lowest, stale = np.inf, 0
    for _ in range(MOST_ROUNDS):
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        missing = wanted - found.shape[1]
        r = image[:, :missing] - basis[:, :missing] * theta[:missing]
        r -= found @ (found.T @ r)
        size = np.linalg.norm(r, axis=0)
        stale = 0 if size[0] < 0.5 * lowest else stale + 1
        lowest = min(lowest, size[0])
        done = 0
        while done < missing and (size[done] <= TOLERANCE * trace or (done == 0 and stale >= PATIENCE and size[0] <= NEARLY * trace)):
            done += 1
        if done:  # lock, in order, and go on orthogonally to what is locked
            found = np.column_stack((found, orthonormal(basis[:, :done], [found])))
            basis, image = basis[:, done:], image[:, done:]
            image = image - found @ (found.T @ image)
            lowest, stale = np.inf, 0
            if found.shape[1] == wanted:
                break
            r, theta = r[:, done:], theta[done:]
        open_pairs = wanted - found.shape[1]
        own, shift = basis[:, :open_pairs], theta[:open_pairs]

        def off(v: np.ndarray) -> np.ndarray:
            v = v - found @ (found.T @ v)
            return v - own * (own * v).sum(0)  # noqa: B023

        solved = minres(lambda v: off(multiply(off(v)) - off(v) * shift), -off(r))  # noqa: B023
        if basis.shape[1] + open_pairs > MOST_BASIS:
            basis, image = basis[:, :KEPT_BASIS], image[:, :KEPT_BASIS]
        new = orthonormal(solved, [found, basis])
        if not new.shape[1]:
            new = orthonormal(np.random.default_rng(basis.shape[1]).standard_normal((width, 1)), [found, basis])
        if new.shape[1]:
            made = multiply(new)
            basis, image = np.column_stack((basis, new)), np.column_stack((image, made - found @ (found.T @ made)))
    else:
        raise RuntimeError(f"residual {lowest:.3g} after {MOST_ROUNDS} rounds, trace {trace:.3g}")
    small = found.T @ multiply(found)
    theta, turn = np.linalg.eigh((small + small.T) / 2)
    return theta[::-1], found @ turn[:, ::-1]


@dataclass
class Whitener:
    """What a fit has found: ``n`` distinct vectors, exact ``sums``, and the eigenpairs with variance."""

    width: int
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # whole numbers: rounded once


def fit(rows: DataFrame, width: int, components: int = COMPONENTS) -> Whitener:
    """From lattice vectors ``x`` (see ``lattice``)."""
    spark = rows.sparkSession
    folder = scratch.new_path(spark, "whitening")
    own = scratch.written(rows.select("x").distinct(), "fit", folder)
    n = own.count()
    if not n:
        return Whitener(width, 0, [0] * width, 0.0, np.zeros(0), np.zeros((width, 0)), 0.0)
    # Halves of the longs are added up apart, so that no task's sum can run over.
    halves = summed(own, width, 2 * width, lambda x: np.concatenate(((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0))), "long")
    sums = [int(high) * (1 << 32) + int(low) for high, low in zip(halves[:width], halves[width:], strict=True)]
    mean = np.array([s / n for s in sums])
    trace = summed(own, width, 1, lambda x: np.array([((x - mean) ** 2).sum()]))[0] / n
    if not trace > 0:
        scratch.remove(spark, folder)
        return Whitener(width, n, sums, 0.0, np.zeros(0), np.zeros((width, 0)), 0.0)

    def multiply(v: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            y = x - mean
            return (y.T @ (y @ v)).ravel()

        return np.array(summed(own, width, v.size, part)).reshape(v.shape) / n

    values, vectors = leading(multiply, width, components, trace)
    some = values > NEARLY * trace
    values, vectors = values[some], vectors[:, some]
    k, scaled = len(values), vectors / np.sqrt(values)
    middle = np.array(summed(own, width, k, lambda x: ((x - mean) @ scaled).sum(0))) / n

    def second(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ scaled - middle
        return (z.T @ z).ravel()

    covariance = np.array(summed(own, width, k * k, second)).reshape(k, k) / n
    scratch.remove(spark, folder)
    return Whitener(width, n, sums, trace, values, vectors, float(np.abs(covariance - np.eye(k)).max()) if k else 0.0)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n x - S)^2, in whole numbers; None beyond a long."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if len(sums) * most**2 < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [d if d < 1 << 63 else None for d in exact]


def whiten(rows: DataFrame, model: Whitener) -> DataFrame:
    """Per row of ``vec_id`` and ``x`` and per component: ``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    mean, scaled, explained, k = (model.mean, model.vectors / np.sqrt(model.values), model.values / model.trace, len(model.values)) if len(model.values) else (None, None, None, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not k or not batch.num_rows:
                continue
            x = unpacked(batch.column(1), model.width)
            rows = len(x)
            each = pa.array(np.repeat(np.arange(rows), k))
            columns = [
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.n)),
                pa.array(deviations(x, model.n, model.sums), pa.int64()).take(each), pa.array(((x - mean) @ scaled).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitened(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``whiten`` of all valid rows by a fit on their distinct lattice vectors."""
    x, width = lattice(rows, id_col, vec_col, scale)
    return whiten(x, fit(x, width, components))
