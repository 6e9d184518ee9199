"""Near duplicates by b-bit MinHash: packed low bits of the minima, candidates from bands, links confirmed on whole sets.

A document's set is its distinct word shingles; equal sets are one class. Of each class ``BANDS * ROWS`` minima are
taken, each under a hash function of its own. A band is ``ROWS`` of them; its key is one hash of their whole values. Of
each minimum only its ``BITS`` low bits are kept, packed in planes of 64 a long: plane p holds bit p of all minima.

* Classes that share a band's key are candidates. A key of up to ``FEW`` classes gives their pairs. Two packed
  signatures are compared by bit counts: a position agrees if it does in all planes. Unequal minima agree by chance in
  ``2 ** -BITS`` of the positions, so the similarity is estimated as (share - chance) / (1 - chance). A pair goes on
  unless its estimate is more than ``SPREAD`` standard errors below the bound.
* A key of more classes (large groups of near copies) gives no pairs: each of its classes is joined to the key's
  smallest one, so work grows with the members. What hangs together is a cluster.
* Clusters are verified on the whole sets, the larger ones in bounded shares, by the verification of ``jaccard_join``:
  links are exact, and none between different texts is left out unless a component implies it.

A pair at the bound itself shares no band with a chance of (1 - t ** ROWS) ** BANDS, 4e-9 for the values here, and the
estimate drops it with one of about 1e-10. Beyond that nothing is lost.

Defined cases: a null or empty text, or one without words, has no shingle and no link. Fewer words than the shingle's
length are one shingle, the whole sequence. Rows repeated under one id are one document and are answered once each; if
their texts differ, each has its own count of shingles and the document is linked by all of them. Rows without id are
linked with nothing and kept. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import scratch
from millrace.llm.common import give_back, texts_of
from millrace.llm.components import connected
from millrace.llm.jaccard_join import CLUSTER_ITEMS, _linked_large, _linked_small, _recut, _sets, _sized, class_of, mix, shingles

WORDS, NUMERATOR, DENOMINATOR = 2, 80, 100
#: Bands and minima in each; their product is a multiple of 64.
BANDS, ROWS = 64, 6
#: Low bits kept of each minimum.
BITS = 2
#: A key of more classes than this gives no pairs.
FEW = 8
#: Standard errors below the bound from which an estimate drops a pair.
SPREAD = 6.5
#: Classes that a task remembers having signed.
REMEMBERED = 200_000
#: Shingles hashed at a time: with all functions they fit a core's cache.
RUN = 512

_rng = np.random.default_rng(20)
FACTORS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
SUMMANDS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the set's shingles."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(FACTORS), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), RUN):
        made = np.multiply.outer(FACTORS, x[i : i + RUN])
        made += SUMMANDS[:, None]
        np.minimum(out, made.min(axis=1), out=out)
    return out


def band_keys(low: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash of each band's minima."""
    rows = low.astype(np.uint64).reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for r in rows.T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + r)
    return key


def packed(low: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of the minima in planes of longs. Minima are scrambled first, so that unequal ones differ by chance."""
    mixed = mix(low.astype(np.uint64))
    planes = [np.packbits((mixed >> np.uint64(p) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<u8") for p in range(bits)]
    return np.concatenate(planes)


def similarity(a: Column, b: Column, minima_count: int = BANDS * ROWS, bits: int = BITS) -> Column:
    """The estimate from two packed signatures, corrected for chance agreement."""
    longs = minima_count // 64
    differ = [reduce(Column.bitwiseOR, [F.get(a, F.lit(p * longs + i)).bitwiseXOR(F.get(b, F.lit(p * longs + i))) for p in range(bits)]) for i in range(longs)]
    share = 1 - reduce(Column.__add__, map(F.bit_count, differ)) / F.lit(minima_count)
    chance = 2.0**-bits
    return (share - chance) / (1 - chance)


def least_estimate(numerator: int = NUMERATOR, denominator: int = DENOMINATOR, minima_count: int = BANDS * ROWS, bits: int = BITS, spread: float = SPREAD) -> float:
    """The estimate below which a pair that is linked practically never falls."""
    chance = 2.0**-bits
    share = chance + (1 - chance) * numerator / denominator
    return numerator / denominator - spread * (share * (1 - share) / minima_count) ** 0.5 / (1 - chance)


def signed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per row: ``doc_id``, ``n`` shingles, ``h1``, the name of its class, and where a task meets a class first ``sig`` and ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            names, sizes, sigs, keys = [], [], [], []
            for text in texts_of(batch):
                s = shingles(text, words)
                h1 = class_of(s)
                names.append(h1)
                sizes.append(len(s))
                if not len(s) or h1 in known:
                    sigs.append(None)
                    keys.append(None)
                    continue
                if len(known) >= REMEMBERED:
                    known.clear()
                known.add(h1)
                low = minima(s)
                sigs.append(packed(low).view(np.int64))
                keys.append(np.unique(band_keys(low)).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(sigs, longs), pa.array(keys, longs)], names=["doc_id", "n", "h1", "sig", "keys"])
        give_back()

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, sig array<long>, keys array<long>")


def candidates(classes: DataFrame, folder: str, few: int = FEW, least: float | None = None) -> tuple[DataFrame, DataFrame]:
    """From ``h1``, ``sig``, ``keys``: pairs ``a``, ``b`` whose estimate is high enough, and spokes ``a``, ``b`` to common keys' smallest classes."""
    bands = scratch.written(classes.select("h1", F.explode("keys").alias("key")), "bands", folder)
    # The counts are a table of their own, so that Spark can split a key that many classes have in the join.
    sizes = bands.groupBy("key").agg(F.count("*").alias("size"), F.min("h1").alias("centre")).where("size > 1")
    met = scratch.written(bands.join(scratch.written(sizes, "sizes", folder), "key"), "met", folder)
    spokes = met.where(F.col("size") > few).select(F.col("h1").alias("a"), F.col("centre").alias("b")).distinct()
    groups = met.where(F.col("size") <= few).groupBy("key").agg(F.sort_array(F.collect_list("h1")).alias("x"))  # at most ``few``
    both = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = groups.select(F.explode(both).alias("p")).select("p.*").distinct()
    sig = lambda c: classes.select(F.col("h1").alias(c), F.col("sig").alias(f"sig_{c}"))
    near = pairs.join(sig("a"), "a").join(sig("b"), "b").where(similarity(F.col("sig_a"), F.col("sig_b")) >= (least_estimate() if least is None else least))
    return near.select("a", "b"), spokes


def near_duplicates(docs: DataFrame, words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, id_col: str = "doc_id", text_col: str = "text", few: int = FEW, most_items: int = CLUSTER_ITEMS) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles``, ``component_id``, the smallest id reachable by links, and ``kept``, whether it is that one.

    Two documents are linked when ``denominator`` times their common shingles are at least ``numerator`` times the union.
    The bands are made for bounds of about 0.8 and more.
    """
    spark = docs.sparkSession
    folder, kept = scratch.new_path(spark, "minhash"), scratch.new_path(spark, "minhash-result")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = scratch.written(signed(docs, words), "signed", kept)
    named = sets.where("n > 0 and doc_id is not null")
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    classes = named.groupBy("h1").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.first("n").alias("n"), first("sig"), first("keys"))
    classes = scratch.written(classes, "classes", folder)

    pairs, spokes = candidates(classes, folder, few, least_estimate(numerator, denominator))
    centre = F.xxhash64(F.lit("centre"), "b").alias("b")
    clusters = connected(pairs.union(spokes.select("a", centre)), folder).select("id", F.col("label").alias("cluster"))
    members = scratch.written(clusters.join(classes.select(F.col("h1").alias("id"), "rep", "n"), "id"), "members", folder)
    made = _sets(_sized(members, folder), docs, words, folder)
    edges = _linked_small(made, most_items, numerator, denominator, folder)
    large = made.where(F.col("total") > most_items).drop("cluster", "total")
    if not large.isEmpty():
        large = scratch.written(large.dropDuplicates(["id"]), "large", folder)
        recut = _sized(large.select("id", "n").join(_recut(large, numerator, denominator, folder), "id"), folder)
        recut = scratch.written(recut.join(large.select("id", "items"), "id"), "recut", folder)
        edges = edges.union(_linked_small(recut, most_items, numerator, denominator, folder))
        large = recut.where(F.col("total") > most_items).drop("total")
        if not large.isEmpty():
            edges = edges.union(_linked_large(large, most_items, numerator, denominator, folder))

    # Different texts under one id link their sets; then each class has the smallest document of its component.
    several = named.groupBy("doc_id").agg(F.min("h1").alias("a"), F.max("h1").alias("z")).where("a < z")
    more = named.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("h1").alias("b"))
    labels = connected(edges.union(more), folder)
    held = classes.select("h1", "rep", "last").join(labels, classes["h1"] == labels["id"], "left").where("label is not null or rep < last")
    roots = held.where("label is not null").groupBy("label").agg(F.min("rep").alias("root"))
    linked = held.join(roots, "label", "left").select(F.col("h1").alias("of"), F.coalesce("root", "rep").alias("root"))
    linked = scratch.written(linked, "roots", kept)
    scratch.remove(spark, folder)
    out = sets.select("doc_id", "n", "h1").join(linked, F.col("h1") == F.col("of"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
