"""N-gram Jaccard join by PartEnum signatures, exact, down to the classes of linked documents.

A document's set is its distinct word shingles; equal sets are one class. Two sets with similarity of at least t differ
in at most (1-t)/(1+t) of the sum of their sizes. Sizes are cut into bands that double; a set takes part in its own band
and, where a larger partner may lie there, in the next. In a band the domain of all shingles is cut by a hash into first
partitions, and each of these into second ones. Of the second partitions of each first one all subsets that leave
``spared`` of them out are enumerated, and what the set holds in a subset is a signature. The differences of a similar
pair can put more than ``spared`` of them into a bounded number of first partitions only; in each other one some subset
is untouched and gives both sets the same signature.

* An empty subset gives no signature. A first partition is sound for a set if each subset of it holds something. Sets
  with too few sound ones for the guarantee take part with single shingles too, where it always holds.
* Signatures of few classes give pairs. A similar pair agrees in at least (sound - spoilt - common signatures) of them,
  so only pairs that reach that count are candidates.
* Common signatures (more than ``FEW`` classes: shared passages, large groups of near copies) give no pairs. A set that
  keeps enough sound partitions without them loses nothing by that. The others are joined to their common signatures'
  centres: two of them that share one are in one cluster.
* Candidates' clusters are verified on the whole sets. Clusters of bounded size are compared in tasks, many in each, by
  a prefix filter that takes a cluster's rarest shingles first. Larger ones are cut anew by the same filter over all
  their sets, which takes apart what only a passage holds together. In one that stays large hubs meet all others first,
  in tasks of bounded shares; then what is outside the largest component meets all others, in blocks against shares.
  Links that components imply are not counted again. No cap, no sample: every link between different texts is found or implied.

Signatures travel as numpy blocks in one shuffle, dealt by hash to as many buckets as the input's bytes call for. What a
task holds of one signature beyond ``FEW`` classes stays out of it: those classes go to the centre directly, so no
bucket grows with a group of copies.

Defined cases: a null or empty text, or one without words, has no shingle and no link. Fewer words than the shingle's
length are one shingle, the whole sequence. Rows repeated under one id are one document and are answered once each. If
their texts differ, each row has its own count of shingles, and the document is linked by all of its texts (a row without
words stays alone). Rows without id are linked with nothing. Other columns are ignored. An empty table gives no rows. Shingles and sets are told apart by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace import scratch
from millrace.llm.common import give_back, texts_of
from millrace.llm.components import connected

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
#: A signature of more classes than this is common.
FEW = 8
#: Shingles of the sets that a task compares at a time; larger clusters are compared by hubs and in blocks.
CLUSTER_ITEMS = 250_000
#: Hubs of each large cluster in the rounds before its blocks.
HUBS = (1, 16)
#: Sets whose names are broadcast to pick documents (40 bytes each); more are joined by a shuffle.
MOST_BROADCAST_IDS = 200_000
#: Signatures in a bucket, and signatures made of a byte of text, for the number of buckets.
BUCKET_ROWS, ROWS_A_BYTE = 1_600_000, 0.17
#: Signatures that a task gathers before it deals them to buckets.
FLUSH = 1 << 19
SALT = 0x01E3779B97F4A7C1  # times 64 it still is a signed 64-bit number
SINGLES, COMMON = 63, 128  # the band of single shingles; the mark of a signature that a task has found common

_words: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    known = _words
    if len(known) > 100_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles. ASCII letters count as lower case; blanks are ASCII white space."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h, k = word_hashes(parts), min(words, len(parts))
    out = np.full(len(parts) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(parts) - k + 1 + i])
    return np.unique(out)


def class_of(s: np.ndarray) -> int:
    """The name of a set: one hash of all its shingles."""
    return int(mix(np.array([int(mix(s).sum(dtype=np.uint64)) ^ len(s)], np.uint64))[0]) if len(s) else 0


def most_different(size: int, partner: int, numerator: int, denominator: int) -> int:
    """Shingles in which a similar pair of such sizes can differ at most."""
    return (size + partner) * (denominator - numerator) // (denominator + numerator)


@cache
def plan(band: int, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> tuple[int, int, int, np.ndarray]:
    """A band's first partitions, second partitions of each, how many of those a subset leaves out, and the subsets as rows of marks.

    Few differences need one first partition only. Beyond that each one bears a single difference, and there are so many
    that the sound ones outnumber those that the band's largest sets can spoil.
    """
    largest = (2 << band) - 1
    most = most_different(largest, largest, numerator, denominator)
    if most <= 4:
        first, second, spared = 1, most + (3 if most <= 2 else 2) if most else 1, most
    else:
        first, second, spared = int(0.56 * most) + 4, 3, 1
    marks = np.zeros((len(chosen := list(combinations(range(second), second - spared))), second), bool)
    for row, subset in enumerate(chosen):
        marks[row, list(subset)] = True
    return first, second, spared, marks


def signatures(hashes: np.ndarray, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> tuple[list[tuple[int, int, int]], list[np.ndarray]]:
    """The bands a set takes part in, as (band, sound first partitions, how many a similar pair can spoil), and each one's signatures."""
    size = len(hashes)
    band, widest = size.bit_length() - 1, size * denominator // numerator
    bands, made, short = [], [], False
    scrambled = np.sort(mix(hashes))
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(scrambled), dtype=np.uint64)))
    for j in range(band, widest.bit_length()):
        first, second, spared, subsets = plan(j, numerator, denominator)
        most = most_different(size, min(widest, (2 << j) - 1), numerator, denominator)
        # A second partition is a run of the scrambled hashes, so what it holds is a sum over a run.
        part = (scrambled >> np.uint64(32)) * np.uint64(first * second) >> np.uint64(32)
        edge = np.searchsorted(part, np.arange(first * second + 1, dtype=np.uint64))
        filled = (np.diff(edge) > 0).reshape(first, second)
        held = (upto[edge[1:]] - upto[edge[:-1]]).reshape(first, second)
        some = filled @ subsets.T
        content = (held @ subsets.T.astype(np.uint64))[some]
        made.append(np.unique(mix(content * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j))))
        sound = int((filled.sum(1) > (spared if first > 1 else min(spared, most))).sum())
        spoilt = most // (spared + 1) if first > 1 else 0
        bands.append((j, sound, spoilt))
        short |= sound <= spoilt
    if short:
        made.append(mix(hashes + np.uint64(SINGLES)))
        bands.append((SINGLES, size, size - -(-numerator * size // denominator)))
    return bands, made


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins, in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    new[:1] = True
    return np.flatnonzero(new)


def counted(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows and how often each occurs."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    first = _runs(*columns)
    return [c[first] for c in columns], np.diff(np.append(first, len(columns[0])))


_OUT = "kind int, a long, b long, n long, doc_id long, bands array<struct<j:int,sound:int,spoilt:int>>"
_SENT = f"bucket int, block binary, {_OUT}"
_BANDS = pa.list_(pa.struct([("j", pa.int32()), ("sound", pa.int32()), ("spoilt", pa.int32())]))
PAIR, COUNT, SPOKE, BRIDGE, SET = range(5)


def in_band(h1: np.ndarray, band: np.ndarray) -> np.ndarray:
    """A class's name in a band. ``key_of`` makes the same of columns."""
    return h1 ^ (band.astype(np.uint64) + np.uint64(1)) * np.uint64(SALT)


def key_of(h1: Column, band: Column) -> Column:
    return h1.bitwiseXOR((band + 1).cast("long") * F.lit(SALT))


def _rows(kind: int, a, b, n) -> dict[str, pa.Array]:
    signed = lambda x: pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))
    size = len(a)
    return {"kind": pa.array(np.full(size, kind, np.int32)), "a": signed(a), "b": signed(b), "n": pa.array(np.asarray(n).astype(np.int64)), "doc_id": pa.nulls(size, pa.int64()), "bands": pa.nulls(size, _BANDS)}


def _to_centres(sig: np.ndarray, h1: np.ndarray, band: np.ndarray) -> list[dict[str, pa.Array]]:
    """Common signatures' members (sorted by signature, then class): how many each class has, and spokes to the smallest class."""
    first = _runs(sig)
    centre = np.repeat(h1[first], np.diff(np.append(first, len(sig))))
    key = in_band(h1, band)
    (a,), n = counted(key)
    (x, y), _ = counted(key, centre)
    return [_rows(COUNT, a, np.zeros(len(a)), n), _rows(SPOKE, x, y, np.zeros(len(x)))]


def _map_pass(docs: DataFrame, buckets: int, words: int, numerator: int, denominator: int, few: int) -> DataFrame:
    """Of each document a row for its set, and of each new class its signatures, in blocks dealt to buckets."""

    def sent(bucket: pa.Array, block: pa.Array, rows: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"bucket": bucket, "block": block, **rows})

    def flush(rows: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        sizes = [len(r[2]) for r in rows]
        sig = np.concatenate([r[2] for r in rows])
        h1, band = np.repeat(np.array([r[0] for r in rows], np.uint64), sizes), np.repeat(np.array([r[1] for r in rows], np.uint8), sizes)
        order = np.lexsort((h1, sig))
        sig, h1, band = sig[order], h1[order], band[order]
        first = _runs(sig)
        size = np.diff(np.append(first, len(sig)))
        hot = np.repeat(size > few, size)
        if hot.any():  # the centre stands for all of them in the bucket, marked; the others are counted here
            rest = hot.copy()
            rest[first] = False
            (a,), n = counted(in_band(h1[rest], band[rest]))
            for part in (_rows(COUNT, a, np.zeros(len(a)), n), _to_centres(sig[hot], h1[hot], band[hot])[1]):
                n = len(part["a"])
                yield sent(pa.array((part["a"].to_numpy() % buckets).astype(np.int32)), pa.nulls(n, pa.binary()), part)
            band = band.copy()
            band[first[size > few]] |= COMMON
            sig, h1, band = sig[~rest], h1[~rest], band[~rest]
        bucket = ((sig >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        low, h1, band, bucket = (sig & np.uint64(0xFFFFFFFF)).astype("<u4")[order], h1[order], band[order], bucket[order]
        first = _runs(bucket)
        blocks = []
        for a, b in zip(first, [*first[1:], len(bucket)], strict=True):
            classes, index = np.unique(h1[a:b], return_inverse=True)
            blocks.append(len(classes).to_bytes(4, "little") + classes.astype("<u8").tobytes() + low[a:b].tobytes() + index.astype("<u2" if len(classes) < 1 << 16 else "<u4").tobytes() + band[a:b].tobytes())
        yield sent(pa.array(bucket[first].astype(np.int32)), pa.array(blocks, pa.binary()), {k: pa.nulls(len(blocks), v.type) for k, v in _rows(0, *[np.zeros(0)] * 3).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        rows, waiting = [], 0
        for batch in batches:
            ids = batch.column(0)
            names, sizes, all_bands = [], [], []
            for text in texts_of(batch):
                s = shingles(text, words)
                h1 = class_of(s)
                bands, made = signatures(s, numerator, denominator) if len(s) else ([], [])
                names.append(h1)
                sizes.append(len(s))
                all_bands.append([{"j": j, "sound": m, "spoilt": k} for j, m, k in bands])
                if not len(s) or h1 in known:
                    continue
                if len(known) > 200_000:
                    known.clear()
                known.add(h1)
                rows += [(h1, b[0], m) for b, m in zip(bands, made, strict=True)]
                waiting += sum(map(len, made))
                if waiting > FLUSH:
                    yield from flush(rows)
                    rows, waiting = [], 0
            own = _rows(SET, np.array(names, np.uint64), np.zeros(len(names)), np.array(sizes, np.int64))
            own |= {"doc_id": ids, "bands": pa.array(all_bands, _BANDS)}
            yield sent(pa.array((np.arange(len(names)) % buckets).astype(np.int32)), pa.nulls(len(names), pa.binary()), own)
        yield from flush(rows)
        give_back()

    return docs.mapInArrow(run, _SENT)


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Low signature halves, classes and bands of a block."""
    n = int.from_bytes(block[:4], "little")
    classes, at = np.frombuffer(block, "<u8", n, 4), 4 + 8 * n
    wide = 2 if n < 1 << 16 else 4
    rows = (len(block) - at) // (5 + wide)
    low = np.frombuffer(block, "<u4", rows, at)
    index = np.frombuffer(block, f"<u{wide}", rows, at + 4 * rows)
    return low, classes[index], np.frombuffer(block, np.uint8, rows, at + (4 + wide) * rows)


def _bucket_pass(sent: DataFrame, few: int) -> DataFrame:
    """Of each bucket: counted pairs of classes, counts and spokes of common signatures, and the sets' rows as they came."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        through = table.filter(pa.compute.is_null(table.column("block"))).select(["kind", "a", "b", "n", "doc_id", "bands"])
        found = [unpack(x.as_py()) for x in table.column("block").drop_null().combine_chunks()]
        del table
        if not found:
            return through
        low, h1, band = (np.concatenate([f[i] for f in found]) for i in range(3))
        del found
        mark, band = band & COMMON, band & (COMMON - 1)
        sig = low.astype(np.uint64) << np.uint64(8) | band
        order = np.lexsort((h1, sig))
        sig, h1, band, mark = sig[order], h1[order], band[order], mark[order]
        stands, its = sig[mark > 0], h1[mark > 0]  # tasks' centres of what they have found common
        first = _runs(sig, h1)
        sig, h1, band = sig[first], h1[first], band[first]
        first = _runs(sig)
        size = np.diff(np.append(first, len(sig)))
        common = np.repeat((size > few) | np.isin(sig[first], stands), size)
        out = _to_centres(sig[common], h1[common], band[common]) if common.any() else []
        if len(stands):
            (a, b), _ = counted(its, h1[first][np.searchsorted(sig[first], stands)])
            out.append(_rows(BRIDGE, a, b, np.zeros(len(a))))
        rest = np.repeat(size > 1, size) & ~common
        sig, h1, band = sig[rest], h1[rest], band[rest]
        a, b = [], []
        for d in range(1, few):
            same = np.flatnonzero(sig[d:] == sig[:-d]) if len(sig) > d else np.zeros(0, np.int64)
            if not len(same):
                break
            a.append(in_band(h1[same], band[same]))
            b.append(in_band(h1[same + d], band[same]))
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            (a, b), n = counted(np.minimum(a, b), np.maximum(a, b))
            out.append(_rows(PAIR, a, b, n))
        give_back()
        return pa.concat_tables([through.cast(pa.table(_rows(0, *[np.zeros(0)] * 3)).schema), *map(pa.table, out)])

    return sent.groupBy("bucket").applyInArrow(run, _OUT)


def _sets(members: DataFrame, docs: DataFrame, words: int, folder: str) -> DataFrame:
    """``members`` (``rep``, ``id``, ``cluster``, ``n``, ``total``) with ``items``, made again from the texts of these only.

    A row that occurs twice gives two equal ones; a document's other texts, of other sets, give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = texts_of(batch), batch.column(1).to_numpy().view(np.uint64)
            for i in range(0, len(texts), 256):
                made = [shingles(t, words) for t in texts[i : i + 256]]
                own = pa.array([class_of(s) == h1 for s, h1 in zip(made, ids[i : i + 256].tolist(), strict=True)], pa.bool_())
                part = batch.slice(i, len(made))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([s.view(np.int64) for s in made], pa.list_(pa.int64()))], names=[*part.schema.names[1:], "items"]).filter(own)
        give_back()

    met = docs.join(F.broadcast(members) if members.count() <= MOST_BROADCAST_IDS else members, docs["doc_id"] == members["rep"])
    return scratch.written(met.select("text", "id", "cluster", "n", "total").mapInArrow(run, "id long, cluster long, n long, total long, items array<long>"), "sets", folder)


def link(ids: np.ndarray, labels: np.ndarray, items: np.ndarray, sizes: np.ndarray, numerator: int, denominator: int, asked: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the components of some sets, given the labels that the sets have: exact.

    The sets in ``asked`` (by default all outside the largest component, until none is left) are compared in turn with
    all sets of other labels that share one of their rarest shingles: of n shingles a partner must share one of the
    n - ceil(t n) + 1 rarest, and has it among its own rarest.
    """
    n = len(ids)
    _, named, often = np.unique(items, return_inverse=True, return_counts=True)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(n), sizes)
    order = np.lexsort((named, often[named], owner))  # each set's shingles, rarest first
    named = named[order]
    ahead = sizes + 1 - -(-numerator * sizes // denominator)
    front = np.arange(len(named)) - np.repeat(ends[:-1], sizes) < np.repeat(ahead, sizes)
    by = np.argsort(named[front], kind="stable")
    holders, start = owner[front][by], np.concatenate(([0], np.cumsum(np.bincount(named[front], minlength=len(often)))))
    label = np.unique(labels, return_inverse=True)[1]
    held, links = np.zeros(len(often), bool), []
    waiting, largest = (np.arange(n), int(np.bincount(label).argmax())) if asked is None else (np.flatnonzero(asked), -1)
    turns, done = waiting.tolist(), np.zeros(n, bool)
    while turns:
        x = turns.pop()
        if label[x] == largest:
            continue
        done[x] = True
        lists = [holders[start[k] : start[k + 1]] for k in named[ends[x] : ends[x] + ahead[x]]]
        near = np.unique(np.concatenate(lists))
        near = near[(label[near] != label[x]) & (denominator * sizes[near] >= numerator * sizes[x]) & (denominator * sizes[x] >= numerator * sizes[near])]
        if not len(near):
            continue
        own = named[ends[x] : ends[x + 1]]
        held[own] = True
        counts = sizes[near]
        at = np.cumsum(counts) - counts
        every = np.arange(counts.sum()) + np.repeat(ends[near] - at, counts)
        both = np.add.reduceat(held[named[every]].astype(np.int64), at)
        held[own] = False
        similar = near[denominator * both >= numerator * (sizes[x] + counts - both)]
        if len(similar):
            parts, at = np.unique(label[similar], return_index=True)
            links += [(int(ids[x]), int(ids[y])) for y in similar[at]]
            label[np.isin(label, parts)] = label[x]
            if asked is None:
                now = int(np.bincount(label).argmax())
                if now != largest:  # those that were left out as members of another component have their turn
                    turns, largest = np.flatnonzero(~done).tolist(), now
    return links


def _table(links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels, items and sizes of the sets, each id once."""
    ids, first = np.unique(table.column("id").to_numpy(), return_index=True)
    if len(ids) < table.num_rows:
        table = table.take(pa.array(first))
    lists = table.column("items").combine_chunks()
    return table.column("id").to_numpy(), table.column("label").to_numpy(), lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64)


def _linked_clusters(table: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Links within clusters of bounded size, many in a task: ``bin``, ``cluster``, ``id``, ``items``."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("cluster")
        cluster = rows.column("cluster").to_numpy()
        first, links = _runs(cluster), []
        for a, b in zip(first, [*first[1:], len(cluster)], strict=True):
            ids, _, items, sizes = _arrays(rows.slice(a, b - a))
            links += link(ids, ids, items, sizes, numerator, denominator)
        give_back()
        return _table(links)

    return table.select("bin", "cluster", "id", F.col("id").alias("label"), "items").groupBy("bin").applyInArrow(run, "a long, b long")


def _linked_blocks(asked: DataFrame, all_sets: DataFrame, most_items: int, numerator: int, denominator: int) -> DataFrame:
    """Links between ``asked`` sets and all sets of their clusters with other labels, in blocks against shares.

    Both: ``cluster``, ``id``, ``label``, ``n``, ``items``. Blocks and shares hold about ``most_items`` shingles each.
    """

    def parts(table: DataFrame, name: str) -> DataFrame:
        return table.groupBy("cluster").agg(F.ceil(F.sum("n") / most_items).cast("int").alias(name))

    many, wide = parts(asked, "blocks"), parts(all_sets, "shares")
    left = asked.join(wide, "cluster").join(many, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    right = all_sets.join(many, "cluster").join(wide, "cluster").withColumn("share", F.pmod(F.xxhash64("id", F.lit(1)), F.col("shares")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    kept = ["cluster", "block", "share", "id", "label", "items"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table([])
        right = right.rename_columns(kept)
        right = right.filter(pa.compute.invert(pa.compute.is_in(right.column("id"), left.column("id").combine_chunks())))
        ids, labels, items, sizes = (np.concatenate(x) for x in zip(_arrays(left), _arrays(right), strict=True))
        links = link(ids, labels, items, sizes, numerator, denominator, np.isin(ids, left.column("id").to_numpy()))
        give_back()
        return _table(links)

    left, right = left.select(kept).toDF(*kept), right.select(kept).toDF(*[f"o_{c}" for c in kept])
    return left.groupBy(kept[:3]).cogroup(right.groupBy(right.columns[:3])).applyInArrow(run, "a long, b long")


def _recut(large: DataFrame, numerator: int, denominator: int, folder: str) -> DataFrame:
    """Clusters beyond the bound (``id``, ``n``, ``items``) cut anew: ``id`` and ``cluster``.

    Over all these sets the shingles are counted, and of each set's n shingles the n - ceil(t n) + 1 rarest stand for it:
    similar sets have one of them in common. Passages that many sets share are not among a set's rarest, so what hangs
    together then is near copies. A shingle's holders meet at the smallest one.
    """
    flat = scratch.written(large.select("id", "n", F.explode("items").alias("item")), "items", folder)
    # A table of its own, so that Spark can split a shingle that very many sets have in the join.
    often = scratch.written(flat.groupBy("item").agg(F.count("*").alias("often"), F.min("id").alias("centre")).where("often > 1"), "often", folder)
    ahead = F.col("n") + 1 - F.ceil(F.col("n") * numerator / denominator)
    # Shingles that no other set has come first; they join nothing, so only their number matters.
    held = flat.join(often, "item").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("often", "item", "centre"))).alias("x"))
    front = F.slice("x", F.lit(1), F.greatest(ahead - (F.col("n") - F.size("x")), F.lit(0)).cast("int"))
    spokes = held.select("id", F.explode(F.array_distinct(F.transform(front, lambda x: x["centre"]))).alias("centre"))
    return connected(spokes.select(F.col("id").alias("a"), F.xxhash64(F.lit("centre"), "centre").alias("b")), folder).select("id", F.col("label").alias("cluster"))


def _sized(members: DataFrame, folder: str) -> DataFrame:
    """``members`` (``cluster``, ``n`` and more) of clusters with several sets, with ``total``, the shingles of the cluster."""
    totals = members.groupBy("cluster").agg(F.sum("n").alias("total"), F.count("*").alias("sets")).where("sets > 1").select("cluster", "total")
    return scratch.written(members.join(totals, "cluster"), "clusters", folder)


def _linked_small(sets: DataFrame, most_items: int, numerator: int, denominator: int, folder: str) -> DataFrame:
    """Links within the clusters of up to ``most_items`` shingles: ``cluster``, ``id``, ``n``, ``total``, ``items``."""
    small = sets.where(F.col("total") <= most_items)
    bins = 4 * int((small.agg(F.sum("n")).first()[0] or 0) // most_items) + 4
    small = small.withColumn("bin", F.pmod(F.xxhash64("cluster"), F.lit(bins)).cast("int"))
    return scratch.written(_linked_clusters(small, numerator, denominator), "edges", folder)


def _linked_large(members: DataFrame, most_items: int, numerator: int, denominator: int, folder: str) -> DataFrame:
    """Links within clusters beyond ``most_items``: ``cluster``, ``id``, ``n``, ``items``."""
    edges: DataFrame | None = None
    for turn in range(len(HUBS) + 1):
        sets = members.withColumn("label", F.col("id"))
        if edges is not None:
            labels = connected(edges, folder)
            sets = members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        by_label = sets.groupBy("cluster", "label").agg(F.sum("n").alias("n"), F.count("*").alias("sets"))
        largest = by_label.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.sum("n").alias("all"), F.max("n").alias("most"))
        left = largest.where("all > most")
        if left.isEmpty():
            break
        rest = sets.join(left, "cluster").where("label <> largest")
        if turn < len(HUBS):
            place = F.row_number().over(Window.partitionBy("cluster").orderBy("id"))
            chosen = rest.select("cluster", "id").withColumn("place", place).where(F.col("place") <= HUBS[turn]).select("id")
            asked = sets.join(chosen, "id")
        else:
            asked = rest.select(sets.columns)
        found = scratch.written(_linked_blocks(asked, sets.join(left.select("cluster"), "cluster", "left_semi"), most_items, numerator, denominator), "links", folder)
        edges = found if edges is None else edges.union(found)
    return edges if edges is not None else members.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false")


def jaccard_join(docs: DataFrame, words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, id_col: str = "doc_id", text_col: str = "text", few: int = FEW, most_items: int = CLUSTER_ITEMS) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Two documents are linked when ``denominator`` times their common shingles are at least ``numerator`` times the union.
    """
    spark = docs.sparkSession
    folder, kept = scratch.new_path(spark, "jaccard"), scratch.new_path(spark, "jaccard-result")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(total * ROWS_A_BYTE / BUCKET_ROWS) + 6
    found = scratch.written(_bucket_pass(_map_pass(docs, buckets, words, numerator, denominator, few), few), "buckets", kept)
    sets = found.where(F.col("kind") == SET).select("doc_id", F.col("a").alias("h1"), "n", "bands")

    # One row for each class of equal sets: its smallest document, and by band what it keeps without common signatures.
    classes = scratch.written(sets.where("n > 0 and doc_id is not null").groupBy("h1").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes", folder)
    common = found.where(F.col("kind") == COUNT).groupBy("a").agg(F.sum("n").alias("common"))
    by_band = classes.select("h1", "n", F.explode("bands").alias("x")).select(key_of(F.col("h1"), F.col("x.j")).alias("key"), "h1", "n", F.col("x.sound").alias("sound"), F.col("x.spoilt").alias("spoilt"))
    by_band = by_band.join(common, F.col("key") == F.col("a"), "left").select("key", "h1", "n", (F.col("sound") - F.col("spoilt") - F.coalesce("common", F.lit(0))).alias("least"))
    by_band = scratch.written(by_band, "bands", folder)

    # Pairs are dealt by their first class once: counted there, and left out there if they agree too seldom for it.
    info = lambda p: by_band.select(*[F.col(c).alias(f"{p}_{c}") for c in ("key", "h1", "n", "least")])
    pairs = found.where(F.col("kind") == PAIR).select("a", "b", "n").repartition("a").groupBy("a", "b").agg(F.sum("n").alias("agree"))
    pairs = pairs.join(info("l"), F.col("a") == F.col("l_key")).where(F.col("agree") >= F.col("l_least")).select("b", "agree", "l_h1", "l_n")
    pairs = pairs.join(info("r"), F.col("b") == F.col("r_key")).where(F.col("agree") >= F.col("r_least"))
    sizes = (F.col("l_n") * denominator >= F.col("r_n") * numerator) & (F.col("r_n") * denominator >= F.col("l_n") * numerator)
    pairs = pairs.where(sizes).select(F.col("l_h1").alias("a"), F.col("r_h1").alias("b"))

    # Sets that common signatures leave too few others: their spokes to the centres of those.
    unsafe = by_band.where("least <= 0").select("key", "h1")
    centre = lambda c: F.xxhash64(F.lit("centre"), c)
    spokes = found.where(F.col("kind") == SPOKE).select(F.col("a").alias("of"), "b").join(unsafe, F.col("of") == F.col("key")).select(F.col("h1").alias("a"), centre("b").alias("b"))
    bridges = found.where(F.col("kind") == BRIDGE).where("a <> b").select(centre("a").alias("a"), centre("b").alias("b"))
    graph = scratch.written(pairs.union(spokes).union(bridges).distinct(), "graph", folder)
    clusters = connected(graph, folder).select("id", F.col("label").alias("cluster"))
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
    texts = sets.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("h1").alias("a"), F.max("h1").alias("last")).where("a < last")
    more = sets.where("n > 0").join(texts.select("doc_id", "a"), "doc_id").select("a", F.col("h1").alias("b"))
    labels = connected(edges.union(more), folder)
    several = classes.join(labels, classes["h1"] == labels["id"], "left").select("h1", "rep", "last", "label").where("label is not null or rep < last")
    roots = several.where("label is not null").groupBy("label").agg(F.min("rep").alias("root"))
    linked = several.join(roots, "label", "left").select(F.col("h1").alias("of"), F.coalesce("root", "rep").alias("root"))
    linked = scratch.written(linked, "roots", kept)
    scratch.remove(spark, folder)
    out = sets.join(linked, sets["h1"] == linked["of"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))
