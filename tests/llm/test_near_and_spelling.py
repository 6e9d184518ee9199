"""b-bit MinHash, whitening and spelling variants against brute force, and on odd rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bbit_minhash, queries, spelling, whitening
from millrace.llm.jaccard_join import shingles

DATA = "/root/testdata/sf0.001"
LONG = ("Lorem ipsum dolor " * 4000).strip()
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, LONG), (5, "same text here for all\nx"), (5, "same text here for all\nx"),
    (6, "Same text here for ALL \nx"), (7, "other"), (8, "ü漢字 😀\x00 mixed"), (8, "two texts under one id"), (9, "Two texts under one id"), (None, "no id at all here"),
]
CLASHES = ["n", "h1", "sig", "key", "word", "form", "root", "id", "x", "v", "pos", "rep", "component"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in CLASHES])


def shingle_set(text, k=2):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute_near(rows, numerator=80):
    """Components by comparing all pairs of different sets."""
    sets = [(d, shingle_set(t)) for d, t in rows]
    classes = sorted({s for _, s in sets if s}, key=len)
    over = list(range(len(classes)))

    def root(x):
        while over[x] != x:
            x = over[x]
        return x

    for i, a in enumerate(classes):
        for j in range(i + 1, len(classes)):
            b = classes[j]
            if 100 * len(a) < numerator * len(b):
                break
            both = len(a & b)
            if 100 * both >= numerator * (len(a) + len(b) - both):
                over[root(j)] = root(i)
    place, first = {s: i for i, s in enumerate(classes)}, {}
    for d, s in sets:
        if s:
            r = root(place[s])
            first[r] = min(first.get(r, d), d)
    return {d: (len(s), first[root(place[s])] if s else d) for d, s in sets}


def test_near_duplicates_equal_brute_force_on_the_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in queries.op11_bbit_minhash(spark, DATA).collect()}
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == brute_near([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert all(r["kept"] == (r["component_id"] == d) for d, r in got.items())


@pytest.mark.parametrize("options", [{}, {"few": 2}, {"few": 2, "most_items": 1}, {"few": 3, "most_items": 900}])
def test_near_duplicates_equal_brute_force(spark, options):
    random.seed(5)
    vocabulary, rows, n = [f"w{i}" for i in range(3000)], [], 0
    for _ in range(14):
        base = [random.choice(vocabulary) for _ in range(random.choice([1, 2, 3, 6, 20, 60, 200]))]
        for _ in range(random.choice([1, 3, 25])):
            p = random.choice([0, 0.01, 0.05, 0.1])
            rows.append((n := n + 1, " ".join(w if random.random() > p else random.choice(vocabulary) for w in base)))
    passage = " ".join(random.choice(vocabulary) for _ in range(60))
    for k in (0, 2, 5, 10, 15, 20, 40, 100) * 3:
        rows.append((n := n + 1, " ".join(random.choice(vocabulary) for _ in range(k)) + " " + passage))
    rows += [(n + 1, None), (n + 2, ""), (n + 3, "A b"), (n + 4, "a  B"), (n + 5, "a")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in bbit_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}
    assert got == brute_near(rows)


def test_near_duplicates_odd_rows(odd):
    got = bbit_minhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append((r["component_id"], r["kept"]))
    assert by_id[5] == [(5, True)] * 2 and by_id[6] == [(5, False)] and by_id[None] == [(None, True)]
    assert by_id[8] == [(8, True)] * 2 and by_id[9] == [(8, False)] and by_id[1] == [(1, True)]
    assert bbit_minhash.near_duplicates(odd.where("false")).count() == 0


def test_estimate_is_near_the_similarity(spark):
    random.seed(3)
    rows = []
    for share in (0.0, 0.3, 0.6, 0.8, 0.95):
        a = [f"w{random.randrange(10**6)}" for _ in range(800)]
        b = [w if random.random() < share else f"v{random.randrange(10**6)}" for w in a]
        x, y = shingles(" ".join(a), 1), shingles(" ".join(b), 1)
        truth = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        rows.append((truth, *[bbit_minhash.packed(bbit_minhash.minima(s)).view(np.int64).tolist() for s in (x, y)]))
    df = spark.createDataFrame(rows, "truth double, a array<long>, b array<long>")
    assert all(abs(r["truth"] - r["e"]) < 0.15 for r in df.select("truth", bbit_minhash.similarity(F.col("a"), F.col("b")).alias("e")).collect())
    assert 0.6 < bbit_minhash.least_estimate() < 0.7


def vectors_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit("x").alias(c) for c in CLASHES])


def check_whitening(rows, got, width):
    """Against numpy's eigenvectors of the whole matrix."""
    good = [(i, [*v, *[0.0] * (width - len(v))]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(256 * np.array([v for _, v in good])).astype(np.int64)
    own = np.unique(x, axis=0)
    n, s = len(own), own.sum(0)
    y = own - s / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(4, int((e > 1e-10 * np.trace(v)).sum()))
    assert len(got) == k * len(good) and {r["component"] for r in got} == set(range(1, k + 1))
    for c in range(k):
        z = (x - s / n) @ u[:, c] / np.sqrt(e[c])
        want = sorted((i, abs(float(w)), int(d)) for (i, _), w, d in zip(good, z, ((n * x - s) ** 2).sum(1), strict=True))
        have = sorted((r["vec_id"], abs(r["whitened"]), r["deviation"]) for r in got if r["component"] == c + 1)
        assert [(i, d) for i, _, d in have] == [(i, d) for i, _, d in want]
        assert np.allclose([w for _, w, _ in have], [w for _, w, _ in want], atol=1e-9)
        signs = {r["vec_id"]: r["whitened"] for r in got if r["component"] == c + 1}
        assert abs(abs(sum(signs[i] * w for (i, _), w in zip(good, z, strict=True))) - sum(w * w for w in z)) < 1e-6 * len(good)
        assert all(abs(r["explained"] - e[c] / np.trace(v)) < 1e-12 and r["n"] == n and r["identity_error"] < 1e-9 for r in got if r["component"] == c + 1)


def test_whitening_equals_the_whole_eigenproblem(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    check_whitening(rows, queries.op12_whitening(spark, DATA).collect(), 64)


@pytest.mark.parametrize("width, count", [(1, 9), (2, 30), (3, 3), (90, 300), (150, 60)])
def test_whitening_of_other_shapes(spark, width, count):
    rng = np.random.default_rng(width)
    rows = [(i, (rng.standard_normal(width) * (1 + np.arange(width) % 3)).tolist()) for i in range(count)]
    check_whitening(rows, whitening.whitened(vectors_table(spark, rows)).collect(), width)


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(40)]
    rows += [(100, rows[0][1])] * 30 + [(101, [0.25, 0.5])]
    odd = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5), (204, [])]
    table = vectors_table(spark, rows + odd)
    got = whitening.whitened(table).collect()
    assert len(got) == 4 * len(rows) and {r["n"] for r in got} == {41}
    distinct = {(r["vec_id"], r["component"]): r["whitened"] for r in got}
    check_whitening([*rows[:40], rows[-1]], [r for r in got if r["vec_id"] != 100], 5)
    assert distinct[100, 1] == distinct[0, 1]
    assert whitening.whitened(table.where("false")).count() == 0
    assert whitening.whitened(vectors_table(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    assert whitening.deviations(np.array([[1 << 40]]), 1 << 20, [0]) == [None]


def brute_words(rows, shortest=7):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_apart(a, b):
    """By alignment from both ends, not by generated edits."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute_variants(rows):
    words = brute_words(rows)
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = {}
    for w, n in words.items():
        end = w
        while form[end]:
            end = form[end]
        out[w] = (form[w], end, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants_equal_brute_force_on_the_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert found(queries.op13_spelling(spark, DATA)) == brute_variants(rows)


@pytest.mark.parametrize("most_bytes", [spelling.MOST_FILTER_BYTES, 64 * 3])
def test_variants_equal_brute_force(spark, most_bytes):
    random.seed(2)
    rows, words = [], ["millrace", "aaaaaaaa", "spelling", "größere", "éèêëàâä", "×÷×÷×÷×", "zzzzzzz"]
    for k, w in enumerate(words):
        text = [w] * 300
        for _ in range(60):
            v, i, c = random.choice([w, w[:-1] + "q"]), random.randrange(len(w)), random.choice("aezß÷")
            text += [random.choice([v[:i] + v[i + 1 :], v[:i] + c + v[i:], v[:i] + c + v[i + 1 :]])] * random.choice([1, 2, 25])
        rows.append((k, " ".join(text)))
    got = found(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), most_bytes=most_bytes))
    want = brute_variants(rows)
    assert got == want and any(x[0] and x[0] != x[1] for x in want.values())


def test_variants_odd_rows(odd):
    assert found(spelling.variants(odd)) == brute_variants(ODD)
    long = odd.sparkSession.createDataFrame([(1, "a" * 70_000 + " " + "a" * 70_000)], "doc_id long, text string")
    assert found(spelling.variants(long)) == brute_variants([(1, "a" * 70_000 + " " + "a" * 70_000)])
    assert spelling.variants(odd.where("false")).count() == 0
