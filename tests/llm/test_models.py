"""The trained operators against plain Python: log-count ratios, context trees, expectation-maximisation, pattern scores."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import language_id, pii, quality, toxicity

random.seed(21)
WORDS = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 7))) for _ in range(60)]


def text(n, words=WORDS):
    return " ".join(random.choice(words) for _ in range(n))


def plain_buckets(data):
    """The n-gram buckets of a text, one n-gram at a time."""
    low = [c + 32 if 65 <= c <= 90 else 32 if c in (9, 10, 11, 12, 13) else c for c in data.encode()]
    out = set()
    for size in toxicity.SIZES:
        for i in range(len(low) - size + 1):
            h = size * 0x9E3779B1 & 0xFFFFFFFF
            for c in low[i : i + size]:
                h = (h ^ c) * 0x85EBCA6B & 0xFFFFFFFF
                h ^= h >> 15
            out.add(h >> (32 - toxicity.BITS))
    return out


def test_toxicity_equals_plain_python(spark):
    texts = [text(30) + (" you vile moron" if k % 4 == 0 else "") + ("\tÜber NEWLINE\n" if k % 3 == 0 else "") for k in range(120)] + ["", "a", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(120)] + [(5, 1), (5, 0), (7, None), (8, 9)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    labels = {k: int(k % 4 == 0) for k in range(120)} | {5: 1}
    toxic = sum(labels.values())
    p, q = Counter(), Counter()
    for k, label in labels.items():
        (p if label else q).update(plain_buckets(texts[k]))
    part = toxic / 120
    ratio = {b: math.log((p[b] + part) / (toxic + part)) - math.log((q[b] + 1 - part) / (120 - toxic + 1 - part)) for b in p | q if p[b] + q[b] >= toxicity.LEAST_DOCS}
    ratio = {b: r for b, r in ratio.items() if abs(r) >= toxicity.LEAST_RATIO}
    assert set(np.flatnonzero(model.weights)) <= set(ratio) and len(ratio) > 20
    # The weights are those of a fit on the ratios: at its minimum the gradient of the penalised loss is small.
    w = {b: float(model.weights[b]) / r for b, r in ratio.items()}
    z = {k: model.intercept + sum(w[b] * ratio[b] for b in plain_buckets(texts[k]) if b in ratio) for k in labels}
    error = {k: 1 / (1 + math.exp(-z[k])) - labels[k] for k in labels}
    first = {b: sum(error[k] * ratio[b] for k in labels if b in plain_buckets(texts[k])) / 120 for b in list(ratio)[:40]}
    assert max(map(abs, first.values())) < 0.02
    got = {r["doc_id"]: r["score"] for r in toxicity.score_table(docs, model).collect()}
    for k, t in enumerate(texts):
        own = model.intercept + sum(float(model.weights[b]) for b in plain_buckets(t or ""))
        assert got[k] == pytest.approx(1 / (1 + math.exp(-own)), abs=1e-5)


def plain_bits(texts_by_lang, depth, data):
    """Code length of a text in each language's tree, byte by byte."""
    used = {b for texts in texts_by_lang.values() for t in texts for b in t}
    width = max(1, len(used).bit_length())
    out = {}
    for lang, texts in texts_by_lang.items():
        counts = defaultdict(Counter)
        for t in texts:
            for i in range(len(t)):
                for size in range(depth + 1):
                    if i >= size:
                        counts[t[i - size : i]][t[i]] += 1
        total, now = 0.0, b"\n" * depth + data
        for i in range(depth, len(now)):
            bits = 0.0
            for size in range(depth, -1, -1):
                own = counts.get(now[i - size : i])
                if not own:
                    continue
                n, kinds = sum(own.values()), len(own)
                if now[i] in own:
                    bits -= math.log2(own[now[i]] / (n + kinds))
                    break
                bits -= math.log2(kinds / (n + kinds))
            else:
                bits += 8
            total += bits
        out[lang] = total
    assert width <= 8
    return out


@pytest.mark.parametrize("depth", [2, 3])
def test_code_lengths_equal_plain_python(spark, depth):
    letters = {"aa": "abcdef ", "bb": "abcxyz ", "cc": "uvwxyzé "}
    made = {lang: ["".join(random.choice(own) for _ in range(random.randint(0, 50))) + "\n" for _ in range(12)] for lang, own in letters.items()}
    rows = [(k, lang, t) for k, (lang, t) in enumerate((lang, t) for lang, texts in made.items() for t in texts)]
    counts = language_id.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string"), depth=depth).toPandas()
    langs = sorted(letters)
    parts = [[(f["gram"].to_numpy(np.int64), f["n"].to_numpy(np.int64)) for size in range(1, depth + 2) for f in [counts[(counts["lang"] == lang) & (counts["size"] == size)].sort_values("gram")]] for lang in langs]
    coder = language_id.Coder(langs, parts, depth)
    tries = ["abc abc", "xyz", "qé", "", "zzzzz\nabc fed", "né" * 9]
    joined = b"".join(t.encode() for t in tries)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in tries])))
    bits = coder.costs(np.frombuffer(joined, np.uint8), offsets)
    for k, t in enumerate(tries):
        want = plain_bits({lang: [x.encode() for x in made[lang]] for lang in langs}, depth, t.encode())
        assert bits[k].tolist() == pytest.approx([want[lang] for lang in langs], rel=1e-4, abs=1e-3)


def test_expectation_maximisation_finds_planted_accuracies():
    rng = np.random.default_rng(4)
    m = len(quality.LABELLERS)
    right, cast = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.9, 0.7, 0.85, 0.8]), np.array([0.9, 0.8, 0.9, 0.7, 0.9, 0.6, 0.9, 0.8, 0.7])
    truth = rng.random(40_000) < 0.7
    agree, vote = rng.random((len(truth), m)) < right, rng.random((len(truth), m)) < cast
    digits = np.where(vote, np.where(agree == truth[:, None], 2, 1), 0)
    names, n = np.unique((digits * 3 ** np.arange(m)).sum(1), return_counts=True)
    posterior, table, share = quality.expectation_maximisation(dict(zip(names.tolist(), n.tolist(), strict=True)))
    assert share == pytest.approx(0.7, abs=0.02)
    for k in range(m):
        assert table[1, k, 2] / (table[1, k, 1] + table[1, k, 2]) == pytest.approx(right[k], abs=0.03)
        assert table[0, k, 1] / (table[0, k, 1] + table[0, k, 2]) == pytest.approx(right[k], abs=0.03)
    # The fixed point itself: the posterior of each pattern by Bayes' rule on the tables found.
    for name in names[:200].tolist():
        odds = math.log(share / (1 - share)) + sum(math.log(table[1, k, v] / table[0, k, v]) for k in range(m) for v in [name // 3**k % 3])
        assert posterior[name] == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-3)


def test_quality_figures_equal_plain_python():
    for t in [text(40), text(3) + "!!! ||| $$", "A B C 1 2 3", "é" * 50, text(10) * 6, "x", " \n", "on on on  the the\nthe end, on on.", "a# b$ c, d. e " * 9]:
        data, marks = t.encode(), "".join(chr(c) for c in [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)] if chr(c) not in ".,")
        n = len(data)
        letters, capitals = len(re.findall("[a-z]", t)), len(re.findall("[A-Z]", t))
        windows = [data[i : i + 16] for i in range(n - 15)]
        repeats = 1 - len(set(windows)) / len(windows) if n >= 64 else 0.0
        want = [sum(t.count(c) for c in marks) / n, capitals / max(1, letters + capitals), len(re.findall("[0-9]", t)) / n, t.count("|") / n, t.count("!") / n, repeats]
        words = re.findall("[^ \t\n\v\f\r]+", t)
        want += [sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words)), sum(any(c in marks for c in w) for w in words) / max(1, len(words))]
        assert quality.figures(np.frombuffer(data, np.uint8))[:8].tolist() == pytest.approx(want)


def plain_bootstrap(graph):
    """The rounds over (found, kind, sort, pattern) rows, with dictionaries."""
    taken = {}
    while True:
        kind_of = {f: k for f, k, _, _ in graph if k} | taken
        holders = defaultdict(set)
        for f, _, s, p in graph:
            holders[s, p].add(f)
        kept = {}
        for key, own in holders.items():
            known = [kind_of[f] for f in own if f in kind_of]
            share = len(known) / len(own)
            if len(known) >= pii.MIN_SUPPORT and share >= pii.MIN_CONFIDENCE and share * math.log2(len(known)) >= pii.MIN_STRENGTH:
                kept[key] = share, Counter(known)
        new = {}
        for f in {f for f, _, _, _ in graph} - set(kind_of):
            best, weight = {}, Counter()
            for g, _, s, p in graph:
                if g == f and (s, p) in kept:
                    best[s] = max(best.get(s, 0), kept[s, p][0])
                    for k, n in kept[s, p][1].items():
                        weight[k] += kept[s, p][0] * n
            if len(best) >= 2 and 1 - math.prod(1.000001 - c for c in best.values()) >= pii.MIN_INSTANCE:
                new[f] = max(pii.KINDS, key=lambda k: (round(weight[k], 9), -pii.KINDS.index(k)))
        if not new:
            return taken
        taken |= new


def test_pattern_scores_equal_plain_python(spark):
    spots = ["card {} ok", "my card {} now", "call {} now", "token = {} x", "the {} of", "no context here {}"]
    makers = [lambda: "4111111111111111", lambda: "".join(random.choice("0123456789") for _ in range(16)), lambda: f"+1 555 000 {random.randint(1000, 9999)}", lambda: f"{random.randint(10, 99)}.1.2.{random.randint(1, 254)}", lambda: "".join(random.choice("0123456789abcdef") for _ in range(20))]
    texts = [text(4) + " " + random.choice(spots).format(random.choice(makers)()) + " " + text(3) for _ in range(220)]
    seeds = pii.seed_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    graph = [tuple(r) for r in pii.pattern_graph(seeds).collect()]
    want = plain_bootstrap(graph)
    assert {r["found"]: r["kind"] for r in pii.bootstrap(seeds).collect()} == want and len(want) > 5


def test_patterns_of_an_identifier(spark):
    df = spark.createDataFrame([("ab12cd34", "Say the Token = \"", "\" then go"), ("4111111111111111", "", "."), ("AB-1234", "x y (", " z")], "found string, before string, after string")
    found = [{(p["sort"], p["pattern"]) for p in r["p"]} for r in df.select(pii.patterns(F.col("found"), F.col("before"), F.col("after")).alias("p")).collect()]
    assert found[0] == {("before", "token"), ("two before", "the token"), ("after", "then"), ("both", "token _ then"), ("joint", 'token = "'), ("shape", "hex 8")}
    assert found[1] == {("shape", "916")}
    assert found[2] == {("before", "y"), ("two before", "x y"), ("after", "z"), ("both", "y _ z"), ("joint", "y ("), ("shape", "A2-94")}


def test_discovery_adds_spans_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    base, spans = pii.find(docs).agg(F.sum(F.size("base")), F.sum(F.size("spans"))).first()
    assert spans > base > 0
